"""Byte-pair encoding over whole batches of texts with an occurrence index of pairs.

A batch's texts are cut into chunks (runs without white space, with the blank
before them where the vocabulary is byte-level); each distinct chunk is encoded
once. All distinct pieces of a batch lie in one symbol array. For every rank
the positions at which its pair stands are listed, ranks are applied in
ascending order, and each merge updates the lists of the pairs to its left and
right. That order is exact because a pair that contains a merged symbol always
has a higher rank than the merge that made the symbol, which is checked when the
vocabulary is read. Vocabulary files of another normalizer or pre-tokenizer than the two
supported ones are refused.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from textquarry.llm.spans import BLANK, NameIndex, names, ragged, utf8, words

#: Unicode White_Space (fixed values).
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space beyond ASCII in UTF-8.
RARE = [c.encode() for c in map(chr, range(128, 0x3001)) if re.match(f"[{WS}]", c)]
NONE = np.int32(2**31 - 1)
#: Normalizer and pre-tokenizer of the two forms of vocabulary that are supported (fixed values).
WORD_FORM = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
    ],
)
BYTE_FORM = (None, [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}])
#: Ranks whose positions are gathered together.
SPAN = 512
#: Distinct chunks, and bytes of long ones, that a worker remembers between batches.
REMEMBERED, REMEMBERED_BYTES = 250_000, 8 << 20
#: Chunks that a worker keeps between tasks.
RESTING = 60_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PairTable:
    """Open-addressing table from pairs of ids to ranks, probed for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        n = len(left)
        self.bits = max(4, int(np.ceil(np.log2(max(1, 4 * n)))))
        size = 1 << self.bits
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        keys = self.key(left, right)
        todo = np.arange(n)
        slots = self.slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            at = slots[todo]
            free = self.keys[at] < 0
            first = np.unique(at[free], return_index=True)[1]
            placed = todo[free][first]
            self.keys[slots[placed]] = keys[placed]
            self.ranks[slots[placed]] = placed
            todo = np.setdiff1d(todo, placed)
            slots[todo] = (slots[todo] + 1) & self.mask

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self.key(left, right)
        slots = self.slot(keys)
        got = self.keys[slots]
        out = np.where(got == keys, self.ranks[slots], NONE)
        open_ = np.flatnonzero((got != keys) & (got >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & self.mask
            got = self.keys[slots[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out


class Bpe:
    """A vocabulary file in the JSON form of the tokenizers library, word-level (lower case, end-of-word suffix) or byte-level."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        form = (spec.get("normalizer"), _cutting(spec.get("pre_tokenizer")))
        options = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or options or form != (WORD_FORM if self.suffix else BYTE_FORM):
            raise ValueError(f"{path} is not of one of the two supported forms: {form}, {options}")
        self.word_level = bool(self.suffix)
        self.left = np.array([vocab[a] for a, _ in merges], np.int32)
        self.right = np.array([vocab[b] for _, b in merges], np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.pairs = PairTable(self.left, self.right)
        born = {int(m): r for r, m in enumerate(self.made)}
        if len(born) < len(merges) or any(max(born.get(int(a), -1), born.get(int(b), -1)) >= r for r, (a, b) in enumerate(zip(self.left, self.right))):
            raise ValueError("merges are not in the order in which their parts are made")
        letters = byte_letters()
        self.first = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + self.suffix] for x in letters], np.int32)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for t, i in chain(vocab.items(), self.special.items()):
            self.tokens[i] = t
        self.byte_of = {x: b for b, x in enumerate(letters)}
        self.token_bytes = None if self.word_level else [t.encode() if t in self.special else bytes(map(self.byte_of.__getitem__, t)) for t in self.tokens]
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        import regex

        solid = "[^" + WS + "\\p{L}\\p{N}]+"
        contracted = "'s|'t|'re|'ve|'m|'ll|'d|"
        #: A line feed stands between chunks; no other chunk than white space itself holds one.
        self.piece = regex.compile("\n|" + contracted + ("\\p{L}+|\\p{N}|" + solid if self.word_level else " ?\\p{L}+| ?\\p{N}+| ?" + solid)).findall
        self.chunk = re.compile(f"[^{WS}]+" if self.word_level else f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+").findall
        self.forget()

    def forget(self) -> None:
        self.index = NameIndex()
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each. Nulls count as empty."""
        raw, starts, ends = utf8(texts)
        if not self._plain(raw):
            return self._encode_slowly(raw, starts, ends)
        first, last, per = self._chunks(raw, starts, ends)
        ids, sizes = self._ids(raw, first, last)
        at = np.concatenate([[0], np.cumsum(sizes)])
        cuts = np.concatenate([[0], np.cumsum(per)])
        return ids, at[cuts[1:]] - at[cuts[:-1]]

    def _plain(self, raw: np.ndarray) -> bool:
        """No white space beyond ASCII and no special token."""
        data = memoryview(raw).tobytes() if len(raw) else b""
        return not any(x in data for x in RARE) and not any(x.encode() in data for x in self.special)

    def _encode_slowly(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text by text; those with rare white space or special tokens are cut by regular expressions."""
        out, sizes = [], np.zeros(len(starts), np.int64)
        for i, (a, b) in enumerate(zip(starts, ends)):
            part = raw[a:b]
            if self._plain(part):
                ids, _ = self._ids(part, *self._chunks(part, np.array([0]), np.array([b - a]))[:2])
            else:
                text = part.tobytes().decode()
                found = [(k % 2, c) for k, x in enumerate(self.cut_special.split(text)) for c in ([x] if k % 2 else self.chunk(x))]
                own = [c for special, c in found if not special]
                data = list(map(str.encode, own))
                last = np.cumsum(np.fromiter(map(len, data), np.int64, len(own)))
                ids, n = self._ids(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], last[:-1]]) if len(own) else last, last, np.array([not c.strip() for c in own], bool))
                each = iter(np.split(ids, np.cumsum(n)[:-1]))
                ids = np.concatenate([np.zeros(0, np.int32), *(np.array([self.special[c]], np.int32) if special else next(each) for special, c in found)])
            out.append(ids)
            sizes[i] = len(ids)
        return np.concatenate([np.zeros(0, np.int32), *out]), sizes

    def _chunks(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, last, per = words(raw, starts, ends)
        if self.word_level or not len(raw):
            return first, last, per
        # Byte-level: a blank goes with the word after it; what is left of a run of white space is one chunk, but a last character that is no blank is one of its own.
        bounds = np.zeros(len(raw) + 1, bool)
        bounds[starts] = True
        bounds[last] = True
        joined = (first > 0) & ~bounds[first]
        joined[joined] = raw[first[joined] - 1] == 32
        bounds[first] |= ~joined
        inner = first[~np.isin(first, starts, assume_unique=False)] - 1
        bounds[inner] = True
        bounds[len(raw)] = True
        at = np.flatnonzero(bounds)
        return at[:-1], at[1:], np.searchsorted(at[:-1], ends) - np.searchsorted(at[:-1], starts)

    def _ids(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray, white: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks in a row, and the number of ids of each. A known chunk is found by all of its bytes."""
        if self.index.n > REMEMBERED or self.long_bytes > REMEMBERED_BYTES:
            self.forget()
        low, high = names(raw, first, last, long=self._numbers)
        at = self.index.find(low, high)
        if (fresh := np.flatnonzero(at < 0)).size:
            by = fresh[np.lexsort((fresh, high[fresh], low[fresh]))]
            order = np.sort(by[np.concatenate([[True], (low[by[1:]] != low[by[:-1]]) | (high[by[1:]] != high[by[:-1]])])])
            self.index.add(low[order], high[order])
            self._learn(raw, first[order], last[order], BLANK[raw[last[order] - 1]] if white is None else white[order])
            at[fresh] = self.index.find(low[fresh], high[fresh])
        return ragged(self.flat, self.starts[at], self.counts[at]), self.counts[at]

    def rest(self) -> None:
        """Forgets much that was learnt: between tasks a worker waits, and may go on to other work."""
        if self.index.n > RESTING:
            self.forget()

    def _numbers(self, spans: list[bytes]) -> list[int]:
        """A number for each long chunk, the same for equal ones."""
        known, before = self.long, len(self.long)
        out = [known.setdefault(x, len(known)) for x in spans]
        if len(known) > before:
            self.long_bytes = sum(map(len, known))
        return out

    def _learn(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray, blank: np.ndarray) -> None:
        """Encodes new chunks and remembers their ids."""
        sizes = last - first
        text = ragged(raw, first[~blank], sizes[~blank])
        text = np.insert(text, np.cumsum(sizes[~blank]), 10).tobytes().decode()
        if self.word_level and text.isascii():
            text = text.lower()
        elif self.word_level:  # letter by letter: a final sigma stays an ordinary one
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        numbers = _Numbers({"\n": 0})
        found = self.piece(text)
        at = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
        stops = np.flatnonzero(at == 0)
        per = np.diff(np.concatenate([[-1], stops])) - 1
        at = at[at > 0] - 1
        white = [raw[a:b].tobytes() for a, b in zip(first[blank], last[blank])]
        pieces = "\n".join(list(numbers)[1:]).encode()
        ids, n = self.merge(np.frombuffer(pieces + (b"\n" if pieces else b""), np.uint8), white)
        owned = np.zeros(len(first), np.int64)
        owned[~blank], owned[blank] = per, 1
        where = np.empty(int(owned.sum()), np.int64)
        of_blank = np.repeat(blank, owned)
        where[~of_blank], where[of_blank] = at, len(numbers) - 1 + np.arange(len(white))
        begin = np.cumsum(n) - n
        ends = np.concatenate([[0], np.cumsum(n[where])])
        cuts = np.concatenate([[0], np.cumsum(owned)])
        self.starts = np.concatenate([self.starts, ends[cuts[:-1]] + len(self.flat)])
        self.counts = np.concatenate([self.counts, ends[cuts[1:]] - ends[cuts[:-1]]])
        self.flat = np.concatenate([self.flat, ragged(ids, begin[where], n[where])])

    def merge(self, lines: np.ndarray, white: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in a row, and the number of ids of each: first those of lines (each ends with a line feed), then white."""
        stops = np.flatnonzero(lines == 10)
        sizes = np.concatenate([np.diff(np.concatenate([[-1], stops])) - 1, np.fromiter(map(len, white), np.int64, len(white))]).astype(np.int64)
        raw = np.concatenate([np.delete(lines, stops), np.frombuffer(b"".join(white), np.uint8)])
        n = len(raw)
        if not n:
            return np.zeros(0, np.int32), sizes
        ends = np.cumsum(sizes)
        symbol = self.first[raw]
        symbol[ends[sizes > 0] - 1] = self.last[raw[ends[sizes > 0] - 1]]
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends[sizes > 0] - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[(ends - sizes)[sizes > 0]] = -1
        rank = np.full(n, NONE, np.int32)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.pairs.rank(symbol[inner], symbol[inner + 1])
        alive = np.ones(n, bool)
        for low in range(0, len(self.made), SPAN):
            here = np.flatnonzero(rank < low + SPAN)
            if not len(here):
                continue
            by = np.argsort(rank[here], kind="stable")
            lists = {r: [x] for r, x in _groups(rank[here][by], here[by])}
            active = list(lists)
            while active:
                r = heapq.heappop(active)
                at = lists.pop(r)
                at = at[0] if len(at) == 1 else np.concatenate(at)
                at = np.sort(at[rank[at] == r])
                at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
                if not len(at):
                    continue
                if self.left[r] == self.right[r] and len(at) > 1:  # of overlapping pairs every second one merges
                    joins = np.concatenate([[False], after[at[:-1]] == at[1:]])
                    begin = np.maximum.accumulate(np.where(joins, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - begin) % 2 == 0]
                gone = after[at]
                symbol[at] = self.made[r]
                alive[gone] = False
                rank[gone] = NONE
                beyond = after[gone]
                after[at] = beyond
                has = beyond >= 0
                before[beyond[has]] = at[has]
                rank[at] = NONE
                previous = before[at]
                touched = np.concatenate([at[has], previous[previous >= 0]])
                if not len(touched):
                    continue
                new = self.pairs.rank(symbol[touched], symbol[after[touched]])
                rank[touched] = new
                near = np.flatnonzero(new < low + SPAN)
                for k in near if len(near) < 64 else ():
                    q = int(new[k])
                    if q not in lists:
                        lists[q] = []
                        heapq.heappush(active, q)
                    lists[q].append(touched[k : k + 1])
                if len(near) >= 64:
                    by = near[np.argsort(new[near], kind="stable")]
                    for q, x in _groups(new[by], touched[by]):
                        if q not in lists:
                            lists[q] = []
                            heapq.heappush(active, q)
                        lists[q].append(x)
        kept = np.concatenate([[0], np.cumsum(alive)])
        return symbol[alive], kept[ends] - kept[ends - sizes]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode with special tokens kept: byte-level tokens give their bytes back, others are joined by blanks."""
        if self.token_bytes is None:
            return " ".join(map(self.tokens.__getitem__, ids))
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class _Numbers(dict):
    """Numbers new keys in their order."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _groups(keys: np.ndarray, values: np.ndarray):
    """Pairs of a key and its values; keys are sorted."""
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return zip(keys[cut].tolist(), np.split(values, cut[1:]))


def _cutting(pre_tokenizer: dict | None) -> list[dict]:
    """The steps of a pre-tokenizer without what only concerns offsets."""
    steps = (pre_tokenizer or {}).get("pretokenizers") or [pre_tokenizer or {}]
    return [{k: v for k, v in x.items() if k != "trim_offsets"} for x in steps]


@lru_cache(4)
def load(path: str) -> Bpe:
    return Bpe(path)
