"""Hierarchical packing of token sequences into windows of several context sizes.

Every partition packs its own documents, so nothing is shuffled. Of a document,
full windows of the longest context go out at once; the rest is routed to the
shortest context size that holds it. Each tier is packed from its longest
pieces on; the gap that a piece leaves is filled with whole pieces of shorter
tiers, the longest that fits first, and at last by the head of a shorter piece,
whose tail is routed anew. So every window is full, except for one in each
partition that holds what is left. Windows of one tier are then dealt to
training steps that hold equally many tokens, snake-wise by attention cost (the
sum of squared piece lengths), so that steps cost about the same.

Null texts are empty; an empty text is one piece that holds the end id alone.
Repeated rows are packed like any others. An empty table gives no pieces.
Columns other than the two that are named are not looked at. A row's own id
lists are cut at will, but each id lies in one piece and pieces say where it
starts.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.llm.common import col, table
from textquarry.llm.tokens import encoded, word_vocabulary

#: Context sizes, longest first.
TIERS = (2048, 1024, 512, 256)
#: Windows of the longest context in a training step; shorter tiers take as many tokens.
STEP = 8
#: Sequences of a task are numbered from its partition's number times this.
PER_TASK = 1 << 40
#: Pieces that wait until they are packed together.
POOL = 4096

Piece = tuple[int, int, int]  # length, document, start


class Pool:
    """Waiting pieces of one tier in order of length."""

    def __init__(self):
        self.pieces: list[Piece] = []

    def put(self, piece: Piece) -> None:
        insort(self.pieces, piece)

    def longest(self, room: int) -> Piece | None:
        """Takes out the longest piece of at most room ids."""
        at = bisect_left(self.pieces, (room + 1, -1, -1))
        return self.pieces.pop(at - 1) if at else None


class Packer:
    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = sorted(tiers, reverse=True)
        self.pools = {t: Pool() for t in self.tiers}

    def route(self, piece: Piece) -> None:
        """To the shortest context that holds it."""
        self.pools[next(t for t in reversed(self.tiers) if t >= piece[0])].put(piece)

    def waiting(self) -> int:
        return sum(len(p.pieces) for p in self.pools.values())

    def fill(self, window: list[Piece], room: int, below: list[int]) -> int:
        """Fills room ids from the tiers below, longest first; what then is open stays open only if they are empty."""
        for t in below:
            while room and (piece := self.pools[t].longest(room)):
                window.append(piece)
                room -= piece[0]
        if room:
            for t in reversed(below):
                if self.pools[t].pieces:
                    n, doc, start = self.pools[t].pieces.pop()
                    window.append((room, doc, start))
                    self.route((n - room, doc, start + room))
                    return 0
        return room

    def pack(self) -> list[tuple[int, list[Piece]]]:
        """Full windows as tier and pieces; pieces that fill no window keep waiting."""
        out = []
        for i, t in enumerate(self.tiers):
            below = self.tiers[i:]
            while self.pools[t].pieces:
                piece = self.pools[t].pieces.pop()
                window = [piece]
                room = self.fill(window, t - piece[0], below)
                if room:
                    for x in window:
                        self.route(x)
                    break
                out.append((t, window))
        return out

    def rest(self) -> list[tuple[int, list[Piece]]]:
        """What waits at the end, in windows filled one after another, each of the longest context that can be filled; the last one may stay short."""
        pieces = [x for p in self.pools.values() for x in p.pieces]
        left, out = sum(x[0] for x in pieces), []
        self.pools = {t: Pool() for t in self.tiers}
        while left:
            t = next((t for t in self.tiers if t <= left), self.tiers[-1])
            window, room = [], min(t, left)
            left -= room
            while room:
                n, doc, start = pieces.pop()
                window.append((min(n, room), doc, start))
                if n > room:
                    pieces.append((n - room, doc, start + room))
                room -= min(n, room)
            out.append((t, window))
        return out


def stepped(windows: list[tuple[int, list[Piece]]], tiers: list[int], step: int, counts: dict[int, int]):
    """Yields tier, window and step number within the tier. Windows are dealt snake-wise by cost to the steps that this call fills; the count of each tier goes on between calls."""
    for t in tiers:
        own = sorted((w for k, w in windows if k == t), key=lambda w: -sum(x[0] ** 2 for x in w))
        size = step * (tiers[0] // t)
        first, there = divmod(counts[t], size)
        steps = max(1, -(-(there + len(own)) // size))
        room = [size - there * (k == 0) for k in range(steps)]
        at, forth = 0, 1
        for w in own:
            while not room[at]:
                at, forth = (at + forth, forth) if 0 <= at + forth < steps else (at, -forth)
            room[at] -= 1
            yield t, w, first + at
            at, forth = (at + forth, forth) if 0 <= at + forth < steps else (at, -forth)
        counts[t] += len(own)


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, tiers: tuple[int, ...] = TIERS, step: int = STEP) -> DataFrame:
    """A row for each piece: id_col, start, length, doc_tokens, sequence_id, offset, context (the window's size), step_id (unique within a context), ids_le (the piece's ids as little-endian 32-bit integers)."""
    if min(tiers) < 1 or step < 1:
        raise ValueError("context sizes and step must be positive")
    schema = T.StructType([T.StructField(id_col, df.select(col(id_col)).schema[0].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset", "context", "step_id")), T.StructField("ids_le", T.BinaryType())])
    longest = max(tiers)

    def run(batches):
        packer, counts, base = Packer(tiers), dict.fromkeys(tiers, 0), TaskContext.get().partitionId() * PER_TASK
        held: dict[int, tuple] = {}  # documents of which pieces wait: key, ids, number of ids
        number, order = 0, sorted(tiers, reverse=True)

        def rows(windows):
            nonlocal number
            keys, values, data = [], [], []
            for t, window, s in stepped(windows, order, step, counts):
                offset = 0
                for n, doc, start in window:
                    key, ids, from_, total = held[doc]
                    keys.append(key)
                    values.append((start, n, total, base + number, offset, t, base + s))
                    data.append(ids[start - from_ : start - from_ + n].tobytes())
                    offset += n
                number += 1
            if keys:
                yield pa.record_batch([pa.array(keys, key_kind), *map(pa.array, np.array(values, np.int64).T.copy()), pa.array(data, pa.binary())], schema.names)
            waiting = {doc for p in packer.pools.values() for _, doc, _ in p.pieces}
            for doc in held.keys() - waiting:
                del held[doc]

        doc, key_kind, size = 0, pa.int64(), 0
        for keys, ids, sizes in encoded(batches, vocabulary, end_id):
            key_kind, windows = keys.type, []
            ends = np.cumsum(sizes)
            for key, a, b in zip(keys.to_pylist(), (ends - sizes).tolist(), ends.tolist()):
                n = b - a
                full = n - n % longest
                windows += [(longest, [(longest, doc, at)]) for at in range(0, full, longest)]
                held[doc] = (key, ids[a:b], 0, n)
                if n > full:
                    packer.route((n - full, doc, full))
                doc += 1
                size += n
                if packer.waiting() >= POOL or size > 1_000_000:
                    yield from rows(windows + packer.pack())
                    windows, size = [], 0
            yield from rows(windows + packer.pack())
            size = 0
            for d, (key, own, from_, n) in held.items():  # let go of the batch's ids
                held[d] = (key, own[n - n % longest - from_ :].copy() if from_ == 0 else own, n - n % longest if from_ == 0 else from_, n)
        yield from rows(packer.rest())

    return df.select(col(id_col), col(text_col).cast("string")).mapInArrow(run, schema)


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids_le")).drop("ids_le")


def op3_pack(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids, each document ending with id 1."""
    return with_crc(pack(table(spark, sf_dir, "documents"), word_vocabulary()))
