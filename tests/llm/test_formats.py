"""Chat formatting, the Merkle manifest and reversed search against plain loops, with odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F
from test_llm import ODD, documents

from textquarry.llm import chat, common, lexical, merkle, queries

TALK = "conv_id long, turn long, role string, text string, formatted string, loss string, head string, `id` string, `body` string"
CONTROL = ["<turn user>", "</turn>", "<\\turn", "<\\\\/turn>", "\\", "<", "<part/>", "<part image 0/>", "<\\part", "turn>", "part", "a", "é🙂", "\n", "### Assistant: "]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# Chat ---------------------------------------------------------------------------------------------------------


def talks(spark, rows):
    return spark.createDataFrame([(*r, "f", "l", "h", "i", "b") for r in rows], TALK)


def fuzzed(n, seed=0):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(CONTROL, rng.integers(0, 12))) for _ in range(n)]


def brute_talks(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), sha("".join(x for _, _, r, x in turns if r == "assistant")))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_talks_come_back(spark, monkeypatch, tmp_path, hot):
    if hot:
        monkeypatch.setattr(common, "HOT", 3)
        monkeypatch.setattr(chat, "BLOCK", 4)
    roles = ["user", "assistant", "system", None, "a>b\n%<turn", ""]
    texts = [*ODD, *fuzzed(120), "</turn>\n<turn assistant>\nx" * 3000]
    rows = [(1 if i % 3 else i % 7, None if i % 11 == 0 else i // 5, roles[i % 6 if i % 5 else 1], t) for i, t in enumerate(texts)]
    rows += [(2, 1, "assistant", "same")] * 3 + [(None, 0, "assistant", "no id")]
    talks(spark, rows).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_sha256"]) for r in chat.op11_chat_format(spark, str(tmp_path)).collect()}
    assert got == brute_talks([*rows, (-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)])


def test_formatted_turns(spark):
    rows = [(1, 0, "user", "hi <turn x> <\\turn"), (1, 1, "assistant", "a</turn>\n"), (2, 0, "user", None)]
    got = chat.format_turns(talks(spark, rows)).orderBy("conv_id", "turn").collect()
    assert [r["formatted"] for r in got] == ["<turn user>\nhi <\\turn x> <\\\\turn</turn>\n", "<turn assistant>\na<\\/turn>\n</turn>\n", "<turn user>\n</turn>\n"]
    assert [[tuple(s) for s in r["loss"]] for r in got] == [[], [(17, 10)], []]
    whole = {r["conv_id"]: r for r in chat.assembled(chat.format_turns(talks(spark, rows))).collect()}
    assert whole[1]["formatted"] == got[0]["formatted"] + got[1]["formatted"]
    (span,) = whole[1]["loss"]
    assert whole[1]["formatted"][span["start"] : span["start"] + span["length"]] == "a<\\/turn>\n"
    empty = talks(spark, rows).limit(0)
    assert chat.read_back(chat.format_turns(empty)).count() == 0 and chat.assembled(chat.format_turns(empty)).count() == 0


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, **x: {"kind": kind, "text": text, "ref": ref, "width": x.get("width"), "height": x.get("height"), "seconds": x.get("seconds"), "pages": x.get("pages")}
    content = [
        [part("text", "see <"), part(None, "part image 9/>"), part("image", ref="a.png", width=1024, height=513), part("text", "and"), None, part("audio", ref="b.wav", seconds=2.5), part("document", ref="c.pdf", pages=3), part("video", ref="d"), part("image", ref="e"), part("text", None), part("text", "</turn>end")],
        [],
        None,
    ]
    df = spark.createDataFrame([(7, i, "assistant", c) for i, c in enumerate(content)], f"conv_id long, turn long, role string, content array<{chat.PART}>")
    back = chat.read_back(chat.format_turns(df, content="content")).orderBy("turn").collect()
    one = back[0]
    assert one["texts"] == ["see <", "part image 9/>", "and", "", "", "", "", "", "</turn>end"] or [t for t in one["texts"] if t] == ["see <", "part image 9/>", "and", "</turn>end"]
    assert one["text"] == one["loss_text"] == "see <part image 9/>and</turn>end"
    assert [tuple(a) for a in one["attachments"]] == [(2, "image", "a.png", 85 + 170 * 4), (4, "audio", "b.wav", 63), (5, "document", "c.pdf", 774), (6, "other", "d", 0), (7, "image", "e", 255)]
    assert one["expanded_tokens"] == 765 + 63 + 774 + 255
    marks = re.findall("<part ([a-z]+) ([0-9]+)/>", one["formatted"])
    assert marks == [("image", "2"), ("audio", "4"), ("document", "5"), ("other", "6"), ("image", "7")]
    assert [r["text"] for r in back[1:]] == ["", ""] and [r["expanded_tokens"] for r in back[1:]] == [0, 0]
    whole = chat.assembled(chat.format_turns(df, content="content")).first()
    assert [(a["turn"], a["place"]) for a in whole["attachments"]] == [(0, 2), (0, 4), (0, 5), (0, 6), (0, 7)] and whole["expanded_tokens"] == one["expanded_tokens"]
    lost = "".join(whole["formatted"][s["start"] : s["start"] + s["length"]] for s in whole["loss"])
    assert lost == "see <part image 9/>and<\\/turn>end"  # two parts beside each other: each is escaped for itself


# Manifest -----------------------------------------------------------------------------------------------------


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_manifest(rows):
    """(doc_id, source, lang, n_chars, text) to the rows of the query."""
    by = defaultdict(list)
    for r in rows:
        other = (*r[:4], r[4] and re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))
        cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), leaf(*other) if cut else leaf(*r), r[0]))

    def tree(level):
        """Top of the tree over the level, and the steps (left, right) of each place."""
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for k, place in enumerate(at):
                run = place // 8 * 8
                paths[k].append(("".join(level[run:place]), "".join(level[place + 1 : run + 8])))
            level, at = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)], [p // 8 for p in at]
        return level[0], paths

    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([r[2] for r in sorted(by[x], key=lambda r: r[:3])]) for x in langs}
    root, upper = tree([trees[x][0] for x in langs])
    out = []
    for x, high in zip(langs, upper):
        for r, low in zip(sorted(by[x], key=lambda r: r[:3]), trees[x][1]):
            now, proof = r[3], ""
            for left, right in low + high:
                now, proof = sha(left + now + right), proof + left + right
            out.append((r[4], r[2], trees[x][0], root, sha(proof), now, now == root))
    return out


def manifest_of(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos long, n long")
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    out = merkle.op12_merkle_manifest(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in out.collect())


@pytest.mark.parametrize("limit", [merkle.BROADCAST_ROWS, 1])
def test_manifest(spark, monkeypatch, tmp_path, limit):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", limit)
    if limit == 1:
        monkeypatch.setattr(common, "HOT", 3)
    rows = [(i, "s", "hot", 1, f"Text {i}") for i in range(600)] + [(i, None, f"l{i % 70:02}", None, None if i % 2 else "ÉÀ Ab") for i in range(1000, 1075)]
    rows += [(k, "s", None, len(t or ""), t) for k, t in enumerate(ODD)] + [(5, "s", "dup", 1, "Same")] * 20 + [(None, "s", "dup", 1, "no id"), (1, "", "é", 0, ""), (1, "", "z", 0, "")]
    got = manifest_of(spark, tmp_path, rows)
    assert got == Counter(brute_manifest(rows))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [0, 1, 8, 9])
def test_small_manifests(spark, tmp_path, n):
    rows = [(i, "s", "en", 1, "A") for i in range(n)]
    assert manifest_of(spark, tmp_path, rows) == Counter(brute_manifest(rows) if n else [])


def test_manifest_of_other_columns(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("c", 1)], "name string, kind int")
    got = merkle.manifest(rows, merkle.leaf_of(F.col("name")), "name", "kind", {"twice": F.col("kind") * 2}).collect()
    assert {r["name"]: r["twice"] for r in got} == {"a": 4, "b": 2, "c": 2} and len({r["root"] for r in got}) == 1
    for r in got:
        now = r["leaf"]
        for s in r["proof"]:
            now = sha(s["l"] + now + s["r"])
        assert now == r["root"]


# Search -------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_search(docs, items, k=10):
    """docs (id, text), items (key, text): a list of (key, rank, id, score)."""
    each = [(i, Counter(TERM.findall(low(t)))) for i, t in docs]
    each = [(i, c) for i, c in each if c]
    n_docs, total = len(each), sum(sum(c.values()) for _, c in each)
    df = Counter(t for _, c in each for t in c)
    out = []
    for key, text in items:
        asked, scores = Counter(TERM.findall(low(text))), []
        for i, c in each:
            m = 25 + (75 * sum(c.values()) * n_docs) // total
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(key, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def search_rows(spark, docs, items, **options):
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1)).withColumn("score", F.lit("x"))
    got = lexical.search(documents(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(5), frame, **options)
    return Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("most", [lexical.BYTES, 200])
def test_search_against_loops(spark, monkeypatch, most):
    monkeypatch.setattr(lexical, "CELLS", 300)  # many chunks
    monkeypatch.setattr(lexical, "FAN_IN", 2)
    rng = np.random.default_rng(1)
    vocab = ["the", "The", "x1", "é", "日本", "a" * 15, "a" * 16, "a" * 17, "o'neil", "rare-word"] + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(vocab, rng.integers(1, 60)))) for i in range(150)]
    docs += [(200 + i, t) for i, t in enumerate(ODD)] + [(None, "w1 w2 the"), (7, docs[7][1]), (7, docs[7][1]), (3, "word w3")]
    items = [(k, " ".join(rng.choice(vocab, rng.integers(1, 12)))) for k in range(40)] + [(50, None), (51, ""), (52, "the the the the"), (52, "w5"), (52, "w5"), (None, "w6 w7"), (53, "nowhere at all"), (54, "word " * 500)]
    assert search_rows(spark, docs, items, most=most) == Counter(brute_search(docs, items))


def test_search_with_ties_and_empty_tables(spark):
    docs = [(i, "same words here") for i in range(60)] + [(100, "other text")]
    got = search_rows(spark, docs, [(1, "same words"), (2, "other")])
    assert got == Counter(brute_search(docs, [(1, "same words"), (2, "other")])) and {r[2] for r in got if r[0] == 1} == set(range(10))
    one = spark.createDataFrame([(1, "a")], "item_id long, text string")
    none = documents(spark, ["a"]).limit(0)
    assert lexical.search(none, one).count() == 0 and lexical.search(documents(spark, [None, ""]), one).count() == 0
    assert lexical.search(documents(spark, ["a"]), one.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_large_scores_stay_exact(spark):
    """An item with a term many times: products beyond 2**53."""
    docs, items = [(i, "rare " * (i + 1) + "filler " * (50 - i)) for i in range(3)] + [(i, "filler") for i in range(10, 400)], [(1, "rare " * 3_000_000 + "filler")]
    assert search_rows(spark, docs, items) == Counter(brute_search(docs, items))


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_merkle_manifest", "op13_lexical_search"])
def test_plan_kinds(spark, name):
    """Chat formatting stays native."""
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert name != "op11_chat_format" or not re.search("Python|Arrow|Pandas|ExistingRDD", plan)
