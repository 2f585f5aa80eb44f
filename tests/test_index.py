"""The stored index: versions, what is read and written, blocks that are skipped, against plain loops."""

import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.operators import bm25, index, vector_index
from textquarry.operators.storage import listed, new_path

VOCAB = [f"w{i}" for i in range(300)]


def texts(n, seed=0, first=0):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, 301)
    return [(first + i, " ".join(rng.choice(VOCAB, rng.integers(1, 40), p=p / p.sum())) if i % 17 else [None, ""][i % 2]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


def asked(spark, questions):
    return bm25.query_terms(spark.createDataFrame(questions, "item_id long, text string"), "item_id", "text")


def brute(rows, questions, k):
    docs = [(i, Counter((t or "").split())) for i, t in rows]
    n, average = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    df = Counter(t for _, c in docs for t in c)
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    out = set()
    for q, text in questions:
        scores = []
        for i, c in docs:
            dl = sum(c.values())
            s = round(sum(m * (max(raw[t], low) if raw[t] < 0 else raw[t]) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * dl / average)) for t, m in Counter(text.split()).items() if c[t]), 6)
            if s > 0:
                scores.append((-s, i))
        out |= {(q, r, i, round(-s, 4)) for r, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def rows_of(found):
    return {(r["qid"], r["rank"], r["id"], round(r["score"], 4)) for r in found.collect()}


QUESTIONS = [(1, "w250 w7"), (2, "w0 w0 w1"), (3, "w299 nowhere"), (4, "nowhere"), (5, "w5 w90 w140 w2")]


@pytest.mark.parametrize("prune", [False, True])
def test_versions_of_an_index(spark, monkeypatch, prune):
    monkeypatch.setattr(bm25, "PRUNE_FROM", 2 if prune else 10**9)
    monkeypatch.setattr(bm25, "CELLS", 4000)  # several chunks of a block
    rows, path = texts(900), new_path(spark, "t")
    first = bm25.build_index(frame(spark, rows), "id", "text", folder=path, block=64)
    assert rows_of(bm25.best(first, asked(spark, QUESTIONS), 5)) == brute(rows, QUESTIONS, 5)

    more = texts(30, seed=5, first=880)  # 20 are replaced, 10 are new
    second = bm25.extended(index.opened(spark, path), frame(spark, more), "id", "text")
    now = rows[:880] + more
    assert (second.version, second.n_docs, len(second.segments)) == (2, len(now), 2)
    assert rows_of(bm25.best(second, asked(spark, QUESTIONS), 5)) == brute(now, QUESTIONS, 5)
    assert {r["term"]: r["df"] for r in second.terms.collect()} == Counter(t for _, x in now for t in set((x or "").split()))
    third = index.shrunk(second, spark.createDataFrame([(i,) for i in range(0, 600)], "id long"))
    left = [r for r in now if r[0] >= 600]
    assert rows_of(bm25.best(third, asked(spark, QUESTIONS), 5)) == brute(left, QUESTIONS, 5)
    fourth = index.merged(third)
    assert len(fourth.segments) == 1 and fourth.n_docs == len(left) and not any(s.gone for s in fourth.segments)
    assert rows_of(bm25.best(fourth, asked(spark, QUESTIONS), 5)) == brute(left, QUESTIONS, 5)
    assert index.merged(fourth) is fourth and index.versions(spark, path) == [1, 2, 3, 4]
    assert rows_of(bm25.best(index.opened(spark, path, 1), asked(spark, QUESTIONS), 5)) == brute(rows, QUESTIONS, 5)
    index.vacuumed(fourth)
    assert index.versions(spark, path) == [4] and len(listed(spark, path)) == 2
    assert rows_of(bm25.best(index.opened(spark, path), asked(spark, QUESTIONS), 5)) == brute(left, QUESTIONS, 5)


def test_pairs_and_subsets(spark):
    rows = texts(200)
    own = bm25.build_index(frame(spark, rows), "id", "text", block=32)
    want = {(q, i): s for q, _, i, s in brute(rows, QUESTIONS, 10**6)}
    pairs = [(q, i) for q in (1, 2, 5, 9) for i in (1, 2, 3, 50, 51, 199, 777)]
    got = bm25.score(own, asked(spark, QUESTIONS), spark.createDataFrame([*pairs, pairs[0]], "qid long, id long")).collect()
    assert {(r["qid"], r["id"]): round(r["score"], 4) for r in got} == {p: want[p] for p in pairs if p in want} and len(got) == len({(r["qid"], r["id"]) for r in got})
    some = bm25.best(own, asked(spark, QUESTIONS), 3, subset=spark.createDataFrame([(i,) for i in range(20, 60)], "id long"))
    assert {(r["qid"], r["id"]) for r in some.collect()} == {(q, i) for q in range(1, 6) for _, i in sorted((-s, i) for (p, i), s in want.items() if p == q and 20 <= i < 60)[:3]}


def scanned(df) -> int:
    """Rows that the scans of a query give to their filters."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
            continue
        if "QueryStage" in p.nodeName():
            todo.append(p.plan())
        if p.nodeName().startswith("Scan parquet"):
            total += p.metrics().apply("numOutputRows").value()
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_reads_the_blocks_of_its_terms(spark):
    own = bm25.build_index(frame(spark, texts(1500)), "id", "text", block=64)
    everything = own.blocks().count()
    one = own.blocks(spark.createDataFrame([("w123",)], "term string"))
    assert one.select("term").distinct().collect()[0]["term"] == "w123"
    bucket = own.spark.range(1).select(index.bucket_of(F.lit("w123"), own.segments[0].buckets).alias("b")).first()["b"]
    in_bucket = own.read(own.segments[0], "postings").where(F.col("bucket") == bucket).count()
    assert scanned(one) <= in_bucket < everything / 4


def test_skips_blocks(spark, monkeypatch):
    """Blocks whose bounds are below the k-th score are not scored: documents of one topic stand together."""
    monkeypatch.setattr(bm25, "PRUNE_FROM", 2)
    rows = [(i, f"topic{i // 64} " * (3 if i % 64 < 20 else 0) + "common " * (1 + i % 3) + f"x{i}") for i in range(2048)]
    own = bm25.build_index(spark.createDataFrame(rows, "id long, text string").repartitionByRange(4, "id"), "id", "text", block=64)
    questions = [(1, "topic3 common"), (2, "topic9 common")]
    seen = []
    scored = bm25._scored
    monkeypatch.setattr(bm25, "_scored", lambda index_, postings, docs, *a, **b: seen.append(docs.count()) or scored(index_, postings, docs, *a, **b))
    got = rows_of(bm25.best(own, asked(spark, questions), 5))
    assert got == brute(rows, questions, 5)
    assert len(seen) == 2 and sum(seen) < 32 / 2  # of 32 blocks


def test_does_not_prune_when_seeds_are_most_blocks(spark, monkeypatch):
    """With as many questions as blocks the seeds would be scored besides all: one pass, the same rows."""
    monkeypatch.setattr(bm25, "PRUNE_FROM", 2)
    rows = [(i, f"topic{i // 64} common x{i}") for i in range(512)]
    own = bm25.build_index(spark.createDataFrame(rows, "id long, text string").repartitionByRange(4, "id"), "id", "text", block=64)
    questions = [(q, f"topic{q} common") for q in range(8)]
    seen = []
    scored = bm25._scored
    monkeypatch.setattr(bm25, "_scored", lambda *a, **b: seen.append(1) or scored(*a, **b))
    assert rows_of(bm25.best(own, asked(spark, questions), 5)) == brute(rows, questions, 5)
    assert len(seen) == 1


def test_adding_writes_little(spark):
    """A hundredth more documents: about a hundredth more posting bytes, and no file is written anew."""
    path = new_path(spark, "t")
    first = bm25.build_index(frame(spark, texts(12_000)), "id", "text", folder=path)
    files = lambda: {f: (f.stat().st_size, f.stat().st_mtime) for f in Path(path.removeprefix("file:")).rglob("*.parquet")}
    before = files()
    second = bm25.extended(first, frame(spark, texts(120, first=50_000)), "id", "text")
    after = files()
    assert before.items() <= after.items()
    assert sum(s for s, _ in after.values()) < 1.15 * sum(s for s, _ in before.values())  # files of a hundred documents are mostly heads
    n = [second.read(s, "postings").agg(F.sum("n")).first()[0] for s in second.segments]
    assert min(n) < 0.015 * max(n)


def test_of_two_writers_one_fails(spark):
    own = bm25.build_index(frame(spark, texts(20)), "id", "text")
    index.shrunk(own, spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(RuntimeError):
        index.shrunk(own, spark.createDataFrame([(2,)], "id long"))
    none = bm25.build_index(frame(spark, texts(20)).limit(0), "id", "text")
    assert bm25.best(none, asked(spark, QUESTIONS), 5).count() == 0


def test_stored_index_is_found_again(spark, tmp_path):
    frame(spark, texts(50)).write.parquet(f"{tmp_path}/t.parquet")
    one, two = (bm25.stored_index(spark, f"{tmp_path}/t.parquet", "id", "text") for _ in range(2))
    assert (one.folder, one.segments) == (two.folder, two.segments)
    frame(spark, texts(60)).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert bm25.stored_index(spark, f"{tmp_path}/t.parquet", "id", "text").n_docs == 60


# Vectors ------------------------------------------------------------------------------------------------------


def vector_rows(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype("float32"))] + [(10**6, None)], "vec_id long, embedding array<float>").repartition(4)


def nearest(x, who, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return {(i, int(j)) for i in who for j in np.argsort(-(u @ u[i]), kind="stable")[:k]}


@pytest.mark.parametrize("dim", [10, 32])
def test_vector_index(spark, dim):
    """Clustered rows: at most a fifth of them is looked at, the rest is never read; all scores are exact."""
    rng = np.random.default_rng(dim)
    x = (rng.normal(size=(40, dim)) * 3)[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, dim)) * 0.4
    x[:100] = x[100]  # a very common vector
    own = vector_index.index_of(vector_rows(spark, x))
    assert own.rows.count() == 3000 and own.rows.select("id").distinct().count() == 3000
    who = list(range(150, 190))
    q = spark.createDataFrame([(i, x[i].tolist()) for i in who], "qid long, vector array<float>")
    got = vector_index.search(own, q, 10).collect()
    assert len({(r["qid"], r["id"]) for r in got} & nearest(x, who, 10)) / 400 >= 0.9
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(abs(r["score"] - u[r["qid"]] @ u[r["id"]]) < 1e-4 for r in got)
    one = spark.createDataFrame([(who[0], x[who[0]].tolist())], "qid long, vector array<float>")
    qids, v = vector_index.asked_vectors(one, "qid", "vector")
    read = scanned(vector_index.shortlisted(own, qids, v, 100))
    assert 0 < read <= 3000 / 5
    again = vector_index.opened(spark, own.folder)
    assert {tuple(r) for r in vector_index.search(again, one, 5).collect()} == {tuple(r) for r in vector_index.search(own, one, 5).collect()}


def test_vector_index_without_clusters(spark):
    """Nothing to prune by lists: exact scores are still taken of a fifth of the rows at most."""
    x = np.random.default_rng(3).normal(size=(1000, 64))
    own = vector_index.index_of(vector_rows(spark, x))
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(30)], "qid long, vector array<float>")
    got = {(r["qid"], r["id"]) for r in vector_index.search(own, q, 10).collect()}
    assert len(got & nearest(x, range(30), 10)) / 300 >= 0.9
    assert vector_index.shortlisted(own, *vector_index.asked_vectors(q, "qid", "vector"), 100).count() <= 30 * 1000 / 5


def test_large_vector_indexes_have_more_lists(spark, monkeypatch):
    """Lists are not capped: beyond LISTS of them, each is split by residuals."""
    monkeypatch.setattr(vector_index, "LISTS", 8)
    x = np.random.default_rng(4).normal(size=(2000, 8))
    own = vector_index.index_of(vector_rows(spark, x))
    assert own.model.lists.shape[0] == 8 and len(own.model.parts) == 6 and own.rows.select("list").distinct().count() > 40
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(20)], "qid long, vector array<float>")
    got = {(r["qid"], r["id"]) for r in vector_index.search(own, q, 10).collect()}
    assert len(got & nearest(x, range(20), 10)) / 200 >= 0.9


def test_odd_vector_tables(spark):
    none = vector_index.index_of(vector_rows(spark, np.zeros((0, 3))))
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "qid long, vector array<float>")
    assert vector_index.search(none, q, 3).count() == 0
    few = vector_index.index_of(vector_rows(spark, np.array([[0, 0, 0], [1, 1, 0], [1, 0, 0]])))
    assert [(r["id"], r["score"]) for r in vector_index.search(few, q, 3).orderBy("rank").collect()] == [(2, 1.0), (1, 0.707107), (0, 0.0)]
    assert vector_index.search(few, q.limit(0), 3).count() == 0


# Similar entries ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bucket,block", [(512, 1024), (8, 16)])
def test_cache_against_all_pairs(spark, monkeypatch, bucket, block):
    """The same key first, then the most similar living entry; a bucket that holds most rows is dealt into blocks."""
    from textquarry.operators import similar

    monkeypatch.setattr(similar, "BUCKET", bucket)
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 24))
    x = base[rng.integers(0, 60, 400)] + rng.normal(size=(400, 24)) * 0.25
    x[:150] = base[0] + rng.normal(size=(150, 24)) * 0.05  # one hot bucket
    x = np.round(x, 3).astype("float32")
    expires = rng.integers(0, 4, 400)
    entries = [(i, f"k{i % 390}", v.tolist(), int(e)) for i, (v, e) in enumerate(zip(x, expires))] + [(900, "dead", None, 9), (901, "none", x[1].tolist(), None)]
    asked = [(i, f"k{i}" if i % 4 == 0 else f"other{i}", (x[i] + rng.normal(size=24) * 0.1).astype("float32").tolist(), i % 3) for i in range(400)] + [(950, "dead", None, 1), (951, "missing", None, 1)]
    got = {r["qid"]: r for r in similar.cached(spark.createDataFrame(asked, "qid long, key string, vector array<float>, at int"), spark.createDataFrame(entries, "id long, key string, vector array<float>, expires int")).collect()}
    assert len(got) == len(asked)
    best = {}
    for i, k, v, e in entries:
        if e is not None and (k not in best or (e, -i) > (best[k][2], -best[k][0])):
            best[k] = (i, v, e)
    right = total = 0
    for q, k, v, t in asked:
        if k in best and t < best[k][2]:
            assert (got[q]["match_id"], got[q]["kind"], got[q]["score"]) == (best[k][0], "exact", 1.0)
            continue
        near = [(round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6), -i) for i, w, e in best.values() if v is not None and w is not None and t < e]
        top = max((n for n in near if n[0] >= 0.85), default=None)
        if top is None:
            assert got[q]["match_id"] is None and got[q]["kind"] is None
        else:
            total += 1
            right += got[q]["match_id"] is not None and abs(got[q]["score"] - top[0]) < 1e-5
    assert total > 100 and right / total >= 0.97


def test_bands_keep_what_is_similar():
    from textquarry.operators import similar

    for n in (10, 10**6, 10**10):
        bits, count = similar.bands(n, 0.85)
        assert 1 - (1 - (1 - math.acos(0.85) / math.pi) ** bits) ** count >= 0.99 and bits <= 24
