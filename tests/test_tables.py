"""Stored tables: what a change rewrites, versions, kills on the way; ingest into several tables at once."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textquarry.functions.text import word_text, word_tokens
from textquarry.operators import bm25, index, models, tables
from textquarry.operators.storage import new_path
from textquarry.operators.tables import Shape
from textquarry.streaming import ingest

T0 = dt.datetime(2024, 1, 1)
ROW = "k long, v string, version int"


def rows(spark, data, schema=ROW):
    return spark.createDataFrame(data, schema)


def files(store):
    return {f for f in Path(store.folder.removeprefix("file:")).glob("data/**/*.parquet")}


def test_changes_touch_their_buckets(spark):
    store = tables.opened(spark, new_path(spark, "t"))
    first = store.change().create("t", Shape(ROW, "k", buckets=32)).merge("t", rows(spark, [(i, "a", 1) for i in range(500)]), "version").commit()
    assert first.count("t") == 500 and len(first.pieces["t"]) == 32
    before = files(first)
    change = first.change().merge("t", rows(spark, [(3, "b", 2), (4, "old", 0), (1000, "new", 1)]), "version")
    touched = change.touched("t", rows(spark, [(3, "", 0), (4, "", 0), (1000, "", 0)]))
    assert change.rewritten["t"] == touched and len(touched) <= 3
    second = change.commit()
    assert before < files(second) and len(files(second) - before) <= 2 * len(touched)  # nothing old is changed, little is new
    assert {b: p for b, p in second.pieces["t"].items() if b not in touched} == {b: p for b, p in first.pieces["t"].items() if b not in touched}
    got = {r["k"]: r["v"] for r in second.read("t").collect()}
    assert len(got) == 501 and (got[3], got[4], got[1000], got[7]) == ("b", "a", "new", "a")
    third = second.change().delete("t", rows(spark, [(3,), (9999,)], "k long")).commit()
    assert third.count("t") == 500 and third.read("t").where("k = 3").count() == 0
    assert first.read("t").where("k = 3").first()["v"] == "a"  # older versions stay
    with pytest.raises(RuntimeError):
        second.change().note(x="y").commit()
    tables.vacuumed(third)
    assert tables.versions(spark, third.folder) == [3] and tables.opened(spark, third.folder).read("t").count() == 500
    gone = third.change().delete("t", third.read("t")).commit()
    assert gone.count("t") == 0 and gone.read("t").count() == 0


def test_expiry_drops_days(spark):
    data = [(i, T0 + dt.timedelta(hours=i)) for i in range(24 * 10)]
    shape = Shape("id long, ts timestamp_ntz", "id", day="ts")
    first = tables.opened(spark, new_path(spark, "t")).change().create("log", shape).merge("log", rows(spark, data, shape.schema), "ts").commit()
    change = first.change().expire("log", "2024-01-04 06:00:00")
    assert change.rewritten == {"log": ["2024-01-04"]}  # one day is written anew
    after = change.commit()
    assert sorted(r["id"] for r in after.read("log").collect()) == list(range(78, 240)) and after.count("log") == 162
    assert after.change().expire("log", "2030-01-01 00:00:00").commit().count("log") == 0


def papers(spark, data):
    return spark.createDataFrame([(i, t, s, ["a"], ["c"], d) for i, t, s, d in data], ingest.PAPER)


def contents(store):
    words = {r["id"]: r["dl"] for r in ingest.index_of(store).lengths.collect()}
    papers_ = {r["id"]: r for r in store.read("papers").collect()}
    chunks = {(r["id"], r["chunk_id"], r["text"]) for r in store.read("chunks").collect()}
    assert {(r["id"], r["chunk_id"]) for r in store.read("vectors").collect()} == {c[:2] for c in chunks}
    assert {r["no"] for r in papers_.values()} == set(words)
    return {i: (r["title"], r["summary"], words[r["no"]]) for i, r in papers_.items()}, chunks


DAY = [T0 + dt.timedelta(days=i) for i in range(9)]
BATCHES = [
    [("a", "Title one", "words of it", DAY[0]), ("a", "Title one", "newer words of it", DAY[1]), ("b", "Other", "x " * 900, DAY[0]), ("", "No id", "x", DAY[0]), ("c", " ", None, DAY[0])],
    [("b", "Other", "short now", DAY[3]), ("a", "Too old", "not taken", DAY[0]), ("d", None, "only a summary", None), (None, "t", "s", None)],
]


def test_ingest_commits_all_tables_together(spark):
    store, counts = ingest.ingested(tables.opened(spark, new_path(spark, "t")), papers(spark, BATCHES[0]), "s", 0)
    assert counts == {"fetched": 5, "indexed": 2, "errors": 2}
    store, counts = ingest.ingested(store, papers(spark, BATCHES[1]), "s", 1)
    assert counts == {"fetched": 4, "indexed": 2, "errors": 1}
    got, chunks = contents(store)
    assert got == {"a": ("Title one", "newer words of it", 6), "b": ("Other", "short now", 3), "d": (None, "only a summary", 3)}
    assert chunks == {("a", "a::chunk_0", "Title: Title one Abstract: newer words of it"), ("b", "b::chunk_0", "Title: Other Abstract: short now"), ("d", "d::chunk_0", "Title: Abstract: only a summary")}
    assert sorted((r["problem"], r["batch"]) for r in store.read("rejects").collect()) == [("no_id", 0), ("no_id", 1), ("no_text", 0)]
    same, counts = ingest.ingested(store, papers(spark, BATCHES[1]), "s", 1)  # a batch comes again
    assert same is store and counts["indexed"] == 0
    hits = bm25.best(ingest.index_of(store), bm25.query_terms(rows(spark, [(1, "short x")], "q long, t string"), "q", "t"), 5).collect()
    number = store.read("papers").where("id = 'b'").first()["no"]
    assert [h["id"] for h in hits] == [number]  # the words of its earlier version are gone


def test_ingest_makes_each_vector_once(spark, tmp_path):
    seen = tmp_path / "texts"

    def counting():
        model = models.hashing_embedder()

        def embed(texts):
            with seen.open("a") as f:
                f.write("x" * len(texts))
            return model(texts)

        return embed

    data = [(str(i), "Title", "some words " * 90 * (i % 3 + 1), DAY[0]) for i in range(40)]
    store, _ = ingest.ingested(tables.opened(spark, new_path(spark, "t")), papers(spark, data), "s", 0, counting)
    assert seen.stat().st_size == store.count("vectors") == store.count("chunks") > 40
    before = contents(store)[1]
    store, _ = ingest.ingested(store, papers(spark, [("7", "Title", "new", DAY[1]), ("x", None, "new", DAY[1])]), "s", 1, counting)
    now = contents(store)[1]
    assert {c for c in now if c[0] not in "7x"} == {c for c in before if c[0] != "7"} and len([c for c in now if c[0] in ("7", "x")]) == 2
    assert store.read("papers").agg(F.countDistinct("no")).first()[0] == 41


def test_words_of_texts_are_the_tokens(spark):
    data = [(1, "Über-Maß, naïve\u2019s caf\u00e9 \u00a0 x\u200dy \u2014 \U0001f600a\u0301 _b9\u0661 ABC\u0130"), (2, ""), (3, None), (4, "plain, ASCII-text 12_3"), (5, "\u4e2d\u6587\u3002ok")]
    df = rows(spark, data, "id long, t string")
    texts = index.built(df.select("id", word_text(F.col("t")).alias("text")), new_path(spark, "i"))
    tokens = index.built(df.select("id", word_tokens(F.col("t")).alias("tokens")), new_path(spark, "i"))
    for kind in ("postings", "lengths", "terms"):
        assert sorted(getattr(texts, kind).collect()) == sorted(getattr(tokens, kind).collect())


@pytest.mark.parametrize("at", ["merge", "replace", "commit"])
def test_a_killed_batch_leaves_the_last_version(spark, monkeypatch, at):
    folder = new_path(spark, "t")
    store, _ = ingest.ingested(tables.opened(spark, folder), papers(spark, BATCHES[0]), "s", 0)
    before = contents(store)
    whole = getattr(tables.Change, at)

    def killed(self, *a, **b):
        if at != "commit":
            whole(self, *a, **b)
        raise KeyboardInterrupt

    monkeypatch.setattr(tables.Change, at, killed)
    with pytest.raises(KeyboardInterrupt):
        ingest.ingested(store, papers(spark, BATCHES[1]), "s", 1)
    monkeypatch.undo()
    left = tables.opened(spark, folder)
    assert left.version == 1 and contents(left) == before
    after, counts = ingest.ingested(left, papers(spark, BATCHES[1]), "s", 1)
    assert counts["indexed"] == 2 and set(contents(after)[0]) == {"a", "b", "d"} and contents(after)[0]["b"][1] == "short now"
    tables.vacuumed(after)
    assert contents(tables.opened(spark, folder)) == contents(after)


def test_ingest_of_a_stream(spark, tmp_path):
    """Restarts, replays and a new checkpoint; equal to one batch of everything."""
    folder, source, said = str(tmp_path / "store"), str(tmp_path / "in"), []

    def arrive(data, checkpoint):
        papers(spark, data).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(spark.readStream.schema(ingest.PAPER).parquet(source), folder, str(tmp_path / checkpoint), said.append).awaitTermination(180)

    for data in BATCHES:
        arrive(data, "cp")
    arrive([], "cp")
    assert [c["indexed"] for c in said][:2] == [2, 2]
    now = contents(tables.opened(spark, folder))
    one, _ = ingest.ingested(tables.opened(spark, new_path(spark, "t")), papers(spark, BATCHES[0] + BATCHES[1]), "s", 0)
    assert contents(one) == now
    arrive([("e", "Late", "one", DAY[0])], "other")  # batch 0 of a new query, with all papers again
    again = contents(tables.opened(spark, folder))
    assert set(again[0]) == {"a", "b", "d", "e"} and {k: v for k, v in again[0].items() if k != "e"} == now[0]
