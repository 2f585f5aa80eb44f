"""Every query of the catalogue that has SQL, on the smallest tables."""

import duckdb
import pytest
from oracle import SF, check

from textquarry.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, name):
    check(spark, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_recall_of_the_registered_index(spark):
    """ann_ivf_topk finds at least 0.9 of the ten nearest of all rows."""
    near, exact = ({(r["qid"], r["doc_id"]) for r in catalogue.QUERIES[n](spark, SF).collect()} for n in ("ann_ivf_topk", "vector_topk"))
    assert len(near & exact) / len(exact) >= 0.9


def test_combined_scores_are_not_cut(spark):
    """norm_combine takes each hit's own keyword score, beyond the first 400 of the list too."""
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    sql = catalogue.ORACLES["norm_combine"]
    want = {(q, i): s for q, i, s in con.execute(sql).fetchall()}
    cut = {(q, i): s for q, i, s in con.execute(sql.replace("LEFT JOIN sc l", "LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM sc) WHERE r <= 400) l")).fetchall()}
    got = {(r["qid"], r["doc_id"]): r["score"] for r in catalogue.QUERIES["norm_combine"](spark, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    assert any(abs(cut[k] - want[k]) >= 1e-5 for k in want)


def test_warm_embeddings_takes_whole_new_messages(spark, tmp_path):
    d, long = str(tmp_path), "word " * 60
    rows = [(1, 0, "user", long + "One"), (2, 0, "user", long + "two"), (3, 0, "user", long + "one"), (4, 0, "user", "Known"), (5, 0, "user", "not yet"), (6, 0, "assistant", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(7, "known"), (8, "not yet")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(7, [1.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    got = {r["query"]: r["n"] for r in catalogue.QUERIES["warm_embeddings"](spark, d).collect()}
    assert got == {long + "one": 2, long + "two": 1, "not yet": 1}
