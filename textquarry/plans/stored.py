"""Queries over stored tables that change: ingest of papers into several tables, merges and expiry by bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.operators import similar, sketches, tables
from textquarry.operators.storage import new_path
from textquarry.operators.tables import Shape, Store
from textquarry.plans.activity import log
from textquarry.plans.retrieval import WORDS, table
from textquarry.plans.texts import _chunk_sql
from textquarry.streaming import horizons, ingest


def shape_of(df: DataFrame, key: str, **options) -> Shape:
    return Shape(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), key, **options)


def _new_store(spark) -> Store:
    return tables.opened(spark, new_path(spark, "store"))


def upsert_latest(spark, d):
    """Orders with newer rows for every third one, and some deleted, in a table by buckets."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("version"))
    new = o.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(2).alias("version"))
    gone = o.where("o_orderkey % 10 = 5").select("o_orderkey")
    first = _new_store(spark).change().create("orders", shape_of(o, "o_orderkey", buckets=16)).merge("orders", o, "version").commit()
    last = first.change().merge("orders", new, "version").delete("orders", gone).commit()
    return last.read("orders").select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), F.col("version").cast("long").alias("version"))


def audit_retention(spark, d):
    """The log after ten days of retention: what stayed in the table, and what the version before it still has besides."""
    rows = log(spark, d)
    bound = rows.agg(F.date_format(F.max("ts") - F.expr("interval 10 days"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    before = _new_store(spark).change().create("events", shape_of(rows, "event_id", day="ts")).merge("events", rows, "ts").commit()
    after = before.change().expire("events", bound).commit()
    kept = after.read("events").select(F.lit(True).alias("kept"), "ts")
    gone = before.read("events").join(after.read("events").select("event_id"), "event_id", "left_anti").select(F.lit(False).alias("kept"), "ts")
    return kept.unionByName(gone).groupBy("kept").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))


def _papers(spark, d, docs: DataFrame, at: str) -> DataFrame:
    """Documents as papers: the first line is the title."""
    title = F.substring_index("text", "\n", 1)
    return docs.select(F.col("doc_id").cast("string").alias("id"), title.alias("title"), F.col("text").alias("summary"), F.array("source").alias("authors"), F.array("lang").alias("categories"), F.lit(at).cast("timestamp").alias("published_at"))


def ingest_tables(spark, d):
    """All documents in three batches: all of them, then every third one again with another summary, then a batch that was taken before. From the tables: chunks, vectors and indexed words of each paper."""
    docs = table(spark, d, "documents")
    store, first = _new_store(spark), _papers(spark, d, docs, "2024-01-01")
    again = _papers(spark, d, docs.where("doc_id % 3 = 0"), "2024-02-01").withColumn("summary", F.concat(F.lit("Revised. "), "summary"))
    for number, batch in enumerate((first, again)):
        store, _ = ingest.ingested(store, batch, "query", number)
    store, _ = ingest.ingested(store, first, "query", 0)
    index = ingest.index_of(store)
    chunks = store.read("chunks").groupBy("id").agg(F.count("*").alias("n_chunks"))
    vectors = store.read("vectors").groupBy("id").agg(F.count("embedding").alias("n_vectors"))
    papers = store.read("papers").select("id", F.col("no"), F.length("summary").cast("long").alias("n_chars"))
    words = index.lengths.select(F.col("id").alias("no"), F.col("dl").alias("n_words"))
    out = papers.join(words, "no").join(chunks, "id").join(vectors, "id")
    return out.select(F.col("id").cast("long").alias("doc_id"), "n_chars", "n_words", "n_chunks", "n_vectors")


def semantic_cache(spark, d):
    """Every vector is a cached question, which lives for some days; every one is asked again, a third of them as they are, the others a little changed. The entry that answers: the same key, else the most similar living one."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    days = F.col("vec_id") % 5
    entries = e.select(F.col("vec_id").alias("id"), similar.vector_key(F.col("embedding")).alias("key"), F.col("embedding").alias("vector"), days.alias("expires"))
    changed = F.transform("embedding", lambda x, i: (x * (F.lit(1.0) + ((F.col("vec_id") + i) % 3) * 0.25)).cast("float"))
    v = F.when(F.col("vec_id") % 3 == 0, F.col("embedding")).otherwise(changed)
    asked = e.select(F.col("vec_id").alias("qid"), v.alias("vector")).select("qid", similar.vector_key(F.col("vector")).alias("key"), "vector", F.lit(1).alias("at"))
    return similar.cached(asked, entries)


def audit_horizons(spark, d):
    """Failures, searches and addresses of each user in the last 15 minutes, hour and day, at the end of every quarter of an hour with calls."""
    return horizons.at_ends(log(spark, d)).withColumn("until", F.date_format("until", "yyyy-MM-dd HH:mm"))


def sketch_rollup(spark, d):
    """Hourly sketches merged to days: exact counts, and whether distinct users and the median are within the bounds of what is exact."""
    rows = log(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "value")
    days = sketches.read_out(sketches.rolled(sketches.by_window(rows, "event_type", "user_id", "value"), "day"))
    each = rows.select(F.date_trunc("day", "ts").alias("start"), F.col("event_type").alias("label"), "user_id", "value").join(days.select("start", "label", "q50"), ["start", "label"])
    exact = each.groupBy("start", "label").agg(F.countDistinct("user_id").alias("k"), F.count_if(F.col("value") < F.col("q50")).alias("below"), F.count_if(F.col("value") <= F.col("q50")).alias("upto"), F.count("value").alias("m"))
    close = (F.abs(F.col("n_distinct") / F.col("k") - 1) <= 0.06).alias("distinct_close")
    middle = (F.col("below") <= 0.52 * F.col("m")) & (F.col("upto") >= 0.48 * F.col("m"))
    return days.join(exact, ["start", "label"]).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "label", "n", F.round("total", 3).alias("total"), close, middle.alias("median_close"))


QUERIES = {f.__name__: f for f in (upsert_latest, audit_retention, ingest_tables, semantic_cache, audit_horizons, sketch_rollup)}

_REVISED = "CASE WHEN doc_id % 3 = 0 THEN 'Revised. ' || text ELSE text END"
ORACLES = {
    "upsert_latest": "SELECT o_orderkey, round(o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END, 2) AS o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM orders WHERE o_orderkey % 10 <> 5",
    "audit_retention": "SELECT ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY AS kept, count(*) AS n, min(ts) AS oldest FROM events GROUP BY 1",
    "semantic_cache": """WITH e AS (SELECT vec_id AS id, embedding AS v, vec_id % 5 AS t FROM embeddings), k AS (SELECT v, arg_max(id, (t, -id)) AS id, max(t) AS t FROM e GROUP BY v),
      q AS (SELECT vec_id AS qid, CASE WHEN vec_id % 3 = 0 THEN embedding ELSE [(embedding[i]::DOUBLE * (1 + ((vec_id + i - 1) % 3) * 0.25::DOUBLE))::FLOAT FOR i IN range(1, len(embedding) + 1)] END AS v FROM embeddings),
      x AS (SELECT qid, q.v, k.id AS exact_id FROM q LEFT JOIN k ON q.v = k.v AND 1 < k.t),
      s AS (SELECT qid, k.id, round(list_sum([x.v[i]::DOUBLE * k.v[i]::DOUBLE FOR i IN range(1, len(k.v) + 1)]) / (sqrt(list_sum([a::DOUBLE * a::DOUBLE FOR a IN x.v])) * sqrt(list_sum([a::DOUBLE * a::DOUBLE FOR a IN k.v]))), 6) AS score FROM x, k WHERE exact_id IS NULL AND 1 < k.t),
      b AS (SELECT qid, arg_max({'i': id, 's': score}, (score, -id)) AS m FROM s WHERE score >= 0.85 GROUP BY qid)
      SELECT qid, coalesce(exact_id, m.i) AS match_id, CASE WHEN exact_id IS NOT NULL THEN 1.0::DOUBLE ELSE m.s END AS score, CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN m.i IS NOT NULL THEN 'similar' END AS kind FROM x LEFT JOIN b USING (qid)""",
    "audit_horizons": """WITH m AS (SELECT user_id, floor(epoch(ts))::BIGINT // 900 AS b, (event_type = 'error')::INT AS f, (event_type = 'view')::INT AS s, props->>'$.k' AS a FROM events), e AS (SELECT DISTINCT user_id, b + 1 AS e FROM m),
      h(horizon, n) AS (VALUES ('15m', 1), ('1h', 4), ('24h', 96))
      SELECT e.user_id::VARCHAR AS "user", strftime(make_timestamp(e * 900000000), '%Y-%m-%d %H:%M') AS until, horizon, sum(f)::BIGINT AS failures, sum(s)::BIGINT AS searches, count(DISTINCT a) AS addresses
      FROM e, h JOIN m ON m.user_id = e.user_id AND b >= e - n AND b < e GROUP BY ALL""",
    "sketch_rollup": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS label, count(*) AS n, round(sum(value), 3) AS total, true AS distinct_close, true AS median_close FROM events GROUP BY 1, 2",
    "ingest_tables": f"""WITH p AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, {_REVISED} AS s FROM documents WHERE length(trim(text)) > 0),
      b AS (SELECT doc_id, 'Title: ' || title || chr(10) || chr(10) || 'Abstract: ' || s AS t FROM p), {_chunk_sql('b', 'doc_id')}, k AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
      SELECT doc_id, length(s)::BIGINT AS n_chars, len({WORDS.format(t="title || ' ' || s")})::BIGINT AS n_words, n AS n_chunks, n AS n_vectors FROM p JOIN k USING (doc_id)""",
}
