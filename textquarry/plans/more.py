"""Queries on row rules, multi-query retrieval and result shaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textquarry.functions import expand, rows
from textquarry.operators import bm25, chains
from textquarry.plans.chains import _VARIANTS, _variants
from textquarry.plans.retrieval import TOP, WORDS, index_of, lexical, lexical_sql, table
from textquarry.sources import reports


def glob_purge(spark, d):
    """Documents by source, but for those whose source matches src1* or s?c2."""
    docs = table(spark, d, "documents")
    return docs.where(~rows.matches_glob(F.col("source"), "src1*") & ~rows.matches_glob(F.col("source"), "s?c2")).groupBy("source").agg(F.count("*").alias("n"))


def category_whitelist(spark, d):
    """Languages as categories, known ones and others."""
    c = F.concat(F.lit("cs."), F.upper(F.col("lang")))
    mapped = F.when(F.col("lang") == "en", "cs.LG").when(F.col("lang") == "de", "cs.DS").otherwise(c)
    return table(spark, d, "documents").select(mapped.alias("category")).groupBy("category").agg(F.count("*").alias("n")).withColumn("known", rows.known_category(F.col("category")))


def not_indexed(spark, d):
    """Documents that have no vector."""
    return table(spark, d, "documents").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id", "lang")


def multi_query(spark, d):
    """Each question's variants in one job, fused by rank: with the number of lists that have the document, and of variants that found nothing."""
    variants = _variants(spark, d)
    found = bm25.search(index_of(spark, d), variants, 2 * TOP)
    lists = found.select(F.floor(F.col("qid") / 10).cast("long").alias("qid"), "id", "rank", "score", F.pmod("qid", F.lit(10)).cast("int").alias("list_no"))
    merged = chains.merged(lists, variants.select("qid", F.col("no").alias("list_no")), TOP, "rrf")
    return merged.select("qid", "rank", F.col("id").alias("doc_id"), "score", "n_lists", "n_failed")


def result_shape(spark, d):
    """Hits as they are shown: rank, score of the last step that gave one, title, excerpt."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.split("text", "\n")[0].alias("title"), F.substring("text", 1, 300).alias("excerpt"))
    hits = lexical(spark, d, 3).withColumn("mmr_score", F.when(F.col("rank") == 2, 0.5)).withColumn("rerank_score", F.when(F.col("rank") == 1, 0.9))
    return hits.join(docs, "id").select("qid", "rank", F.coalesce("rerank_score", "mmr_score", "score").alias("score"), "title", "excerpt", F.col("id").alias("doc_id"))


def export_json(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.split("text", "\n")[0].alias("title"))
    return reports.result_json(lexical(spark, d, 2).join(docs, "id").withColumnRenamed("id", "doc_id"), F.create_map(F.lit("method"), F.lit("keyword")), "2024-01-01T00:00:00Z")


def cache_ttl(spark, d):
    """Events as cache entries with a life of k hours: expired and live ones at the end of the log."""
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("as_of"))
    ttl = F.get_json_object("props", "$.k").cast("long") * 3600
    out = e.crossJoin(F.broadcast(last)).withColumn("expired", rows.expired(F.col("ts"), F.when(F.col("event_type") != "error", ttl), F.col("as_of")))
    return out.groupBy("event_type", "expired").agg(F.count("*").alias("n"))


def job_progress(spark, d):
    """Each order as a job: lines shipped by a day, of all, after as many days."""
    line, day = table(spark, d, "lineitem"), F.lit("1997-01-01").cast("timestamp_ntz")
    by = line.groupBy("l_orderkey").agg(F.count_if(F.col("l_shipdate") < day).alias("done"), F.count("*").alias("total"))
    return by.withColumn("p", rows.progress(F.col("done"), F.col("total"), F.lit(3600.0))).select("l_orderkey", "done", "total", F.col("p.percent").alias("percent"), F.col("p.seconds_left").alias("seconds_left"))


def file_manifest(spark, d):
    """Addresses as file names, page lengths as sizes."""
    p = table(spark, d, "pages").select("page_id", F.concat(F.regexp_replace("url", "^https?://", ""), F.when(F.col("page_id") % 3 == 0, ".html").otherwise(".exe")).alias("name"), F.when(F.col("page_id") % 5 == 0, 0).otherwise(F.length("html") * 1000).cast("long").alias("size"))
    return p.select("page_id", F.array_join(rows.file_problems(F.col("name"), F.col("size")), ",").alias("problems"))


def request_paths(spark, d):
    """Requests by path prefix, excluded or not, and their success."""
    k = F.get_json_object("props", "$.k").cast("int")
    path = F.when(k % 4 == 0, "/health").when(k % 4 == 1, "/static/a.css").otherwise(F.concat(F.lit("/item/"), k % 3))
    r = table(spark, d, "events").select(path.alias("path"), rows.succeeded(F.when(F.col("event_type") == "error", 500).otherwise(200 + k)).alias("ok"))
    return r.groupBy("path").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok")).withColumn("excluded", rows.excluded_path(F.col("path")))


def user_lists(spark, d):
    """The third page of two of each customer's orders, newest first."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("no")).where("no between 5 and 6")


def variant_lines(spark, d):
    """Lines of assistants' answers as variants of the question before."""
    c = table(spark, d, "conversations").where("role = 'assistant'")
    out = c.select("conv_id", "turn", F.posexplode(expand.variant_lines(F.col("text"), F.lit("original question"), 3)).alias("no", "variant"))
    return out.select("conv_id", "turn", F.col("no").cast("long").alias("no"), "variant")


QUERIES = {f.__name__: f for f in (glob_purge, category_whitelist, not_indexed, multi_query, result_shape, export_json, cache_ttl, job_progress, file_manifest, request_paths, user_lists, variant_lines)}

_K = "(props->>'$.k')::BIGINT"
_IN = ", ".join(f"'{c}'" for c in rows.CATEGORIES)
ORACLES = {
    "glob_purge": "SELECT source, count(*) AS n FROM documents WHERE NOT regexp_full_match(source, 'src1.*') AND NOT regexp_full_match(source, 's.c2') GROUP BY 1",
    "category_whitelist": f"SELECT category, count(*) AS n, category IN ({_IN}) AS known FROM (SELECT CASE lang WHEN 'en' THEN 'cs.LG' WHEN 'de' THEN 'cs.DS' ELSE 'cs.' || upper(lang) END AS category FROM documents) GROUP BY 1",
    "not_indexed": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "multi_query": f"""WITH {lexical_sql(2 * TOP).replace('FROM benchmark', f'FROM {_VARIANTS}')}, fu AS (SELECT qid // 10 AS qid, id, round(sum(1.0 / (60.0::DOUBLE + rank)), 6) AS score, count(*) AS n_lists FROM lex GROUP BY 1, 2),
      va AS (SELECT item_id // 10 AS qid, count(*) AS n FROM {_VARIANTS} GROUP BY 1), fo AS (SELECT qid // 10 AS qid, count(DISTINCT qid) AS n FROM lex GROUP BY 1)
      SELECT qid, rank, id AS doc_id, score, n_lists, va.n - fo.n AS n_failed FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fu) JOIN va USING (qid) JOIN fo USING (qid) WHERE rank <= {TOP}""",
    "result_shape": f"WITH {lexical_sql(3)} SELECT qid, rank, CASE rank WHEN 1 THEN 0.9::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE score END AS score, string_split(text, chr(10))[1] AS title, substring(text, 1, 300) AS excerpt, doc_id FROM lex JOIN documents ON doc_id = id",
    "export_json": f"""WITH {lexical_sql(2)}, r AS (SELECT qid, rank, id, score, string_split(text, chr(10))[1] AS title FROM lex JOIN documents ON doc_id = id)
      SELECT qid, '{{"timestamp":"2024-01-01T00:00:00Z","metadata":{{"method":"keyword"}},"count":' || count(*) || ',"results":[' || string_agg('{{"rank":' || rank || ',"doc_id":' || id || ',"title":' || to_json(title) || ',"score":' || score || '}}', ',' ORDER BY rank) || ']}}' AS json FROM r GROUP BY qid""".replace("{{", "{").replace("}}", "}"),
    "cache_ttl": f"SELECT event_type, coalesce(CASE WHEN event_type <> 'error' THEN floor(epoch((SELECT max(ts) FROM events)))::BIGINT - floor(epoch(ts))::BIGINT > {_K} * 3600 END, false) AS expired, count(*) AS n FROM events GROUP BY 1, 2",
    "job_progress": "SELECT l_orderkey, done, total, round(100.0::DOUBLE * done / total, 4) AS percent, CASE WHEN done > 0 THEN round((total - done) / (done / 3600.0::DOUBLE), 4) END AS seconds_left FROM (SELECT l_orderkey, count_if(l_shipdate < '1997-01-01')::BIGINT AS done, count(*) AS total FROM lineitem GROUP BY 1)",
    "file_manifest": """WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') || CASE WHEN page_id % 3 = 0 THEN '.html' ELSE '.exe' END AS name, CASE WHEN page_id % 5 = 0 THEN 0 ELSE length(html) * 1000 END AS size FROM pages)
      SELECT page_id, array_to_string(list_filter([CASE WHEN lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) NOT IN ('pdf', 'txt', 'md', 'html') THEN 'extension' END, CASE WHEN size > 10485760 THEN 'size' END, CASE WHEN size = 0 THEN 'empty' END, CASE WHEN contains(name, '..') THEN 'traversal' END, CASE WHEN NOT regexp_matches(name, '^[A-Za-z0-9._ /-]+$') THEN 'name' END], lambda x: x IS NOT NULL), ',') AS problems FROM p""",
    "request_paths": f"WITH r AS (SELECT CASE {_K} % 4 WHEN 0 THEN '/health' WHEN 1 THEN '/static/a.css' ELSE '/item/' || ({_K} % 3) END AS path, CASE WHEN event_type = 'error' THEN false ELSE 200 + {_K} < 400 END AS ok FROM events) SELECT path, count(*) AS n, count_if(ok)::BIGINT AS n_ok, path IN ('/health', '/metrics') OR starts_with(path, '/static/') OR starts_with(path, '/docs') AS excluded FROM r GROUP BY 1",
    "user_lists": "SELECT o_custkey, o_orderkey, no FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS no FROM orders) WHERE no BETWEEN 5 AND 6",
    "variant_lines": """WITH l AS (SELECT conv_id, turn, ['original question'] || list_filter([trim(x) FOR x IN string_split(text, chr(10))], lambda x: length(x) > 3) AS a FROM conversations WHERE role = 'assistant'),
      u AS (SELECT conv_id, turn, x, min(i) AS i FROM (SELECT conv_id, turn, unnest(a) AS x, unnest(range(0, len(a))) AS i FROM l) GROUP BY conv_id, turn, x), r AS (SELECT conv_id, turn, x AS variant, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS no FROM u) SELECT conv_id, turn, no, variant FROM r WHERE no <= 3""",
}
