"""Queries that put searches together, and on papers as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions import expand
from textquarry.functions.text import word_tokens
from textquarry.operators import bm25, chains, fusion, repository, vectors
from textquarry.plans.results import warm_embeddings
from textquarry.plans.texts import _expanded as expanded_sql
from textquarry.plans.retrieval import BOTH, CLEAN, RRF, TOP, WORDS, final_sql, index_of, lexical, lexical_sql, ranked, second, semantic, semantic_sql, table

#: Languages that a filter on both sides of a search lets through.
SOME = ("en", "fr")


def _variants(spark, d):
    """qid and no of each variant of a question, its text, and its id as a question of its own."""
    b = table(spark, d, "benchmark")
    out = b.select(F.col("item_id").alias("qid"), F.posexplode(expand.variants(F.col("text"))).alias("no", "text"))
    return out.withColumn("item_id", F.col("qid") * 10 + F.col("no"))


def ensemble_rrf(spark, d):
    """Every variant of a question against the documents, and the question's vector against all vectors, fused list by list; both sides are filtered by language."""
    docs = table(spark, d, "documents").where(F.col("lang").isin(*SOME))
    found = bm25.search(index_of(spark, d, where=f"lang IN {SOME}"), _variants(spark, d), 3 * TOP).select(F.floor(F.col("qid") / 10).cast("long").alias("qid"), "id", "rank", "score", (F.pmod("qid", F.lit(10)) + 1).cast("int").alias("list_no"))
    rows = table(spark, d, "embeddings").join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    q = table(spark, d, "benchmark").join(table(spark, d, "embeddings"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("qid"), F.col("embedding").alias("vector"))
    near = vectors.search(rows, q, 3 * TOP).select("qid", "id", "rank", "score", F.lit(0).alias("list_no"))
    return ranked(fusion.rrf(near.unionByName(found), TOP))


def search_switch(spark, d):
    """The three methods side by side; semantic hits of 0.3 or more, keyword hits of 0.7 or more."""
    run = lambda m, least=None: chains.by_method(m, lambda k: semantic(spark, d, k), lambda k: lexical(spark, d, k), TOP, least).withColumn("method", F.lit(m))
    all_ = run("semantic", 0.3).unionByName(run("keyword", 0.7)).unionByName(run("hybrid"))
    return all_.select("method", "qid", "rank", F.col("id").alias("doc_id"), "score")


def bm25_threshold(spark, d):
    """Keyword hits that reach a score of 20 after the cut to ten."""
    return ranked(bm25.search(index_of(spark, d), table(spark, d, "benchmark"), TOP, threshold=20.0))


def text_key_rrf(spark, d):
    """Two lists fused by the first 100 characters of the texts."""
    lists = fusion.lists_of(lexical(spark, d, 2 * TOP), lexical(spark, d, 2 * TOP, tokens="clean", variant="okapi", k1=1.5))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return ranked(chains.rrf_by_text(lists.join(texts, "id"), TOP))


def rank_positions(spark, d):
    lists = fusion.lists_of(semantic(spark, d, TOP), lexical(spark, d, TOP))
    return chains.rank_positions(lists).select("qid", F.col("id").alias("doc_id"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def _sentences(spark, d):
    """The sentences of a question as its sub-questions, those of three words or more."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.posexplode(F.split("text", "[.]")).alias("no", "text"))
    most = b.agg(F.max("no")).first()[0] or 0  # so many numbers are kept for each question that none meets another's
    return b.where(F.size(word_tokens(F.col("text"))) >= 3).withColumn("item_id", F.col("qid") * (most + 1) + F.col("no"))


def sub_questions(spark, d):
    """Three documents for each sub-question, put together for the question."""
    subs = _sentences(spark, d)
    found = bm25.search(index_of(spark, d), subs, 3)
    out = chains.combined_sources(found, subs.select(F.col("item_id").alias("sub_id"), "qid", "no"))
    return out.select("qid", "n_sources", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


def rerank_chain(spark, d):
    """Twenty keyword hits: scaled to 0..1, joined with the share of the question's words, cut to five."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))

    def scaled(df):
        return df.withColumn("score", F.round(fusion.minmax(df), 6))

    def overlap(df):
        q, t = F.array_distinct(word_tokens(F.col("query"))), F.array_distinct(word_tokens(F.col("text")))
        share = F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1))
        both = df.join(texts, "id").join(asked, "qid")
        return both.select("qid", "id", "rank", F.round(F.col("score") * 0.5 + share * 0.5, 6).alias("score"))

    return ranked(chains.reranked(lexical(spark, d, 20), [scaled, overlap], 5))


def chunk_metadata(spark, d):
    """Documents as chunks with a title and a link, some blank: how many are complete, and what the others miss."""
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.when(k % 7 == 0, " ").otherwise(F.split("text", "\n")[0]).alias("title"), F.when(k % 11 != 0, F.concat(F.lit("http://x/"), k)).alias("link"))
    good, bad = chains.complete(rows)
    return good.select("doc_id", F.lit("").alias("missing")).unionByName(bad.select("doc_id", F.array_join("missing", ",").alias("missing")))


def warm_statistics(spark, d):
    """Statistics of embedding the new questions."""
    return chains.warm_up_statistics(warm_embeddings(spark, d))


def paper_author_search(spark, d):
    """Orders as papers: of two clerks' priorities as authors, from one date to another, newest first."""
    o = table(spark, d, "orders").select("o_orderkey", F.array("o_orderpriority", "o_orderstatus").alias("authors"), F.col("o_orderdate").cast("date").alias("published"))
    asked = repository.metadata_filter({"authors": ["1-URGENT", "2-HIGH"], "published_after": "1996-01-01", "published_before": "1996-03-31"})
    return o.where(asked).select("o_orderkey", F.col("published").cast("string").alias("published"))


def recent_rows(spark, d):
    """Events of the last three days of the log."""
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("as_of"))
    return e.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("as_of") - F.expr("INTERVAL 3 DAYS")).select("event_id", "event_type")


def cascade_delete(spark, d):
    """Lines that are left when the orders of one customer segment go with all that hangs on them."""
    gone = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, d, "orders").join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return repository.delete(table(spark, d, "lineitem"), orders, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def token_estimates(spark, d):
    """Both estimates of a document's tokens: its words, and a quarter of its characters."""
    words = F.size(F.filter(F.split(F.regexp_replace("text", "[\\x09-\\x0D]", " "), " "), lambda w: w != ""))
    return table(spark, d, "documents").select("doc_id", words.cast("long").alias("words"), (F.length("text") / 4.0).alias("quarter"))


QUERIES = {f.__name__: f for f in (ensemble_rrf, search_switch, bm25_threshold, text_key_rrf, rank_positions, sub_questions, rerank_chain, chunk_metadata, warm_statistics, paper_author_search, recent_rows, cascade_delete, token_estimates)}

_K2 = 2 * TOP
_WIDE = "(SELECT max(len(string_split(text, '.'))) FROM benchmark)"
_SUBS = f"(SELECT item_id * {_WIDE} + no AS item_id, text FROM (SELECT item_id, unnest(string_split(text, '.')) AS text, unnest(range(0, len(string_split(text, '.')))) AS no FROM benchmark) WHERE len({WORDS.format(t='text')}) >= 3)"
_VARIANTS = f"""(WITH x AS (SELECT item_id, text AS v, trim(regexp_extract(text, '^[^.!?]*')) AS s, trim(regexp_replace(regexp_replace(text, '\\([^)]*\\)', '', 'g'), '\\s+', ' ', 'g')) AS b FROM benchmark),
  y AS (SELECT item_id, [v, {expanded_sql('v', False)}] || CASE WHEN length(s) > 10 THEN [s] ELSE [] END || CASE WHEN length(b) > 5 THEN [b] ELSE [] END AS a FROM x), z AS (SELECT item_id, unnest(a) AS text, unnest(range(0, len(a))) AS i FROM y),
  u AS (SELECT item_id, text, min(i) AS i FROM z GROUP BY item_id, text) SELECT item_id * 10 + row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS item_id, text FROM u)"""
_SOME = "(SELECT * FROM documents WHERE lang IN ('en', 'fr'))"
ORACLES = {
    "ensemble_rrf": final_sql(
        f"{semantic_sql(3 * TOP, f'vec_id IN (SELECT doc_id FROM {_SOME})')}, {lexical_sql(3 * TOP).replace('FROM benchmark', f'FROM {_VARIANTS}').replace('FROM documents', f'FROM {_SOME}')}",
        "SELECT qid, id, round(sum(1 / (60.0::DOUBLE + rank)), 6) AS score FROM (SELECT qid, id, rank FROM sem UNION ALL SELECT qid // 10, id, rank FROM lex) GROUP BY qid, id",
    ),
    "search_switch": f"""WITH {semantic_sql(_K2)}, {lexical_sql(_K2)}, fu AS ({RRF.format(src=f"SELECT *, 1.0::DOUBLE AS w FROM ({BOTH})")}),
      hy AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fu)
      SELECT 'semantic' AS method, qid, rank, id AS doc_id, score FROM sem WHERE rank <= {TOP} AND score >= 0.3 UNION ALL SELECT 'keyword', qid, rank, id, score FROM lex WHERE rank <= {TOP} AND score >= 0.7 UNION ALL SELECT 'hybrid', qid, rank, id, score FROM hy WHERE rank <= {TOP}""",
    "bm25_threshold": f"WITH {lexical_sql(TOP)} SELECT qid, rank, id AS doc_id, score FROM lex WHERE score >= 20",
    "rank_positions": f"WITH {semantic_sql(TOP)}, {lexical_sql(TOP)} SELECT qid, id AS doc_id, string_agg(rank::VARCHAR, ',' ORDER BY list_no) AS positions FROM ({BOTH}) GROUP BY qid, id",
    "sub_questions": f"WITH {lexical_sql(3).replace('FROM benchmark', f'FROM {_SUBS}')} SELECT qid // w AS qid, count(*) AS n_sources, string_agg(id::VARCHAR, ',' ORDER BY qid % w, rank) AS sources FROM lex, {_WIDE.replace(" FROM", " AS w FROM")} GROUP BY 1",
    "rerank_chain": final_sql(
        f"""{lexical_sql(20)}, mm AS (SELECT qid, id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS s FROM lex WINDOW w AS (PARTITION BY qid)),
        tx AS (SELECT doc_id AS id, list_distinct({WORDS.format(t='text')}) AS tw FROM documents), qx AS (SELECT item_id AS qid, list_distinct({WORDS.format(t='text')}) AS qw FROM benchmark)""",
        "SELECT qid, id, round(s * 0.5::DOUBLE + len(list_intersect(qw, tw)) / greatest(len(qw), 1)::DOUBLE * 0.5::DOUBLE, 6) AS score FROM mm JOIN tx USING (id) JOIN qx USING (qid)",
        5,
    ),
    "text_key_rrf": final_sql(
        f"{lexical_sql(_K2)}, {second(lexical_sql(_K2, CLEAN, 'okapi', 1.5))}",
        "SELECT qid, min(id) AS id, round(sum(1 / (60.0::DOUBLE + rank)), 6) AS score FROM (SELECT qid, id, rank FROM lex UNION ALL SELECT qid, id, rank FROM lex2) JOIN documents ON doc_id = id GROUP BY qid, substring(text, 1, 100)",
    ),
    "chunk_metadata": "SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE coalesce(string_split(text, chr(10))[1], '') END) = '' THEN 'title' END, CASE WHEN doc_id % 11 = 0 THEN 'link' END], lambda x: x IS NOT NULL), ',') AS missing FROM documents",
    "warm_statistics": "WITH k AS (SELECT lower(text) AS q FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings)), a AS (SELECT lower(text) AS q, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1), c AS (SELECT q FROM a WHERE q NOT IN (SELECT q FROM k) ORDER BY n DESC, q LIMIT 100) SELECT count(*) AS total, count(*) AS ok, 0::BIGINT AS failed, CASE WHEN count(*) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS success_rate FROM c",
    "paper_author_search": "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS published FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate::DATE BETWEEN '1996-01-01' AND '1996-03-31'",
    "recent_rows": "SELECT event_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAYS",
    "cascade_delete": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY') GROUP BY 1",
    "token_estimates": "SELECT doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words, length(text) / 4.0::DOUBLE AS quarter FROM documents",
}
