"""Queries on models, evaluation and exports of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.operators import evals, models, vectors
from textquarry.plans.retrieval import TOP, lexical, lexical_sql, semantic, table
from textquarry.sources import reports


def results(spark, d, excerpt: int = 300):
    """Lexical hits with the metadata of their documents and the beginning of their texts."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.split("text", "\n")[0].alias("title"), F.concat(F.col("source"), F.lit(", "), F.col("lang")).alias("authors"), F.concat((F.lit(2000) + F.col("doc_id") % 25).cast("string"), F.lit("-01-02")).alias("published"), F.concat(F.lit("http://x/"), F.col("doc_id")).alias("link"), F.substring("text", 1, excerpt).alias("text"))
    return lexical(spark, d, 5).join(docs, "id").withColumnRenamed("id", "doc_id")


def citations(spark, d):
    r = results(spark, d)
    return r.select("qid", "rank", *(reports.citation(s).alias(s) for s in reports.STYLES))


def bibtex(spark, d):
    return results(spark, d).select("qid", "rank", reports.bibtex().alias("entry"))


def context_strings(spark, d):
    return reports.contexts(results(spark, d))


#: Characters of a source, and of all sources, in a prompt.
EACH, WHOLE = 2000, 32_000


def prompts(spark, d):
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return reports.prompts(reports.bounded_contexts(results(spark, d, EACH), EACH, WHOLE), questions)


def export_csv(spark, d):
    return reports.result_table(results(spark, d))


def export_markdown(spark, d):
    answers = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.concat(F.lit("See "), F.lower("text")).alias("answer"))
    return reports.markdown(results(spark, d), answers)


def export_audit(spark, d):
    return reports.audit_table(table(spark, d, "events").select("event_id", "user_id", "event_type", F.when(F.col("event_type") == "error", None).otherwise(F.col("user_id") % 2 == 0).alias("success")))


def embed_hash(spark, d):
    return models.embed(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm"), "error")


def _candidates(spark, d):
    e = table(spark, d, "embeddings")
    q = table(spark, d, "benchmark").join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("qid"), F.col("embedding").alias("query_vector"))
    found = vectors.search(e, q, 20, query_vector="query_vector")
    return found.join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id").join(q, "qid")


def mmr_topk(spark, d):
    return models.mmr(_candidates(spark, d), 5).withColumn("mmr_score", F.round("mmr_score", 6))


def mmr_full(spark, d):
    return models.mmr(_candidates(spark, d), 20, full=True).withColumn("mmr_score", F.round("mmr_score", 6))


def rerank_overlap(spark, d):
    pairs = lexical(spark, d, 20).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id").join(table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query")), "qid")
    return models.rerank(pairs, 5).select("qid", F.col("id").alias("doc_id"), F.round("rerank_score", 6).alias("rerank_score"), "rank")


def chunks_sentence(spark, d):
    return models.sentence_chunks(table(spark, d, "documents"), "doc_id", "text")


def chunks_semantic(spark, d):
    return models.semantic_chunks(table(spark, d, "documents"), "doc_id", "text", least=0.3)


def warm_embeddings(spark, d):
    """Vectors of the commonest questions, whole messages, without the benchmark questions that the table of vectors has already."""
    asked = table(spark, d, "conversations").where("role = 'user'").groupBy(F.lower("text").alias("query")).agg(F.count("*").alias("n"))
    known = table(spark, d, "benchmark").join(table(spark, d, "embeddings"), F.col("item_id") == F.col("vec_id"), "left_semi").select(F.lower("text").alias("query"))
    common = asked.join(known, "query", "left_anti").orderBy(F.desc("n"), "query").limit(100)
    return models.embed(common, "query").select("query", "n", F.size("embedding").cast("long").alias("dim"), "error")


def _relevant(spark, d):
    """A question's relevant vectors: those of its own label."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid")).join(e.select(F.col("id").alias("qid"), "label"), "qid").join(e, "label").where("id != qid").select("qid", "id")


def eval_quality(spark, d):
    return evals.quality(semantic(spark, d, TOP), _relevant(spark, d), TOP)


def _runs(spark, d):
    a, b = semantic(spark, d, 5).withColumn("config", F.lit("semantic")), lexical(spark, d, 5).withColumn("config", F.lit("lexical"))
    return a.select("config", "qid", "id", "rank", "score").unionByName(b.select("config", "qid", "id", "rank", "score"))


def eval_run(spark, d):
    return evals.runs(_runs(spark, d))


def eval_compare(spark, d):
    return evals.comparison(evals.runs(_runs(spark, d)), ["n", "mean_score", "max_score"], ["lexical", "semantic"])


QUERIES = {f.__name__: f for f in (citations, bibtex, context_strings, prompts, export_csv, export_markdown, export_audit, embed_hash, mmr_topk, mmr_full, rerank_overlap, chunks_sentence, chunks_semantic, warm_embeddings, eval_quality, eval_run, eval_compare)}

from textquarry.plans.retrieval import WORDS, semantic_sql  # noqa: E402

#: Length of the vectors of the built-in embedding.
DIM = 64

_RES = f"""{lexical_sql(5)}, re AS (SELECT qid, id AS doc_id, score, rank, string_split(text, chr(10))[1] AS title, source || ', ' || lang AS authors, (2000 + doc_id % 25) || '-01-02' AS published, 'http://x/' || doc_id AS link, substring(text, 1, 300) AS text FROM lex JOIN documents ON doc_id = id)"""


def _style(t: str) -> str:
    return "'" + t.replace("'", "''").replace("{authors}", "' || authors || '").replace("{year}", "' || substring(published, 1, 4) || '").replace("{title}", "' || title || '") + "'"


_JOIN = "SELECT qid, string_agg({line}, {sep} ORDER BY rank) AS text FROM re GROUP BY qid"
_RUN = f"""{semantic_sql(5)}, {lexical_sql(5)}, ru AS (SELECT 'semantic' AS config, qid, id, rank, score FROM sem UNION ALL SELECT 'lexical', qid, id, rank, score FROM lex),
rs AS (SELECT config, qid, count(*) AS n, round(avg(score), 6) AS mean_score, max(score) AS max_score, string_agg(id::VARCHAR, ',' ORDER BY rank) AS ids FROM ru GROUP BY config, qid)"""
ORACLES = {
    "rerank_overlap": f"""WITH {lexical_sql(20)}, tx AS (SELECT doc_id AS id, list_distinct({WORDS.format(t='text')}) AS tw FROM documents), qx AS (SELECT item_id AS qid, list_distinct({WORDS.format(t='text')}) AS qw FROM benchmark),
      s AS (SELECT qid, id, CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, tw)) / len(qw)::DOUBLE ELSE 0 END AS s FROM lex JOIN tx USING (id) JOIN qx USING (qid)) SELECT qid, id AS doc_id, round(s, 6) AS rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM s) WHERE rank <= 5""",
    "warm_embeddings": f"""WITH k AS (SELECT lower(text) AS q FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings)), a AS (SELECT lower(text) AS q, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1)
      SELECT q AS query, n, {DIM}::BIGINT AS dim, NULL::VARCHAR AS error FROM a WHERE q NOT IN (SELECT q FROM k) ORDER BY n DESC, q LIMIT 100""",
    "citations": f"WITH {_RES} SELECT qid, rank, {', '.join(f'{_style(t)} AS {chr(34)}{s}{chr(34)}' for s, t in reports.STYLES.items())} FROM re",
    "bibtex": f"WITH {_RES} SELECT qid, rank, '@article{{' || trim(string_split(authors, ',')[1]) || substring(published, 1, 4) || doc_id || ',' || chr(10) || '  title={{{{' || title || '}}}},' || chr(10) || '  author={{{{' || authors || '}}}},' || chr(10) || '  journal={{{{arXiv preprint arXiv:' || doc_id || '}}}},' || chr(10) || '  year={{{{' || substring(published, 1, 4) || '}}}},' || chr(10) || '}}' || chr(10) AS entry FROM re".replace("{{{{", "{{").replace("}}}}", "}}").replace("'}}' || chr(10) AS", "'}' || chr(10) AS").replace("@article{{'", "@article{'"),
    "context_strings": f"WITH {_RES} {_JOIN.format(line='''concat('[', rank, '] ', title, chr(10), 'SOURCE: ', link, chr(10), 'EXCERPT: ', text, chr(10))''', sep='chr(10)')}",
    "prompts": f"WITH {_RES.replace('substring(text, 1, 300)', 'substring(text, 1, 2000)')}, c AS ({_JOIN.format(line='''concat('[', rank, '] ', title, chr(10), substring(text, 1, 2000), chr(10))''', sep='chr(10)')}), d AS (SELECT qid, CASE WHEN length(text) > 32000 THEN substring(text, 1, 32000) || chr(10) || '...(truncated)' ELSE text END AS text FROM c) SELECT qid, 'Answer the question from the numbered sources below and cite them by number.' || chr(10) || chr(10) || 'Question: ' || b.text || chr(10) || chr(10) || 'Sources:' || chr(10) || d.text || chr(10) || 'Answer:' AS prompt FROM d JOIN benchmark b ON item_id = qid",
    "export_csv": f"WITH {_RES} SELECT qid, rank, title, authors, substring(published, 1, 4) AS year, link, score FROM re",
    "export_markdown": f"WITH {_RES}, c AS ({_JOIN.format(line='''concat(rank, '. **', title, '** - ', authors, ' (', substring(published, 1, 4), ')  ', chr(10), '   <', link, '>')''', sep='chr(10)')}) SELECT item_id AS qid, '# ' || b.text || chr(10) || chr(10) || 'See ' || lower(b.text) || chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || coalesce(c.text, '') || chr(10) AS text FROM benchmark b LEFT JOIN c ON qid = item_id",
    "export_audit": "SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id, event_type, coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE (user_id % 2 = 0)::VARCHAR END, '') AS success FROM events",
    "eval_quality": f"""WITH {semantic_sql(TOP)}, e AS (SELECT b.item_id AS qid, y.vec_id AS id FROM benchmark b JOIN embeddings x ON x.vec_id = b.item_id JOIN embeddings y ON y.label = x.label AND y.vec_id <> x.vec_id),
      g AS (SELECT qid, count(*) AS n_relevant, count(rank) AS n_hits, min(rank) AS first, coalesce(sum(1 / log2(rank + 1)), 0) AS dcg FROM e LEFT JOIN sem USING (qid, id) GROUP BY qid)
      SELECT qid, n_relevant, n_hits, round(n_hits / 10::DOUBLE, 6) AS precision, round(n_hits / n_relevant::DOUBLE, 6) AS recall, round(coalesce(1 / first::DOUBLE, 0), 6) AS reciprocal_rank, round(dcg / list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM g""",
    "eval_run": f"WITH {_RUN} SELECT * FROM rs",
    "eval_compare": f"WITH {_RUN}, m AS (SELECT config, round(avg(n), 6) AS n, round(avg(mean_score), 6) AS mean_score, round(avg(max_score), 6) AS max_score FROM rs GROUP BY config), l AS (SELECT config, 'n' AS metric, n::DOUBLE AS v FROM m UNION ALL SELECT config, 'mean_score', mean_score FROM m UNION ALL SELECT config, 'max_score', max_score FROM m) SELECT metric, max(v) FILTER (config = 'lexical') AS lexical, max(v) FILTER (config = 'semantic') AS semantic FROM l GROUP BY metric",
}
