"""Queries on retrieval: the benchmark questions against documents and vectors. A question's vector is that of its own number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import word_tokens
from textquarry.operators import bm25, fusion, vector_index, vectors

TOP = 10


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index_of(spark, d: str, tokens: str = "words", where: str = "true") -> bm25.Index:
    """The stored index of the documents that meet a condition; the first query that needs it builds it."""
    return bm25.stored_index(spark, f"{d}/documents.parquet", "doc_id", "text", tokens, where)


def lexical(spark, d: str, k: int, tokens: str = "words", **options) -> DataFrame:
    return bm25.search(index_of(spark, d, tokens), table(spark, d, "benchmark"), k, tokens=tokens, **options)


def asked(spark, d: str) -> DataFrame:
    """Vectors of the questions."""
    return table(spark, d, "benchmark").join(table(spark, d, "embeddings"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("qid"), F.col("embedding").alias("vector"))


def semantic(spark, d: str, k: int, **options) -> DataFrame:
    return vectors.search(table(spark, d, "embeddings"), asked(spark, d), k, **options)


def ranked(df: DataFrame) -> DataFrame:
    return df.select("qid", "rank", F.col("id").alias("doc_id"), "score")


# DuckDB twins -------------------------------------------------------------------------------------------------

WORDS = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+')"
CLEAN = "list_filter(regexp_split_to_array(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 2)"
BLANK = "list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda x: x <> '')"
PLAIN = "ln(n - df + 0.5) - ln(df + 0.5)"
IDF = {
    "floor": "CASE WHEN raw < 0 THEN greatest(raw, 0.25 * avg(raw) OVER ()) ELSE raw END",
    "package": "CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END",
}
RAW = {"floor": PLAIN, "package": PLAIN, "okapi": "ln((n - df + 0.5) / (df + 0.5) + 1)", "l": "ln((n + 1) / (df + 0.5))", "plus": "ln((n + 1) / df::DOUBLE) + 0.25"}


def lexical_sql(k: int, tokens: str = WORDS, variant: str = "floor", k1: float = 1.2, keep: str = "true") -> str:
    """CTEs up to lex (qid, id, score, rank)."""
    return f"""dt AS (SELECT doc_id AS id, unnest({tokens.format(t="text")}) AS term FROM documents),
po AS (SELECT id, term, count(*) AS tf FROM dt GROUP BY id, term),
le AS (SELECT doc_id AS id, coalesce(len({tokens.format(t="text")}), 0) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM le),
te AS (SELECT term, count(*) AS df FROM po GROUP BY term),
ra AS (SELECT term, {RAW[variant]} AS raw FROM te, st),
idf AS (SELECT term, {IDF.get(variant, "raw")} AS idf FROM ra),
qt AS (SELECT qid, term, count(*) AS m FROM (SELECT item_id AS qid, unnest({tokens.format(t="text")}) AS term FROM benchmark) GROUP BY qid, term),
sc AS (SELECT qid, id, round(sum(m * (idf * tf * {k1 + 1} / (tf + {k1} * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
  FROM qt JOIN po USING (term) JOIN idf USING (term) JOIN le USING (id), st WHERE {keep} GROUP BY qid, id),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc WHERE score > 0) WHERE rank <= {k})"""


def semantic_sql(k: int, keep: str = "true") -> str:
    """CTEs up to sem (qid, id, score, rank)."""
    dot = "list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i]::DOUBLE * b[i]::DOUBLE))"
    norm = "sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)))"
    return f"""qv AS (SELECT item_id AS qid, embedding AS a, {norm.format(v="embedding")} AS na FROM benchmark JOIN embeddings ON item_id = vec_id),
cv AS (SELECT vec_id AS id, embedding AS b, {norm.format(v="embedding")} AS nb FROM embeddings WHERE {keep}),
sv AS (SELECT qid, id, round({dot} / (na * nb), 6) + 0.0 AS score FROM qv, cv),
sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sv) WHERE rank <= {k})"""


OUT = "SELECT qid, rank, id AS doc_id, score FROM {t}"


def final_sql(ctes: str, body: str, k: int = TOP) -> str:
    """Ranks what body (qid, id, score) gives and cuts it to k."""
    return f"WITH {ctes}, fu AS ({body}) SELECT qid, rank, id AS doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fu) WHERE rank <= {k}"


BOTH = "SELECT *, 0 AS list_no FROM sem UNION ALL BY NAME SELECT *, 1 AS list_no FROM lex"


# Queries ------------------------------------------------------------------------------------------------------


def tokenize_counts(spark, d):
    """Tokens of each document."""
    t = table(spark, d, "documents").select("doc_id", word_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


def postings_df_idf(spark, d):
    """Document frequency and floored inverse document frequency of every term."""
    index = index_of(spark, d)
    return bm25.idf(index).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_floor_topk(spark, d):
    return ranked(lexical(spark, d, TOP))


def bm25_variant(variant: str):
    def query(spark, d):
        return ranked(lexical(spark, d, TOP, tokens="clean", variant=variant, k1=1.5))

    return query


def bm25_subset(spark, d):
    """Documents of one source as candidates, statistics over all."""
    docs = table(spark, d, "documents")
    return ranked(lexical(spark, d, TOP, tokens="clean", variant="okapi", k1=1.5, subset=docs.where("source in ('src1', 'src2', 'src3')").select(F.col("doc_id").alias("id"))))


def vector_topk(spark, d):
    return ranked(semantic(spark, d, TOP))


def vector_topk_filtered(spark, d):
    return ranked(semantic(spark, d, TOP, condition="label between 1 and 3"))


#: Similarity from which a stored answer serves another question.
SAME = 0.85


def semantic_near_dupes(spark, d):
    """Stored vectors that could serve others: for every row whose id is divisible by 100 the best other row of all, and whether it is similar enough."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    found = vectors.search(e, q, 2).where("qid != id")
    best = found.groupBy("qid").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("match_id"), F.max("score").alias("score"))
    return best.withColumn("same", F.col("score") >= SAME)


def hybrid_rrf_alpha(spark, d):
    return ranked(fusion.rrf(fusion.lists_of(semantic(spark, d, 2 * TOP), lexical(spark, d, 2 * TOP)), TOP, {0: 0.6, 1: 0.4}))


def hybrid_rrf_weighted(spark, d):
    return ranked(fusion.rrf(fusion.lists_of(semantic(spark, d, 2 * TOP), lexical(spark, d, 2 * TOP, tokens="clean", variant="okapi", k1=1.5)), TOP, {0: 0.5, 1: 0.5}))


def package_lexical(spark, d, k):
    return lexical(spark, d, k, tokens="blank", variant="package", k1=1.5)


def hybrid_maxnorm(spark, d):
    return ranked(fusion.max_normalised(semantic(spark, d, 4 * TOP), package_lexical(spark, d, 4 * TOP), TOP))


def hybrid_ranknorm(spark, d):
    n = table(spark, d, "documents").agg(F.least(F.count("*"), F.lit(4 * TOP)).alias("n_lex"))
    lex = package_lexical(spark, d, 4 * TOP).crossJoin(F.broadcast(n))
    return ranked(fusion.rank_normalised(semantic(spark, d, 4 * TOP), lex, F.col("n_lex"), TOP))


def hybrid_avg(spark, d):
    return ranked(fusion.averaged(semantic(spark, d, 2 * TOP), lexical(spark, d, 2 * TOP), TOP))


def three_lists(spark, d) -> DataFrame:
    k = 2 * TOP
    return fusion.lists_of(semantic(spark, d, k), lexical(spark, d, k), package_lexical(spark, d, k))


def multi_rrf(spark, d):
    return ranked(fusion.rrf(three_lists(spark, d), TOP))


def multi_weighted(spark, d):
    return ranked(fusion.weighted_merge(three_lists(spark, d), TOP))


def multi_union(spark, d):
    return ranked(fusion.union_merge(three_lists(spark, d), TOP))


def ensemble_flattened(spark, d):
    return ranked(fusion.rrf(fusion.flattened(three_lists(spark, d)), TOP))


def norm_minmax(spark, d):
    s = lexical(spark, d, TOP)
    return s.select("qid", F.col("id").alias("doc_id"), F.round(fusion.minmax(s), 6).alias("score"))


def norm_zscore(spark, d):
    return lexical(spark, d, TOP).select("qid", F.col("id").alias("doc_id"), F.round(fusion.zscore(), 6).alias("score"))


def norm_combine(spark, d):
    """Semantic hits with their own keyword scores, however far down the keyword list they are."""
    near = semantic(spark, d, 4 * TOP)
    index = index_of(spark, d)
    own = bm25.score(index, bm25.query_terms(table(spark, d, "benchmark"), "item_id", "text"), near)
    both = near.join(own.select("qid", "id", F.col("score").alias("keyword_score")), ["qid", "id"], "left").na.fill(0.0, ["keyword_score"])
    return both.select("qid", F.col("id").alias("doc_id"), F.round(fusion.combined(both, "score", "keyword_score"), 6).alias("score"))


def low_quality_flag(spark, d):
    """Questions whose best hit is below 0.3."""
    return semantic(spark, d, 2 * TOP).where("qid != id").groupBy("qid").agg(F.max("score").alias("top_score"), F.count("*").alias("n_candidates")).withColumn("low_quality", F.col("top_score") < 0.3)


def ann_ivf_topk(spark, d):
    """The nearest rows by the stored index: lists, codes, exact scores of a shortlist."""
    return ranked(vector_index.search(vector_index.stored(spark, f"{d}/embeddings.parquet"), asked(spark, d), TOP))


PACKAGE = dict(tokens=BLANK, variant="package", k1=1.5)
THREE = f"sem3 AS (SELECT *, 0 AS list_no FROM sem UNION ALL BY NAME SELECT *, 1 AS list_no FROM lex UNION ALL BY NAME SELECT *, 2 AS list_no FROM lex2)"


def second(sql: str) -> str:
    """The CTEs of a second lexical search under other names."""
    import re

    return re.sub(r"\b(dt|po|le|st|te|ra|idf|qt|sc|lex)\b(?!\()", r"\g<1>2", sql).replace("idf2.", "idf.")


def three_sql() -> str:
    k = 2 * TOP
    return f"{semantic_sql(k)}, {lexical_sql(k)}, {second(lexical_sql(k, **PACKAGE))}, {THREE}"


QUERIES = {
    "tokenize_counts": tokenize_counts,
    "postings_df_idf": postings_df_idf,
    "bm25_floor_topk": bm25_floor_topk,
    "bm25_okapi_topk": bm25_variant("okapi"),
    "bm25_l_topk": bm25_variant("l"),
    "bm25_plus_topk": bm25_variant("plus"),
    "bm25_subset": bm25_subset,
    "vector_topk": vector_topk,
    "vector_topk_filtered": vector_topk_filtered,
    "semantic_near_dupes": semantic_near_dupes,
    "hybrid_rrf_alpha": hybrid_rrf_alpha,
    "hybrid_rrf_weighted": hybrid_rrf_weighted,
    "hybrid_maxnorm": hybrid_maxnorm,
    "hybrid_ranknorm": hybrid_ranknorm,
    "hybrid_avg": hybrid_avg,
    "multi_rrf": multi_rrf,
    "multi_weighted": multi_weighted,
    "multi_union": multi_union,
    "ensemble_flattened": ensemble_flattened,
    "norm_minmax": norm_minmax,
    "norm_zscore": norm_zscore,
    "norm_combine": norm_combine,
    "low_quality_flag": low_quality_flag,
    "ann_ivf_topk": ann_ivf_topk,
}

K2, K4 = 2 * TOP, 4 * TOP
OKAPI = dict(tokens=CLEAN, variant="okapi", k1=1.5)
RRF = "SELECT qid, id, round(sum(w / (60.0 + rank)), 6) AS score FROM ({src}) GROUP BY qid, id"
ORACLES = {
    "tokenize_counts": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_terms FROM (SELECT doc_id, {WORDS.format(t='text')} AS t FROM documents)",
    "postings_df_idf": f"WITH {lexical_sql(TOP).split('qt AS')[0].rstrip().rstrip(',')} SELECT term, df, round(idf, 6) AS idf FROM te JOIN idf USING (term)",
    "bm25_floor_topk": f"WITH {lexical_sql(TOP)} {OUT.format(t='lex')}",
    **{f"bm25_{v}_topk": f"WITH {lexical_sql(TOP, CLEAN, v, 1.5)} {OUT.format(t='lex')}" for v in ("okapi", "l", "plus")},
    "bm25_subset": f"WITH {lexical_sql(TOP, **OKAPI, keep='''id IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3'))''')} {OUT.format(t='lex')}",
    "vector_topk": f"WITH {semantic_sql(TOP)} {OUT.format(t='sem')}",
    "vector_topk_filtered": f"WITH {semantic_sql(TOP, 'label BETWEEN 1 AND 3')} {OUT.format(t='sem')}",
    "semantic_near_dupes": f"""WITH {semantic_sql(TOP).replace('FROM benchmark JOIN embeddings ON item_id = vec_id', 'FROM embeddings WHERE vec_id % 100 = 0').replace('SELECT item_id AS qid', 'SELECT vec_id AS qid')},
      o AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM sv WHERE qid <> id) SELECT qid, id AS match_id, score, score >= {SAME} AS same FROM o WHERE r = 1""",
    "hybrid_rrf_alpha": final_sql(f"{semantic_sql(K2)}, {lexical_sql(K2)}", RRF.format(src=f"SELECT *, CASE list_no WHEN 0 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS w FROM ({BOTH})")),
    "hybrid_rrf_weighted": final_sql(f"{semantic_sql(K2)}, {lexical_sql(K2, **OKAPI)}", RRF.format(src=f"SELECT *, 0.5::DOUBLE AS w FROM ({BOTH})")),
    "hybrid_maxnorm": final_sql(f"{semantic_sql(K4)}, {lexical_sql(K4, **PACKAGE)}, nl AS (SELECT qid, id, score / greatest(max(score) OVER (PARTITION BY qid), 0.001) AS l FROM lex)", "SELECT qid, id, round(0.7::DOUBLE * score + (1 - 0.7::DOUBLE) * coalesce(l, 0), 8) AS score FROM sem LEFT JOIN nl USING (qid, id)"),
    "hybrid_ranknorm": final_sql(f"{semantic_sql(K4)}, {lexical_sql(K4, **PACKAGE)}, nl AS (SELECT qid, id, 1 - (rank - 1) / least((SELECT n FROM st), {K4})::DOUBLE AS l FROM lex)", "SELECT qid, id, round(0.7::DOUBLE * score + (1 - 0.7::DOUBLE) * coalesce(l, 0), 8) AS score FROM sem LEFT JOIN nl USING (qid, id)"),
    "hybrid_avg": final_sql(f"{semantic_sql(K2)}, {lexical_sql(K2)}", f"SELECT qid, id, round(sum(score) / 2, 8) AS score FROM ({BOTH}) GROUP BY qid, id"),
    "multi_rrf": final_sql(three_sql(), RRF.format(src="SELECT *, 1.0::DOUBLE AS w FROM sem3")),
    "multi_weighted": final_sql(three_sql(), "SELECT qid, id, round(sum(CASE list_no WHEN 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END / rank), 6) AS score FROM sem3 GROUP BY qid, id"),
    "multi_union": f"WITH {three_sql()}, o AS (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY list_no, rank) AS r FROM sem3) SELECT qid, r2 AS rank, id AS doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY list_no, rank, id) AS r2 FROM o WHERE r = 1) WHERE r2 <= {TOP}",
    "ensemble_flattened": final_sql(three_sql(), RRF.format(src="SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY list_no, rank, id) AS rank, 1.0::DOUBLE AS w FROM sem3")),
    "norm_minmax": f"WITH {lexical_sql(TOP)} SELECT qid, id AS doc_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS score FROM lex WINDOW w AS (PARTITION BY qid)",
    "norm_zscore": f"WITH {lexical_sql(TOP)} SELECT qid, id AS doc_id, round(CASE WHEN count(*) OVER w < 2 THEN 1.0 WHEN stddev_pop(score) OVER w < 1e-12 THEN 0.0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END, 6) AS score FROM lex WINDOW w AS (PARTITION BY qid)",
    "norm_combine": f"""WITH {semantic_sql(K4)}, {lexical_sql(TOP)}, j AS (SELECT s.qid, s.id, s.score AS a, greatest(coalesce(l.score, 0), 0) AS b FROM sem s LEFT JOIN sc l USING (qid, id))
      SELECT qid, id AS doc_id, round(0.7::DOUBLE * CASE WHEN max(a) OVER w = min(a) OVER w THEN 0 ELSE (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) END + (1 - 0.7::DOUBLE) * CASE WHEN max(b) OVER w = min(b) OVER w THEN 0 ELSE (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) END, 6) AS score FROM j WINDOW w AS (PARTITION BY qid)""",
    "low_quality_flag": f"WITH {semantic_sql(K2)} SELECT qid, max(score) AS top_score, count(*) AS n_candidates, max(score) < 0.3 AS low_quality FROM sem WHERE qid <> id GROUP BY qid",
}
