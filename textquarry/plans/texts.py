"""Queries on texts: chunks, expansion, suggestions, screening."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textquarry.functions import expand, screen
from textquarry.functions.text import cache_key, fixed_chunks, normalised, token_estimate
from textquarry.operators import suggest
from textquarry.plans.retrieval import table


def chunks_fixed(spark, d):
    chunks = table(spark, d, "documents").select("doc_id", F.posexplode(fixed_chunks(F.col("text"))).alias("chunk_index", "text"))
    return chunks.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


def built(spark, d):
    """Chunks of title and abstract with ids and metadata; a document's first line is its title, its language a tag."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.split("text", "\n")[0].alias("title"), "text")
    whole = F.concat(F.lit("Title: "), F.col("title"), F.lit("\n\nAbstract: "), F.col("text"))
    out = docs.select("doc_id", "source", "lang", "title", F.posexplode(fixed_chunks(whole)).alias("i", "text"))
    return out.select("doc_id", F.concat("doc_id", F.lit("::chunk_"), "i").alias("chunk_id"), F.col("i").cast("long").alias("chunk_index"), "text", "title", "source", "lang")


def index_listing(spark, d):
    """Chunks by title: metadata of the first one, number, preview, running number, total."""
    by = built(spark, d).groupBy("title").agg(F.count("*").alias("n_chunks"), F.min_by(F.struct("doc_id", "source", F.substring("text", 1, 300).alias("preview")), F.struct("doc_id", "chunk_index")).alias("f"))
    total = by.agg(F.count("*").alias("total"))
    listed = by.orderBy(F.desc("n_chunks"), "title").limit(50).withColumn("no", F.row_number().over(Window.orderBy(F.desc("n_chunks"), "title")).cast("long"))
    return listed.crossJoin(F.broadcast(total)).select("no", "title", "n_chunks", F.col("f.doc_id").alias("doc_id"), F.col("f.source").alias("source"), F.col("f.preview").alias("preview"), "total")


def unique_docs(spark, d):
    return table(spark, d, "documents").agg(F.countDistinct(F.nullif(F.split("text", "\n")[0], F.lit(""))).alias("n_titles"), F.count("*").alias("n_docs"))


def asked(spark, d):
    """Short questions from the benchmark: every sentence of each, some with acronyms in front."""
    each = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "[.]")).alias("s", "q"))
    front = F.when(F.col("item_id") % 4 == 0, "LLM model ").when(F.col("item_id") % 4 == 1, "rag ").otherwise("")
    return each.select("item_id", F.col("s").cast("long").alias("sentence"), F.concat(front, "q").alias("q"))


def query_expand(spark, d):
    q = asked(spark, d)
    return q.select("item_id", "sentence", "q", expand.intensity(F.col("q")).alias("intensity"), expand.expandable(F.col("q")).alias("expandable"), expand.expanded(F.col("q")).alias("acronym"), expand.expanded(F.col("q"), "both").alias("both"))


def query_variants(spark, d):
    out = asked(spark, d).select("item_id", "sentence", F.posexplode(expand.variants(F.concat("q", F.lit(" (see above). More")))).alias("no", "variant"))
    return out.select("item_id", "sentence", F.col("no").cast("long").alias("no"), "variant")


def query_templates(spark, d):
    out = asked(spark, d).select("item_id", "sentence", F.posexplode(expand.template_variants(F.col("q"))).alias("no", "variant"))
    return out.select("item_id", "sentence", F.col("no").cast("long").alias("no"), "variant")


def vocab_freq(spark, d):
    return suggest.vocabulary(table(spark, d, "documents"), "text")


def _prefixes(spark, d):
    """Prefixes of questions: four characters of the first word, and the first word with two characters of the next."""
    low = table(spark, d, "benchmark").select(F.lower("text").alias("t"))
    one = low.select(F.substring(F.regexp_extract("t", "[a-z]{3,}", 0), 1, 4).alias("prefix")).where("length(prefix) >= 3")
    return one.union(low.select(F.regexp_extract("t", "[a-z]{3,} [a-z]{2}", 0))).where("prefix != ''").distinct()


def _completions(spark, d, prefixes, single=False):
    """Terms of the documents that the prefixes can get; what users wrote counts as asked."""
    path = f"{d}/conversations.parquet"
    return suggest.stored(spark, f"{d}/documents.parquet", "text", spark.read.parquet(path).where("role = 'user'"), path, prefixes, single)


def suggest_prefix(spark, d):
    prefixes = _prefixes(spark, d)
    return suggest.by_prefix(_completions(spark, d, prefixes), prefixes, 5)


def suggest_fuzzy(spark, d):
    prefixes = _prefixes(spark, d)
    return suggest.fuzzy(_completions(spark, d, prefixes, single=True).vocab, prefixes, 5)


def suggest_all(spark, d):
    prefixes = _prefixes(spark, d)
    return suggest.suggest(_completions(spark, d, prefixes), prefixes, 8)


def _pages(spark, d):
    return table(spark, d, "pages").select("page_id", "html")


def screen_threats(spark, d):
    out = table(spark, d, "documents").select("doc_id", screen.threats(F.col("text")).alias("t"))
    return out.where("size(t) > 0").select("doc_id", F.array_join("t", ",").alias("threats"))


def screen_injection(spark, d):
    """Matches in web pages."""
    out = _pages(spark, d).select("page_id", screen.injections(F.col("html")).alias("t"))
    return out.select("page_id", F.size("t").cast("long").alias("n_found"), F.array_join("t", "|").alias("found"))


def screen_rules(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(screen.question_problems(F.col("text")), ",").alias("problems"))


def sanitize_text(spark, d):
    return _pages(spark, d).select("page_id", F.md5(screen.sanitised(F.col("html"), 100_000)).alias("digest"), F.length(screen.sanitised(F.col("html"), 100_000)).cast("long").alias("n"))


def text_keys(spark, d):
    """Normalised length, token estimate and cache key of each document."""
    return table(spark, d, "documents").select("doc_id", F.length(normalised(F.col("text"))).cast("long").alias("n"), token_estimate(F.col("text")).alias("tokens"), cache_key("q:", F.col("lang"), F.col("source"), F.col("text")).alias("key"))


def semantic_formats(spark, d):
    """Forms of the pages' addresses."""
    return table(spark, d, "pages").select("page_id", screen.formats(F.col("url")).alias("form"))


QUERIES = {f.__name__: f for f in (chunks_fixed, index_listing, unique_docs, query_expand, query_variants, query_templates, vocab_freq, suggest_prefix, suggest_fuzzy, suggest_all, screen_threats, screen_injection, screen_rules, sanitize_text, text_keys)} | {"chunks_built": built, "url_formats": semantic_formats}


def _chunk_sql(source: str, cols: str) -> str:
    """Chunks of column t of source."""
    return f"""n AS (SELECT {cols}, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS t FROM {source}),
c AS (SELECT *, unnest(CASE WHEN length(t) = 0 THEN []::BIGINT[] ELSE range(0, (ceil(greatest(length(t) - 900, 0) / 750.0) + 1)::BIGINT) END) AS i FROM n)"""


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_BUILT = f"""b AS (SELECT doc_id, source, lang, string_split(text, chr(10))[1] AS title, 'Title: ' || string_split(text, chr(10))[1] || chr(10) || chr(10) || 'Abstract: ' || text AS t FROM documents),
{_chunk_sql('b', 'doc_id, source, lang, title')}, ch AS (SELECT doc_id, doc_id || '::chunk_' || i AS chunk_id, i AS chunk_index, substring(t, (i * 750 + 1)::BIGINT, 900) AS text, title, source, lang FROM c)"""
_ASKED = "q AS (SELECT item_id, sentence, CASE item_id % 4 WHEN 0 THEN 'LLM model ' WHEN 1 THEN 'rag ' ELSE '' END || x AS q FROM (SELECT item_id, unnest(string_split(text, '.')) AS x, unnest(range(0, len(string_split(text, '.')))) AS sentence FROM benchmark))"
_KIND = "CASE WHEN length(trim({q})) < 30 THEN 'full' WHEN length(trim({q})) < 100 THEN 'moderate' ELSE 'minimal' END"
_ACRONYMS = "list_filter([" + ", ".join(f"CASE WHEN contains(lower({{q}}), {_lit(a.lower())}) AND NOT contains(lower({{q}}), {_lit(x)}) THEN {_lit(x)} END" for a, x in expand.ACRONYMS.items()) + "], lambda x: x IS NOT NULL)"
_RELATED = "list_filter(flatten(list_transform(regexp_extract_all(lower({q}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: CASE " + " ".join(f"WHEN w = {_lit(w)} THEN [{', '.join(map(_lit, terms))}]" for w, terms in expand.RELATED.items()) + " ELSE []::VARCHAR[] END)), lambda t: NOT contains(lower({q}), t))"


def _expanded(q: str, both: bool) -> str:
    kind = _KIND.format(q=q)
    acronyms = f"(CASE WHEN {kind} = 'minimal' THEN list_slice({_ACRONYMS.format(q=q)}, 1, 2) ELSE {_ACRONYMS.format(q=q)} END)"
    related = f"(CASE {kind} WHEN 'minimal' THEN list_slice({_RELATED.format(q=q)}, 1, 1) WHEN 'moderate' THEN list_slice({_RELATED.format(q=q)}, 1, 3) ELSE {_RELATED.format(q=q)} END)"
    parts = f"[{q}] || {acronyms}" + (f" || {related}" if both else "")
    return f"CASE WHEN length(trim({q})) BETWEEN 10 AND 200 THEN array_to_string({parts}, ' ') ELSE {q} END"


_VOCAB = """w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: regexp_matches(x, '^[a-z]{3,}$')) AS w FROM documents),
ph AS (SELECT doc_id, unnest(list_distinct(w || list_filter([array_to_string(w[i:i + 1], ' ') FOR i IN range(1, len(w))] || [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)], lambda p: length(p) >= 5))) AS term FROM w),
vo AS (SELECT term, count(*) AS df FROM ph GROUP BY term),
wa AS (SELECT list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: regexp_matches(x, '^[a-z]{3,}$')) AS w FROM conversations WHERE role = 'user'),
pa AS (SELECT unnest(list_distinct(w || list_filter([array_to_string(w[i:i + 1], ' ') FOR i IN range(1, len(w))] || [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)], lambda p: length(p) >= 5))) AS term FROM wa),
qf AS (SELECT term, count(*) AS qf FROM pa GROUP BY term),
vs AS (SELECT term, df, round(least(df / 100, 1.0::DOUBLE) * 0.5::DOUBLE + least(coalesce(qf, 0) / 10, 1.0::DOUBLE) * 0.3::DOUBLE + CASE WHEN length(term) BETWEEN 3 AND 20 THEN 0.1::DOUBLE WHEN length(term) BETWEEN 21 AND 40 THEN 0.05::DOUBLE ELSE 0 END, 6) AS score FROM vo LEFT JOIN qf USING (term)),
pr AS (SELECT DISTINCT substring(regexp_extract(lower(text), '[a-z]{3,}'), 1, 4) AS prefix FROM benchmark WHERE length(regexp_extract(lower(text), '[a-z]{3,}')) >= 3
  UNION SELECT regexp_extract(lower(text), '[a-z]{3,} [a-z]{2}') FROM benchmark WHERE regexp_matches(lower(text), '[a-z]{3,} [a-z]{2}')),
f0 AS (SELECT prefix, term, score FROM pr, vs WHERE starts_with(term, prefix) AND term <> prefix),
f1 AS (SELECT prefix, term, round(score * 0.8::DOUBLE, 6) AS score FROM pr, vs WHERE NOT contains(term, ' ') AND abs(length(term) - length(prefix)) <= 2 AND levenshtein(prefix, term) <= 2 AND term <> prefix),
f2 AS (SELECT DISTINCT prefix, term, round(score * 0.6::DOUBLE, 6) AS score FROM (SELECT prefix, unnest(string_split(prefix, ' ')) AS w FROM pr) JOIN (SELECT term, score, unnest(string_split(term, ' ')) AS w FROM vs) USING (w) WHERE term <> prefix)"""


def _best(src: str, k: int) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY score DESC, term) AS rank FROM {src}) WHERE rank <= {k})"


_T = {k: v for k, v in screen.THREATS.items()}
_INJ = _lit(screen.INJECTION.replace("(?im)", "(?i)"))
_P = "list_filter([CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN length(trim(text)) BETWEEN 1 AND 2 THEN 'too_short' END, CASE WHEN length(text) > 2000 THEN 'too_long' END, CASE WHEN length(replace(text, '(', '')) <> length(replace(text, ')', '')) THEN 'unbalanced_parentheses' END, CASE WHEN length(replace(text, '[', '')) <> length(replace(text, ']', '')) THEN 'unbalanced_brackets' END, CASE WHEN (length(text) - length(replace(text, '\"', ''))) % 2 <> 0 THEN 'unbalanced_quotes' END, CASE WHEN regexp_matches(text, " + _INJ + ") THEN 'injection' END], lambda x: x IS NOT NULL)"
_SAN = "replace(replace(replace(replace(replace(replace(substring(trim(html), 1, 100000), chr(0), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_LINE = "regexp_replace(q || ' (see above). More', '\\([^)]*\\)', '', 'g')"
ORACLES = {
    "chunks_fixed": f"WITH b AS (SELECT doc_id, text AS t FROM documents), {_chunk_sql('b', 'doc_id')} SELECT doc_id, i AS chunk_index, substring(t, (i * 750 + 1)::BIGINT, 900) AS text FROM c",
    "chunks_built": f"WITH {_BUILT} SELECT * FROM ch",
    "index_listing": f"WITH {_BUILT}, g AS (SELECT title, count(*) AS n_chunks, arg_min({{'d': doc_id, 's': source, 'p': substring(text, 1, 300)}}, (doc_id, chunk_index)) AS f FROM ch GROUP BY title) SELECT no, title, n_chunks, f.d AS doc_id, f.s AS source, f.p AS preview, (SELECT count(*) FROM g) AS total FROM (SELECT *, row_number() OVER (ORDER BY n_chunks DESC, title) AS no FROM g) WHERE no <= 50",
    "unique_docs": "SELECT count(DISTINCT nullif(string_split(text, chr(10))[1], '')) AS n_titles, count(*) AS n_docs FROM documents",
    "query_expand": f"WITH {_ASKED} SELECT item_id, sentence, q, {_KIND.format(q='q')} AS intensity, length(trim(q)) BETWEEN 10 AND 200 AS expandable, {_expanded('q', False)} AS acronym, {_expanded('q', True)} AS both FROM q",
    "query_variants": f"""WITH {_ASKED}, x AS (SELECT item_id, sentence, q || ' (see above). More' AS v, trim(string_split(q || ' (see above). More', '.')[1]) AS s, trim(regexp_replace({_LINE}, '\\s+', ' ', 'g')) AS b FROM q),
      y AS (SELECT item_id, sentence, [v, {_expanded('v', False)}] || CASE WHEN length(s) > 10 THEN [s] ELSE [] END || CASE WHEN length(b) > 5 THEN [b] ELSE [] END AS a FROM x), z AS (SELECT item_id, sentence, unnest(a) AS variant, unnest(range(0, len(a))) AS i FROM y),
      u AS (SELECT item_id, sentence, variant, min(i) AS i FROM z GROUP BY item_id, sentence, variant) SELECT item_id, sentence, row_number() OVER (PARTITION BY item_id, sentence ORDER BY i) - 1 AS no, variant FROM u""",
    "query_templates": f"WITH {_ASKED}, t AS (SELECT unnest([{', '.join(map(_lit, expand.TEMPLATES))}]) AS t, unnest(range(0, {len(expand.TEMPLATES)})) AS no) SELECT item_id, sentence, no, replace(t, '{{query}}', q) AS variant FROM q, t",
    "vocab_freq": f"WITH {_VOCAB} SELECT term, df FROM vo",
    "suggest_prefix": f"WITH {_VOCAB} SELECT prefix, term, score, rank FROM {_best('f0', 5)}",
    "suggest_fuzzy": f"WITH {_VOCAB} SELECT prefix, term, score, rank FROM {_best('f1', 5)}",
    "suggest_all": f"WITH {_VOCAB}, a AS (SELECT *, 0 AS stage FROM {_best('f0', 8)} UNION ALL SELECT *, 1 FROM {_best('f1', 8)} UNION ALL SELECT *, 2 FROM {_best('f2', 8)}), o AS (SELECT *, row_number() OVER (PARTITION BY prefix, term ORDER BY stage, rank) AS r FROM a), p AS (SELECT prefix, term, score FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY stage, rank) AS r2 FROM o WHERE r = 1) WHERE r2 <= 8) SELECT prefix, term, score, rank FROM {_best('p', 8)}",
    "screen_threats": "SELECT doc_id, t AS threats FROM (SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {_lit(p)}) THEN {_lit(k)} END" for k, p in _T.items()) + "], lambda x: x IS NOT NULL), ',') AS t FROM documents) WHERE t <> ''",
    "screen_injection": f"WITH m AS (SELECT page_id, regexp_extract_all(html, {_INJ}) AS a FROM pages), z AS (SELECT page_id, unnest(a) AS x, unnest(range(0, len(a))) AS i FROM m), u AS (SELECT page_id, x, min(i) AS i FROM z GROUP BY page_id, x), r AS (SELECT page_id, count(*) AS n, array_to_string(list(x ORDER BY i), '|') AS f FROM u GROUP BY page_id) SELECT page_id, coalesce(n, 0) AS n_found, coalesce(f, '') AS found FROM pages LEFT JOIN r USING (page_id)",
    "screen_rules": f"SELECT doc_id, array_to_string({_P}, ',') AS problems FROM documents",
    "sanitize_text": f"SELECT page_id, md5({_SAN}) AS digest, length({_SAN}) AS n FROM pages",
    "text_keys": "SELECT doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n, length(text) / 4.0::DOUBLE AS tokens, 'q:' || md5(lang || ':' || source || ':' || text) AS key FROM documents",
    "url_formats": "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^\\s/$.?#][^\\s]*$') THEN 'url' END AS form FROM pages",
}
