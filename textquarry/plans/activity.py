"""Queries on logs, conversations, alerts and generic tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textquarry.operators import alerts, logs, repository, talks
from textquarry.plans.retrieval import table


def log(spark, d):
    return table(spark, d, "events")


def _as_of(spark, d):
    """The log with the time of its last row."""
    last = log(spark, d).agg(F.max("ts").alias("as_of"))
    return log(spark, d).crossJoin(F.broadcast(last))


def audit_stats(spark, d):
    return logs.statistics(log(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("resource", F.expr("CASE WHEN k % 10 = 0 THEN NULL ELSE concat('r', k % 10) END")), "event_type", "resource")


def audit_user_activity(spark, d):
    return logs.user_activity(log(spark, d))


def audit_suspicious(spark, d):
    return logs.suspicious(_as_of(spark, d), F.col("as_of"), logins=0, addresses=2, searches=1)


def audit_failed(spark, d):
    """Failures of the last day by address."""
    rows = _as_of(spark, d).where((F.col("event_type") == "error") & (F.col("ts") > F.col("as_of") - F.expr("interval 1 day")))
    return rows.groupBy(F.get_json_object("props", "$.k").alias("address")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def audit_page(spark, d):
    rows = logs.filtered(log(spark, d), action="error", start="2024-01-05 00:00:00", end="2024-01-20 00:00:00", success=False)
    return repository.page(rows.select("event_id", "user_id", "ts", "value"), "ts", "event_id", 25, 2, descending=True)


def rate_minute(spark, d):
    return logs.request_counts(log(spark, d), minute=2, hour=4).select("event_id", "user_id", "last_minute", "last_hour", "blocked")


def rate_fixed(spark, d):
    """Calls in aligned windows of a minute by client."""
    return log(spark, d).groupBy("user_id", F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n"))


def rolling_failure(spark, d):
    """Failure rate of the last 20 calls of each kind of value."""
    w = Window.partitionBy(F.col("user_id")).orderBy("ts", "event_id").rowsBetween(-19, 0)
    return log(spark, d).select("event_id", F.round(F.avg(logs.failed().cast("double")).over(w), 6).alias("failure_rate"))


def latency_quantiles(spark, d):
    q = lambda p: F.round(F.percentile("value", p), 6)
    return log(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), q(0.5).alias("median"), q(0.95).alias("p95"), logs.rate(F.count_if(F.col("value") > 20), F.count("*")).alias("slow_rate"))


BOUNDS = [0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 30.0]


def metric_histogram(spark, d):
    return logs.histogram(log(spark, d), "event_type", "value", BOUNDS).select("label", F.col("i").cast("long").alias("bucket"), "n")


def cache_stats(spark, d):
    """Each (user, k) is a cache key: entries, hits beyond the first access, keys with a hit, hit rate."""
    keys = log(spark, d).groupBy("user_id", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))
    return keys.agg(F.count("*").alias("entries"), F.sum(F.col("n") - 1).alias("hits"), F.count_if(F.col("n") > 1).alias("with_hit"), F.round(F.sum(F.col("n") - 1) / F.sum("n"), 6).alias("hit_rate"))


def metric_totals(spark, d):
    """Counters summed, gauges by their last value, for each event type."""
    return log(spark, d).groupBy("event_type").agg(F.count("*").alias("requests"), F.round(F.sum("value"), 4).alias("total"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


def trending_window(spark, d):
    """Event types by day: sum of 0.95 to the power of the age in hours, in windows of a day."""
    rows = log(spark, d).withColumn("day", F.date_trunc("day", "ts"))
    age = (F.unix_timestamp(F.col("day").cast("timestamp")) + 86400 - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 3600.0
    by = rows.groupBy("day", "event_type").agg(F.round(F.sum(F.pow(F.lit(0.95), age)), 6).alias("score")).where("score >= 2")
    w = Window.partitionBy("day").orderBy(F.desc("score"), "event_type")
    return by.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3")


def query_frequency(spark, d):
    """How often each lower-cased message is sent by users."""
    t = table(spark, d, "conversations").where("role = 'user'")
    return t.groupBy(F.lower("text").alias("query")).agg(F.count("*").alias("n"))


def error_labels(spark, d):
    m = F.expr("CASE WHEN event_type <> 'error' THEN NULL ELSE CASE CAST(get_json_object(props, '$.k') AS INT) % 6 WHEN 0 THEN 'Connection reset' WHEN 1 THEN 'HTTP 429' WHEN 2 THEN 'Auth needed' WHEN 3 THEN 'Invalid field' WHEN 4 THEN 'HTTP 503' ELSE 'odd' END END")
    rows = logs.error_labels(log(spark, d).where("event_type = 'error'").withColumn("m", m), "m")
    return rows.groupBy(F.col("label.severity").alias("severity"), F.col("label.type").alias("type"), F.col("label.retryable").alias("retryable")).agg(F.count("*").alias("n"))


def talk(spark, d):
    return table(spark, d, "conversations")


def conv_context(spark, d):
    return talks.last_messages(talk(spark, d), 4).select("conv_id", "place", "role", F.md5("text").alias("digest"))


def conv_rollup(spark, d):
    return talks.roll_up(talk(spark, d), 6)


def conv_search(spark, d):
    return talks.first_match(talk(spark, d), "the")


def conv_summary(spark, d):
    return talks.summary(talk(spark, d), 3)


def conv_titles(spark, d):
    return talks.titles(talk(spark, d))


def papers(spark, d):
    """Documents as papers: the first line is the title, the language a category, the source an author."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("summary"), F.array("lang").alias("categories"), F.array("source").alias("authors"))


def standing(spark, d):
    """An alert for each benchmark item: a keyword, by turns with a language, an author, or neither."""
    word = F.regexp_extract("text", "^(\\S+\\s+\\S+)", 1)
    none = F.array().cast("array<string>")
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("alert_id"),
        F.when(F.col("item_id") % 5 == 4, none).otherwise(F.array(word)).alias("keywords"),
        F.when(F.col("item_id") % 3 == 0, F.array(F.lit("en"), F.lit("fr"))).otherwise(none).alias("categories"),
        F.when(F.col("item_id") % 5 == 4, F.array(F.concat(F.lit("src"), F.col("item_id") % 20))).otherwise(none).alias("authors"),
    )


def alert_matches(spark, d):
    return alerts.matches(standing(spark, d), papers(spark, d))


def alert_event_counts(spark, d):
    return alerts.events(alert_matches(spark, d))


def repo_page(spark, d):
    return repository.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").where("o_orderstatus = 'F'"), "o_totalprice", "o_orderkey", 20, 3, descending=True)


def repo_search(spark, d):
    return repository.select_rows(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), {"c_mktsegment": "MACHINERY", "no_such": 1}, "00_1", ("c_name", "c_mktsegment")).unionByName(repository.select_rows(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), {"c_mktsegment": "MACHINERY"}, "#0000001", ("c_name",)))


def paper_search(spark, d):
    """Papers of two languages with a word in title or abstract, longest first."""
    rows = papers(spark, d).where(repository.metadata_filter({"categories": ["en", "de"]})).where(F.contains(F.lower(F.concat_ws(" ", "title", "summary")), F.lit("idiot")))
    return rows.select("paper_id", F.length("summary").cast("long").alias("n")).orderBy(F.desc_nulls_last("n"), "paper_id").limit(30)


def paper_with_chunks(spark, d):
    """Orders with their lines in order."""
    out = repository.with_children(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus"), table(spark, d, "lineitem").withColumn("k", F.col("l_orderkey")), "k", F.col("l_partkey").cast("string"), "l_linenumber")
    return out.select("k", "o_orderstatus", F.size("children").cast("long").alias("n"), F.array_join("children", ",").alias("parts"))


def papers_by_category(spark, d):
    return papers(spark, d).select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def _collections(spark, d):
    """Orders as additions of papers (their clerks' priority) to customers' collections."""
    return table(spark, d, "orders").select(F.col("o_custkey").alias("collection_id"), (F.col("o_orderkey") % 7).alias("paper_id"), F.col("o_orderkey").alias("added_at"), F.col("o_orderpriority").alias("notes"))


def collection_order(spark, d):
    return repository.collection_order(_collections(spark, d)).select("collection_id", "paper_id", "order_index", "notes")


def collection_visible(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), (F.col("o_orderstatus") == "P").alias("is_public"))
    return repository.visible(rows, 17).select("o_orderkey", "user_id", "is_public")


QUERIES = {
    f.__name__: f
    for f in (audit_stats, audit_user_activity, audit_suspicious, audit_failed, audit_page, rate_minute, rate_fixed, rolling_failure, latency_quantiles, metric_histogram, cache_stats, metric_totals, trending_window, query_frequency, error_labels,
              conv_context, conv_rollup, conv_search, conv_summary, conv_titles, alert_matches, alert_event_counts, repo_page, repo_search, paper_search, paper_with_chunks, papers_by_category, collection_order, collection_visible)
}

_K = "(props->>'$.k')"
_ALERTS = """p AS (SELECT doc_id AS paper_id, lower(concat_ws(' ', string_split(text, chr(10))[1], text)) AS low, lang, source FROM documents),
a AS (SELECT item_id AS alert_id, CASE WHEN item_id % 5 = 4 THEN NULL ELSE lower(regexp_extract(text, '^(\\S+\\s+\\S+)', 1)) END AS kw, item_id % 3 = 0 AS lim, CASE WHEN item_id % 5 = 4 THEN 'src' || (item_id % 20) END AS au FROM benchmark),
m AS (SELECT alert_id, paper_id FROM a, p WHERE (kw IS NULL OR contains(low, kw)) AND (NOT lim OR lang IN ('en', 'fr')) AND (au IS NULL OR au = source))"""
ORACLES = {
    "audit_stats": f"""WITH r AS (SELECT event_type AS a, coalesce(CASE WHEN {_K}::INT % 10 = 0 THEN NULL ELSE 'r' || ({_K}::INT % 10) END, 'unknown') AS b, event_type = 'error' AS f FROM events),
      u AS (SELECT 'action' AS level, a AS name, f FROM r UNION ALL SELECT 'resource', b, f FROM r UNION ALL SELECT 'all', 'all', f FROM r)
      SELECT level, name, count(*) AS total, count_if(f)::BIGINT AS failures, round((count(*) - count_if(f)) / count(*)::DOUBLE, 6) AS success_rate FROM u GROUP BY level, name""",
    "audit_user_activity": """WITH b AS (SELECT user_id, event_type, count(*) AS n, count_if(event_type = 'error') AS f, max(ts) AS last FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM b)
      SELECT user_id, sum(n)::BIGINT AS total, sum(f)::BIGINT AS failures, round((sum(n) - sum(f)) / sum(n)::DOUBLE, 6) AS success_rate, string_agg(event_type || ':' || n, ',' ORDER BY r) FILTER (r <= 5) AS top_actions, max(last) AS last_activity FROM r GROUP BY user_id""",
    "audit_suspicious": f"""WITH e AS (SELECT *, max(ts) OVER () AS as_of FROM events), g AS (SELECT user_id, count_if(ts > as_of - INTERVAL 1 HOUR AND event_type = 'error')::BIGINT AS failed_logins, count(DISTINCT {_K}) AS addresses, count_if(ts > as_of - INTERVAL 1 HOUR AND event_type = 'view')::BIGINT AS searches FROM e WHERE ts > as_of - INTERVAL 24 HOUR GROUP BY user_id)
      SELECT *, failed_logins > 0 OR addresses > 2 OR searches > 1 AS suspicious FROM g""",
    "audit_failed": f"SELECT {_K} AS address, count(*) AS n, max(ts) AS last FROM events WHERE event_type = 'error' AND ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1",
    "audit_page": "WITH r AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'error' AND ts >= '2024-01-05' AND ts <= '2024-01-20') SELECT *, (SELECT count(*) FROM r) AS total, 2::BIGINT AS page, ceil((SELECT count(*) FROM r) / 25.0)::BIGINT AS total_pages, 2 < ceil((SELECT count(*) FROM r) / 25.0) AS has_next, true AS has_prev FROM (SELECT * FROM r ORDER BY ts DESC, event_id LIMIT 25 OFFSET 25)",
    "rate_minute": """WITH c AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '59.999999 seconds' PRECEDING AND CURRENT ROW) - 1 AS last_minute, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) - 1 AS last_hour FROM events)
      SELECT *, last_minute >= 2 OR last_hour >= 4 AS blocked FROM c""",
    "rate_fixed": "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1, 2",
    "rolling_failure": "SELECT event_id, round(avg((event_type = 'error')::INT::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS failure_rate FROM events",
    "latency_quantiles": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(count_if(value > 20) / count(*)::DOUBLE, 6) AS slow_rate FROM events GROUP BY 1",
    "metric_histogram": f"WITH b AS (SELECT unnest([{', '.join(map(str, BOUNDS))}, 1e308]::DOUBLE[]) AS b, unnest(range(0, {len(BOUNDS) + 1})) AS i) SELECT event_type AS label, i AS bucket, count(*) AS n FROM events JOIN b ON value <= b GROUP BY 1, 2",
    "cache_stats": f"WITH k AS (SELECT count(*) AS n FROM events GROUP BY user_id, {_K}) SELECT count(*) AS entries, sum(n - 1)::BIGINT AS hits, count_if(n > 1)::BIGINT AS with_hit, round(sum(n - 1) / sum(n)::DOUBLE, 6) AS hit_rate FROM k",
    "metric_totals": "SELECT event_type, count(*) AS requests, round(sum(value), 4) AS total, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1",
    "trending_window": """WITH b AS (SELECT date_trunc('day', ts) AS day, event_type, round(sum(pow(0.95, (epoch(date_trunc('day', ts))::BIGINT + 86400 - floor(epoch(ts))::BIGINT) / 3600.0)), 6) AS score FROM events GROUP BY 1, 2 HAVING score >= 2)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, event_type) AS rank FROM b) WHERE rank <= 3""",
    "query_frequency": "SELECT lower(text) AS query, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1",
    "error_labels": f"""SELECT CASE {_K}::INT % 6 WHEN 0 THEN 'warning' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' WHEN 3 THEN 'error' WHEN 4 THEN 'warning' ELSE 'error' END AS severity, CASE {_K}::INT % 6 WHEN 0 THEN 'connection' WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'authentication' WHEN 3 THEN 'invalid_request' WHEN 4 THEN 'server_error' ELSE 'unknown' END AS type,
      {_K}::INT % 6 IN (0, 1, 4) AS retryable, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2, 3""",
    "conv_context": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, role, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 4",
    "conv_rollup": "SELECT conv_id, count(*) AS n_messages, sum(coalesce(length(text) // 4, 0))::BIGINT AS n_tokens, count(*) >= 6 OR sum(coalesce(length(text) // 4, 0)) > 5600 AS summarise FROM conversations GROUP BY 1",
    "conv_search": "SELECT conv_id, turn, substring(text, 1, 100) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE contains(lower(text), 'the')) WHERE r = 1",
    "conv_summary": "WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) SELECT conv_id, count_if(role = 'user')::BIGINT AS n_user, arg_min(substring(text, 1, 100), turn) FILTER (role = 'user') AS first_user FROM l WHERE b <= 3 GROUP BY 1",
    "conv_titles": "SELECT conv_id, CASE WHEN length(t) > 100 THEN substring(t, 1, 100) || '...' ELSE t END AS title FROM (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1)",
    "alert_matches": f"WITH {_ALERTS} SELECT * FROM m",
    "alert_event_counts": f"WITH {_ALERTS} SELECT alert_id, count(*) AS paper_count, min(paper_id) AS first_paper, max(paper_id) AS last_paper FROM m GROUP BY 1",
    "repo_page": "WITH r AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F') SELECT *, (SELECT count(*) FROM r) AS total, 3::BIGINT AS page, ceil((SELECT count(*) FROM r) / 20.0)::BIGINT AS total_pages, 3 < ceil((SELECT count(*) FROM r) / 20.0) AS has_next, true AS has_prev FROM (SELECT * FROM r ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40)",
    "repo_search": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY' AND contains(c_name, '#0000001')",
    "paper_search": "SELECT doc_id AS paper_id, length(text) AS n FROM documents WHERE lang IN ('en', 'de') AND contains(lower(text), 'idiot') ORDER BY n DESC, doc_id LIMIT 30",
    "paper_with_chunks": "SELECT o_orderkey AS k, o_orderstatus, count(l_partkey) AS n, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey::VARCHAR), '') AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "papers_by_category": "SELECT lang AS category, count(*) AS n FROM documents GROUP BY 1",
    "collection_order": "WITH g AS (SELECT o_custkey AS collection_id, o_orderkey % 7 AS paper_id, min(o_orderkey) AS f, arg_max(o_orderpriority, o_orderkey) AS notes FROM orders GROUP BY 1, 2) SELECT collection_id, paper_id, row_number() OVER (PARTITION BY collection_id ORDER BY f, paper_id) - 1 AS order_index, notes FROM g",
    "collection_visible": "SELECT o_orderkey, o_custkey AS user_id, o_orderstatus = 'P' AS is_public FROM orders WHERE o_custkey = 17 OR o_orderstatus = 'P'",
}
