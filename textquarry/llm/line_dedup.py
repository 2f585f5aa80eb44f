"""Line deduplication by a tree of log templates.

The tree has a fixed depth: a line goes by its number of tokens and then by its
leading tokens, in which fields with digits count as variable, to a leaf. In a
leaf that occurs in enough documents, a token is constant at its place if at least
``min_docs`` different documents of the leaf have it there, however many others the leaf has;
all other tokens are variable fields. A line whose constants make up enough of it has a
template; templates that recur in at least ``min_docs`` different documents are dropped, in every document.

All is DataFrame functions. Tokens, lines and leaves are compared by themselves, those of more than LONG bytes and templates by SHA-256; only lines of recurring
leaves are ever exploded into tokens. Documents of a token, and of a template, are made
distinct before they are counted, so counts are pre-aggregated; equal lines are
matched once; joins deal the rows of a very common leaf, token, line or template over several
tasks. Leaves are broadcast while they are at most BROADCAST_ROWS, and joined by a shuffle beyond.

Null texts are empty. Lines of fewer than ``min_tokens`` tokens are kept. Repeated rows
count as one document (same id and text). An empty table gives no rows. Columns other than
the two that are named are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import BLANKS, bound, col, hot_keys, row_key, salted_join, table, text_of, without, written

#: Leading tokens that make up the levels of the tree below the number of tokens.
DEPTH = 3
MIN_DOCS = 5
MIN_TOKENS = 3
#: Share of constants from which a line has a template.
SIMILAR = 0.7
VARIABLE = "<*>"
BROADCAST_ROWS = 500_000
#: Bytes from which a token, a line or a leaf is named by its SHA-256.
LONG = 64


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def plain(line: Column) -> Column:
    """A line with its tokens parted by single blanks; most lines are so already."""
    odd = line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    return F.when(odd, F.trim(F.regexp_replace(line, " +", " "))).otherwise(line)


def blanks_of(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))


def exact(text: Column) -> Column:
    """text itself, or for a long one its SHA-256 behind a mark: one is shorter, the other longer than LONG bytes."""
    return F.when(F.octet_length(text) > LONG, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)


def leaf_of(line: Column, min_tokens: int) -> Column:
    """Where a plain line belongs: number of tokens, then the leading tokens, fields with digits as variables. Null for short lines."""
    masked = lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, "[^ ]*[0-9][^ ]*", VARIABLE)).otherwise(x)
    leading = bound(bound(F.substring_index(line, " ", DEPTH), masked), exact)
    n = blanks_of(line)
    return F.when((n >= min_tokens - 1) & (F.length(line) >= 2 * min_tokens - 1), F.concat(n.cast("string"), F.lit(" "), leading))


def nodes_of(lines: DataFrame, *keys: str) -> DataFrame:
    """The keys and node (a token at its place in a leaf) of rows (leaf_no, line)."""
    each = lines.select(*keys, "leaf_no", F.posexplode(F.split("line", " ")).alias("i", "token"))
    return each.select(*keys, F.concat_ws(" ", F.col("leaf_no").cast("string"), F.col("i").cast("string"), exact(F.col("token"))).alias("node"))


def dropped_lines(rows: DataFrame, min_docs: int, min_tokens: int) -> DataFrame:
    """id, h and lines (the numbers of the lines to drop); rows: id, h, text."""
    lines = lines_of(without(F.col("text"), BLANKS[1:].replace("\n", ""), " "))
    own = F.transform(lines, lambda x: bound(plain(x), lambda y: leaf_of(y, min_tokens)))
    leaves = rows.select(F.explode(F.array_distinct(own)).alias("leaf")).where("leaf is not null").groupBy("leaf").agg(F.count("*").alias("docs"))
    leaves = written(leaves.where(F.col("docs") >= min_docs).withColumn("leaf_no", F.monotonically_increasing_id()), "leaves")
    both = F.transform(lines, lambda x: bound(plain(x), lambda y: F.struct(y.alias("line"), leaf_of(y, min_tokens).alias("leaf"))))
    exploded = rows.select("id", "h", F.posexplode(both).alias("no", "x")).select("id", "h", "no", "x.line", "x.leaf").where("leaf is not null")
    numbers = leaves.select("leaf", "leaf_no")
    if leaves.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        inside = exploded.join(F.broadcast(numbers), "leaf")
    else:
        inside = salted_join(exploded, numbers, "leaf", hot_keys(leaves, "leaf", "docs"), ["id", "h", "no"])
    inside = written(inside.select("leaf_no", "id", "h", "no", "line"), "lines")

    # Each document's nodes are made distinct first, so that the count after it is pre-aggregated.
    constant = nodes_of(inside, "id", "h").distinct().groupBy("node").agg(F.count("*").alias("docs"))
    constant = written(constant.where(F.col("docs") >= min_docs), "constants")

    # Equal lines are one here: what many documents repeat is looked at once.
    each = inside.groupBy("leaf_no", exact(F.col("line")).alias("key")).agg(F.first("line").alias("line"), F.count("*").alias("c"))
    each = written(each.withColumn("line_no", F.monotonically_increasing_id()), "different-lines")
    parts = nodes_of(each.withColumn("n", blanks_of(F.col("line")) + 1), "line_no", "n")
    fixed = salted_join(parts, constant.select("node"), "node", hot_keys(constant, "node", "docs"), ["line_no"])
    # The nodes that are constants name the template: they tell the leaf and the places, and no token has a blank.
    templates = fixed.groupBy("line_no", "n").agg(F.collect_set("node").alias("some")).where(F.size("some") >= SIMILAR * F.col("n"))
    templates = templates.select("line_no", F.sha2(F.array_join(F.sort_array("some"), " "), 256).alias("template")).join(each.select("line_no", "key"), "line_no").select("key", "template")
    places = inside.select("id", "h", "no", exact(F.col("line")).alias("key"))
    matched = written(salted_join(places, templates, "key", hot_keys(each, "key", "c"), ["id", "h", "no"]).select("id", "h", "no", "template"), "templates")

    found = matched.select("template", "id", "h").distinct().groupBy("template").agg(F.count("*").alias("docs"))
    recurring = written(found.where(F.col("docs") >= min_docs), "recurring")
    gone = salted_join(matched, recurring.select("template"), "template", hot_keys(recurring, "template", "docs"), ["id", "h", "no"])
    return gone.groupBy("id", "h").agg(F.collect_set("no").alias("lines"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """A row for each row of df: id_col, n_lines, n_dropped, kept_text (the other lines in their order)."""
    text = text_of(text_col)
    rows = df.select(col(id_col).alias("id"), row_key(text).alias("h"), text.alias("text"))
    marks = dropped_lines(rows, min_docs, min_tokens)
    joined = rows.alias("r").join(marks.alias("m"), F.expr("r.id <=> m.id and r.h = m.h"), "left").select("r.id", "r.text", "m.lines")
    left = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("lines")), lambda i: F.get(x, i)), "\n")
    return joined.select(
        F.col("id").alias(id_col),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("lines").isNull(), F.col("text")).otherwise(bound(lines_of(F.col("text")), left)).alias("kept_text"),
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the lines of recurring templates."""
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = """
WITH l AS (
  SELECT doc_id, unnest(x) AS line, unnest(range(0, len(x))) AS no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), p AS (
  SELECT doc_id, no, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS t FROM l
), q AS (
  SELECT *, [len(t)::VARCHAR] || [CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END FOR x IN t[1:3]] AS leaf FROM p WHERE len(t) >= 3
), leaves AS (
  SELECT leaf, count(DISTINCT doc_id) AS docs FROM q GROUP BY leaf HAVING count(DISTINCT doc_id) >= 5
), tok AS (
  SELECT leaf, doc_id, no, unnest(t) AS token, unnest(range(0, len(t))) AS i, len(t) AS n FROM q JOIN leaves USING (leaf)
), con AS (
  SELECT leaf, i, token FROM tok GROUP BY leaf, i, token HAVING count(DISTINCT doc_id) >= 5
), tem AS (
  SELECT tok.doc_id, tok.no, leaf, string_agg(coalesce(con.token, '<*>'), ' ' ORDER BY tok.i) AS template FROM tok LEFT JOIN con USING (leaf, i, token)
  GROUP BY tok.doc_id, tok.no, leaf, tok.n HAVING count(con.token) >= 0.7 * tok.n
), rec AS (
  SELECT leaf, template FROM tem GROUP BY leaf, template HAVING count(DISTINCT doc_id) >= 5
), gone AS (
  SELECT doc_id, no FROM tem JOIN rec USING (leaf, template)
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS t, count(*) AS n FROM l ANTI JOIN gone USING (doc_id, no) GROUP BY doc_id
), size AS (
  SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id
)
SELECT size.doc_id, size.n::BIGINT AS n_lines, (size.n - coalesce(kept.n, 0))::BIGINT AS n_dropped, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM size LEFT JOIN kept USING (doc_id)
"""
