"""Quality rules in a ledger of bit masks.

``ledger`` measures every document once and evaluates every rule once: bit k of
``failures`` is set if rule k fails. Policies are named sets of rules, so a
verdict under any version of a policy is one bitwise and; ``ablations`` counts
from the ledger, by bitwise aggregation, how many documents each rule alone
keeps out and how many pass without it. No text is read for any of that.

All is DataFrame functions; no shuffle is needed before the ablations. Repeated
three-word windows are found inside a row: hashes of the windows, cut to what their
places leave free of a long, are sorted, and the windows whose neighbours agree are
compared by their words, so that counts are exact for texts of any length.

Null texts are empty and fail as too short. Repeated rows are judged alike. An
empty table gives an empty ledger. Columns other than the two named are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import bound, col, squeezed, table, text_of, words_of

SYMBOLS = "#*$%&|<>"

#: Rules in the order of their bits; each condition is true for a failure.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "exclamations": "100 * n_exclamations > 50 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
#: Versions of the policy: the rules that a document must pass.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": tuple(RULES),
}


def mask(policy: str) -> int:
    return sum(1 << k for k, rule in enumerate(RULES) if rule in POLICIES[policy])


def repeat_words(words: Column) -> Column:
    """Words that lie in three-word windows found twice or more in the array, the first find included."""

    # A first sort of plain longs, which hold as many bits of a window's hash as its place leaves free, finds the places of all windows
    # that may be repeated. Only these are compared by their words.
    def hashed(h: Column, bits: Column) -> Column:
        key = lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2])
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.call_function("shiftleft", F.call_function("shiftright", key(i), bits), bits).bitwiseOR(i.cast("long"))))

    def likely(s: Column, bits: Column) -> Column:
        equal = lambda x, y: F.call_function("shiftright", x.bitwiseXOR(y), bits) == 0
        same = lambda x, j: ((j > 0) & equal(s[j - 1], x)) | ((j + 1 < F.size(s)) & equal(s[j + 1], x))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        return F.transform(F.filter(s, same), lambda x: x.bitwiseAND(mask).cast("int"))

    def spelled(p: Column) -> Column:
        # No word holds a blank, so that words joined by blanks are equal only if all of them are.
        return F.sort_array(F.transform(p, lambda i: F.struct(F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("w"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, j: ((j > 0) & (s[j - 1]["w"] == x["w"])) | ((j + 1 < F.size(s)) & (s[j + 1]["w"] == x["w"]))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        # The last window covers three words, every other one those before the next window at most.
        return F.aggregate(p, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])

    each = F.transform(words, lambda w: F.xxhash64(w))
    bits = lambda h: F.ceil(F.log2(F.size(h).cast("double"))).cast("int")
    places = bound(each, lambda h: bound(bits(h), lambda b: bound(hashed(h, b), lambda s: likely(s, b))))
    exact = lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(bound(spelled(p), lambda s: bound(repeated(s), covered)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(bound(places, exact))


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the counts that the rules look at, all long."""
    text = text_of(text_col)
    counted = lambda letters: F.regexp_count(text, F.lit(f"[{letters}]"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    of_words = bound(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r")))
    of_lines = bound(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    whole = F.struct(of_words.alias("w"), of_lines.alias("l"), F.length(squeezed(text)).alias("c"), counted(SYMBOLS).alias("s"), counted("!").alias("e"))
    m = F.col("m")
    long = {"n_words": m["w"]["n"], "word_chars": m["c"], "n_symbols": m["s"], "n_exclamations": m["e"], "n_lines": m["l"]["n"], "n_dup_lines": m["l"]["d"], "n_repeat_words": m["w"]["r"]}
    # A one-element array exploded: the measures are taken once, whatever reads them.
    return df.select(col(id_col), F.explode(F.array(whole)).alias("m")).select(col(id_col), *(c.cast("long").alias(k) for k, c in long.items()))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures and failures long, the mask of the rules that fail."""
    bits = sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())), F.lit(0))
    return measures(df, id_col, text_col).withColumn("failures", bits.cast("long"))


def verdict(led: DataFrame, policy: str = "v2", out_col: str = "kept") -> DataFrame:
    """Whether a row passes a policy."""
    return led.withColumn(out_col, F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(led: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: n_failed, n_only (kept out by this rule alone) and n_kept_without (documents that pass the policy without it)."""
    masks = led.groupBy(F.col("failures").bitwiseAND(F.lit(mask(policy))).alias("f")).agg(F.count("*").alias("n"))  # a row for each combination of rules
    own = [(rule, 1 << k) for k, rule in enumerate(RULES) if rule in POLICIES[policy]]
    counts = masks.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for r, b in own))).alias("x"), "f", "n")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return counts.groupBy(F.col("x.rule").alias("rule")).agg(
        n(F.col("f").bitwiseAND(F.col("x.bit")) != 0).alias("n_failed"),
        n(F.col("f") == F.col("x.bit")).alias("n_only"),
        n((F.col("f") == 0) | (F.col("f") == F.col("x.bit"))).alias("n_kept_without"),
    )


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Measures, failures and verdict of every document under the newest policy."""
    judged = verdict(verdict(ledger(table(spark, sf_dir, "documents")), "base", "base_ok"), "v2")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_ok")).alias("base_failed"), "kept", "failures")


OP5_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS d FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(text) - length(replace(text, '!', '')))::BIGINT AS n_ex,
    coalesce(l.n, 0)::BIGINT AS n_lines, coalesce(l.d, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN cov USING (doc_id)
), f AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 30 * n_words)::INT
    + 8 * (100 * n_ex > 50 * n_words)::INT + 16 * (100 * n_dup_lines > 30 * n_lines)::INT
    + 32 * (word_chars < 2 * n_words)::INT + 64 * (word_chars > 20 * n_words)::INT)::BIGINT AS failures FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""
