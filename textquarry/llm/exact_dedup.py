"""Exact deduplication with a split of heavy hitters.

Texts are equal when they agree after all blanks are deleted. One scan turns
each row into a digest and a length. A Misra-Gries summary of the digests (the
frequent-items aggregate, merged over partitions) names at most 1 / support
candidates for frequent digests; their groups are counted and their winners found
exactly, with map-side aggregation, and this table of bounded size is broadcast,
so that no row of a hot group is shuffled. All other digests are grouped and joined by
an ordinary shuffle.

Null texts are empty; all empty texts form one group. The row with the most code
points in its original text stays, then the smallest id; a null id loses against
any other; of rows that are equal in all of this one stays. Other columns are
not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import col, squeezed, table, text_of, written

#: Digests that make up this share of the rows are sure to be among the candidates.
SUPPORT = 0.001


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (SHA-256 of the text without blanks) and n (code points of the whole text)."""
    return df.select(col(id_col).alias("id"), F.sha2(squeezed(text_of(text_col)), 256).alias("digest"), F.length(text_of(text_col)).cast("long").alias("n"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """A row for each row of df: id_col, keep_id, group_size, kept, text_sha256."""
    if not 1e-4 <= support <= 1:
        raise ValueError("support must be from 0.0001 to 1")
    rows = written(digests(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "digests")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), "id", "row")).alias("best")

    frequent = rows.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))  # 1 / support rows at most
    heavy = rows.join(F.broadcast(frequent), "digest").groupBy("digest").agg(best, F.count("*").alias("group_size")).where("group_size > 1")
    heavy = written(heavy, "heavy-digests")
    hot = rows.join(F.broadcast(heavy), "digest")
    cold = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = cold.groupBy("digest").agg(best, F.count("*").alias("group_size"))
    both = hot.unionByName(cold.join(groups, "digest"))
    return both.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, one of each group: where several share the kept id, null ids included, one that has the most code points."""
    verdict, wins = exact_dedup(df, id_col, text_col), F.col(id_col).eqNullSafe(F.col("keep_id"))
    lost = verdict.where(~F.col("kept")).groupBy(F.col(id_col).alias("lost_id"), F.col("text_sha256").alias("lost_sha")).agg(F.first(wins).alias("lost_wins"))
    lost = written(lost, "lost-copies")
    sha = F.sha2(squeezed(text_of(text_col)), 256)
    match = col(id_col).eqNullSafe(F.col("lost_id")) & (sha == F.col("lost_sha"))
    alone = df.join(lost, match, "left_anti")
    if lost.where("lost_wins").isEmpty():
        return alone
    shared = df.join(lost.where("lost_wins"), match, "left_semi")  # copies that the id can't tell apart
    whole, order = F.struct(*map(col, df.columns)), F.struct(F.length(text_of(text_col)), text_of(text_col))
    one = shared.groupBy(col(id_col), sha).agg(F.max_by(whole, order).alias("one"))
    return alone.unionByName(one.select(*(F.col("one").getField(c).alias(c) for c in df.columns)))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r
"""
