"""Fusion of ranked lists and normalising of scores.

A ranked list has the columns qid, id, rank (from 1) and score; several lists are told apart by list_no.
All forms are one union, one grouped aggregation and one ranking by query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.operators.bm25 import top

#: The constant of reciprocal rank fusion.
K = 60


def lists_of(*ranked: DataFrame) -> DataFrame:
    """One table of several lists, numbered in their order."""
    return reduce(DataFrame.unionByName, (df.select("qid", "id", "rank", "score", F.lit(i).alias("list_no")) for i, df in enumerate(ranked)))


def rrf(lists: DataFrame, k: int, weights: dict[int, float] | None = None, constant: int = K) -> DataFrame:
    """Sum of weight / (constant + rank) over the lists; ranks in the order of the lists. Order of the lists does not matter for scores."""
    w = F.lit(1.0) if weights is None else F.coalesce(*(F.when(F.col("list_no") == i, F.lit(x)) for i, x in weights.items()), F.lit(0.0))
    fused = lists.groupBy("qid", "id").agg(F.round(F.sum(w / (F.lit(float(constant)) + F.col("rank"))), 6).alias("score"), F.count("*").alias("n_lists"))
    return top(fused, k)


def weighted_merge(lists: DataFrame, k: int, first: float = 1.0, others: float = 0.5) -> DataFrame:
    """Sum of weight / rank; the first list weighs more."""
    w = F.when(F.col("list_no") == 0, first).otherwise(others)
    return top(lists.groupBy("qid", "id").agg(F.round(F.sum(w / F.col("rank")), 6).alias("score")), k)


def union_merge(lists: DataFrame, k: int) -> DataFrame:
    """First occurrence in the order of lists, then ranks; the first k."""
    once = lists.groupBy("qid", "id").agg(F.min(F.struct("list_no", "rank", "score")).alias("f")).select("qid", "id", "f.*")
    w = Window.partitionBy("qid").orderBy("list_no", "rank", "id")
    place = once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return place.select("qid", "id", "score", F.col("place").cast("long").alias("rank"))


def flattened(lists: DataFrame) -> DataFrame:
    """All lists of a query as one: the rank is the place in the concatenation."""
    w = Window.partitionBy("qid").orderBy("list_no", "rank", "id")
    return lists.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("list_no", F.lit(0))


def max_normalised(semantic: DataFrame, lexical: DataFrame, k: int, share: float = 0.7, floor: float = 0.001) -> DataFrame:
    """share * similarity + (1 - share) * lexical / its largest; only rows of the semantic side stay."""
    largest = F.greatest(F.max("score").over(Window.partitionBy("qid")), F.lit(floor))
    side = lexical.select("qid", "id", (F.col("score") / largest).alias("lex"))
    return _left_sum(semantic, side, k, share)


def rank_normalised(semantic: DataFrame, lexical: DataFrame, n_lexical: Column, k: int, share: float = 0.7) -> DataFrame:
    """As max_normalised with 1 - place / n_lexical for the lexical side, places from 0."""
    return _left_sum(semantic, lexical.select("qid", "id", (1 - (F.col("rank") - 1) / n_lexical).alias("lex")), k, share)


def _left_sum(semantic: DataFrame, side: DataFrame, k: int, share: float) -> DataFrame:
    both = semantic.join(side, ["qid", "id"], "left")
    total = F.round(share * F.col("score") + (1 - share) * F.coalesce("lex", F.lit(0.0)), 8)
    return top(both.select("qid", "id", total.alias("score")), k)


def averaged(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Mean of both scores, a missing one counting as 0."""
    both = lists_of(left, right)
    return top(both.groupBy("qid", "id").agg(F.round(F.sum("score") / 2, 8).alias("score")), k)


def minmax(df: DataFrame, score: str = "score", by: str = "qid", flat: float = 1.0) -> Column:
    """Scores of a query scaled to 0..1; all equal give flat."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, F.lit(flat)).otherwise((F.col(score) - low) / (high - low))


def zscore(score: str = "score", by: str = "qid") -> Column:
    """Standard scores within a query; one row gives 1, no spread gives 0."""
    w = Window.partitionBy(by)
    mean, sd = F.avg(score).over(w), F.stddev_pop(score).over(w)
    return F.when(F.count("*").over(w) < 2, F.lit(1.0)).when(sd < 1e-12, F.lit(0.0)).otherwise((F.col(score) - mean) / sd)


def combined(df: DataFrame, a: str, b: str, share: float = 0.7, by: str = "qid") -> Column:
    """share * min-max of a + the rest * min-max of b; all equal give 0."""
    return share * minmax(df, a, by, 0.0) + (1 - share) * minmax(df, b, by, 0.0)
