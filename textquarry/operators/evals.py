"""Quality of retrieval against labels, and comparison of configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quality(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """For each query with relevant rows: precision, recall, reciprocal rank and nDCG at k. results: qid, id, rank; relevant: qid, id."""
    hits = relevant.select("qid", "id").distinct().join(results.where(F.col("rank") <= k).select("qid", "id", "rank"), ["qid", "id"], "left")
    gain = 1 / F.log2(F.col("rank") + 1.0)
    out = hits.groupBy("qid").agg(F.count("*").alias("n_relevant"), F.count("rank").alias("n_hits"), F.min("rank").alias("first"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    r = lambda c: F.round(c, 6)
    return out.select("qid", "n_relevant", "n_hits", r(F.col("n_hits") / k).alias("precision"), r(F.col("n_hits") / F.col("n_relevant")).alias("recall"), r(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"), r(F.col("dcg") / ideal).alias("ndcg"))


def runs(results: DataFrame) -> DataFrame:
    """For each configuration and query: number, mean and largest score, ids in order. results: config, qid, id, rank, score."""
    return results.groupBy("config", "qid").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.max("score").alias("max_score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ",").alias("ids"))


def comparison(metrics: DataFrame, names: list[str], configs: list[str]) -> DataFrame:
    """A row for each metric, a column for each configuration, from means over queries. metrics: config and the named columns."""
    means = metrics.groupBy("config").agg(*(F.round(F.avg(n), 6).alias(n) for n in names))
    long = means.unpivot(["config"], names, "metric", "value")
    return long.groupBy("metric").pivot("config", configs).agg(F.first("value"))


def best(metrics: DataFrame, metric: str) -> DataFrame:
    """The configuration with the largest mean of a metric."""
    means = metrics.groupBy("config").agg(F.avg(metric).alias("mean"))
    return means.withColumn("r", F.row_number().over(Window.orderBy(F.desc("mean"), "config"))).where("r = 1").drop("r")
