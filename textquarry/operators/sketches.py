"""Distinct and quantile sketches by window, stored, and merged over any range of windows.

Rows are summarised once, by hour and label: counts and sums exactly, distinct values in a HyperLogLog sketch, values in a KLL sketch. A day, a week or
any range is then the merge of its hours, at the cost of the hours, not of the rows; no task ever holds the values of a label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the distinct sketch (an error of about 1.04 / 2**(LG_K / 2)) and size of the quantile sketch (a rank error of about 1.7 / K ** 0.9).
LG_K, K = 12, 400


def by_window(log: DataFrame, label: str, who: str, value: str, ts: str = "ts", size: str = "1 hour") -> DataFrame:
    """start, label, n, total, distinct and quantiles for each window and label. Null values count in n only."""
    rows = log.select(F.window(F.col(ts).cast("timestamp"), size)["start"].alias("start"), F.col(label).alias("label"), F.col(who).alias("who"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("start", "label").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.hll_sketch_agg("who", F.lit(LG_K)).alias("distinct"), F.kll_sketch_agg_double("value", F.lit(K)).alias("quantiles"))


def rolled(windows: DataFrame, unit: str) -> DataFrame:
    """The windows of each unit (day, week, month, ...) as one; of the same columns."""
    start = F.date_trunc(unit, F.col("start")).alias("start")
    return windows.groupBy(start, "label").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"))


def read_out(windows: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """start, label, n, total, n_distinct and a column q50, q95, ... for each quantile."""
    q = [F.kll_sketch_get_quantile_double("quantiles", F.lit(p)).alias(f"q{round(100 * p)}") for p in quantiles]
    return windows.select("start", "label", "n", "total", F.hll_sketch_estimate("distinct").alias("n_distinct"), *q)
