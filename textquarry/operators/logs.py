"""Analytics over audit and request logs.

A log row has user_id, ts, event_type, value (milliseconds or seconds taken) and props (JSON). All operators are one grouped aggregation, or one window by user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAILURE = "error"


def failed(kind: str = "event_type") -> Column:
    return F.col(kind) == FAILURE


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(F.lit(0.0))


def statistics(log: DataFrame, action: str, resource: str) -> DataFrame:
    """Totals by action, by resource (null: unknown) and over all, from one pass with grouping sets."""
    rows = log.select(F.col(action).alias("action"), F.coalesce(F.col(resource), F.lit("unknown")).alias("resource"), failed(action).alias("failed"))
    out = rows.groupingSets([["action"], ["resource"], []], "action", "resource").agg(F.grouping_id().alias("level"), F.count("*").alias("total"), F.count_if("failed").alias("failures"))
    name = F.coalesce("action", "resource", F.lit("all"))
    level = F.when(F.col("level") == 1, "action").when(F.col("level") == 2, "resource").otherwise("all")
    return out.select(level.alias("level"), name.alias("name"), "total", "failures", rate(F.col("total") - F.col("failures"), F.col("total")).alias("success_rate"))


def user_activity(log: DataFrame, n: int = 5) -> DataFrame:
    """For each user: totals, success rate, the n commonest actions, last activity."""
    by = log.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(failed()).alias("f"), F.max("ts").alias("last"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    ranked = by.withColumn("r", F.row_number().over(w))
    top = F.array_sort(F.collect_list(F.when(F.col("r") <= n, F.struct("r", F.concat_ws(":", "event_type", "n").alias("x")))))
    out = ranked.groupBy("user_id").agg(F.sum("n").alias("total"), F.sum("f").alias("failures"), F.array_join(F.transform(top, lambda t: t["x"]), ",").alias("top_actions"), F.max("last").alias("last_activity"))
    return out.select("user_id", "total", "failures", rate(F.col("total") - F.col("failures"), F.col("total")).alias("success_rate"), "top_actions", "last_activity")


def suspicious(log: DataFrame, as_of: Column, login: str = "error", search: str = "view", logins: int = 5, addresses: int = 10, searches: int = 20) -> DataFrame:
    """Users with too many failed logins in an hour, addresses in a day or searches in an hour before as_of."""
    since = lambda hours: F.col("ts") > as_of - F.expr(f"interval {hours} hours")
    address = F.get_json_object("props", "$.k")
    day = log.where(since(24))
    out = day.groupBy("user_id").agg(
        F.count_if(since(1) & (F.col("event_type") == login)).alias("failed_logins"),
        F.countDistinct(address).alias("addresses"),
        F.count_if(since(1) & (F.col("event_type") == search)).alias("searches"),
    )
    return out.withColumn("suspicious", (F.col("failed_logins") > logins) | (F.col("addresses") > addresses) | (F.col("searches") > searches))


def filtered(log: DataFrame, user: int | None = None, action: str | None = None, start: str | None = None, end: str | None = None, success: bool | None = None) -> DataFrame:
    """Rows that meet every condition that is given."""
    tests = [
        user is not None and (F.col("user_id") == user),
        action is not None and (F.col("event_type") == action),
        start is not None and (F.col("ts") >= F.lit(start).cast("timestamp_ntz")),
        end is not None and (F.col("ts") <= F.lit(end).cast("timestamp_ntz")),
        success is not None and (failed() != success),
    ]
    for t in tests:
        if t is not False:
            log = log.where(t)
    return log


def within_retention(log: DataFrame, as_of: Column, days: int) -> Column:
    """Whether a row is younger than the retention."""
    return F.col("ts") >= as_of - F.expr(f"interval {days} days")


def request_counts(log: DataFrame, minute: int = 60, hour: int = 1000) -> DataFrame:
    """Earlier calls of the same client within a minute and an hour, and whether either bound is reached. A call exactly 60 s old no longer counts."""
    frame = "count(*) over (partition by user_id order by ts range between interval {s} seconds preceding and current row) - 1"
    out = log.select("*", F.expr(frame.format(s="59.999999")).alias("last_minute"), F.expr(frame.format(s="3599.999999")).alias("last_hour"))
    return out.withColumn("blocked", (F.col("last_minute") >= minute) | (F.col("last_hour") >= hour))


def histogram(df: DataFrame, label: str, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts: values up to each bound, and all of them under +Inf."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(str(b)).alias("le"), F.lit(float(b)).alias("b")) for i, b in enumerate([*bounds, float("inf")]))))
    first = F.coalesce(*(F.when(F.col(value) <= b, F.lit(i)) for i, b in enumerate(bounds)), F.lit(len(bounds)))
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(label).alias("label"), first.alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("x", each).where("bucket <= x.i").groupBy("label", F.col("x.i").alias("i")).agg(F.sum("n").alias("n"))


def error_labels(df: DataFrame, message: str) -> DataFrame:
    from textquarry.functions.screen import error_label

    return df.withColumn("label", error_label(F.col(message)))
