"""Streaming forms: alerts, audit windows, rates, metrics.

Event times are cast to timestamp, because watermarks do not take timestamp_ntz. Late rows beyond the watermark are
dropped. State of the exact form is kept by client, never under one key.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.operators import logs
from textquarry.operators.blocks import batches_of


def timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def alert_stream(papers: DataFrame, standing: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Matches of new papers: each paper is judged once within the watermark."""
    once = timed(papers, ts, late).dropDuplicatesWithinWatermark(["paper_id"])
    low = F.lower(F.concat_ws(" ", "title", "summary"))
    asked = standing.select("alert_id", "keywords", F.col("categories").alias("c"), F.col("authors").alias("a"))
    test = ((F.size("keywords") == 0) | F.exists("keywords", lambda k: F.contains(low, F.lower(k)))) & ((F.size("c") == 0) | F.arrays_overlap("c", "categories")) & ((F.size("a") == 0) | F.arrays_overlap("a", "authors"))
    found = [once.join(F.broadcast(part), test).select("alert_id", "paper_id", ts) for part in batches_of(asked, "alert_id")]
    return reduce(DataFrame.unionByName, found)


def failed_logins(stream: DataFrame, window: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Failures, calls and approximate number of addresses by user in sliding windows."""
    by = timed(stream, "ts", late).groupBy(F.window("ts", window, slide).alias("w"), "user_id")
    out = by.agg(F.count_if(logs.failed()).alias("failures"), F.count("*").alias("calls"), F.approx_count_distinct(F.get_json_object("props", "$.k")).alias("addresses"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "failures", "calls", "addresses")


def metric_windows(stream: DataFrame, size: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    by = timed(stream, "ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return by.agg(F.count("*").alias("requests"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "requests", "total")


def query_counts(stream: DataFrame, query: str = "query") -> DataFrame:
    """How often each lower-cased query came (update mode)."""
    return stream.groupBy(F.lower(query).alias("query")).agg(F.count("*").alias("n"))


def admitted(times: list[float], accepted: list[float], minute: int, hour: int) -> tuple[list[bool], list[float]]:
    """Which calls are let in when only calls that were let in count; times in seconds, in order."""
    out, accepted, first = [], list(accepted), 0
    for t in times:
        first = bisect_right(accepted, t - 3600, first)
        ok = len(accepted) - first < hour and len(accepted) - bisect_right(accepted, t - 60, first) < minute
        if ok:
            accepted.append(t)
        out.append(ok)
    return out, accepted[first:]


def rate_limit(stream: DataFrame, client: str = "user_id", ts: str = "ts", minute: int = 60, hour: int = 1000, late: str = "10 minutes") -> DataFrame:
    """Calls with admitted, by client: at most minute accepted ones within 60 s and hour within 3600 s before. A client's state goes an hour after its last call, by event time."""

    def step(k, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("t", kind="stable")
        t = rows["t"].astype("int64").to_numpy() / 1e6 if str(rows["t"].dtype).endswith("[us]") else rows["t"].map(lambda x: x.timestamp()).to_numpy()
        ok, held = admitted(t.tolist(), held, minute, hour)
        state.update((held,))
        state.setTimeoutTimestamp(max(int(max(t) * 1000) + 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": [str(k[0])] * len(rows), "t": t, "admitted": ok})

    rows = timed(stream, ts, late).select(F.col(client).cast("string").alias("client"), F.col(ts).alias("t"))
    return rows.groupBy("client").applyInPandasWithState(step, "client string, t double, admitted boolean", "held array<double>", "append", "EventTimeTimeout")
