"""Exact trends of a stream in constant time for each arrival.

The trends of a key are those of its last ``window`` queries: from the moment that so many are held, each arrival multiplies all scores by a
decay, takes 1 from the oldest query's score (which goes at 0 or below) and adds 1 to its own. Scores are kept relative to
a growing unit: instead of shrinking all of them, the unit that is added and taken grows by 1 / decay; a score is the stored number
divided by it. An arrival then changes two numbers and one place of a ring, whatever the number of different queries.
When the unit becomes very large all stored numbers are divided by it, once in some thousands of arrivals.

State is kept by key in a map (query to number), a ring (place to query) and two numbers; it needs the RocksDB state store. A key
without arrivals for ``idle`` of event time loses its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Unit beyond which all numbers are divided by it.
LARGE = 1e100


class Trend:
    """Scores of one key over three stores with get and put: numbers (by query), ring (by place), and (arrivals, unit)."""

    def __init__(self, numbers: dict, ring: dict, arrivals: int = 0, unit: float = 1.0, window: int = 1000, decay: float = 0.95):
        self.numbers, self.ring, self.arrivals, self.unit, self.window, self.decay = numbers, ring, arrivals, unit, window, decay

    def arrive(self, query: str) -> None:
        place = self.arrivals % self.window
        if self.arrivals >= self.window:
            self.unit /= self.decay
            oldest = self.ring[place]
            left = self.numbers.get(oldest, 0.0) - self.unit
            if left <= 1e-9 * self.unit:
                self.numbers.pop(oldest, None)
            else:
                self.numbers[oldest] = left
        self.numbers[query] = self.numbers.get(query, 0.0) + self.unit
        self.ring[place] = query
        self.arrivals += 1
        if self.unit > LARGE:
            for q in list(self.numbers):
                self.numbers[q] /= self.unit
            self.unit = 1.0

    def leaders(self, n: int, least: float) -> list[tuple[str, float]]:
        """The 2n best, of these the ones that reach the least score, cut to n."""
        best = sorted(((q, x / self.unit) for q, x in self.numbers.items()), key=lambda x: (-x[1], x[0]))[: 2 * n]
        return [x for x in best if x[1] >= least - 1e-9][:n]


class _Stored(dict):
    """A map state as a dictionary: what was not looked up stays in the store, what changed goes back to it."""

    def __init__(self, state, read):
        self.state, self.read, self.changed, self.gone = state, read, set(), set()

    def __missing__(self, k):
        if k in self.gone or not self.state.containsKey((k,)):
            raise KeyError(k)
        value = self.read(self.state.getValue((k,)))
        dict.__setitem__(self, k, value)
        return value

    def get(self, k, default=None):
        try:
            return self[k]
        except KeyError:
            return default

    def __setitem__(self, k, v):
        dict.__setitem__(self, k, v)
        self.changed.add(k)
        self.gone.discard(k)

    def pop(self, k, default=None):
        self.gone.add(k)
        self.changed.discard(k)
        return dict.pop(self, k, default)

    def load(self):
        """Everything that the store has, for a look at all of it."""
        for k, v in self.state.iterator():
            if k[0] not in self.gone and not dict.__contains__(self, k[0]):
                dict.__setitem__(self, k[0], self.read(v))

    def flush(self):
        for k in self.gone:
            if self.state.containsKey((k,)):
                self.state.removeKey((k,))
        for k in self.changed:
            self.state.updateValue((k,), (self[k],))


class _Trends(StatefulProcessor):
    def __init__(self, window: int, decay: float, most: int, least: float, idle: int):
        self.window, self.decay, self.most, self.least, self.idle = window, decay, most, least, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getMapState("numbers", "query string", "number double")
        self.ring = handle.getMapState("ring", "place int", "query string")
        self.both = handle.getValueState("both", "arrivals long, unit double, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrivals, unit, timer = self.both.get() if self.both.exists() else (0, 1.0, None)
        numbers, ring = _Stored(self.numbers, lambda v: v[0]), _Stored(self.ring, lambda v: v[0])
        trend = Trend(numbers, ring, arrivals, unit, self.window, self.decay)
        all_ = pd.concat(list(rows)).sort_values("t", kind="stable")
        if unit / self.decay ** len(all_) > LARGE:
            numbers.load()  # all are divided on the way
        for q in all_["query"]:
            trend.arrive(q)
        numbers.load()
        numbers.flush()
        ring.flush()
        at = int(all_["t"].max().timestamp() * 1000) + self.idle * 1000
        if timer is not None:
            at = max(at, timer)
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)
        self.both.update((trend.arrivals, trend.unit, at))
        top = trend.leaders(self.most, self.least)
        yield pd.DataFrame({"key": [str(key[0])] * len(top), "query": [a for a, _ in top], "score": [b for _, b in top]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.numbers, self.ring, self.both):
            state.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "query": pd.Series([], dtype=str), "score": pd.Series([], dtype=float)})

    def close(self) -> None:
        pass


def trending(stream: DataFrame, key: str, query: str, ts: str = "ts", window: int = 1000, decay: float = 0.95, most: int = 10, least: float = 2.0, late: str = "10 minutes", idle: int = 7 * 86_400) -> DataFrame:
    """key, query, score: the leaders of each key after each batch. Rows of a batch are taken in the order of their times. Sets the state store that this needs in the session."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    rows = rows.select(F.col(key).cast("string").alias("k"), F.lower(F.trim(query)).alias("query"), F.col(ts).alias("t"))
    processor = _Trends(window, decay, most, least, idle)
    return rows.groupBy("k").transformWithStateInPandas(processor, "key string, query string, score double", "Update", "EventTime")
