"""Failed logins, addresses and searches of each user over several horizons, from one state.

A user's state is a ring of buckets of BUCKET seconds: failures, searches and a sketch of the addresses (the smallest hashes, exact up to KEPT
different ones, mergeable beyond). The answer for 15 minutes, an hour or a day is a merge of the newest buckets; no window is held twice. When the watermark passes the
end of a bucket that has rows, the horizons that end there are put out. Rows that are late, but not later than the watermark, go to the bucket of their own
time. Buckets older than the longest horizon go, and with the last one the whole state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textquarry.operators import logs
from textquarry.streaming.trends import ROCKSDB

BUCKET = 900
#: Horizons in buckets.
HORIZONS = {"15m": 1, "1h": 4, "24h": 96}
KEPT = 256
OUT = "user string, until timestamp, horizon string, failures long, searches long, addresses long"


def merged(sketches: list[list[int]]) -> list[int]:
    """The KEPT smallest of all hashes."""
    return sorted(set().union(*map(set, sketches)))[:KEPT]


def estimate(sketch: list[int]) -> int:
    """Number of different values: exact below KEPT, by the largest of the smallest hashes beyond. Hashes are spread over 63 bits."""
    return len(sketch) if len(sketch) < KEPT else round((KEPT - 1) / (sketch[-1] / 2.0**63))


class _Horizons(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getMapState("ring", "bucket long", "failures long, searches long, addresses array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = pd.Timestamp(max(0, timerValues.getCurrentWatermarkInMs()), unit="ms")
        for batch in rows:
            batch = batch[batch["t"] > passed]  # others are too late
            for bucket, own in batch.groupby("bucket"):
                place = (int(bucket),)
                old = self.ring.getValue(place) if self.ring.containsKey(place) else None
                failures, searches, seen = (old[0], old[1], list(old[2])) if old else (0, 0, [])
                fresh = own["address"].dropna().astype("int64").tolist()
                self.ring.updateValue(place, (failures + int(own["failed"].sum()), searches + int(own["searched"].sum()), merged([seen, fresh])))
                if not old:
                    self.handle.registerTimer((int(bucket) + 1) * BUCKET * 1000)
        yield _rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs() // 1000 // BUCKET  # the bucket after the one that ended
        ring = {int(k[0]): v for k, v in self.ring.iterator()}
        out = []
        for name, n in HORIZONS.items():
            own = [v for b, v in ring.items() if end - n <= b < end]
            out.append((str(key[0]), pd.Timestamp(end * BUCKET, unit="s"), name, sum(v[0] for v in own), sum(v[1] for v in own), estimate(merged([list(v[2]) for v in own]))))
        last = max(HORIZONS.values())
        for b in [b for b in ring if b <= end - last]:  # no later end will ask for it
            self.ring.removeKey((b,))
        if not any(b >= end for b in ring) and expiredTimerInfo.getExpiryTimeInMs() // 1000 % BUCKET == 0:
            self.handle.registerTimer((end + last) * BUCKET * 1000 + 1)  # when nothing of it counts any more
        if expiredTimerInfo.getExpiryTimeInMs() % 1000:
            if all(b <= end - last for b in ring):
                self.ring.clear()
            yield _rows([])
            return
        yield _rows(out)

    def close(self) -> None:
        pass


def _rows(out: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUT.split(", ")]
    frame = pd.DataFrame(out, columns=names)
    return frame.astype({"user": "str", "until": "datetime64[us]", "horizon": "str", "failures": "int64", "searches": "int64", "addresses": "int64"})


def measures(log: DataFrame, ts: str = "ts", user: str = "user_id", search: str = "view") -> DataFrame:
    """user, t, bucket, failed, searched, address (a hash of 63 bits) of a log."""
    address = F.get_json_object("props", "$.k")
    at = F.col(ts).cast("timestamp")
    hashed = F.when(address.isNotNull(), F.shiftrightunsigned(F.xxhash64(address), 1))
    return log.select(F.col(user).cast("string").alias("user"), at.alias("t"), F.floor(F.unix_seconds(at) / BUCKET).cast("long").alias("bucket"), F.coalesce(logs.failed(), F.lit(False)).cast("int").alias("failed"), (F.col("event_type") == search).cast("int").alias("searched"), hashed.alias("address"))


def horizons(stream: DataFrame, ts: str = "ts", user: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """user, until, horizon, failures, searches, addresses at the end of every bucket that has rows of the user. Sets the state store that this needs in the session."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = measures(stream, ts, user).withWatermark("t", late)
    return rows.groupBy("user").transformWithStateInPandas(_Horizons(), OUT, "Append", "EventTime")


def at_ends(log: DataFrame, ts: str = "ts", user: str = "user_id") -> DataFrame:
    """What the stream puts out for all buckets, from a whole table, with exact numbers of addresses.

    A row counts from its bucket on and no longer after n buckets; an address until then or until it comes again, if that is earlier. So a horizon needs
    two changes for each row, whatever its length, and running sums of them: rows are neither repeated for the ends they belong to nor joined.
    Changes are summed by bucket first: a user has no more of them than the log has buckets.
    """
    rows = measures(log, ts, user).where("user is not null and bucket is not null").groupBy("user", "bucket", "address").agg(F.sum("failed").alias("failed"), F.sum("searched").alias("searched"), F.count("searched").alias("known"))
    again = F.lead("bucket").over(Window.partitionBy("user", "address").orderBy("bucket"))
    rows = rows.withColumn("again", F.when(F.col("address").isNotNull(), again)).na.fill(0, ["searched"])

    def change(horizon: str, at: Column, sign: int, counts: bool, address: bool, ends: bool) -> Column:
        some = lambda c: F.lit(sign) * F.col(c) if counts else F.lit(0).cast("long")
        seen = F.when(F.col("address").isNotNull(), F.lit(sign)).otherwise(0) if address else F.lit(0)
        return F.struct(F.lit(horizon).alias("horizon"), at.alias("bucket"), some("failed").alias("failures"), some("searched").alias("searches"), some("known").alias("known"), seen.cast("long").alias("addresses"), F.lit(ends).alias("ends"))

    changes = []
    for name, n in HORIZONS.items():
        out = F.col("bucket") + n
        changes += [change(name, F.col("bucket"), 1, True, True, True), change(name, out, -1, True, False, False), change(name, F.least(out, "again"), -1, False, True, False)]
    sums = ("failures", "searches", "known", "addresses")
    each = rows.select("user", F.explode(F.array(*changes)).alias("c")).select("user", "c.*")
    by = each.groupBy("user", "horizon", "bucket").agg(*(F.sum(c).alias(c) for c in sums), F.max("ends").alias("ends"))
    w = Window.partitionBy("user", "horizon").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = by.select("user", "horizon", "bucket", "ends", *(F.sum(c).over(w).alias(c) for c in sums)).where("ends")
    return own.select("user", F.timestamp_seconds((F.col("bucket") + 1) * BUCKET).alias("until"), "horizon", "failures", F.when(F.col("known") > 0, F.col("searches")).alias("searches"), "addresses")
