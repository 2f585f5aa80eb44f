"""Streams with state: trends and horizons, against loops and batches."""

import datetime as dt
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import collected

from textquarry.streaming import trends

T0 = dt.datetime(2024, 1, 1)


def arrived(queue: deque, scores: dict[str, float], q: str, window: int, decay: float) -> tuple[deque, dict[str, float]]:
    """State after one more query; both are changed in place."""
    queue = queue if isinstance(queue, deque) else deque(queue)
    if len(queue) >= window:
        oldest = queue.popleft()
        for a in scores:
            scores[a] *= decay
        scores[oldest] = scores.get(oldest, 0.0) - 1
        if scores[oldest] <= 0:
            del scores[oldest]
    scores[q] = scores.get(q, 0.0) + 1
    queue.append(q)
    return queue, scores


def leaders(scores: dict[str, float], n: int, least: float) -> list[tuple[str, float]]:
    """The 2n best, of these the ones that reach the least score, cut to n."""
    best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[: 2 * n]
    return [x for x in best if x[1] >= least][:n]


@pytest.mark.parametrize("window", [5, 50, 1000])
def test_trends_equal_the_loop(window):
    rng = np.random.default_rng(window)
    asked = [f"q{int(x)}" for x in np.minimum(rng.zipf(1.3, 10_000), 5000)]
    queue, scores, trend = [], {}, trends.Trend({}, {}, window=window)
    for i, q in enumerate(asked):
        queue, scores = arrived(queue, scores, q, window, 0.95)
        trend.arrive(q)
        if i % 500 == 0 or i == len(asked) - 1:
            want = {k: v for k, v in scores.items() if v > 1e-6}
            got = {k: x / trend.unit for k, x in trend.numbers.items() if x / trend.unit > 1e-6}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
            assert [a for a, _ in trend.leaders(10, 2.0)] == [a for a, _ in leaders(scores, 10, 2.0)]
    assert len(trend.ring) == window and trend.unit <= trends.LARGE


def test_an_arrival_touches_few_numbers():
    """Three looks at the stores for an arrival, with ten queries in them or with a thousand."""

    class Counting(dict):
        looks = 0

        def get(self, *a):
            Counting.looks += 1
            return dict.get(self, *a)

        def __setitem__(self, *a):
            Counting.looks += 1
            dict.__setitem__(self, *a)

    def looks(different):
        trend = trends.Trend(Counting(), Counting(), window=1000)
        for i in range(1500):
            trend.arrive(f"q{i % different}")
        Counting.looks = 0
        for i in range(100):
            trend.arrive(f"q{i % different}")
        return Counting.looks

    assert looks(10) <= 500 and looks(1000) <= 500


def test_trends_of_a_stream(spark, tmp_path):
    at = lambda i: T0 + dt.timedelta(seconds=i)
    rng = np.random.default_rng(1)
    asked = [f"q{int(x)}" for x in np.minimum(rng.zipf(1.5, 300), 40)]
    source, schema = tmp_path / "in", "tenant string, query string, ts timestamp"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for done, part in ((0, asked[:120]), (120, asked[120:])):
            spark.createDataFrame([("t", f" {q.upper()} ", at(done + i)) for i, q in enumerate(part)], schema).coalesce(1).write.mode("append").parquet(str(source))
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))  # two batches
        got = collected(spark, trends.trending(rows, "tenant", "query", window=50, least=0.5), "trend_rows", "update")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    queue, scores = [], {}
    for x in asked:
        queue, scores = arrived(queue, scores, x, 50, 0.95)
    want = leaders(scores, 10, 0.5)
    last = [(r["query"], r["score"]) for r in got.collect()][-len(want) :]  # the leaders after the second batch come last
    assert [q for q, _ in last] == [q for q, _ in want] and all(abs(x - y) < 1e-6 for (_, x), (_, y) in zip(last, want))


def test_horizons_equal_the_batch(spark, tmp_path):
    """At the end of every bucket the stream says what the whole table says, late rows included; rows beyond the watermark do not count."""
    from textquarry.streaming import horizons

    rng = np.random.default_rng(0)
    schema = "user_id long, ts timestamp, event_type string, props string"
    row = lambda u, s: (u, T0 + dt.timedelta(seconds=s), str(rng.choice(["error", "view", "click"])), '{"k": %d}' % rng.integers(0, 9))
    first = [row(int(rng.integers(1, 4)), int(rng.integers(0, 30 * 3600))) for _ in range(300)]
    late = [row(1, 30 * 3600 - 300), row(2, 30 * 3600 - 120)]  # late, within the watermark
    gone = [row(3, 60), row(1, 3600)]  # a day too late
    end = [row(9, 60 * 3600), row(9, 90 * 3600)]  # moves the watermark past all ends
    source = tmp_path / "in"
    for part in (first, [*late, *gone], end[:1], end[1:], end[1:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        got = collected(spark, horizons.horizons(rows), "horizon_rows", "append")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    key = lambda df: sorted((r["user"], r["until"], r["horizon"], r["failures"], r["searches"], r["addresses"]) for r in df.where("user != '9'").collect())
    assert key(got) == key(horizons.at_ends(spark.createDataFrame(first + late, schema)))


def test_batch_horizons_neither_repeat_nor_join_rows(spark):
    """Two changes a row whatever the horizon's length, then running sums; plain loops say the same, odd rows included."""
    from textquarry.streaming import horizons

    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(1, 4)), T0 + dt.timedelta(seconds=int(rng.integers(0, 60 * 3600))), str(rng.choice(["error", "view", "click"])), '{"k": %d}' % rng.integers(0, 6) if rng.random() < 0.9 else None) for _ in range(400)]
    rows += [(None, T0, "error", '{"k": 1}'), (1, None, "view", '{"k": 1}'), (5, T0, None, '{"k": 1}')]
    df = horizons.at_ends(spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string, props string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "sequence(" not in plan
    want = set()
    at = lambda t: int(t.replace(tzinfo=dt.timezone.utc).timestamp()) // 900
    whole = [(u, at(t), e, p) for u, t, e, p in rows if u and t]
    for u, b in {(u, b) for u, b, _, _ in whole}:
        for name, n in horizons.HORIZONS.items():
            own = [r for r in whole if r[0] == u and b - n < r[1] <= b]
            searches = sum(e == "view" for _, _, e, _ in own) if any(e for _, _, e, _ in own) else None
            want.add((str(u), b, name, sum(e == "error" for _, _, e, _ in own), searches, len({p for *_, p in own if p})))
    got = df.selectExpr("user", "unix_seconds(until) div 900 - 1", "horizon", "failures", "searches", "addresses").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_address_sketches():
    from textquarry.streaming import horizons

    x = [int(v) for v in np.random.default_rng(0).integers(0, 2**63, 5000)]
    parts = [horizons.merged([x[i::7]]) for i in range(7)]
    assert horizons.merged(parts) == horizons.merged([x]) and abs(horizons.estimate(horizons.merged(parts)) / 5000 - 1) < 0.2
    assert horizons.estimate(horizons.merged([x[:100], x[50:150]])) == 150


def test_sketches_roll_up(spark):
    """Hours merged to days equal the sketch of the day within the bounds; counts and sums are exact."""
    from textquarry.operators import sketches

    log = spark.range(60_000).selectExpr("id", "timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id * 5) AS ts", "concat('t', id % 3) AS kind", "id % 4001 AS who", "IF(id % 11 = 0, NULL, pmod(hash(id), 10000) / 10) AS value")
    days = sketches.read_out(sketches.rolled(sketches.by_window(log, "kind", "who", "value"), "day"), (0.5, 0.95, 0.99))
    want = {(r["d"], r["kind"]): r for r in log.groupBy(F.to_date("ts").alias("d"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.countDistinct("who").alias("k"), F.collect_list("value").alias("v")).collect()}
    rows = days.collect()
    assert len(rows) == len(want) == 12
    for r in rows:
        w = want[r["start"].date(), r["label"]]
        v = np.sort(w["v"])
        assert r["n"] == w["n"] and abs(r["total"] - w["s"]) < 1e-3 and abs(r["n_distinct"] / w["k"] - 1) < 0.06
        for p, q in ((0.5, r["q50"]), (0.95, r["q95"]), (0.99, r["q99"])):
            assert abs(np.searchsorted(v, q) / len(v) - p) < 0.02
