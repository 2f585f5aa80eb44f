"""Answers of a cache for asked vectors: the same key first, then the most similar entry, never one past its life.

Entries of one key are one class, of which the longest-lived entry counts; asked rows that have no such entry of their key go on to the
similarity join. Vectors meet in bands of random-hyperplane bits: as many bits as keep a bucket near BUCKET entries, and as many bands as
miss a pair at the threshold with a probability of at most MISS. The two sides of a bucket are dealt into blocks; a block of asked rows and one of
entries are multiplied inside a task, from which only the best entry of each asked row comes out: no list of pairs exists, however
large a bucket is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.operators.storage import written
from textquarry.operators.vectors import matrix, unit

BUCKET, MISS = 512, 0.01
#: Rows of a block of either side.
BLOCK = 1024
#: Fewest and most bits of a band.
BITS = (6, 24)


def bands(n: int, least: float) -> tuple[int, int]:
    """Bits of a band and number of bands for n entries and a least cosine."""
    bits = int(np.clip(math.ceil(math.log2(max(1, n / BUCKET))), *BITS))
    same = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - same)) if same < 1 else 1)


def vector_key(vector: Column) -> Column:
    """A key for vectors that are equal."""
    return F.sha2(F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), 256)


def _banded(rows: DataFrame, bits: int, n_bands: int, dim: int, seed: int = 11) -> DataFrame:
    """band and code for every band of rows (row, v, t)."""
    planes = np.random.default_rng(seed).normal(size=(dim, bits * n_bands))
    held, weights = rows.sparkSession.sparkContext.broadcast(planes), 1 << np.arange(bits)

    def run(batches):
        for b in batches:
            side = matrix(b.column(1)) @ held.value > 0 if b.num_rows else np.zeros((0, bits * n_bands), bool)
            code = side.reshape(len(side), n_bands, bits) @ weights
            at = pa.array(np.repeat(np.arange(len(side)), n_bands))
            yield pa.record_batch([pa.array(np.tile(np.arange(n_bands, dtype=np.int32), len(side))), pa.array(code.ravel().astype(np.int32)), *(c.take(at) for c in b.columns)], ["band", "code", "row", "v", "t"])

    return rows.mapInArrow(run, "band int, code int, row long, v array<float>, t double")


def cached(asked: DataFrame, entries: DataFrame, least: float = 0.85) -> DataFrame:
    """qid, match_id, score, kind (exact, similar, or null without a match) for asked (qid, key, vector, at) and entries (id, key, vector, expires), all numbers as times. Null vectors match by key only; an entry matches while at < expires; of equal scores the entry with the smallest id."""
    if not 0 < least <= 1:
        raise ValueError("least is above 0 and at most 1")
    lived = F.struct("expires", (-F.col("id")).alias("i"))
    classes = written(entries.where("expires is not null").groupBy("key").agg(F.max_by("id", lived).alias("id"), F.max_by("vector", lived).alias("v"), F.max("expires").alias("t")), "cache-classes")
    q = asked.select("qid", "key", F.col("vector").alias("v"), F.col("at").alias("t"))
    met = q.alias("q").join(classes.alias("c"), F.expr("q.key = c.key and q.t < c.t"), "left").select("q.*", F.col("c.id").alias("exact_id"))
    met = written(met, "cache-exact")
    exact = met.where("exact_id is not null").select("qid", F.col("exact_id").alias("match_id"), F.lit(1.0).alias("score"), F.lit("exact").alias("kind"))
    rest = met.where("exact_id is null")

    whole = classes.where("v is not null").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not whole["n"]:
        return exact.unionByName(rest.select("qid", F.lit(None).cast("long").alias("match_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("kind")))
    bits, n_bands = bands(whole["n"], least)
    sides = [
        _banded(rest.where("v is not null").select(F.col("qid").alias("row"), F.col("v").cast("array<float>").alias("v"), F.col("t").cast("double").alias("t")), bits, n_bands, whole["dim"]),
        _banded(classes.where("v is not null").select(F.col("id").alias("row"), F.col("v").cast("array<float>").alias("v"), F.col("t").cast("double").alias("t")), bits, n_bands, whole["dim"]),
    ]
    bucket = ["band", "code"]
    counts = [s.groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(c)) for s, c in zip(sides, ("left_blocks", "right_blocks"))]
    blocks = written(counts[0].join(counts[1], bucket), "cache-buckets")  # buckets that both sides have

    def dealt(side: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        """Each row in a block of its side, once for each block of the other."""
        rows = side.join(blocks, bucket).withColumn(names[0], F.pmod(F.xxhash64("row", "band"), F.col(own)).cast("int"))
        return rows.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(*bucket, "a", "b", "row", "v", "t")

    left, right = dealt(sides[0], "left_blocks", "right_blocks", ("a", "b")), dealt(sides[1], "right_blocks", "left_blocks", ("b", "a"))

    def best(key, one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "match_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids = two.column("row").to_numpy()
        order = np.argsort(ids)
        x, y = (unit(matrix(t.column("v").combine_chunks())) for t in (one, two))
        sims = np.round(x @ y[order].T, 6)
        sims[one.column("t").to_numpy()[:, None] >= two.column("t").to_numpy()[order][None, :]] = -2
        at = sims.argmax(1)  # of equal ones the smallest id
        score = sims[np.arange(len(sims)), at]
        keep = score >= least
        return pa.table({"qid": one.column("row").to_numpy()[keep], "match_id": ids[order][at[keep]], "score": score[keep]})

    block = [*bucket, "a", "b"]
    found = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(best, "qid long, match_id long, score double")
    found = found.groupBy("qid").agg(F.max(F.struct("score", (-F.col("match_id")).alias("i"))).alias("m")).select("qid", (-F.col("m.i")).alias("match_id"), F.col("m.score").alias("score"))
    similar = rest.select("qid").join(found, "qid", "left").select("qid", "match_id", "score", F.when(F.col("match_id").isNotNull(), "similar").alias("kind"))
    return exact.unionByName(similar)
