"""A stored vector index: rows by list, with product-quantised residuals, and exact scores for a shortlist.

Every row belongs to the list of its nearest centroid (large indexes split each list further by the residual's nearest
centroid, so that lists stay near the square root of the number of rows). The table is partitioned by list: id, code (a
byte for each few places of the residual), vector. A search reads the codes of the probed lists, not their vectors, scores
them by the code words, keeps a shortlist for each query, and scores only that by its vectors, from the lists it lies in.

Centroids and code words are fitted on at most SAMPLE rows drawn by hash; every row is in the index. How many lists a query
probes is measured on that sample: so many that HELD of the nearest neighbours of sampled rows lie in them. Clustered vectors
need few lists; those without any clusters nearly all, and then the codes are what makes a search cheap.
"""

from __future__ import annotations

import io
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators.blocks import ROWS, batches_of
from textquarry.operators.bm25 import top
from textquarry.operators.storage import fingerprint, listed, new_path, removed, renamed, shared_dir
from textquarry.operators.vectors import asked_vectors, matrix, unit

#: Rows that centroids and code words are fitted on, at most; lists of the first level, at most.
SAMPLE, LISTS = 20_000, 4096
#: Places of a vector that share a byte, and code words for them.
SPAN, WORDS = 4, 256
#: Share of sampled neighbours that the probed lists must hold.
HELD = 0.97
#: Rows of a shortlist for each row that is wanted.
SHORT = 10
ROW = "id long, code binary, vector array<float>, list int"


@dataclass(frozen=True)
class Model:
    """Centroids, centroids of residuals, code words (place, word, SPAN), lists to probe, rows and dimensions."""

    lists: np.ndarray
    parts: np.ndarray
    words: np.ndarray
    probes: int
    n: int
    dim: int

    def saved(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @staticmethod
    def loaded(data: bytes) -> Model:
        held = np.load(io.BytesIO(data))
        return Model(*(held[k] for k in ("lists", "parts", "words")), *(int(held[k]) for k in ("probes", "n", "dim")))

    def assigned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List of each unit vector and its code."""
        first = (x @ self.lists.T).argmax(1)
        rest = x - self.lists[first]
        second = _nearest(rest, self.parts)
        rest = _padded(rest - self.parts[second], self.words)
        code = np.stack([_nearest(rest[:, j], w) for j, w in enumerate(self.words)], 1).astype(np.uint8)
        return first * len(self.parts) + second, code

    def restored(self, which: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The vectors that lists and codes stand for."""
        x = self.lists[which // len(self.parts)] + self.parts[which % len(self.parts)]
        for j, w in enumerate(self.words):
            a = j * SPAN
            x[:, a : a + SPAN] += w[code[:, j]][:, : x.shape[1] - a]
        return x

    def probed(self, q: np.ndarray) -> np.ndarray:
        """Which lists of the first level each query probes."""
        near = np.argsort(-(q @ self.lists.T), axis=1, kind="stable")[:, : self.probes]
        out = np.zeros((len(q), len(self.lists)), bool)
        np.put_along_axis(out, near, True, 1)
        return out


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * x @ c.T).argmin(1)


def _padded(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Rows cut into pieces of SPAN places, the last one filled with zeros."""
    return np.pad(x, ((0, 0), (0, len(words) * SPAN - x.shape[1]))).reshape(len(x), len(words), SPAN)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int, sphere: bool = False) -> np.ndarray:
    """Centres of k-means; with sphere, of length one."""
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1) if sphere else _nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        c = unit(c) if sphere else c
    return c


def fitted(x: np.ndarray, n: int, seed: int = 7, k: int = 10) -> Model:
    """The model of n rows from a sample of unit vectors."""
    rng, wanted = np.random.default_rng(seed), max(1, round(n**0.5))
    lists = _means(x, min(wanted, LISTS, len(x)), rng, 15, sphere=True)
    first = (x @ lists.T).argmax(1)
    rest = x - lists[first]
    split = -(-wanted // LISTS)
    parts = _means(rest, min(split, len(x)), rng, 10) if split > 1 else np.zeros((1, x.shape[1]))
    rest = rest - parts[_nearest(rest, parts)]
    pieces = np.zeros((-(-x.shape[1] // SPAN), 1, SPAN))
    words = np.stack([_means(p, min(WORDS, len(p)), rng, 10) for p in _padded(rest, pieces).transpose(1, 0, 2)])
    # Rank of the list that holds each neighbour of some sampled rows, among the lists by nearness.
    some = rng.permutation(len(x))[:200]
    sims = x[some] @ x.T
    sims[np.arange(len(some)), some] = -np.inf
    near = np.argsort(-sims, 1)[:, : min(k, max(1, len(x) - 1))]
    rank = np.argsort(np.argsort(-(x[some] @ lists.T), 1, kind="stable"), 1)
    need = np.take_along_axis(rank, first[near], 1)
    probes = int(np.quantile(need, HELD, method="higher")) + 1
    return Model(lists, parts, words, probes, n, x.shape[1])


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    folder: str
    model: Model

    @property
    def rows(self) -> DataFrame:
        """id, code, vector, list."""
        return self.spark.read.schema(ROW).parquet(f"{self.folder}/rows")


def built(rows: DataFrame, id_col: str, vector_col: str, folder: str) -> VectorIndex:
    """Writes the index of all rows whose vector is not null."""
    spark = rows.sparkSession
    source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).where("vector is not null")
    n = source.count()
    sample = source.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).toArrow()["vector"].combine_chunks()
    x = unit(matrix(sample))
    model = fitted(x, n) if n else Model(np.zeros((1, 1)), np.zeros((1, 1)), np.zeros((1, 1, SPAN)), 1, 0, 1)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            which, code = held.value.assigned(unit(matrix(b.column(1))))
            width = pa.array(np.arange(len(code) + 1, dtype=np.int32) * code.shape[1]).buffers()[1]
            yield pa.record_batch([b.column(0), b.column(1), pa.Array.from_buffers(pa.binary(), len(code), [None, width, pa.py_buffer(code.tobytes())]), pa.array(which.astype(np.int32))], ["id", "vector", "code", "list"])

    draft = f"{folder}.new"
    removed(spark, draft)
    placed = source.mapInArrow(run, "id long, vector array<float>, code binary, list int") if n else source.select("id", "vector", F.lit(None).cast("binary").alias("code"), F.lit(0).alias("list"))
    placed.write.parquet(f"{draft}/placed")  # assigned once
    placed = spark.read.schema("id long, vector array<float>, code binary, list int").parquet(f"{draft}/placed")
    placed.repartitionByRange("list", "id").sortWithinPartitions("list", "id").select("id", "code", "vector", "list").write.partitionBy("list").parquet(f"{draft}/rows")
    removed(spark, f"{draft}/placed")
    spark.createDataFrame([(model.saved(),)], "model binary").coalesce(1).write.parquet(f"{draft}/model")
    renamed(spark, draft, folder)  # the whole index at once; another one that was there first stays
    return VectorIndex(spark, folder, model)


def opened(spark: SparkSession, folder: str) -> VectorIndex:
    return VectorIndex(spark, folder, Model.loaded(spark.read.parquet(f"{folder}/model").first()["model"]))


def stored(spark: SparkSession, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> VectorIndex:
    """The index of a Parquet table, from the shared folder if it has one of the same files; else it is built there."""
    folder = f"{shared_dir(spark).rstrip('/')}/textquarry/vectors-{fingerprint(spark, path)}-{id_col}-{vector_col}"
    return opened(spark, folder) if listed(spark, folder) else built(spark.read.parquet(path), id_col, vector_col, folder)


def index_of(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> VectorIndex:
    return built(rows, id_col, vector_col, new_path(rows.sparkSession, "vectors"))


def shortlisted(index: VectorIndex, qids: np.ndarray, q: np.ndarray, short: int) -> DataFrame:
    """qid, list, id of the short best rows of each query by their codes, among the lists that it probes."""
    spark, model = index.spark, index.model
    probed = model.probed(q)
    wanted = np.flatnonzero(probed.any(0))
    per = len(model.parts)
    codes = index.rows.select("id", "code", "list")
    if len(wanted) < len(model.lists):
        codes = codes.where(F.col("list").isin([int(a * per + b) for a in wanted for b in range(per)]))
    held = spark.sparkContext.broadcast((model, qids, q, probed))

    def run(batches):
        model, qids, q, probed = held.value
        best = np.full((len(qids), short), -np.inf)
        ids, lists = np.zeros((2, len(qids), short), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                which, new = np.array(part.column(2), np.int64), np.array(part.column(0), np.int64)
                code = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(new), -1)
                x = model.restored(which, code)
                for low in range(0, len(qids), ROWS):
                    rows = slice(low, low + ROWS)
                    sims = np.where(probed[rows][:, which // len(model.parts)], q[rows] @ x.T, -np.inf)
                    sims = np.concatenate([best[rows], sims], 1)
                    top_ = np.argpartition(-sims, short - 1, 1)[:, :short]
                    best[rows] = np.take_along_axis(sims, top_, 1)
                    for kept, fresh in ((ids, new), (lists, which)):
                        kept[rows] = np.take_along_axis(np.concatenate([kept[rows], np.broadcast_to(fresh, (len(sims), len(fresh)))], 1), top_, 1)
        row, place = np.nonzero(best > -np.inf)
        yield pa.record_batch([pa.array(qids[row]), pa.array(lists[row, place].astype(np.int32)), pa.array(ids[row, place]), pa.array(best[row, place])], ["qid", "list", "id", "score"])

    found = codes.mapInArrow(run, "qid long, list int, id long, score double")
    return top(found, short).select("qid", "list", "id")


def search(index: VectorIndex, queries: DataFrame, k: int, query_id: str = "qid", query_vector: str = "vector", short: int | None = None) -> DataFrame:
    """qid, id, score (cosine, rounded to six places), rank of the k best rows of each query, approximately; scores are exact. short: rows whose vectors are read for a query, SHORT times k if none."""
    short, out = max(k, short or SHORT * k), []
    for part in batches_of(queries, query_id):
        qids, q = asked_vectors(part, query_id, query_vector)
        if not len(qids) or not index.model.n:
            continue
        pairs = shortlisted(index, qids.astype(np.int64), q, short)
        held = index.spark.sparkContext.broadcast((qids, q))

        def run(batches, held=held):
            qids, q = held.value
            order = np.argsort(qids, kind="stable")
            for b in batches:
                if b.num_rows:
                    at = order[np.searchsorted(qids, np.array(b.column(0), np.int64), sorter=order)]
                    sims = np.einsum("ij,ij->i", q[at], unit(matrix(b.column(2))))
                    yield pa.record_batch([b.column(0), b.column(1), pa.array(np.round(sims, 6) + 0.0)], ["qid", "id", "score"])

        met = pairs.join(index.rows.select("list", "id", "vector"), ["list", "id"]).select("qid", "id", "vector")
        out.append(met.mapInArrow(run, "qid long, id long, score double"))
    if not out:
        out = [index.spark.createDataFrame([], "qid long, id long, score double")]
    return top(reduce(DataFrame.unionByName, out), k)
