"""Vector search for a stated set of queries against all rows.

Queries are taken in batches that are broadcast; each Arrow block of rows is multiplied with a chunk of
them at a time, keeps its k best for each query, and only those are shuffled to the final ranking. ``vector_index`` has the stored,
approximate form.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.operators.blocks import CHUNK, ROWS, batches_of, best_of_block, result
from textquarry.operators.bm25 import top


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zero vectors stay zero."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def asked_vectors(queries: DataFrame, query_id: str, query_vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of one batch of queries."""
    batch = queries.select(F.col(query_id).cast("long").alias("qid"), F.col(query_vector).alias("v")).where("v is not null").toArrow()
    return batch.column("qid").to_numpy(), unit(matrix(batch.column("v").combine_chunks()))


def search(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "qid", query_vector: str = "vector", condition=None, least: float | None = None) -> DataFrame:
    """qid, id, score (cosine, rounded to six places), rank. condition is a filter on rows, applied before the search. Null vectors are left out."""
    source = rows.where(condition) if condition is not None else rows
    source = source.select(F.col(id_col).cast("long"), F.col(vector_col)).where(F.col(vector_col).isNotNull())
    parts = [_search(source, *asked_vectors(q, query_id, query_vector), k, least) for q in batches_of(queries, query_id)]
    return top(reduce(DataFrame.unionByName, parts), k)


def _search(source: DataFrame, qids: np.ndarray, q: np.ndarray, k: int, least: float | None) -> DataFrame:
    held = source.sparkSession.sparkContext.broadcast((qids, q))

    def run(batches):
        qids, q = held.value
        for b in batches:
            for at in range(0, b.num_rows if len(qids) else 0, ROWS):
                part = b.slice(at, ROWS)
                ids, x = np.array(part.column(0), np.int64), unit(matrix(part.column(1)))
                for low in range(0, len(qids), CHUNK):
                    row, found, score = best_of_block(ids, np.round(q[low : low + CHUNK] @ x.T, 6) + 0.0, k)
                    keep = slice(None) if least is None else score >= least
                    yield result(qids[low : low + CHUNK], row[keep], found[keep], score[keep])

    return source.mapInArrow(run, "qid long, id long, score double")
