"""Batches of queries against Arrow blocks of rows: each block keeps its k best rows for each query, and only those are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries that one pass over the rows takes, and of these the ones that meet a block at once.
BATCH, CHUNK = 20_000, 256
#: Rows of a block.
ROWS = 1024


def batches_of(queries: DataFrame, qid: str = "qid") -> Iterator[DataFrame]:
    """The queries in parts of about BATCH, by a hash of their id."""
    ids = queries.select(qid).distinct()
    parts = max(1, -(-ids.count() // BATCH))
    for i in range(parts):
        yield queries.where(F.pmod(F.xxhash64(qid), F.lit(parts)) == i) if parts > 1 else queries


def best_of_block(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of sims, id and value of the k best of each row by (value, id)."""
    n = sims.shape[1]
    least = np.partition(sims, n - k, axis=1)[:, n - k] if n > k else np.full(len(sims), -np.inf)
    row, at = np.nonzero(sims >= least[:, None])  # ties with the k-th included
    order = np.lexsort((ids[at], -sims[row, at], row))
    row, at = row[order], at[order]
    begin = np.searchsorted(row, row)
    keep = np.arange(len(row)) - begin < k
    return row[keep], ids[at[keep]], sims[row[keep], at[keep]]


def result(qids: np.ndarray, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(qids[row].astype(np.int64)), pa.array(ids), pa.array(scores)], ["qid", "id", "score"])
