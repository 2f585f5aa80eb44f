"""Byte-pair encoding and decoding of text columns.

``encode`` runs the pair-occurrence encoder of ``bpe`` over Arrow batches: each
distinct chunk of a batch is encoded once, so work in Python follows the number
of distinct words. There is no shuffle and nothing is broadcast; the vocabulary
is read from its path once in each worker.

Null and empty texts give an empty list of ids. Texts may be of any length.
Repeated rows give equal rows; an empty table gives an empty table of the same
columns. Columns other than the two that are named are not looked at, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.llm import bpe
from textquarry.llm.common import col, table
from textquarry.llm.spans import give_back

#: Ids that leave a worker in one batch, about.
OUT_IDS = 2_000_000
#: Characters of text that are encoded at a time, about.
IN_BYTES = 4 << 20


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about most."""
    at = 0
    ends = np.cumsum(sizes)
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield at, to
        at = to


def encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """First column, ids in a row and number of ids for each run of rows; the second column holds the texts."""
    model = bpe.load(vocabulary)
    for batch in batches:
        lengths = batch.column(1).cast(pa.large_string()).buffers()
        at = np.frombuffer(lengths[1], np.int64, batch.num_rows + 1) if batch.num_rows else np.zeros(1, np.int64)
        for a, b in slices(batch, np.diff(at), IN_BYTES):
            part = batch.slice(a, b - a)
            ids, sizes = model.encode_batch(part.column(1))
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                sizes = sizes + 1
            yield part.column(0), ids, sizes
    model.rest()
    give_back()


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None) -> DataFrame:
    """id_col, ids array<int>, n_tokens long: the ids of every whole text, with end_id after them if it is given."""

    def run(batches):
        for keys, ids, sizes in encoded(batches, vocabulary, end_id):
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for a, b in slices(keys_batch := pa.record_batch([keys], ["k"]), sizes, OUT_IDS):
                lists = pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), pa.array(ids[ends[a] : ends[b]]))
                yield pa.record_batch([keys_batch.column(0).slice(a, b - a), lists, pa.array(sizes[a:b])], names)

    names = [id_col, "ids", "n_tokens"]
    kind = df.select(col(id_col)).schema[0].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])
    return df.select(col(id_col), col(text_col).cast("string")).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the text of its ids in out_col (a column of that name is replaced). Null lists give empty texts; special tokens stay."""
    rest = [c for c in df.columns if c != out_col]
    at = rest.index(ids_col)

    def run(batches):
        model = bpe.load(vocabulary)
        for batch in batches:
            lists = batch.column(at)
            sizes = np.array(lists.value_lengths().fill_null(0))
            for a, b in slices(batch, sizes, OUT_IDS // 4):
                part = batch.slice(a, b - a)
                texts = [model.decode(x or []) for x in part.column(at).to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], [*rest, out_col])

    schema = T.StructType([*df.select(*map(col, rest)).schema.fields, T.StructField(out_col, T.StringType())])
    return df.select(*map(col, rest)).mapInArrow(run, schema)


def op2_bpe_encode(spark, sf_dir: str) -> DataFrame:
    """Round trip of every document through the word-level vocabulary, as digests."""
    path = word_vocabulary()
    back = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return back.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
