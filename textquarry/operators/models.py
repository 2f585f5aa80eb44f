"""Operators that call a model in Python workers: embedding, diversification, pair scoring, sentence and semantic chunks.

Models are plain callables made once in each task by a factory, so any library can stand behind them. The defaults need
no files: feature hashing for vectors, word overlap for pairs. Work is in Arrow batches; groups are the candidates of one
query, whose number the search before has bounded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.text import normalised

Embedder = Callable[[list[str]], np.ndarray]
DIM = 64
BATCH = 32


def hashing_embedder(dim: int = DIM) -> Embedder:
    """Signed counts of words hashed into dim places."""

    blank = {i: " " for i in range(128) if not re.match(r"\w", chr(i))}

    def embed(texts: list[str]) -> np.ndarray:
        words = [t.lower().translate(blank).split(" ") if t.isascii() else re.findall(r"\w+", t.lower()) for t in texts]  # the same words, and empty ones
        numbers = {w: crc32(w.encode()) for w in set().union(*words)}  # each word of a batch once
        h = np.array([numbers[w] for own in words for w in own if w], np.int64)
        rows = np.repeat(np.arange(len(words)), [len(own) - own.count("") for own in words])
        return np.bincount(rows * dim + h % dim, np.where(h >> 31 > 0, 1.0, -1.0), len(texts) * dim).reshape(len(texts), dim)

    return embed


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x, float), where=n > 0)


def embedded(model: Embedder, texts: list[str]) -> list[tuple[np.ndarray | None, str | None]]:
    """Vectors of length one with errors; a batch that fails is tried again text by text."""
    try:
        return [(v, None) for v in unit_rows(np.asarray(model(texts), float))]
    except Exception as e:
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}"[:200])]
        return [embedded(model, [t])[0] for t in texts]


def embed(df: DataFrame, text_col: str, factory: Callable[[], Embedder] = hashing_embedder, prefix: str = "", batch: int = BATCH) -> DataFrame:
    """df with embedding array<float> and error string. Null texts have neither. prefix is put before each text (query: or passage: for models that want it)."""

    def run(batches: Iterable[pa.RecordBatch]):
        model = factory()
        for rows in batches:
            texts = rows.column(text_col).to_pylist()
            some = [i for i, t in enumerate(texts) if t is not None]
            sizes, values, errors = np.full(len(texts), -1), [], [None] * len(texts)
            for at in range(0, len(some), batch):
                own = some[at : at + batch]
                for i, (v, e) in zip(own, embedded(model, [prefix + texts[i] for i in own])):
                    errors[i] = e
                    if v is not None:
                        sizes[i] = len(v)
                        values.append(v)
            flat = pa.array(np.concatenate(values).astype(np.float32) if values else [], pa.float32())
            ends = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))]).astype(np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array(sizes < 0))
            yield pa.RecordBatch.from_arrays([*rows.columns, vectors, pa.array(errors, pa.string())], [*rows.schema.names, "embedding", "error"])

    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])
    return df.mapInArrow(run, schema)


def batch_result(df: DataFrame) -> DataFrame:
    """Processed, succeeded, failed of an embedding job."""
    return df.agg(F.count("*").alias("processed"), F.count_if(F.col("embedding").isNotNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def diversified(relevance: np.ndarray, similar: np.ndarray, k: int, share: float, floor: float | None = None) -> list[int]:
    """Greedy choice by share * relevance - (1 - share) * largest similarity to what is chosen; ties go to the first. floor bounds that similarity from below."""
    chosen: list[int] = []
    nearest = np.zeros(len(relevance))
    left = np.ones(len(relevance), bool)
    while left.any() and len(chosen) < k:
        gain = np.where(left, share * relevance - (1 - share) * nearest, -np.inf)
        best = int(gain.argmax())
        left[best] = False
        nearest = similar[best] if len(chosen) == 0 else np.maximum(nearest, similar[best])
        if floor is not None:
            nearest = np.maximum(nearest, floor)
        chosen.append(best)
    return chosen


def mmr(candidates: DataFrame, k: int, share: float = 0.5, full: bool = False) -> DataFrame:
    """Diversified candidates: qid, id, rank, mmr_score. Rows: qid, id, score, vector, query_vector.

    Top-k form: relevance is the cosine to the query, which is also mmr_score; k candidates or fewer stay as they are, without
    mmr_score. Full form: relevance is the score given, similarities below 0 count as 0, all are reordered, ranks begin at 0,
    mmr_score is the score. Candidates come in the order of score and id.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        x = np.array(pdf["vector"].tolist(), float)
        if full:
            n = np.linalg.norm(x, axis=1)
            order = diversified(pdf["score"].to_numpy(float), (x @ x.T) / (np.outer(n, n) + 1e-8), len(pdf), share, 0.0)
            score, start = pdf["score"].to_numpy(float), 0
        elif len(pdf) <= k:
            order, score, start = list(range(len(pdf))), np.full(len(pdf), np.nan), 1
        else:
            x, q = unit_rows(x), unit_rows(np.array(pdf["query_vector"].iloc[:1].tolist(), float))[0]
            score, start = x @ q, 1
            order = diversified(score, x @ x.T, k, share)
        out = pd.DataFrame({"qid": pdf["qid"].iloc[order].to_numpy(), "id": pdf["id"].iloc[order].to_numpy(), "rank": np.arange(start, start + len(order)), "mmr_score": score[order]})
        return out.astype({"mmr_score": object}).where(out["mmr_score"].notna(), None) if out["mmr_score"].isna().any() else out

    return candidates.select("qid", "id", "score", "vector", "query_vector").groupBy("qid").applyInPandas(one, "qid long, id long, rank long, mmr_score double")


Scorer = Callable[[list[tuple[str, str]]], list[float]]


def overlap_scorer() -> Scorer:
    """Share of the query's distinct words that the text has."""

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        words = {t: set(re.findall(r"\w+", t.lower())) for pair in pairs for t in pair}  # each text of a batch once
        return [len(words[a] & words[b]) / len(words[a]) if words[a] else 0.0 for a, b in pairs]

    return score


def rerank(pairs: DataFrame, k: int, factory: Callable[[], Scorer] = overlap_scorer) -> DataFrame:
    """Rows (qid, id, rank, query, text) scored by a pair model and cut to k: qid, id, rerank_score, rank. Where the model fails, rows keep their order (no score)."""
    from textquarry.operators.bm25 import top

    def run(frames):
        model = factory()
        for pdf in frames:
            try:
                score = list(map(float, model(list(zip(pdf["query"].fillna(""), pdf["text"].fillna(""))))))
            except Exception:
                score = [None] * len(pdf)
            yield pd.DataFrame({"qid": pdf["qid"], "id": pdf["id"], "old": pdf["rank"], "rerank_score": pd.Series(score, index=pdf.index, dtype="float64")})

    scored = pairs.select("qid", "id", "rank", "query", "text").mapInPandas(run, "qid long, id long, old long, rerank_score double")
    return top(scored.withColumn("s", F.coalesce("rerank_score", -F.col("old").cast("double"))), k, "s").select("qid", "id", "rerank_score", "rank")


# Chunks by sentences ------------------------------------------------------------------------------------------

SENTENCE = "(?<=[.!?])\\s+"


def sentences(text):
    """Sentences of the normalised text; null and empty texts have none."""
    parts = F.split(F.coalesce(normalised(text), F.lit("")), SENTENCE)
    return F.filter(parts, lambda s: s != "")


def long_pieces(sentence: str, size: int) -> list[str]:
    """A sentence longer than size: packed anew from its parts after ; , : or else cut every size characters with an overlap of 50."""
    parts = re.split(r"(?<=[;,:])\s+", sentence)
    if len(parts) == 1:
        step = max(1, size - 50)
        return [sentence[i : i + size] for i in range(0, max(1, -(-(len(sentence) - size) // step) * step + 1), step)]
    out = [parts[0]]
    for p in parts[1:]:
        if len(out[-1]) + len(p) + 1 <= size:
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def packed(parts: list[str], size: int, overlap: int) -> list[str]:
    """Sentences packed greedily up to size (a blank each counts), the last overlap ones repeated in the next chunk."""
    chunks, held, n = [], [], 0

    def flush() -> None:
        nonlocal held, n
        chunks.append(" ".join(held))
        held = held[-overlap:] if overlap else []
        n = sum(len(s) + 1 for s in held)

    for s in parts:
        if len(s) > size:
            if held:
                flush()
            *whole, last = long_pieces(s, size)
            chunks += whole
            held, n = [last], len(last)
            continue
        if held and n + len(s) + 1 > size:
            flush()
        held.append(s)
        n += len(s) + 1
    return chunks + ([" ".join(held)] if held else [])


def sentence_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 900, overlap: int = 150) -> DataFrame:
    """id_col, chunk_index, text: chunks that end with sentences."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    repeat = max(1, overlap // 100)

    schema = T.StructType([df.schema[id_col], T.StructField("chunk_index", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, 1):
                chunks = [packed(s, size, repeat) for s in part.column(1).to_pylist()]
                row = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
                no = np.concatenate([np.arange(len(c)) for c in chunks]).astype(np.int64)
                yield pa.record_batch([part.column(0).take(pa.array(row)), pa.array(no), pa.array([t for c in chunks for t in c], pa.string())], schema.names)

    return df.select(id_col, sentences(F.col(text_col)).alias("s")).mapInArrow(run, schema)


#: Bytes of rows that are Python objects at a time.
PIECE = 4 << 20


def pieces_of(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about PIECE bytes of a column of lists of texts."""
    lists = batch.column(column)
    ends = np.array(pc.fill_null(pc.list_value_length(lists), 0), np.int64).cumsum()
    length = np.append(0, np.array(pc.fill_null(pc.binary_length(lists.flatten()), 0), np.int64).cumsum())
    upto, at = length[ends], 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PIECE, "right")))
        yield batch.slice(at, to - at)
        at = to


def semantic_chunks(df: DataFrame, id_col: str, text_col: str, factory: Callable[[], Embedder] = hashing_embedder, size: int = 900, least: float = 0.7) -> DataFrame:
    """id_col, chunk_index, text: sentences stay together while neighbours are similar and the chunk does not exceed size. One row holds all of a document, so nothing is shuffled."""

    def run(frames):
        model = factory()
        for pdf in frames:
            keys, no, texts = [], [], []
            for key, parts in zip(pdf[id_col], pdf["s"]):
                parts = list(parts)
                if not parts:
                    continue
                x = np.asarray(model(parts), float)
                x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
                near = (x[:-1] * x[1:]).sum(1)
                chunks, held = [], [parts[0]]
                n = len(parts[0])
                for s, sim in zip(parts[1:], near):
                    if sim < least or n + len(s) + 1 > size:
                        chunks.append(" ".join(held))
                        held, n = [s], len(s)
                    else:
                        held.append(s)
                        n += len(s) + 1
                chunks.append(" ".join(held))
                keys += [key] * len(chunks)
                no += range(len(chunks))
                texts += chunks
            yield pd.DataFrame({id_col: pd.Series(keys, dtype=pdf[id_col].dtype), "chunk_index": pd.Series(no, dtype="int64"), "text": pd.Series(texts, dtype=object)})

    schema = T.StructType([df.schema[id_col], T.StructField("chunk_index", T.LongType()), T.StructField("text", T.StringType())])
    return df.select(id_col, sentences(F.col(text_col)).alias("s")).mapInPandas(run, schema)
