"""BM25 for a table of queries at once, over the stored index of ``index``.

A search weighs the terms of a bounded batch of queries and reads the posting rows of these terms. The rows of a block of documents
meet in one task: a block's saturated counts times the weights gives all scores, and only the k best of a block
for each query are shuffled. From PRUNE_FROM blocks on, bounds of the blocks (from the largest counts and the smallest lengths, without reading a posting)
tell which blocks can't reach a query's k-th score; these are neither shuffled nor scored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.text import blank_tokens, clean_tokens, word_tokens
from textquarry.operators import index as index_
from textquarry.operators.blocks import CHUNK, best_of_block
from textquarry.operators.index import Index
from textquarry.operators.storage import fingerprint, new_path, shared_dir, written

#: Pairs of a query and a term in a batch; cells of a matrix.
PAIRS, CELLS = 1_000_000, 2_000_000
#: Blocks from which pruning is worth its own reading, and pairs of a query and a block up to which their bounds are made.
PRUNE_FROM, PRUNE_TO = 16, 200_000_000
#: Blocks of a query that are scored first, and what rounding may cost.
SEEDS, SLACK = 2, 1e-5
#: Seeds of all questions of a batch are one in so many blocks at most, or nothing is pruned.
SEEDS_SHARE = 4


def build_index(docs: DataFrame, id_col: str, text_col: str, tokens: Callable[[Column], Column] = word_tokens, folder: str | None = None, block: int = index_.BLOCK) -> Index:
    """Writes an index to a folder, a new one in the shared folder if none is given. Null texts have no terms but count as documents."""
    return index_.built(tokenised(docs, id_col, text_col, tokens), folder or new_path(docs.sparkSession, "index"), block)


def tokenised(docs: DataFrame, id_col: str, text_col: str, tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """id, tokens."""
    return docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("tokens"))


def stored_index(spark: SparkSession, path: str, id_col: str, text_col: str, tokens: str = "words", where: str = "true") -> Index:
    """The index of the rows of a Parquet table that meet a condition, from the shared folder if it has one of the same files, tokeniser, columns and condition; else it is built there."""
    key = hashlib.sha256("\n".join((fingerprint(spark, path), tokens, id_col, text_col, where)).encode()).hexdigest()[:32]
    folder = f"{shared_dir(spark).rstrip('/')}/textquarry/index-{key}"
    if index_.versions(spark, folder):
        return index_.opened(spark, folder)
    return build_index(spark.read.parquet(path).where(where), id_col, text_col, TOKENISERS[tokens], folder)


def extended(index: Index, docs: DataFrame, id_col: str, text_col: str, tokens: Callable[[Column], Column] = word_tokens) -> Index:
    """The index with further documents; those that it has are replaced. Writes one segment of the new ones."""
    return index_.extended(index, tokenised(docs, id_col, text_col, tokens))


def query_terms(queries: DataFrame, id_col: str, text_col: str, tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """qid, term and how often the query has it."""
    return queries.select(F.col(id_col).alias("qid"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("m"))


#: Inverse document frequency by variant; n documents, df of them with the term.
PLAIN = "ln(n - df + 0.5D) - ln(df + 0.5D)"
VARIANTS = {
    "floor": PLAIN,
    "package": PLAIN,
    "okapi": "ln((n - df + 0.5D) / (df + 0.5D) + 1)",
    "l": "ln((n + 1) / (df + 0.5D))",
    "plus": "ln((n + 1) / CAST(df AS DOUBLE)) + {epsilon}D",
}


def idf(index: Index, variant: str = "floor", epsilon: float = 0.25) -> DataFrame:
    """term, df, idf. floor: negative values are lifted to epsilon times the mean; package: they are replaced by it."""
    raw = index.terms.withColumn("n", F.lit(index.n_docs)).withColumn("idf", F.expr(VARIANTS[variant].format(epsilon=epsilon))).drop("n")
    if variant not in ("floor", "package"):
        return raw.select("term", "df", "idf")
    mean = raw.agg((F.lit(epsilon) * F.avg("idf")).alias("low"))
    low = F.greatest("idf", "low") if variant == "floor" else F.col("low")
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("idf") < 0, low).otherwise(F.col("idf")).alias("idf"))  # one row is broadcast


def top(scored: DataFrame, k: int, score: str = "score", by: str = "qid", tie: str = "id") -> DataFrame:
    """The k best rows of each query with rank from 1; ties go by id."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


@dataclass(frozen=True)
class Batch:
    """Terms of a bounded number of questions with their weights, sparse; sent to all tasks."""

    qids: np.ndarray
    names: pa.Array
    term: np.ndarray
    question: np.ndarray
    weight: np.ndarray

    def matrix(self, terms: np.ndarray, low: int, high: int) -> np.ndarray:
        """Weights of some terms (ascending numbers) for the questions from low to high."""
        out = np.zeros((len(terms), high - low))
        at = np.searchsorted(terms, self.term)
        own = (terms[np.minimum(at, len(terms) - 1)] == self.term) & (self.question >= low) & (self.question < high)
        out[at[own], self.question[own] - low] = self.weight[own]
        return out


def _batches(index: Index, terms: DataFrame, variant: str, epsilon: float) -> Iterator[tuple[DataFrame, Batch]]:
    """The questions in parts of about PAIRS terms: their different terms, and their weights."""
    n = terms.count()
    parts = max(1, -(-n // PAIRS))
    values = idf(index, variant, epsilon)
    for i in range(parts):
        own = terms.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i) if parts > 1 else terms
        rows = own.join(values, "term").select("qid", "term", (F.col("m") * F.col("idf")).alias("w")).toArrow()
        words = rows.column("term").combine_chunks().dictionary_encode() if len(rows) else pa.array([], pa.string()).dictionary_encode()
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        qids, of = np.unique(rows.column("qid").to_numpy(), return_inverse=True)
        order = np.argsort(words.indices.to_numpy(), kind="stable")
        held = Batch(qids.astype(np.int64), words.dictionary, words.indices.to_numpy().astype(np.int64)[order], of[order], rows.column("w").to_numpy()[order])
        schema = T.StructType([T.StructField("term", T.StringType())])
        yield terms.sparkSession.createDataFrame(pa.table({"term": words.dictionary.cast(pa.string())}), schema), held


def _saturated(tf, dl, k1: float, b: float, average: float):
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average))


def _scored(index: Index, postings: DataFrame, docs: DataFrame, held: Batch, k: int, k1: float, b: float, least=None, restricted: bool = False) -> DataFrame:
    """qid, id, score of the k best of each block for each question, above 0 and not below least (a value for each question). With restricted, docs have asked (qid, off): only these pairs, all of them."""
    average, size = index.average or 1.0, max((s.block for s in index.segments), default=1)
    sent = docs.sparkSession.sparkContext.broadcast((held, least))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        batch, floor = sent.value
        none = pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        code = pc.index_in(left.column("term").combine_chunks(), value_set=batch.names).to_numpy().astype(np.int64)
        gaps, tfs = left.column("gaps").combine_chunks(), left.column("tfs").combine_chunks()
        n = np.array(gaps.value_lengths(), np.int64)
        end = np.cumsum(gaps.flatten().to_numpy().astype(np.int64))
        off = end - np.repeat(np.concatenate([[0], end[np.cumsum(n)[:-1] - 1]]), n)  # gaps of a row begin at its first place
        tf = tfs.flatten().to_numpy().astype(np.int64)
        ids = right.column("ids")[0].values.to_numpy()
        dls = right.column("dls")[0].values.to_numpy().astype(np.int64)
        there = np.ones(len(ids), bool)
        for c in (right.column("gone")[0].values,):
            if c is not None:
                there[c.to_numpy()] = False
        if "some" in right.column_names:
            some = np.zeros(len(ids), bool)
            some[right.column("some")[0].values.to_numpy()] = True
            there &= some
        terms, at = np.unique(code, return_inverse=True)
        value = _saturated(tf, dls[off], k1, b, average)
        column = np.repeat(at, n)
        bound = _saturated(left.column("max_tf").to_numpy().astype(float), left.column("min_dl").to_numpy().astype(float), k1, b, average)
        most = np.zeros(len(terms))
        np.maximum.at(most, at, bound)
        order = np.argsort(off, kind="stable")
        off, column, value = off[order], column[order], value[order]
        asked = None
        if restricted:
            pairs = right.column("asked")[0].values
            qid = pairs.field("qid").to_numpy()
            place = np.minimum(np.searchsorted(batch.qids, qid), len(batch.qids) - 1)
            own = batch.qids[place] == qid  # others belong to another batch
            asked = place[own], pairs.field("off").to_numpy()[own]
        out = []
        wide = max(1, min(CHUNK, CELLS // len(terms)))
        for low in range(0, len(batch.qids), wide):
            weights = batch.matrix(terms, low, min(low + wide, len(batch.qids)))
            open_ = np.arange(weights.shape[1])
            if floor is not None:  # questions that no document of the block can serve
                open_ = open_[np.maximum(weights, 0).T @ most >= floor[low : low + len(open_)] - SLACK]
            elif asked is not None:
                open_ = np.unique(asked[0][(asked[0] >= low) & (asked[0] < low + len(open_))]) - low
            if not len(open_):
                continue
            weights = weights[:, open_]
            step = max(1, min(size, CELLS // len(terms), CELLS // max(1, len(open_))))
            cuts = np.searchsorted(off, np.arange(0, len(ids) + step, step))
            for j, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
                base = j * step
                if a == z:
                    continue
                met, place = np.unique(column[a:z], return_inverse=True)
                counts = np.zeros((min(step, len(ids) - base), len(met)))
                counts[off[a:z] - base, place] = value[a:z]
                sums = np.round((counts @ weights[met]).T, 6)
                if asked is not None:
                    own = (asked[1] >= base) & (asked[1] < base + step) & np.isin(asked[0], open_ + low)
                    row, doc = np.searchsorted(open_, asked[0][own] - low), asked[1][own]
                    found, score = ids[doc], sums[row, doc - base]
                else:
                    sums[:, ~there[base : base + step]] = -np.inf
                    row, found, score = best_of_block(ids[base : base + step], sums, k)
                keep = score > 0
                if floor is not None:
                    keep &= score >= floor[low + open_[row]] - SLACK
                out.append(pa.table({"qid": batch.qids[low + open_[row[keep]]], "id": found[keep], "score": score[keep]}))
        return pa.concat_tables(out) if out else none

    here = ["seg", "block"]
    return postings.groupBy(*here).cogroup(docs.groupBy(*here)).applyInArrow(run, "qid long, id long, score double")


def _bounds(index: Index, postings: DataFrame, weights: DataFrame, k1: float, b: float) -> DataFrame:
    """qid, seg, block, most: what no document of the block can exceed. Reads no posting."""
    part = _saturated(F.col("max_tf"), F.col("min_dl"), k1, b, index.average or 1.0)
    return postings.select("seg", "block", "term", part.alias("part")).join(F.broadcast(weights), "term").groupBy("qid", "seg", "block").agg(F.sum(F.greatest("w", F.lit(0.0)) * F.col("part")).alias("most"))


def _pruned(index: Index, postings: DataFrame, docs: DataFrame, held: Batch, k: int, k1: float, b: float) -> DataFrame:
    """Like _scored, over the blocks that may hold one of the k best only. Each question's SEEDS most promising blocks are scored first; their k-th score is what the others must reach."""
    spark, names = index.spark, held.names.to_pylist()
    weights = spark.createDataFrame([(int(held.qids[q]), names[t], float(w)) for t, q, w in zip(held.term.tolist(), held.question.tolist(), held.weight.tolist())], "qid long, term string, w double")
    bounds = written(_bounds(index, postings, weights, k1, b), "block-bounds")
    w = Window.partitionBy("qid").orderBy(F.desc("most"), "seg", "block")
    seeds = bounds.withColumn("r", F.row_number().over(w)).where(F.col("r") <= SEEDS).select("seg", "block").distinct()
    here = ["seg", "block"]
    first = _scored(index, postings.join(seeds, here, "left_semi"), docs.join(seeds, here, "left_semi"), held, k, k1, b)
    kth = {r["qid"]: r["s"] for r in top(first, k).where(F.col("rank") == k).select("qid", F.col("score").alias("s")).collect()}  # a row for each question of the batch
    least = np.array([kth.get(q, 0.0) for q in held.qids.tolist()])
    bars = spark.createDataFrame(pa.table({"qid": held.qids, "least": least}))
    able = bounds.join(F.broadcast(bars), "qid").where(F.col("most") >= F.col("least") - SLACK).select(*here).distinct()
    return _scored(index, postings.join(able, here, "left_semi"), docs.join(able, here, "left_semi"), held, k, k1, b, least)


def score(index: Index, terms: DataFrame, pairs: DataFrame, variant: str = "floor", k1: float = 1.2, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """qid, id, score (rounded to six places) of the pairs (qid, id), only rows above 0."""
    here = ["seg", "block"]
    wanted = pairs.select(F.col("qid").cast("long").alias("qid"), F.col("id").cast("long").alias("id")).distinct()
    at = index.places().select("seg", "block", "off", "id").join(wanted, "id").groupBy(*here).agg(F.collect_list(F.struct("qid", "off")).alias("asked"))
    at, out = written(at, "asked-pairs"), []
    docs = index.docs().join(at, here)
    for words, held in _batches(index, terms, variant, epsilon):
        out.append(_scored(index, index.blocks(words).join(at.select(*here), here, "left_semi"), docs, held, 0, k1, b, restricted=True))
    return reduce(DataFrame.unionByName, out)


def best(index: Index, terms: DataFrame, k: int, variant: str = "floor", k1: float = 1.2, b: float = 0.75, epsilon: float = 0.25, subset: DataFrame | None = None) -> DataFrame:
    """qid, id, score, rank of the k best documents above 0 of each query; terms: qid, term, m. subset (id) restricts the documents, not the statistics."""
    docs = index.docs()
    if subset is not None:
        some = index.places().join(subset.select("id").distinct(), "id", "left_semi").groupBy("seg", "block").agg(F.collect_list("off").alias("some"))
        docs = docs.join(some, ["seg", "block"])
    out = []
    for words, held in _batches(index, terms, variant, epsilon):
        postings = index.blocks(words)
        blocks = sum(-(-s.n_docs // s.block) for s in index.segments)
        few = SEEDS * len(held.qids) * SEEDS_SHARE <= blocks  # else scoring the seeds would be as much work as scoring all
        prune = PRUNE_FROM <= blocks and few and blocks * len(held.qids) <= PRUNE_TO and subset is None
        out.append((_pruned if prune else _scored)(index, postings, docs, held, k, k1, b))
    return top(reduce(DataFrame.unionByName, out), k)


TOKENISERS = {"words": word_tokens, "clean": clean_tokens, "blank": blank_tokens}


def search(docs: DataFrame | Index, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", tokens: str = "words", threshold: float | None = None, stop_words: tuple[str, ...] = (), **options) -> DataFrame:
    """qid, id, score, rank of the k best documents of each query; docs are an index or documents, from which one is built. stop_words count in no question. A threshold of 0 or None is off and applies after the cut."""
    of = TOKENISERS[tokens]
    index = docs if isinstance(docs, Index) else build_index(docs, id_col, text_col, of)
    asked = query_terms(queries, query_id, query_text, of)
    found = best(index, asked.where(~F.col("term").isin(*stop_words)) if stop_words else asked, k, **options)
    return found.where(F.col("score") >= threshold) if threshold else found
