"""Ranked lexical search the other way round: the items are the index, the documents are the stream.

An inverted index of the items' terms is broadcast. Every document's terms are counted against it where
the document is read; what is left is a narrow table of document, length and the counts of terms that some item has. From it come the
numbers of documents with each term, of all documents and of all terms, and then the scores: a block of
documents times a block of items is a product of two small matrices, and each task keeps a heap of the best documents for each item. Heaps
of some tasks are merged, then the merged ones; no list of an item's matches ever exists.

The index is bounded by BYTES of items' text: more items are taken in several passes, each with an index of its own. Scores are
integers; products are made in doubles while an item's largest possible score is below 2**53, so that they are exact, and in
64-bit integers beyond.

Terms are the maximal runs of ASCII letters, digits and all characters beyond ASCII; A-Z count as a-z. Terms of at most
fifteen bytes are their own names, longer ones are named by 120 bits of BLAKE2b. Null and empty texts have no terms and count as no
documents; an item without terms has no rows. Repeated rows are documents, or items, of their own. Equal scores go by ascending id, null last. Texts
of any length are read whole. Empty tables give empty results. Columns other than those named are not looked at. Ids of documents are integers; others are refused by the cast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.llm.common import col, table, text_of, written
from textquarry.llm.minhash_dedup import parts
from textquarry.llm.spans import NameIndex, names, utf8, words

TOP = 10
#: Bytes of items' texts in one index.
BYTES = 32 << 20
#: Cells of the matrices of a block of items and of a block of documents, at most about.
CELLS = 2_000_000
#: Heaps that are merged at a time.
FAN_IN = 64
#: Bytes that belong to no term.
GAP = np.ones(256, bool)
GAP[128:] = GAP[48:58] = GAP[65:91] = GAP[97:123] = False


@dataclass
class Chunk:
    """Some of the items: terms (ascending numbers) and, for each pair of a term and an item, how often the item has it."""

    items: np.ndarray
    terms: np.ndarray
    term_at: np.ndarray
    item_at: np.ndarray
    times: np.ndarray


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The names' two halves of all terms of all texts in a row, and their number in each text."""
    raw, starts, ends = utf8(texts)
    first, last, n = words(raw, starts, ends, GAP)
    return *names(raw, first, last, lower=True), n


class ItemIndex:
    """Terms of a bounded batch of items, numbered, and the items by chunks."""

    def __init__(self, texts: list[str | None]):
        low, high, n = terms_of(pa.array(texts, pa.string()))
        both, code = np.unique(np.stack([low, high], 1), axis=0, return_inverse=True)
        self.low, self.high = both[:, 0].copy(), both[:, 1].copy()
        item = np.repeat(np.arange(len(n)), n)
        key, times = np.unique(item * max(1, len(both)) + code.ravel(), return_counts=True)
        item, code = key // max(1, len(both)), key % max(1, len(both))
        begin = np.searchsorted(item, np.arange(len(n) + 1))
        self.chunks, at = [], 0
        while at < len(n):
            to = at + 1  # each item adds a row and its terms
            while to < len(n) and (to + 1 - at) * (begin[to + 1] - begin[at]) <= CELLS:
                to += 1
            own = slice(begin[at], begin[to])
            if begin[to] > begin[at]:
                terms, place = np.unique(code[own], return_inverse=True)
                self.chunks.append(Chunk(np.arange(at, to), terms, place, item[own] - at, times[own]))
            at = to

    def lookup(self) -> NameIndex:
        found = NameIndex()
        found.add(self.low, self.high)
        return found


def counted(docs: DataFrame, held, id_col: str, text_col: str) -> DataFrame:
    """id, n (terms of the document), terms (numbers in the index, ascending) and times, for each document with a term."""

    def run(batches):
        index = held.value
        size, known = max(1, len(index.low)), index.lookup()
        for p in parts(batches, 1):
            low, high, n = terms_of(p.column(1))
            code = known.find(low, high)
            met = code >= 0
            key, times = np.unique(np.repeat(np.arange(len(n)), n)[met] * size + code[met], return_counts=True)
            cut = np.searchsorted(key, np.arange(len(n) + 1) * size).astype(np.int32)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int32)))
            yield pa.record_batch([p.column(0), pa.array(n.astype(np.int64)), lists(key % size), lists(times)], ["id", "n", "terms", "times"]).filter(pa.array(n > 0))

    rows = docs.select(col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, terms array<int>, times array<int>")


class Heaps:
    """The best documents of each item by (score, id), at most k."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.zeros(items, np.int64)
        self.item, self.score, self.id, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def offer(self, item: np.ndarray, score: np.ndarray, id_: np.ndarray, none: np.ndarray) -> None:
        if not len(item):
            return
        item, score, id_, none = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.id, id_), (self.none, none)))
        order = np.lexsort((id_, none, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[rank < self.k]
        self.item, self.score, self.id, self.none = item[rank < self.k], score[keep], id_[keep], none[keep]
        last = rank == self.k - 1
        self.least[item[last]] = score[order[last]]


def scored(rows: DataFrame, held, weights, total: tuple[int, int], k: int) -> DataFrame:
    """item, id, score, part: each task's heaps."""
    n_docs, n_terms = total

    def run(batches: Iterator[pa.RecordBatch]):
        index, weight = held.value, weights.value
        items = max((int(c.items[-1]) + 1 for c in index.chunks), default=0)
        heaps = Heaps(items, k)
        for batch in batches:
            lists = batch.column("terms")
            sizes = np.array(lists.value_lengths(), np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            term, tf = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            m = 25 + (75 * np.array(batch.column("n"), np.int64) * n_docs) // n_terms
            part = (1_000_000_000 * tf) // (1000 * tf + 8 * m[owner])
            none = np.array(batch.column("id").is_null())
            ids = batch.column("id").fill_null(0).to_numpy()
            for c in index.chunks:
                at = np.searchsorted(c.terms, term)
                here = np.flatnonzero(c.terms[np.minimum(at, len(c.terms) - 1)] == term)
                cell = c.times * weight[c.terms[c.term_at]]
                exact = np.bincount(c.item_at, cell.astype(float), len(c.items)).max() * 1e6 < 2**52
                kind = np.float64 if exact else np.int64
                right = np.zeros((len(c.terms), len(c.items)), kind)
                right[c.term_at, c.item_at] = cell
                step = max(1, min(256, CELLS // len(c.terms)))
                cuts = np.searchsorted(owner[here], np.arange(0, len(sizes) + step, step))
                for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if a == b:
                        continue
                    own, base = here[a:b], j * step
                    some, column = np.unique(at[own], return_inverse=True)
                    left = np.zeros((min(step, len(sizes) - base), len(some)), kind)
                    left[owner[own] - base, column] = part[own]
                    score = (left @ right[some]).astype(np.int64)
                    doc, item = np.nonzero(score >= np.maximum(heaps.least[c.items], 1))
                    heaps.offer(c.items[item], score[doc, item], ids[base + doc], none[base + doc])
        if len(heaps.item):
            own = TaskContext.get().partitionId()
            yield pa.record_batch([pa.array(heaps.item.astype(np.int32)), pa.array(heaps.id, pa.int64(), mask=heaps.none), pa.array(heaps.score), pa.array(np.full(len(heaps.item), own, np.int32))], ["item", "id", "score", "part"])

    return rows.mapInArrow(run, "item int, id long, score long, part int")


def best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best rows by score, then id, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _batches(items: DataFrame, most: int) -> Iterator[list[tuple]]:
    """Items (key, text) in lists of about most bytes of text."""
    held, size = [], 0
    for r in items.toLocalIterator():
        held.append((r[0], r[1]))
        size += 64 + len(r[1] or "")
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = BYTES) -> DataFrame:
    """item_col, rank, id_col, score: the k documents with the highest scores above 0 for each row of items."""
    spark = docs.sparkSession
    asked = items.select(col(item_col).alias("key"), text_of(item_text).alias("text"))
    schema = T.StructType([T.StructField(item_col, asked.schema["key"].dataType), T.StructField("rank", T.IntegerType()), T.StructField(id_col, T.LongType()), T.StructField("score", T.LongType())])
    out, total = [], None
    for batch in _batches(asked, most):
        index = ItemIndex([text for _, text in batch])
        held = spark.sparkContext.broadcast(index)
        rows = written(counted(docs, held, id_col, text_col), "term-counts")
        if total is None:
            all_ = rows.agg(F.count("*"), F.sum("n")).first()
            total = (all_[0], all_[1] or 1)
        df = np.zeros(len(index.low), np.int64)
        found = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("c")).toPandas()  # a row for each term of the index at most
        df[found["t"].to_numpy(np.int64)] = found["c"].to_numpy(np.int64)
        weight = np.floor(1000 * np.log((2 * total[0] + 2) / (2 * df + 1))).astype(np.int64)
        heaps = scored(rows, held, spark.sparkContext.broadcast(weight), total, k)
        merged = best(heaps.withColumn("some", (F.col("part") / FAN_IN).cast("int")), ["item", "some"], k)
        merged = best(merged.select("item", "id", "score"), ["item"], k)
        keys = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(batch)], T.StructType([T.StructField("no", T.IntegerType()), T.StructField("key", schema[0].dataType)]))
        out.append(merged.join(F.broadcast(keys), F.col("item") == F.col("no")).select(F.col("key").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, {_TERMS.format("text")} AS t FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0
), z AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM l
), p AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY doc_id, term
), q AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark) GROUP BY item_id, term
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), z
), s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN l USING (doc_id), z GROUP BY item_id, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
