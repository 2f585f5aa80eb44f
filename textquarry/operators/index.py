"""A stored inverted index: segments of posting blocks as Parquet tables, with versions.

A segment is never changed. It has three tables:

* ``docs``: a row for each block of up to BLOCK documents: block, ids, dls (lengths in tokens)
* ``postings``: a row for each term and block, by bucket (a hash of the term) and sorted by term: gaps (the places of the documents in the
  block, as differences), tfs, and for the block the number of postings, the largest tf and the smallest dl
* ``terms``: term, df, by bucket

A version is a row for each segment: its counts and, if documents of it were replaced or deleted, the tables of their places
(``gone``) and of the terms they had (``lost``). Adding documents writes one segment and one version. ``merged`` joins the
small segments and drops what is gone. A version takes its final name when all it names is written, so readers see whole versions only; of two
writers of the same version one fails.

A term's blocks are spread over as many files as it needs, so a very frequent term is no larger task than others; a row never has more than BLOCK
postings.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators.storage import listed, removed, renamed, spread

#: Documents of a block, and tokens beyond which it is closed.
BLOCK, TOKENS = 4096, 1_000_000
#: Tokens for each bucket, about; and the bounds of the number of buckets.
BUCKET_TOKENS, BUCKETS = 2_000_000, (8, 4096)
#: Bytes of text that are cut into words at a time, and the bytes of words.
CUT, WORD_BYTE = 1 << 22, np.array([b > 127 or chr(b).isalnum() or b == 95 for b in range(256)])
#: Segments of fewer than this share of all documents are merged.
SMALL = 0.1
TABLES = {
    "docs": "block long, ids array<long>, dls array<int>",
    "postings": "term string, block long, n int, gaps array<int>, tfs array<int>, max_tf int, min_dl int, bucket int",
    "terms": "bucket int, term string, df long",
    "gone": "block long, gone array<int>",
    "lost": "term string, df long",
}
VERSION = "segment string, n_docs long, n_tokens long, buckets int, block int, gone string, lost string, n_gone long, gone_tokens long"


@dataclass(frozen=True)
class Segment:
    segment: str
    n_docs: int
    n_tokens: int
    buckets: int
    block: int
    gone: str | None
    lost: str | None
    n_gone: int
    gone_tokens: int


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Index:
    """One version of an index."""

    spark: SparkSession
    folder: str
    version: int
    segments: tuple[Segment, ...]

    @property
    def n_docs(self) -> int:
        return sum(s.n_docs - s.n_gone for s in self.segments)

    @property
    def average(self) -> float:
        """Mean length of a document in tokens."""
        return sum(s.n_tokens - s.gone_tokens for s in self.segments) / self.n_docs if self.n_docs else 0.0

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, segment: Segment, table: str) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(self.path(f"{segment.segment}/{table}"))

    def side(self, table: str, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(self.path(name))

    def _all(self, frames: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    @property
    def terms(self) -> DataFrame:
        """term, df."""
        parts = [self.read(s, "terms").select("term", "df") for s in self.segments]
        lost = [self.side("lost", s.lost).select("term", (-F.col("df")).alias("df")) for s in self.segments if s.lost]
        if len(parts) == 1 and not lost:
            return parts[0]
        return self._all(parts + lost, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def docs(self) -> DataFrame:
        """seg, block, ids, dls, gone (places of documents that are not there any more, or null)."""

        def one(i: int, s: Segment) -> DataFrame:
            rows = self.read(s, "docs").select(F.lit(i).alias("seg"), "block", "ids", "dls")
            if not s.gone:
                return rows.withColumn("gone", F.lit(None).cast("array<int>"))
            return rows.join(self.side("gone", s.gone), "block", "left")

        return self._all([one(i, s) for i, s in enumerate(self.segments)], "seg int, block long, ids array<long>, dls array<int>, gone array<int>")

    def places(self) -> DataFrame:
        """seg, block, off, id, dl of the documents that are there."""
        each = self.docs().select("seg", "block", "gone", F.posexplode(F.arrays_zip("ids", "dls")).alias("off", "x"))
        return each.where(F.col("gone").isNull() | ~F.array_contains("gone", F.col("off"))).select("seg", "block", "off", F.col("x.ids").alias("id"), F.col("x.dls").alias("dl"))

    @property
    def lengths(self) -> DataFrame:
        """id, dl."""
        return self.places().select("id", F.col("dl").cast("long").alias("dl"))

    def blocks(self, table: DataFrame | None = None) -> DataFrame:
        """seg and all columns of the posting rows; with a table (term) that is bounded, only the rows of its terms, from their buckets."""
        few = [r[0] for r in table.limit(201).collect()] if table is not None else None

        def one(i: int, s: Segment) -> DataFrame:
            rows = self.read(s, "postings")
            if few is not None:
                if len(few) <= 200:
                    at = self.spark.range(1).select(F.array(*(bucket_of(F.lit(t), s.buckets) for t in few)).alias("b")).first()["b"] if few else []
                    rows = rows.where(F.col("bucket").isin(at or [-1])).where(reduce(lambda a, b: a | b, [F.col("term") == t for t in few], F.lit(False)))
                else:
                    rows = rows.join(F.broadcast(table.select("term", bucket_of(F.col("term"), s.buckets).alias("bucket"))), ["bucket", "term"], "left_semi")
            return rows.select(F.lit(i).alias("seg"), "term", "block", "n", "gaps", "tfs", "max_tf", "min_dl")

        return self._all([one(i, s) for i, s in enumerate(self.segments)], "seg int, term string, block long, n int, gaps array<int>, tfs array<int>, max_tf int, min_dl int")

    @property
    def postings(self) -> DataFrame:
        """id, term, tf of all documents that are there."""
        return self._each().join(self.places().select("seg", "block", "off", "id"), ["seg", "block", "off"]).select("id", "term", F.col("tf").cast("long").alias("tf"))

    def _each(self) -> DataFrame:
        """seg, term, block, off, tf, those that are gone included."""
        return self.blocks().select("seg", "term", "block", "tfs", "gaps").mapInArrow(_opened, "seg int, term string, block long, off int, tf int")


def _running(gaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row of each value of lists of gaps, and the sum of its list up to it."""
    n = np.array(gaps.value_lengths(), np.int64)
    sums, row = np.cumsum(gaps.flatten().to_numpy(), dtype=np.int64), np.repeat(np.arange(len(n)), n)
    before = np.append(0, sums)[np.cumsum(n) - n]
    return row, sums - before[row]


def _opened(batches):
    """A row for each posting."""
    for rows in batches:
        for at in range(0, rows.num_rows, 1024):  # of at most BLOCK postings each
            part = rows.slice(at, 1024)
            row, off = _running(part.column("gaps"))
            own = part.select(["seg", "term", "block"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(off.astype(np.int32)), part.column("tfs").flatten()], ["seg", "term", "block", "off", "tf"])


def _bits(batches):
    """Lists of places as bits, a byte for eight places."""
    for rows in batches:
        out = []
        for places in rows.column("gone"):
            at = places.values.to_numpy()
            held = np.zeros(int(at.max()) + 1, bool)
            held[at] = True
            out.append(np.packbits(held, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([rows.column("block"), pa.array(out, pa.binary())], ["block", "bits"])


def _counted(batches):
    """How many places of each posting row are among the bits."""
    for rows in batches:
        row, off = _running(rows.column("gaps"))
        bits = rows.column("bits")
        size = np.array(pc.binary_length(bits), np.int64)
        held, start = np.frombuffer(b"".join(bits.to_pylist()) + b"\0", np.uint8), np.cumsum(size) - size
        inside = off >> 3 < size[row]
        hit = inside & (held[np.where(inside, start[row] + (off >> 3), 0)] >> (off & 7) & 1 > 0)
        df = np.bincount(row[hit], minlength=rows.num_rows)
        some = pa.array(np.flatnonzero(df))
        yield pa.RecordBatch.from_arrays([rows.column("term").take(some), pa.array(df).take(some)], ["term", "df"])


def versions(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n) for n in listed(spark, f"{folder}/versions") if n.isdigit())


def opened(spark: SparkSession, folder: str, version: int | None = None) -> Index:
    """The last version of an index, or the one that is named."""
    version = versions(spark, folder)[-1] if version is None else version
    rows = spark.read.schema(VERSION).parquet(f"{folder}/versions/{version:08d}").orderBy("segment").collect()
    return Index(spark, folder, version, tuple(Segment(**r.asDict()) for r in rows))


def _committed(spark: SparkSession, folder: str, version: int, segments: list[Segment]) -> Index:
    path = f"{folder}/versions/.new-{uuid.uuid4().hex}"
    spark.createDataFrame([tuple(s.__dict__.values()) for s in segments], VERSION).coalesce(1).write.parquet(path)
    if not renamed(spark, path, f"{folder}/versions/{version:08d}"):
        removed(spark, path)
        raise RuntimeError(f"version {version} of the index is there already")
    return opened(spark, folder, version)


def built(docs: DataFrame, folder: str, block: int = BLOCK) -> Index:
    """Writes a new index of documents: id, and tokens or a text of words (``word_text``), which is cut where blocks are made."""
    return _committed(docs.sparkSession, folder, 1, [_segment(docs, folder, block)])


def _words(texts: pa.Array) -> pa.Array:
    """Lists of the runs of word bytes of texts without nulls."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    word = WORD_BYTE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]
    begins[first] = word[first]
    kept = data[word]
    cut = np.append(np.flatnonzero(begins[word]), len(kept)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut), pa.py_buffer(kept))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(begins))[ends].astype(np.int32)), words)


def _cut(batches):
    """Batches of id and text as batches of id and tokens, about CUT bytes at a time."""
    for rows in batches:
        ends, at = np.cumsum(np.array(pc.binary_length(rows.column(1)), np.int64)), 0
        while at < rows.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CUT, "right")))
            part = rows.slice(at, to - at)
            yield pa.RecordBatch.from_arrays([part.column(0), _words(part.column(1))], ["id", "tokens"])
            at = to


def _postings(ids: pa.Array, lists: pa.Array, number: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """The row of a block's documents, and its posting rows in the order of their terms."""
    dl = np.array(lists.value_lengths(), np.int64)
    words = lists.flatten().dictionary_encode()
    size = max(1, len(words.dictionary))
    key, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(dl) + np.repeat(np.arange(len(dl)), dl), return_counts=True)
    code, doc = key // len(dl), key % len(dl)
    begin = np.searchsorted(code, np.arange(size)) if len(code) else np.zeros(0, np.int64)
    gaps = np.diff(doc, prepend=0)
    gaps[begin] = doc[begin]
    cut, n = pa.array(np.append(begin, len(code)).astype(np.int32)), len(begin)
    ints = lambda x: pa.array(x.astype(np.int32))
    terms = words.dictionary if n else pa.array([], pa.string())
    none = lambda kind, n: pa.nulls(n, kind)
    own = pa.record_batch([none(pa.string(), 1), pa.array([number], pa.int64()), none(pa.int32(), 1), none(pa.list_(pa.int32()), 1), none(pa.list_(pa.int32()), 1), none(pa.int32(), 1), none(pa.int32(), 1), pa.ListArray.from_arrays(pa.array([0, len(dl)], pa.int32()), ids), pa.ListArray.from_arrays(pa.array([0, len(dl)], pa.int32()), ints(dl))], RAW)
    rows = pa.record_batch(
        [terms.cast(pa.string()), pa.array(np.full(n, number)), ints(np.diff(np.append(begin, len(code)))), pa.ListArray.from_arrays(cut, ints(gaps)), pa.ListArray.from_arrays(cut, ints(tf)), ints(np.maximum.reduceat(tf, begin) if n else begin), ints(np.minimum.reduceat(dl[doc], begin) if n else begin), none(pa.list_(pa.int64()), n), none(pa.list_(pa.int32()), n)],
        RAW,
    )
    return own, rows


#: Columns of a segment before it is sorted: posting rows, and rows without a term for the documents of a block.
RAW = ["term", "block", "n", "gaps", "tfs", "max_tf", "min_dl", "ids", "dls"]
RAW_SCHEMA = "term string, block long, n int, gaps array<int>, tfs array<int>, max_tf int, min_dl int, ids array<long>, dls array<int>"


def _blocks(batches, block: int):
    """Whole blocks of a task's documents (id, tokens): at most block documents, and about TOKENS tokens."""
    part, number, ids, lists, docs, tokens = TaskContext.get().partitionId(), 0, [], [], 0, 0

    def flush():
        nonlocal number, ids, lists, docs, tokens
        out = _postings(pa.concat_arrays(ids), pa.concat_arrays(lists), (part << 32) + number)
        number, ids, lists, docs, tokens = number + 1, [], [], 0, 0
        return out

    for batch in batches:
        ends, at = np.cumsum(np.array(batch.column(1).value_lengths(), np.int64)), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = min(int(np.searchsorted(ends, base + max(0, TOKENS - tokens), "right")), at + block - docs)
            to = max(to, at + (docs == 0))  # a document of more tokens is a block of its own
            if to > at:
                ids.append(batch.column(0).slice(at, to - at))
                lists.append(batch.column(1).slice(at, to - at))
                docs, tokens, at = docs + to - at, tokens + int(ends[to - 1] - base), to
            if docs >= block or tokens >= TOKENS or at < batch.num_rows:
                yield from flush()
    if docs:
        yield from flush()


def _segment(docs: DataFrame, folder: str, block: int) -> Segment:
    """Writes a segment of documents (id, tokens). Null tokens are none. Each task makes whole blocks of its documents; only posting rows are shuffled."""
    spark, name = docs.sparkSession, f"segment-{uuid.uuid4().hex}"
    path = f"{folder}/{name}"
    cut = "text" in docs.columns
    tokens = F.coalesce("text", F.lit("")) if cut else F.coalesce(F.col("tokens"), F.array().cast("array<string>"))
    rows = spread(docs).select(F.col("id").cast("long").alias("id"), tokens.alias("tokens"))
    rows.mapInArrow(lambda b: _blocks(_cut(b) if cut else b, block), RAW_SCHEMA).write.parquet(f"{path}/raw")
    raw = spark.read.schema(RAW_SCHEMA).parquet(f"{path}/raw")
    held = raw.where("term is null").select("block", "ids", "dls")
    held.write.parquet(f"{path}/docs")
    size = spark.read.schema(TABLES["docs"]).parquet(f"{path}/docs").agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)).alias("t")).first()
    buckets = int(np.clip(2 ** math.ceil(math.log2(max(1, (size["t"] or 0) / BUCKET_TOKENS))), *BUCKETS))
    out = raw.where("term is not null").select(bucket_of(F.col("term"), buckets).alias("bucket"), "term", "block", "n", "gaps", "tfs", "max_tf", "min_dl")
    out.repartitionByRange("bucket", "term", "block").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    df = spark.read.schema(TABLES["postings"]).parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    df.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.parquet(f"{path}/terms")
    removed(spark, f"{path}/raw")
    return Segment(name, size["n"] or 0, size["t"] or 0, buckets, block, None, None, 0, 0)


def _without(index: Index, ids: DataFrame) -> list[Segment]:
    """The segments with the documents of these ids gone. Writes their places and terms only."""
    spark, folder = index.spark, index.folder
    found = index.places().join(ids.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi").select("seg", "block", "off", "dl")
    path = f"{folder}/gone-{uuid.uuid4().hex}"
    found.write.partitionBy("seg").parquet(f"{path}/places")
    places = spark.read.schema("block long, off int, dl int, seg int").parquet(f"{path}/places")
    sizes = {r["seg"]: (r["n"], r["t"]) for r in places.groupBy("seg").agg(F.count("*").alias("n"), F.sum("dl").alias("t")).collect()}
    out = []
    for i, s in enumerate(index.segments):
        if i not in sizes:
            out.append(s)
            continue
        own = places.where(F.col("seg") == i)
        # A block's places are sent as bits to its posting rows, which are counted where they are, not opened to a row for each posting and joined.
        bits = own.groupBy("block").agg(F.collect_list("off").alias("gone")).mapInArrow(_bits, "block long, bits binary")
        postings = index.read(s, "postings").select("term", "block", "gaps").join(bits, "block").select("term", "gaps", "bits")
        lost = postings.mapInArrow(_counted, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
        gone = own.select("block", F.array(F.col("off")).alias("gone"))
        if s.gone:
            gone = gone.unionByName(index.side("gone", s.gone))
            lost = lost.unionByName(index.side("lost", s.lost)).groupBy("term").agg(F.sum("df").alias("df"))
        names = f"gone-{uuid.uuid4().hex}", f"lost-{uuid.uuid4().hex}"
        gone.groupBy("block").agg(F.array_sort(F.flatten(F.collect_list("gone"))).alias("gone")).write.parquet(f"{folder}/{names[0]}")
        lost.write.parquet(f"{folder}/{names[1]}")
        n, t = sizes[i]
        out.append(Segment(s.segment, s.n_docs, s.n_tokens, s.buckets, s.block, *names, s.n_gone + n, s.gone_tokens + t))
    removed(spark, path)
    return out


def extended(index: Index, docs: DataFrame, version: int | None = None) -> Index:
    """The next version, with further documents (id, tokens or text, as for ``built``); those of the same ids are replaced. Writes one segment. version is its number, if not the next one."""
    block = index.segments[0].block if index.segments else BLOCK
    new = _segment(docs, index.folder, block)
    ids = index.read(new, "docs").select(F.explode("ids").alias("id"))
    return _committed(index.spark, index.folder, version or index.version + 1, [*_without(index, ids), new])


def shrunk(index: Index, ids: DataFrame) -> Index:
    """The next version, without the documents of these ids."""
    return _committed(index.spark, index.folder, index.version + 1, _without(index, ids))


def merged(index: Index, small: float = SMALL) -> Index:
    """The next version, in which the segments with less than the share small of all documents, and those of which more than half is gone, are one; nothing is written if there is none of these but one."""
    live = {s.segment: s.n_docs - s.n_gone for s in index.segments}
    chosen = [s for s in index.segments if live[s.segment] < small * index.n_docs or 2 * s.n_gone > s.n_docs]
    if len(chosen) < 2 and not any(s.n_gone for s in chosen):
        return index
    part = Index(index.spark, index.folder, index.version, tuple(chosen))
    # Documents come back from their postings: the order of tokens does not matter.
    tokens = part._each().groupBy("seg", "block", "off").agg(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf")))).alias("tokens"))
    docs = part.places().join(tokens, ["seg", "block", "off"], "left").select("id", "tokens")
    new = _segment(docs, index.folder, chosen[0].block)
    return _committed(index.spark, index.folder, index.version + 1, [*(s for s in index.segments if s not in chosen), new])


def vacuumed(index: Index) -> None:
    """Removes what this version does not name: older versions and their tables."""
    named = {x for s in index.segments for x in (s.segment, s.gone, s.lost) if x}
    for name in listed(index.spark, index.folder):
        if name != "versions" and name not in named:
            removed(index.spark, index.path(name))
    for v in versions(index.spark, index.folder):
        if v < index.version:
            removed(index.spark, index.path(f"versions/{v:08d}"))
