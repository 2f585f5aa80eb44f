"""Removal of repeated word windows, with a count-min prefilter.

A window is a run of consecutive words of one document. Its sketch key is the
smallest hash among its runs of sixteen words (leftmost on ties), so neighbouring
windows share a key and two equal windows at different places always count it
twice: the count of a key is never below that of any of its windows. Each
partition counts keys in a count-min sketch of four cells a key, cut into segments; segments of
all partitions are merged by grouping. A second pass emits only windows whose key is estimated to
occur twice or more, and groups these exactly, by 96 bits of hash mixed with a key that is
drawn for each run: none is lost, those let through in vain are found unique, and no
text can be made to agree with another.

Up to 2**MOST cells the merged sketch is broadcast, a bit for each cell (64 MB at most). Beyond
that it stays a table of segments: each document's keys are joined to the segments
of their cells, one depth after the other, and only what is estimated as repeated comes back to the
document. The sketch grows with the input in both forms, so that the share of windows let through
does not.

Counts of windows are pre-aggregated before the shuffle. Windows that make up a large share of
all (HOT at most) are then dealt over several tasks by a salt. Texts without any
window that may be repeated are never shuffled.

Ids are integers; others are refused by the cast. Null texts have no words. Texts shorter than a window are left alone. Repeated
rows repeat each other's windows: both lose them. Blanks of a document from
which nothing is removed become single ones, as in all others. An empty table
gives no rows. Columns other than the two that are named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.llm.common import HOT, SALTS, col, hot_keys, row_pair, salted_join, table, text_of, written
from textquarry.llm.minhash_dedup import parts
from textquarry.llm.spans import U, joined, keyed, mix, names, new_key, seeds, utf8, words

WINDOW = 35
GRAM = 16
DEPTH = 2
#: Bits of a cell's number: at most in a sketch that is broadcast, and at least.
MOST, LEAST = 28, 16
#: Sketches of so many partitions are merged at a time.
FAN_IN = 64


def runs(h: np.ndarray, sizes: tuple[int, ...], key: int) -> list[np.ndarray]:
    """Hashes of the runs of each of the sizes from each word on (fewer at the end of all): runs of powers of two are joined from halves, others from those."""
    powers, out = [h], []
    for size in sizes:
        while 2 << len(powers) - 1 <= size:
            x, half = powers[-1], 1 << len(powers) - 1
            powers.append(joined(x[: max(0, len(x) - half)], x[half:], key + len(powers)))
        acc, have = None, 0
        for k in reversed(range(len(powers))):
            if size >> k & 1:
                n = max(0, len(h) - have - (1 << k) + 1)
                acc = powers[k] if acc is None else joined(acc[:n], powers[k][have : have + n], key + 64)
                have += 1 << k
        out.append(acc)
    return out


def leftmost(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value in each run of width values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(values[a] <= values[b], a, b)
        have += step
    return at[:n]


class Windows:
    """The windows of all texts of an Arrow column in a row."""

    def __init__(self, texts: pa.Array, size: int, gram: int, key: int, whole: bool = False):
        self.raw, starts, ends = utf8(texts)
        self.first, self.last, self.n = words(self.raw, starts, ends)
        self.stop = np.cumsum(self.n)
        low, high = names(self.raw, self.first, self.last)
        found = runs(keyed(low, high, key), (gram, size) if whole else (gram,), key)
        #: Where whole windows start, hashes of the short runs, and the place of the one that is each window's key.
        self.at = np.flatnonzero(np.arange(len(self.first)) + size <= np.repeat(self.stop, self.n))
        self.grams = found[0]
        self.key_at = leftmost(self.grams, size - gram + 1)[self.at] if len(self.at) else self.at
        if whole:
            self.low = found[1]
            self.high = (runs(keyed(high, low, key + 7), (size,), key + 7)[0] >> U(32)).astype(np.uint32)

    def places(self) -> np.ndarray:
        """The places of the different keys; neighbouring windows mostly share theirs."""
        return self.key_at[np.concatenate([[True], self.key_at[1:] != self.key_at[:-1]])] if len(self.key_at) else self.key_at

    def cut(self, at: np.ndarray) -> np.ndarray:
        """Where the ascending places of each text begin and end in at."""
        return np.searchsorted(at, np.concatenate([[0], self.stop]))

    def begin(self) -> np.ndarray:
        return self.stop - self.n


def cells(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(keys ^ s) >> U(64 - bits)).astype(np.int64) for s in seeds(DEPTH, 5)]


def segment_cells(bits: int) -> int:
    """Cells of a segment: so many that a sketch has a few thousand segments, within bounds."""
    return 1 << int(np.clip(bits - 12, min(16, bits), 22))


def packed(offsets: np.ndarray, twice: np.ndarray) -> bytes:
    """Ascending places of cells that are not zero, and which of them count two or more."""
    x = (offsets.astype(np.uint32) << np.uint32(1)) | twice.astype(np.uint32)
    return zstandard.ZstdCompressor(level=1).compress(np.diff(x, prepend=np.uint32(0)).tobytes())


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(data), np.uint32), dtype=np.uint32)
    return x >> np.uint32(1), (x & np.uint32(1)).astype(bool)


def partition_sketch(batches: Iterator[pa.RecordBatch], bits: int, size: int, gram: int, key: int):
    """Count-min counters of a partition, saturated at two: rows of depth, segment, counters. A segment may come several times; its counters add up."""
    width = segment_cells(bits)
    pending: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]

    def settle():
        for d in range(DEPTH):
            found = np.concatenate([np.zeros(0, np.int64), *pending[d]])
            pending[d].clear()
            some, n = np.unique(found, return_counts=True)
            of = some // width
            begin = np.flatnonzero(np.diff(of, prepend=-1))
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(of)]):
                yield d, int(of[a]), packed(some[a:b] % width, n[a:b] > 1)

    held = 0
    for p in parts(batches, 0):
        w = Windows(p.column(0), size, gram, key)
        places = w.places()
        for d, c in enumerate(cells(w.grams[places], bits)):
            pending[d].append(c)
        held += len(places)
        if held > 4_000_000:
            yield from settle()
            held = 0
    yield from settle()


def merged_sketch(rows: DataFrame, bits: int, size: int, gram: int, key: int) -> DataFrame:
    """d, s, counters: the merged segments of the sketch."""
    width = segment_cells(bits)

    def local(batches):
        part = TaskContext.get().partitionId() // FAN_IN
        found = partition_sketch(batches, bits, size, gram, key)
        while some := list(islice(found, 256)):
            d, s, data = zip(*some)
            yield pa.record_batch([pa.array(d, pa.int32()), pa.array(s, pa.int32()), pa.array([part] * len(d), pa.int32()), pa.array(data, pa.binary())], ["d", "s", "part", "counters"])

    def merge(key_: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.uint8)
        for batch in group:
            for data in batch.column("counters"):
                at, twice = unpacked(data.as_py())
                total[at] = np.minimum(total[at] + 1 + twice, 2)
        at = np.flatnonzero(total)
        d, s, part = (k.as_py() for k in (*key_, pa.scalar(0))[:3])
        yield pa.record_batch([pa.array([d], pa.int32()), pa.array([s], pa.int32()), pa.array([part], pa.int32()), pa.array([packed(at, total[at] > 1)], pa.binary())], ["d", "s", "part", "counters"])

    schema = "d int, s int, part int, counters binary"
    sketch = rows.select("text").mapInArrow(local, schema)
    grouped = sketch.groupBy("d", "s", "part").applyInArrow(merge, schema)
    return grouped.groupBy("d", "s").applyInArrow(merge, schema).drop("part")


def cell_bits(rows: DataFrame) -> int:
    """Four cells for each key of the input: a key is met once in about 60 bytes."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(max(np.ceil(np.log2(max(1, 4 * size // 60))), LEAST))


def bit_maps(sketch: DataFrame, bits: int) -> list[np.ndarray]:
    """For each depth, a bit for each cell that counts two or more; for sketches of at most 2**MOST cells."""
    width = segment_cells(bits)
    out, per = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(DEPTH)], width // 8
    for r in sketch.toLocalIterator():  # a bounded number of segments
        dense = np.zeros(width, bool)
        at, twice = unpacked(bytes(r["counters"]))
        dense[at[twice]] = True
        out[r["d"]][r["s"] * per : r["s"] * per + per] = np.packbits(dense, bitorder="little")
    return out


def probed(rows: DataFrame, sketch: DataFrame, bits: int, size: int, gram: int, key: int) -> DataFrame:
    """id, h and keys (places in the text whose key is estimated to occur twice or more) of rows (id, h, text), by joins with the cells that count two or more."""
    width = segment_cells(bits)

    def all_keys(batches):
        for p in parts(batches, 2):
            w = Windows(p.column(2), size, gram, key)
            places = w.places()
            per = np.diff(w.cut(places))
            of = pa.array(np.repeat(np.arange(len(per)), per))
            yield pa.record_batch([p.column(0).take(of), p.column(1).take(of), pa.array((places - np.repeat(w.begin(), per)).astype(np.int32)), *map(pa.array, cells(w.grams[places], bits))], ["id", "h", "at", "c0", "c1"])

    def often(batches):
        for batch in batches:
            for d, s, data in zip(*(batch.column(c).to_pylist() for c in ("d", "s", "counters"))):
                at, twice = unpacked(data)
                at = at[twice].astype(np.int64) + s * width
                yield pa.record_batch([pa.array(np.full(len(at), d, np.int32)), pa.array(at)], ["d", "cell"])

    found = written(rows.mapInArrow(all_keys, "id long, h long, at int, c0 long, c1 long"), "keys")
    twice = written(sketch.mapInArrow(often, "d int, cell long"), "cells")
    for d in range(DEPTH):
        c = f"c{d}"
        hot = hot_keys(found.groupBy(c).agg(F.count("*").alias("n")), c, "n")
        found = written(salted_join(found, twice.where(F.col("d") == d).select(F.col("cell").alias(c)), c, hot, ["id", "h", "at"]).drop(c), "keys")
    return found.groupBy("id", "h").agg(F.collect_set("at").alias("keys"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, gram: int = GRAM, others: tuple[str, ...] = (), key: int | None = None) -> DataFrame:
    """A row for each row of df: id_col, n_words, n_removed, kept_text (the kept words joined by single blanks); with others, text_col and these columns too. key is that of the hashes; none draws one."""
    if not 1 <= gram <= size:
        raise ValueError("gram is from 1 to size")
    key = new_key() if key is None else key
    text = text_of(text_col)
    own = F.struct(col(id_col).cast("long").alias("_0"), col(text_col).isNull().alias("_null"), *(col(c).alias(f"_{i}") for i, c in enumerate(others, 1))).alias("own")
    kept = ["text"] if others else []  # a text is sent to a worker once
    pair = row_pair(col(id_col).cast("long"), text)  # id and h tell rows apart from here on
    whole = df.select(pair[0].alias("id"), pair[1].alias("h"), text.alias("text"), own)
    rows = whole.select("id", "h", "text")
    bits = cell_bits(rows)
    sketch = merged_sketch(rows, bits, size, gram, key)
    if bits <= MOST:
        maps = rows.sparkSession.sparkContext.broadcast(bit_maps(sketch, bits))
    else:
        maps = None
        found = probed(rows, sketch, bits, size, gram, key)
        whole = whole.alias("r").join(found.alias("k"), F.expr("r.id = k.id and r.h = k.h"), "left").select("r.*", "k.keys")
        whole = written(whole, "keyed-texts")  # so that texts move once

    def estimated(p: pa.RecordBatch, full: bool) -> tuple[Windows, np.ndarray]:
        """The windows of a batch and which of them may be repeated."""
        w = Windows(p.column("text"), size, gram, key, full)
        if maps is None:
            lists = p.column("keys")
            of = lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(w.begin(), np.array(lists.value_lengths().fill_null(0)))
            return w, np.isin(w.key_at, of)
        often = np.ones(len(w.at), bool)
        for c, m in zip(cells(w.grams[w.key_at], bits), maps.value):
            often &= (m[c >> 3] >> (c & 7).astype(np.uint8)) & 1 > 0
        return w, often

    def flagged(hot):
        def run(batches):
            for p in parts(batches, 2):
                w, often = estimated(p, True)
                at = w.at[often]
                cut = w.cut(at)
                per = np.diff(cut)
                low, high = (w.low[at], w.high[at]) if len(at) else (np.zeros(0, U), np.zeros(0, np.uint32))
                if hot is not None:  # each of its places takes one of the salted forms of a hot window
                    here = np.flatnonzero(np.isin(low, hot))
                    low[here] = salted(low[here], (at[here] + len(w.first)).astype(U) % U(SALTS))
                lists = lambda x: pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(x))
                one = pa.record_batch([p.column(0), p.column(1), lists((at - np.repeat(w.begin(), per)).astype(np.int32)), lists(low.view(np.int64)), lists(high.view(np.int32))], ["id", "h", "at", "w", "v"])
                yield one.filter(pa.array(per > 0))

        return whole.drop("own").mapInArrow(run, "id long, h long, at array<int>, w array<long>, v array<int>")  # made twice: cheaper than a written copy, which would be half the input

    counted = flagged(None).select(F.explode(F.arrays_zip("w", "v")).alias("x")).select("x.w", "x.v").groupBy("w", "v").agg(F.count("*").alias("c")).where("c > 1")
    counted = written(counted, "windows")
    total = counted.agg(F.sum("c")).first()[0] or 0
    heavy = counted.where(F.col("c") * HOT >= max(total, HOT * HOT)).select("w").distinct()  # HOT rows at most
    heavy = counted.join(F.broadcast(heavy), "w").select("w", "v").collect()
    hot = np.unique(np.array([r["w"] for r in heavy], np.int64).view(U)) if heavy else None
    repeated = counted.select("w", "v")
    if heavy:
        forms = [(x, r["v"]) for r in heavy for x in salted(np.full(SALTS, r["w"], np.int64).view(U), np.arange(SALTS, dtype=U)).view(np.int64).tolist()]
        repeated = repeated.unionByName(rows.sparkSession.createDataFrame(forms, repeated.schema))
    places = flagged(hot).select("id", "h", F.explode(F.arrays_zip("at", "w", "v")).alias("x")).select("id", "h", "x.at", "x.w", "x.v")
    marks = places.join(repeated, ["w", "v"]).groupBy("id", "h").agg(F.collect_set("at").alias("starts"))

    names_ = ["id", "own", "n_words", "n_removed", "kept_text", *kept]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("own", whole.schema["own"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), *(T.StructField(c, T.StringType()) for c in kept)])

    def may(batches):
        """Rows with a window that may be repeated."""
        for p in parts(batches, 2):
            w, often = estimated(p, False)
            yield p.filter(pa.array(np.diff(w.cut(w.at[often])) > 0)).select(["id", "h", "text", "own"])

    def left_alone(batches):
        """Results of all other rows."""
        for p in parts(batches, 2):
            w, often = estimated(p, False)
            none = pa.array(np.diff(w.cut(w.at[often])) == 0)
            yield pa.record_batch([p.column("id"), p.column("own"), pa.array(w.n.astype(np.int64)), pa.array(np.zeros(len(w.n), np.int64)), _joined(w.raw, w.first, w.last, w.n), *(p.column(c) for c in kept)], names_).filter(none)

    def cut(batches):
        for p in parts(batches, 2):
            raw, starts, ends = utf8(p.column(2))
            first, last, n = words(raw, starts, ends)
            begin = np.cumsum(n) - n
            lists = p.column(3)
            of, per = lists.flatten().to_numpy(zero_copy_only=False), np.array(lists.value_lengths().fill_null(0))
            cover = np.zeros(len(first) + 1, np.int64)
            at = of + np.repeat(begin, per)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + size, -1)
            stay = np.cumsum(cover[:-1]) == 0
            so_far = np.concatenate([[0], np.cumsum(stay)])
            left = so_far[begin + n] - so_far[begin]
            yield pa.record_batch([p.column(0), p.column(1), pa.array(n.astype(np.int64)), pa.array((n - left).astype(np.int64)), _joined(raw, first[stay], last[stay], left), *(p.column(2) for _ in kept)], names_)

    some = whole.mapInArrow(may, whole.select("id", "h", "text", "own").schema)
    met = some.alias("r").join(marks.alias("m"), F.expr("r.id = m.id and r.h = m.h"), "left").select("r.id", "r.own", "r.text", "m.starts")
    out = met.mapInArrow(cut, schema).unionByName(whole.mapInArrow(left_alone, schema))
    field = F.col("own").getField
    texts = [F.when(~field("_null"), F.col("text")).alias(text_col) for _ in kept]
    return out.select(field("_0").alias(id_col), *texts, *(field(f"_{i}").alias(c) for i, c in enumerate(others, 1)), "n_words", "n_removed", "kept_text")


def salted(low: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """One of the forms of a hot window's hash."""
    return mix(low ^ (salt + U(1)) * U(0x9E3779B97F4A7C15))


def _joined(raw: np.ndarray, first: np.ndarray, last: np.ndarray, per: np.ndarray) -> pa.Array:
    """Words joined by single blanks; per of them for each text."""
    sizes = last - first + 1
    ends = np.cumsum(sizes)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = False
    if len(first):
        out[inner] = raw[np.repeat(first - (np.cumsum(sizes - 1) - (sizes - 1)), sizes - 1) + np.arange(int((sizes - 1).sum()))]
    cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per)])].astype(np.int64)
    data = out.tobytes()
    return pa.array([data[a : max(a, b - 1)].decode() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.string())


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated 35-word windows."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(x)) AS c FROM win) WHERE c > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM rep, (SELECT unnest(range(0, 35)) AS k)
), word AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w
), k AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
