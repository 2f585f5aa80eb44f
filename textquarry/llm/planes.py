"""Token ids in binary shards: blocks of ids as bit or byte planes, each compressed with zstandard.

A shard holds the documents of one range of ids in ascending order. Layout,
little-endian: 8 bytes magic; the blocks' planes one after another; then the
footer, a zstandard frame with the chunk index (JSON: ids in a block, kind of
planes, number of ids; for each block its offset and its planes' sizes) and the
documents' keys and lengths; at last the footer's offset and size (two unsigned
64-bit integers) and the magic again. A reader seeks to the end, reads the
footer, and from then on any block by itself.

Rows are dealt to shards by ranges of (id, hash of the text, number of the row), so
that neither a hot id nor a text that many rows repeat meets in one shard. Ids are
integers; others are refused by the cast. Each shard is read by a task of its own. Each task writes its shard under a
name of its own and reports it in the manifest; a file of an attempt that failed
is in no manifest. Null texts are empty (the end id alone), null ids come first,
repeated rows follow one another. An empty table gives no shards and no rows.
Other columns are not looked at.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.llm.common import col, shared_path, table, text_of, written
from textquarry.llm.files import new_file, open_file
from textquarry.llm.tokens import byte_vocabulary, encoded, slices

MAGIC = b"TQPLANE1"
#: Ids in a block.
BLOCK = 1 << 16
LEVEL = 3
#: Rows of ids that leave a reader in one batch, about.
OUT_IDS = 2_000_000


def split_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of unsigned 32-bit ids, lowest first; planes above the highest set bit are left out. Bit planes are padded to whole bytes."""
    data = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    bits = int(ids.max(initial=0)).bit_length()
    if kind == "byte":
        return [data[:, k].tobytes() for k in range(-(-bits // 8))]
    return [np.packbits((data[:, k // 8] >> (k % 8)) & 1, bitorder="little").tobytes() for k in range(bits)]


def join_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        x = np.frombuffer(plane, np.uint8)
        if kind == "byte":
            out[:, k] = x
        else:
            out[:, k // 8] |= np.unpackbits(x, count=n, bitorder="little") << (k % 8)
    return out.reshape(-1).view("<u4")


class ShardWriter:
    def __init__(self, out, kind: str = "byte", block: int = BLOCK):
        if kind not in ("bit", "byte"):
            raise ValueError("planes are bit or byte")
        self.out, self.kind, self.block = out, kind, block
        self.at, self.n = len(MAGIC), 0
        self.open: list[np.ndarray] = []
        self.waiting = 0
        self.blocks: list[list] = []
        self.press = zstandard.ZstdCompressor(level=LEVEL)
        out.write(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        self.open.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            ids = np.concatenate(self.open)
            whole = len(ids) - len(ids) % self.block
            for k in range(0, whole, self.block):
                self._put(ids[k : k + self.block])
            self.open, self.waiting = [ids[whole:].copy()], len(ids) - whole

    def _put(self, ids: np.ndarray) -> None:
        planes = [self.press.compress(p) for p in split_planes(ids, self.kind)]
        self.blocks.append([self.at, [len(p) for p in planes]])
        for p in planes:
            self.out.write(p)
        self.at += sum(map(len, planes))
        self.n += len(ids)

    def close(self, keys: list, sizes: list[int]) -> None:
        if self.waiting:
            self._put(np.concatenate(self.open))
        footer = self.press.compress(json.dumps({"block": self.block, "kind": self.kind, "n": self.n, "blocks": self.blocks, "keys": keys, "sizes": sizes}).encode())
        self.out.write(footer + struct.pack("<QQ", self.at, len(footer)) + MAGIC)


class ShardReader:
    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        end = file.tell()
        file.seek(end - 24)
        at, size = struct.unpack("<QQ", (tail := file.read(24))[:16])
        if tail[16:] != MAGIC:
            raise ValueError("not a shard of planes")
        file.seek(at)
        self.unpress = zstandard.ZstdDecompressor().decompressobj
        self.footer = json.loads(self.unpress().decompress(file.read(size)))

    def block(self, k: int) -> np.ndarray:
        at, sizes = self.footer["blocks"][k]
        n = min(self.footer["block"], self.footer["n"] - k * self.footer["block"])
        self.file.seek(at)
        return join_planes([self.unpress().decompress(self.file.read(s)) for s in sizes], n, self.footer["kind"])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop; only the blocks that hold them are read."""
        size = self.footer["block"]
        parts = [self.block(k) for k in range(start // size, -(-stop // size))]
        base = start - start % size
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32))[start - base : stop - base]


def write_shards(df: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, kind: str = "byte", shards: int | None = None) -> DataFrame:
    """Encodes and writes all documents; returns the manifest: shard, path, n_docs, n_ids."""

    def run(batches):
        part = TaskContext.get().partitionId()
        keys, sizes, first = [], [], next(batches, None)
        if first is None:
            return
        with new_file(folder, f"shard-{part:06d}", ".planes") as (out, path):
            shard = ShardWriter(out, kind)
            for own, ids, n in encoded((b for x in ([first], batches) for b in x), vocabulary, end_id):
                shard.add(ids)
                keys += own.to_pylist()
                sizes += n.tolist()
            shard.close(keys, sizes)
        yield pa.RecordBatch.from_pylist([{"shard": part, "path": path, "n_docs": len(keys), "n_ids": int(sum(sizes))}], pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = df.select(col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), F.xxhash64(text_of(text_col)).alias("h"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange(*([shards] if shards else []), "id", "h", "row").sortWithinPartitions("id", "h").select("id", "text")
    return written(dealt.mapInArrow(run, "shard long, path string, n_docs long, n_ids long"), "planes-manifest")


def read_shards(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col long, start long (ids of all documents before it), n_tokens long, ids_le binary, read back from the shards."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("path", "n_docs", before.alias("base"))  # one row for each shard

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["path"]) as f:
                    shard = ShardReader(f)
                    keys, sizes = shard.footer["keys"], np.array(shard.footer["sizes"], np.int64)
                    ends = np.concatenate([[0], np.cumsum(sizes)])
                    for a, b in slices(pa.record_batch([pa.array(sizes)], ["n"]), sizes, OUT_IDS):
                        ids = shard.ids(int(ends[a]), int(ends[b]))
                        cuts = ((ends[a : b + 1] - ends[a]) * 4).astype(np.int32)
                        data = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(ids.tobytes())])
                        yield pa.record_batch([pa.array(keys[a:b], pa.int64()), pa.array(ends[a:b] + row["base"]), pa.array(sizes[a:b]), data], names)

    names = [id_col, "start", "n_tokens", "ids_le"]
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_le", T.BinaryType())])
    return placed.repartition(max(1, manifest.count())).mapInArrow(run, schema)  # round robin over one partition: a task for each shard


def op9_bit_planes(spark, sf_dir: str) -> DataFrame:
    """Writes all documents' ids and reads them back."""
    manifest = write_shards(table(spark, sf_dir, "documents"), shared_path(spark, "planes"), byte_vocabulary())
    return read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))
