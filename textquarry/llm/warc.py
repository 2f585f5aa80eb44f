"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about FRAME plain bytes, each compressed for itself; a bundle ends with a skippable frame that
holds the seek table of the public seekable format (for each frame its
compressed and plain size). The index maps record ids to bundle, frame and the record's place inside the plain
frame, so a record is read with one seek and one frame, and its neighbours with the same frame.

Which record is the response and which ones revisit it is settled on digests
alone (grouped, then joined on the digest, a hot one dealt over several tasks); payloads move once, by page. Bundles get names of their
own for each attempt at a task, and only those of the attempt that succeeded are
in the index.

Null payloads are empty. Of rows that share page and payload each gets a record
of the same kind; rows of a null page are archived, and are responses unless a
page with an id has the same payload. A payload may have any length: a task holds one Arrow batch of rows, one frame and one record besides it.
An empty table gives no bundles. Other columns than those named are not looked
at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import col, hot_keys, salted_join, shared_path, table, written
from textquarry.llm.files import new_file, open_file

#: Payloads of fewer bytes are never revisited.
LEAST = 1000
#: Plain bytes after which a bundle is closed.
BUNDLE = 64 << 20
#: Plain bytes after which a frame is closed.
FRAME = 256 << 10
LEVEL = 3
SEEK_HEAD, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: All records of a run carry one date, so that runs are repeatable.
DATE = "2024-01-01T00:00:00Z"


def record_id(page) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}"


def record(page, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A WARC/1.1 record: response with an HTTP head, or revisit without its payload."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id(page)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Page: {'' if page is None else page}",
        f"X-Payload-Length: {len(payload)}",
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{record_id(refers_to)}>", f"X-Refers-To-Page: {refers_to}"]
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Heads of a record and its payload; a response's digest is taken anew."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    heads = dict(x.split(": ", 1) if ": " in x else (x.rstrip(": "), "") for x in lines)
    block = rest[: int(heads["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if first != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    digest = base64.b32decode(heads["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if heads["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(heads["X-Payload-Length"])):
        raise ValueError(f"payload of {heads['WARC-Record-ID']} is damaged")
    number = lambda x: int(x) if x else None
    return {"page": number(heads["X-Page"]), "payload": payload, "payload_bytes": int(heads["X-Payload-Length"]), "payload_digest": digest, "record_type": heads["WARC-Type"], "refers_to": number(heads.get("X-Refers-To-Page"))}


class Bundle:
    """Frames of records and, at the end, the seek table."""

    def __init__(self, out, frame: int):
        self.out, self.most, self.frames, self.plain = out, frame, [], 0
        self.press, self.held, self.size = zstandard.ZstdCompressor(level=LEVEL), [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame of a record and its place in it."""
        place = len(self.frames), self.size
        self.held.append(data)
        self.size += len(data)
        self.plain += len(data)
        if self.size >= self.most:
            self._flush()
        return place

    def _flush(self) -> None:
        if self.held:
            frame = self.press.compress(b"".join(self.held))
            self.out.write(frame)
            self.frames.append((len(frame), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        table_ = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_HEAD, len(table_)) + table_)


def seek_table(file) -> list[tuple[int, int]]:
    """Offset and compressed size of each frame."""
    file.seek(0, 2)
    end = file.tell()
    file.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    file.seek(end - 9 - 8 * n)
    sizes = [struct.unpack_from("<I", data, 8 * k)[0] for data in [file.read(8 * n)] for k in range(n)]
    out, at = [], 0
    for s in sizes:
        out.append((at, s))
        at += s
    return out


def read_frame(file, at: int, size: int) -> bytes:
    file.seek(at)
    return zstandard.ZstdDecompressor().decompressobj().decompress(file.read(size))


def read_record(path: str, frame: int, offset: int, size: int) -> dict:
    """One record of the index."""
    with open_file(path) as f:
        return parse(read_frame(f, *seek_table(f)[frame])[offset : offset + size])


INDEX = pa.schema([("record_id", pa.string()), ("page", pa.int64()), ("path", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("size", pa.int64())])


def write_bundles(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """Writes a record for each row; returns the index: record_id, page, path, frame, offset and size (of the record in the plain frame)."""
    rows = df.select(
        col(id_col).cast("long").alias("page"),
        col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    small = rows.select("page", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= least)
    # Only payloads that occur twice: one row each, its size is that of the smaller groups' table.
    firsts = small.groupBy("digest").agg(F.max("page").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null")
    firsts = written(firsts, "repeated-payloads")
    refers = salted_join(small.select("page", "digest"), firsts.select("digest", "first"), "digest", hot_keys(firsts, "digest", "c"), ["page"]).where("page is null or page != first").distinct()
    joined = rows.alias("r").join(refers.alias("x"), F.expr("r.page <=> x.page and r.digest = x.digest"), "left").select("r.*", "x.first")

    def run(batches):
        part, k, open_, held = TaskContext.get().partitionId(), 0, None, None
        found: list[tuple] = []

        def close():
            nonlocal open_, held, found
            open_.close()
            held.__exit__(None, None, None)
            out = pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*found), INDEX)], schema=INDEX)
            open_, held, found = None, None, []
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, digest, first = (c[i].as_py() for c in batch.columns)
                if open_ is None:
                    held = new_file(folder, f"bundle-{part:06d}-{k:04d}", ".warc.zst")
                    out, path = held.__enter__()
                    open_, k = Bundle(out, frame), k + 1
                data = record(page, url, payload, digest, first)
                found.append((record_id(page), page, path, *open_.add(data), len(data)))
                if open_.plain >= bundle:
                    yield close()
        if open_ is not None:
            yield close()

    return written(joined.mapInArrow(run, "record_id string, page long, path string, frame long, offset long, size long"), "warc-index")


def read_bundles(index: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The records of the index, read through the bundles' seek tables, each frame once: id_col, record_type, refers_to, payload_digest, payload_bytes, payload (null for revisits)."""

    def run(batches):
        path, file, at, plain, places = None, None, None, b"", []
        try:
            for batch in batches:
                out, held = [], 0
                for row in zip(*(batch.column(c).to_pylist() for c in ("path", "frame", "offset", "size"))):
                    if row[0] != path:
                        if file:
                            file.close()
                        path, file, at = row[0], open_file(row[0]), None
                        places = seek_table(file)
                    if row[1] != at:
                        at, plain = row[1], read_frame(file, *places[row[1]])
                    out.append(parse(plain[row[2] : row[2] + row[3]]))
                    held += len(out[-1]["payload"])
                    if held > 16 << 20:
                        yield _records(out)
                        out, held = [], 0
                if out:
                    yield _records(out)
        finally:
            if file:
                file.close()

    def _records(out: list[dict]) -> pa.RecordBatch:
        revisit = [x["record_type"] == "revisit" for x in out]
        column = lambda k, t: pa.array([x[k] for x in out], t)
        return pa.record_batch([column("page", pa.int64()), column("record_type", pa.string()), column("refers_to", pa.int64()), column("payload_digest", pa.string()), column("payload_bytes", pa.int64()), pa.array([None if r else x["payload"] for r, x in zip(revisit, out)], pa.binary())], [id_col, "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])

    places = index.select("path", "frame", "offset", "size").repartition(max(1, index.select("path").distinct().count()), "path").sortWithinPartitions("path", "frame", "offset")
    return places.mapInArrow(run, f"`{id_col}` long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def op6_warc_bundles(spark, sf_dir: str) -> DataFrame:
    """Archives all pages and reads the archives back."""
    index = write_bundles(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages
), q AS (
  SELECT page_id, octet_length(b) AS n, d, CASE WHEN octet_length(b) >= 1000 THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM q
"""
