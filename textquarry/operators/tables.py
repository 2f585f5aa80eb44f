"""Several tables with one version: buckets of rows as Parquet, rewritten only where a change touches them.

A table is dealt into buckets by a hash of its key or by the day of a time. A bucket's files are never changed: a change reads the buckets
that it touches, writes these anew and leaves all others as they are. A version lists, for every table of the store, where each
bucket lies. It takes its name when all that it lists is written, so that the tables change together or not at all: a change that
is killed on its way, or that fails, leaves the last version as it was.

There is one writer at a time; of two writers of the same version one fails. Notes are short strings that are kept with a version, such as the
last batch of a stream.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.operators.repository import upsert
from textquarry.operators.storage import listed, removed, renamed

VERSION = "name string, bucket string, path string, n long, shape string"


@dataclass(frozen=True)
class Shape:
    """What a table is made of: its columns, its key, and its buckets (a number of them by a hash of the key, or none and a time whose days they are)."""

    schema: str
    key: str
    buckets: int = 64
    day: str | None = None

    def bucket(self) -> Column:
        if self.day:
            return F.date_format(F.col(self.day), "yyyy-MM-dd")
        return F.lpad(F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("string"), 5, "0")

    def part(self, tasks: int) -> Column:
        """A bucket's part of a key: buckets by a hash are cut so that their parts are a few times as many as tasks."""
        return F.pmod(F.shiftright(F.xxhash64(self.key), 32), F.lit(max(1, 4 * tasks // self.buckets)))

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows with the column bucket, those of a bucket in as few tasks as their number asks for. A range of days needs a sample of the rows, which are made twice for it; a hash does not."""
        out = rows.withColumn("bucket", self.bucket())
        if self.day:
            return out.repartitionByRange("bucket", self.key)
        return out.repartition("bucket", self.part(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


@dataclass(frozen=True)
class Store:
    """One version of all tables."""

    spark: SparkSession
    folder: str
    version: int
    shapes: dict[str, Shape] = field(default_factory=dict)
    pieces: dict[str, dict[str, tuple[str, int]]] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)

    def read(self, name: str, buckets: list[str] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        shape, there = self.shapes[name], self.pieces[name]
        paths = [f"{self.folder}/{there[b][0]}" for b in (there if buckets is None else buckets) if b in there]
        return self.spark.read.schema(shape.schema).parquet(*paths) if paths else self.spark.createDataFrame([], shape.schema)

    def count(self, name: str) -> int:
        """Rows of a table, from the version alone."""
        return sum(n for _, n in self.pieces[name].values())

    def change(self) -> Change:
        return Change(self)


def versions(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n) for n in listed(spark, f"{folder}/versions") if n.isdigit())


def opened(spark: SparkSession, folder: str, version: int | None = None) -> Store:
    """The last version, or the one that is named; a store without tables if there is none."""
    there = versions(spark, folder)
    if version is None:
        if not there:
            return Store(spark, folder, 0)
        version = there[-1]
    store = Store(spark, folder, version)
    for r in spark.read.schema(VERSION).parquet(f"{folder}/versions/{version:08d}").collect():
        if r["name"] is None:
            store.notes.update(json.loads(r["shape"]))
        elif r["bucket"] is None:
            store.shapes[r["name"]] = Shape(**json.loads(r["shape"]))
            store.pieces.setdefault(r["name"], {})
        else:
            store.pieces.setdefault(r["name"], {})[r["bucket"]] = (r["path"], r["n"])
    return store


class Change:
    """Changes to some tables of a store, which become one version."""

    def __init__(self, store: Store):
        self.base, self.spark, self.folder = store, store.spark, store.folder
        self.shapes, self.notes = dict(store.shapes), dict(store.notes)
        self.pieces = {k: dict(v) for k, v in store.pieces.items()}
        self.rewritten: dict[str, list[str]] = {}
        self.placed: dict[str, DataFrame] = {}  # rows that were written as they lay, from their files

    def create(self, name: str, shape: Shape) -> Change:
        """Adds a table without rows, unless there is one of that name."""
        if name not in self.shapes:
            self.shapes[name], self.pieces[name] = shape, {}
        return self

    def read(self, name: str, buckets: list[str] | None = None) -> DataFrame:
        return Store(self.spark, self.folder, self.base.version, self.shapes, self.pieces).read(name, buckets)

    def touched(self, name: str, keys: DataFrame) -> list[str]:
        """The buckets in which rows with these keys lie: at most as many as the table has."""
        return sorted(r[0] for r in keys.select(self.shapes[name].bucket().alias("b")).distinct().collect() if r[0] is not None)

    def _write(self, name: str, rows: DataFrame | None, buckets: list[str], placed: DataFrame | None = None) -> None:
        """Writes the rows in place of these buckets, and with them those that lie by bucket already, which are not shuffled. A bucket that has no rows left is not there any more."""
        shape, path = self.shapes[name], f"data/{name}-{uuid.uuid4().hex}"
        put = lambda out: out.sortWithinPartitions("bucket", shape.key).write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/{path}")
        if placed is not None:
            put(placed.withColumn("bucket", shape.bucket()))
            self.placed[name] = self.spark.read.schema(shape.schema).parquet(f"{self.folder}/{path}")  # the files that are there now
        if rows is not None:
            put(rows if "bucket" in rows.columns else shape.dealt(rows))
        kept = self.spark.read.schema(f"{shape.schema}, bucket string").parquet(f"{self.folder}/{path}") if listed(self.spark, f"{self.folder}/{path}").keys() - {"_SUCCESS"} else None
        counts = {r["bucket"]: r["n"] for r in kept.groupBy("bucket").agg(F.count("*").alias("n")).collect()} if kept is not None else {}
        for b in buckets:
            self.pieces[name].pop(b, None)
        self.pieces[name] |= {b: (f"{path}/bucket={b}", n) for b, n in counts.items()}
        self.rewritten.setdefault(name, []).extend(buckets)

    def merge(self, name: str, rows: DataFrame, version: str, placed: bool = False) -> Change:
        """The latest row of each key by the column version, of equal ones the new one. Null keys are rows of one key. placed: the rows lie by bucket, have each key once, none of them null, and are the latest of their keys."""
        if placed:
            return self.replace(name, rows, self.shapes[name].key, rows, True)
        where = self.touched(name, rows)
        self._write(name, upsert(self.read(name, where), rows.select(*self.read(name, []).columns), self.shapes[name].key, version), where)
        return self

    def replace(self, name: str, rows: DataFrame, owner: str, owners: DataFrame, placed: bool = False) -> Change:
        """Rows in place of all that the owners have; the table is dealt by owner, its key. placed: the rows lie by bucket, and are of owners only."""
        if placed:
            where = self.touched(name, owners.select(F.col(owner).alias(self.shapes[name].key)))
            there = [b for b in where if b in self.pieces[name]]
            columns = self.read(name, []).columns
            left = self._left(name, there, owners.select(F.col(owner).alias(self.shapes[name].key))) if there else None
            self._write(name, left, where, rows.select(*columns))
            return self
        where = self.touched(name, owners.select(F.col(owner).alias(self.shapes[name].key)).unionByName(rows.select(self.shapes[name].key)))
        left = self.read(name, where).join(owners.select(owner).distinct(), owner, "left_anti")
        self._write(name, left.unionByName(rows.select(*left.columns)), where)
        return self

    def _left(self, name: str, buckets: list[str], keys: DataFrame) -> DataFrame:
        """The rows of these buckets but those of keys. Both go through one shuffle, by which the rows are dealt for writing too."""
        shape = self.shapes[name]
        both = self.read(name, buckets).withColumn("_gone", F.lit(0)).unionByName(keys.withColumn("_gone", F.lit(1)), allowMissingColumns=True)
        w = Window.partitionBy("bucket", "_part", shape.key)
        part = shape.part(int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return shape.dealt(both).withColumn("_part", part).withColumn("_out", F.max("_gone").over(w)).where("_out = 0").drop("_gone", "_out", "_part")

    def delete(self, name: str, keys: DataFrame) -> Change:
        """Takes the rows of these keys away."""
        shape = self.shapes[name]
        where = self.touched(name, keys)
        if where:
            self._write(name, self.read(name, where).join(keys.select(shape.key).distinct(), shape.key, "left_anti"), where)
        return self

    def expire(self, name: str, before: str) -> Change:
        """Takes away what is older than a time (yyyy-MM-dd HH:mm:ss) from a table by days: whole days are dropped unread, only the day of the bound is written anew."""
        shape, day = self.shapes[name], before[:10]
        for b in [b for b in self.pieces[name] if b < day]:
            del self.pieces[name][b]
        if day in self.pieces[name]:
            self._write(name, self.read(name, [day]).where(F.col(shape.day) >= F.lit(before).cast("timestamp_ntz")), [day])
        return self

    def note(self, **notes: str) -> Change:
        self.notes |= notes
        return self

    def commit(self) -> Store:
        """Makes all changes the next version."""
        rows = [(name, None, None, None, json.dumps(s.__dict__)) for name, s in self.shapes.items()]
        rows += [(name, b, path, n, None) for name, there in self.pieces.items() for b, (path, n) in there.items()]
        rows.append((None, None, None, None, json.dumps(self.notes)))
        draft, version = f"{self.folder}/versions/.new-{uuid.uuid4().hex}", self.base.version + 1
        self.spark.createDataFrame(rows, VERSION).coalesce(1).write.parquet(draft)
        if not renamed(self.spark, draft, f"{self.folder}/versions/{version:08d}"):
            removed(self.spark, draft)
            raise RuntimeError(f"version {version} is there already")
        return opened(self.spark, self.folder, version)


def vacuumed(store: Store) -> None:
    """Removes older versions and all files that this one does not list, those of changes that were killed included."""
    named = {path.rpartition("/")[0] for there in store.pieces.values() for path, _ in there.values()}
    for name in listed(store.spark, f"{store.folder}/data"):
        if f"data/{name}" not in named:
            removed(store.spark, f"{store.folder}/data/{name}")
    for name in listed(store.spark, f"{store.folder}/versions"):
        if name != f"{store.version:08d}":
            removed(store.spark, f"{store.folder}/versions/{name}")
