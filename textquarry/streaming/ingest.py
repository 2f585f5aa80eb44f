"""Ingest of papers: papers, chunks, vectors and postings, committed together batch by batch.

Each micro-batch becomes one version of a store (``tables``): the latest version of every paper, the chunks and vectors of the papers that
changed, and a segment of the stored index with their words. A batch that was already taken, by the note of its stream, changes nothing; one
that is killed before its commit leaves the last version, and is taken whole when it comes again. Papers that can't be used are counted as errors and kept
in a table of rejects with the reason.

A paper needs an id, and a title or a summary that is not blank. Papers of one id: the one with the latest date, null dates first; a batch may bring them in any order,
however late. Only buckets of the batch's papers are read and written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from textquarry.functions.text import fixed_chunks, word_text
from textquarry.operators import index as index_
from textquarry.operators import models, tables
from textquarry.operators.storage import removed
from textquarry.operators.tables import Shape, Store

PAPER = "id string, title string, summary string, authors array<string>, categories array<string>, published_at timestamp"
SHAPES = {
    "papers": Shape(f"{PAPER}, no long", "id"),
    "chunks": Shape("id string, chunk_id string, chunk_index int, text string", "id"),
    "vectors": Shape("id string, chunk_id string, embedding array<float>, error string", "id"),
    "rejects": Shape(f"{PAPER}, problem string, batch long", "id"),
}


def problem():
    """Why a paper can't be used, or null."""
    blank = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0
    return F.when(blank("id"), F.lit("no_id")).when(blank("title") & blank("summary"), F.lit("no_text"))


def chunked(papers: DataFrame, size: int = 900, overlap: int = 150) -> DataFrame:
    """id, chunk_id, chunk_index, text: title and abstract in overlapping pieces."""
    whole = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\n\nAbstract: "), F.coalesce("summary", F.lit("")))
    each = papers.select("id", F.posexplode(fixed_chunks(whole, size, overlap)).alias("chunk_index", "text"))
    return each.select("id", F.concat("id", F.lit("::chunk_"), "chunk_index").alias("chunk_id"), "chunk_index", "text")


def words_of(papers: DataFrame) -> DataFrame:
    """id (the paper's number), text of words."""
    whole = papers.select(F.col("no").alias("id"), F.concat_ws(" ", "title", "summary").alias("text"))
    return whole.select("id", word_text(F.col("text")).alias("text"))


def _numbered(newer: DataFrame, first: int) -> tuple[DataFrame, int, int]:
    """Written rows with no, where it is null, from their places at, which were written with them; the number of rows and the next no. Rows that have a no leave gaps."""
    part = F.shiftright("at", 33)
    counts = newer.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.count_if(F.col("no").isNull()).alias("fresh")).orderBy("p").collect()  # a row for each task that wrote the batch
    starts, total = [], first
    for r in counts:
        starts.append((r["p"], total - (r["p"] << 33)))
        total += r["n"] if r["fresh"] else 0
    shift = newer.sparkSession.createDataFrame(starts, "_p long, _shift long")
    numbered = newer.join(F.broadcast(shift), part == F.col("_p")).withColumn("no", F.coalesce("no", F.col("at") + F.col("_shift")))
    return numbered.drop("at", "_p", "_shift"), sum(r["n"] for r in counts), total


def _newer(valid: DataFrame, old: DataFrame, shape: Shape) -> DataFrame:
    """The latest row of each id, where it is not older than the table's, with the table's no; those of a bucket lie together. Rows of the table (id, no, published_at) come through the same shuffle, before the others of their id."""
    both = valid.withColumn("_old", F.lit(0)).unionByName(old.withColumn("_old", F.lit(1)), allowMissingColumns=True)
    dealt = shape.dealt(both).withColumn("_part", shape.part(int(valid.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    w = Window.partitionBy("bucket", "_part", "id").orderBy(F.desc("_old"), F.desc_nulls_last("published_at"), *(F.desc_nulls_last(F.col(c)) for c in ("title", "summary")))
    head = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = dealt.withColumn("_r", F.row_number().over(w)).withColumn("_known", head("_old")).withColumn("no", head("no")).withColumn("_had", F.when(F.col("_known") == 1, head("published_at")))
    return each.where("_old = 0 and _r = 1 + _known and (no is null or _had is null or published_at >= _had)").drop("_old", "_r", "_known", "_had", "_part", "bucket")


def ingested(store: Store, batch: DataFrame, stream: str, number: int, factory: Callable = models.hashing_embedder) -> tuple[Store, dict[str, int]]:
    """The next version of the store with a batch of papers, and {fetched, indexed, errors}."""
    spark, folder = store.spark, store.folder
    if int(store.notes.get(f"batch:{stream}", -1)) >= number:
        return store, {"fetched": 0, "indexed": 0, "errors": 0}
    # One pass over the batch counts it and writes it; all that follows reads the written rows.
    seen, path = Observation(), f"{folder}/staged/{stream}-{number}"
    judged = batch.select(*(F.col(f.split()[0]).cast(f.split()[1]) for f in PAPER.split(", "))).withColumn("problem", problem())
    judged = judged.observe(seen, F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("problem").isNull()).alias("usable"), F.count_if(F.col("problem").isNotNull()).alias("errors"))
    judged.write.mode("overwrite").parquet(f"{path}/batch")
    staged = spark.read.schema(f"{PAPER}, problem string").parquet(f"{path}/batch")

    change = store.change()
    for name, shape in SHAPES.items():
        change.create(name, shape)
    valid = staged.where("problem is null").drop("problem")
    old = change.read("papers", change.touched("papers", valid)).select("id", "no", "published_at")
    newer = _newer(valid, old, SHAPES["papers"]).withColumn("at", F.monotonically_increasing_id())
    newer.write.mode("overwrite").parquet(f"{path}/papers")
    newer = spark.read.schema(f"{PAPER}, no long, at long").parquet(f"{path}/papers")
    changed, n, following = _numbered(newer, int(store.notes.get("papers", 0)))
    if n:
        # The written papers lie by bucket, and so does what is made of each: chunks and vectors are made once and not shuffled.
        change.merge("papers", changed, "published_at", True)
        change.replace("chunks", chunked(changed), "id", newer, True)
        vectors = models.embed(change.placed["chunks"].select("id", "chunk_id", "text"), "text", factory)
        change.replace("vectors", vectors.select("id", "chunk_id", "embedding", "error"), "id", newer, True)
        change.note(index=str(_indexed(store, changed).version), papers=str(following))
    bad = staged.where("problem is not null").withColumn("batch", F.lit(number).cast("long"))
    if seen.get["errors"]:
        change.replace("rejects", bad.withColumn("id", F.coalesce("id", F.lit(""))), "id", bad.limit(0))
    after = change.note(**{f"batch:{stream}": str(number)}).commit()
    removed(spark, path)
    return after, {"fetched": seen.get["fetched"], "indexed": n, "errors": seen.get["errors"]}


def _indexed(store: Store, changed: DataFrame) -> index_.Index:
    """The index with the changed papers. Versions that a killed batch has left are passed over."""
    folder = f"{store.folder}/index"
    if "index" not in store.notes:
        removed(store.spark, folder)  # of a first batch that was killed
        return index_.built(words_of(changed), folder)
    base = index_.opened(store.spark, folder, int(store.notes["index"]))
    return index_.extended(base, words_of(changed), index_.versions(store.spark, folder)[-1] + 1)


def index_of(store: Store) -> index_.Index:
    """The index of a version of the store; its ids are the papers' numbers."""
    return index_.opened(store.spark, f"{store.folder}/index", int(store.notes["index"]))


def ingest(stream: DataFrame, folder: str, checkpoint: str | None = None, said: Callable[[dict[str, int]], None] | None = None, factory: Callable = models.hashing_embedder):
    """A stream of papers into the store in folder. Starts the query (available-now). said gets {fetched, indexed, errors} of each batch. Batches are told apart by the id of the query, which its checkpoint keeps, and their number."""

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        name = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        _, counts = ingested(tables.opened(spark, folder), batch, name, number, factory)
        if said:
            said(counts)

    writer = stream.writeStream.foreachBatch(take).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
