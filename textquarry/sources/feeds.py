"""Feeds of papers, paper and chunk tables, evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "id string, title string, summary string, published string, updated string, link array<struct<_href:string,_rel:string>>, author array<struct<name:string>>, category array<struct<_term:string>>"
PAPER = "id string, title string, summary string, authors array<string>, published timestamp, updated timestamp, link string, categories array<string>, primary_category string"


def flat(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files: line feeds in title and summary become blanks; the link is that of the page, else the id."""
    raw = spark.read.schema(ENTRY).format("xml").option("rowTag", "entry").load(path)
    return entries(raw)


def entries(raw: DataFrame) -> DataFrame:
    page = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return raw.select(
        F.coalesce(F.get(page, F.lit(0))["_href"], F.col("id")).alias("link"),
        flat(F.col("title")).alias("title"),
        flat(F.col("summary")).alias("summary"),
        F.transform(F.coalesce("author", F.array().cast("array<struct<name:string>>")), lambda a: a["name"]).alias("authors"),
        F.col("published"),
        F.col("updated"),
        F.transform(F.coalesce("category", F.array().cast("array<struct<_term:string>>")), lambda c: c["_term"]).alias("categories"),
    )


def normalised_entries(df: DataFrame, primary: str | None = None) -> DataFrame:
    """id from the link (rows without one go), the primary category first, each category once in its order."""
    cats = F.col("categories") if primary is None else F.array_prepend("categories", F.col(primary))
    out = df.withColumn("id", F.regexp_extract("link", r"arxiv\.org/abs/(\S+)", 1)).where("id != ''")
    return out.withColumn("categories", F.array_distinct(F.array_compact(cats))).withColumn("primary_category", F.get("categories", F.lit(0)))


def recent(df: DataFrame, days: int, as_of: Column, order: str) -> DataFrame:
    """Entries younger than days, or without a date that can be read; of each id the first of these in the given order."""
    at = F.try_to_timestamp("published")
    young = df.withColumn("published_at", at).where(at.isNull() | (at >= as_of - F.expr(f"interval {days} days")))
    w = Window.partitionBy("id").orderBy(order)
    return young.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def write_papers(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_papers(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    return spark.read.schema(PAPER).option("multiLine", not lines).json(path)


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """question and ground_truth from JSON or CSV."""
    schema = "question string, ground_truth string"
    if path.endswith(".csv"):
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_eval(df: DataFrame, path: str) -> None:
    """Results by run; rows have run_ts."""
    df.write.mode("append").partitionBy("run_ts").json(path)


def eval_history(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    """The latest runs, newest first, with their number of rows."""
    return spark.read.json(path).groupBy("run_ts").agg(F.count("*").alias("n")).orderBy(F.desc("run_ts")).limit(n)


def write_chunks(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
