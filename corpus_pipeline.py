"""From documents to packed sequences: quality classifier, exact and near deduplication, substring deduplication, packing.

Each stage takes what its predecessor kept. Rows are told apart by id and text, so repeated ids do no harm; of rows that
agree in both, and of copies without an id, exact deduplication leaves one. Ids are integers.

Null and empty texts are documents without words: the classifier judges them like others, exact deduplication leaves one of
them, the near and substring stages leave it alone, and it is packed as its end id. So is a document whose words all lie in
repeated windows: it stays, with an empty text. An empty table gives no rows. All columns of documents are handed on, further ones
too, whatever their names; only text and n_chars change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import exact_dedup, minhash_dedup, packing, quality_classifier, substring_dedup, tokens
from textquarry.llm.common import row_key, scratch, shared_path, table, text_of, written
from textquarry.llm.files import remove


def kept_rows(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """The documents that verdict (doc_id, h, kept) keeps; h is the row_key of the text."""
    once = verdict.groupBy("doc_id", "h").agg(F.bool_or("kept").alias("kept"))  # repeated rows stay together
    gone = once.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h"))
    match = docs["doc_id"].eqNullSafe(F.col("gone_id")) & (row_key(text_of("text")) == F.col("gone_h"))
    return docs.join(gone, match, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return kept_rows(docs, written(quality_classifier.classify(docs, table(spark, sf_dir, "labels")), "verdict"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    return kept_rows(docs, written(minhash_dedup.near_duplicates(docs, k=5, percent=80), "verdict"))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows of 35 words that repeat are removed. Documents from which nothing is removed keep their text as it was."""
    out = substring_dedup.remove_repeats(docs, others=tuple(c for c in docs.columns if c not in ("doc_id", "text")))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids."""
    return packing.with_crc(packing.pack(docs, tokens.word_vocabulary()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("substring dedup", substring),
    ("packing", pack),
]

#: The classifier and the tokenizer can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents, each written and read again. What a stage wrote for itself, and its input, are removed once its result is written."""
    docs, folder, before = table(spark, sf_dir, "documents"), shared_path(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k + 1}-{name.replace(' ', '-')}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
