"""Steps that put searches together: choice of a method, sub-questions, rerankers in a row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.operators import fusion
from textquarry.operators.bm25 import top


class Reranker(Protocol):
    """A step that takes ranked rows (qid, id, score, rank and more) and returns rows with new scores and ranks."""

    def __call__(self, ranked: DataFrame) -> DataFrame: ...


def reranked(ranked: DataFrame, steps: list[Reranker], k: int) -> DataFrame:
    """The steps one after another, then the k best by the last scores."""
    return top(reduce(lambda df, step: step(df), steps, ranked).drop("rank"), k)


def by_method(method: str, semantic: Callable[[int], DataFrame], lexical: Callable[[int], DataFrame], k: int, least: float | None = None) -> DataFrame:
    """qid, id, score, rank by one method: semantic or keyword alone, with a least score on either, or hybrid, fused by rank from twice as many of each."""
    if method == "hybrid":
        return fusion.rrf(fusion.lists_of(semantic(2 * k), lexical(2 * k)), k).drop("n_lists")
    if method not in ("semantic", "keyword"):
        raise ValueError(f"no search method {method}")
    found = (semantic if method == "semantic" else lexical)(k)
    return found if least is None else found.where(F.col("score") >= least)


def combined_sources(found: DataFrame, parents: DataFrame) -> DataFrame:
    """qid, n_sources and sources of each question: the hits of all its sub-questions in their order, each document as often as it was found. parents: sub_id, qid, no; found: qid (a sub_id), id, rank."""
    rows = found.withColumnRenamed("qid", "sub_id").join(parents, "sub_id")
    lists = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("no", "rank", "id"))).alias("l"))
    return lists.select("qid", F.size("l").cast("long").alias("n_sources"), F.transform("l", lambda x: x["id"]).alias("sources"))


def rrf_by_text(lists: DataFrame, k: int, key: int = 100) -> DataFrame:
    """Reciprocal rank fusion of rows (qid, id, rank, list_no, text) in which texts with the same beginning are one; the smallest id stands for them."""
    rows = lists.withColumn("key", F.substring("text", 1, key))
    fused = rows.groupBy("qid", "key").agg(F.min("id").alias("id"), F.round(F.sum(1 / (fusion.K + F.col("rank"))), 6).alias("score"))
    return top(fused.drop("key"), k)


def merged(lists: DataFrame, asked: DataFrame, k: int, strategy: str = "rrf") -> DataFrame:
    """The lists (qid, id, rank, score, list_no) of a question's variants as one, by rrf, weighted or union; with n_failed, how many of the variants that were asked (qid, list_no) found nothing. Questions of which all failed have no rows."""
    by = {"rrf": fusion.rrf, "weighted": fusion.weighted_merge, "union": fusion.union_merge}
    if strategy not in by:
        raise ValueError(f"no strategy {strategy}")
    failed = asked.join(lists.select("qid", "list_no").distinct(), ["qid", "list_no"], "left_anti").groupBy("qid").agg(F.count("*").alias("n_failed"))
    return by[strategy](lists, k).join(failed, "qid", "left").fillna(0, ["n_failed"])


def rank_positions(lists: DataFrame) -> DataFrame:
    """qid, id and positions: the rank in each list that has the row, in the order of the lists."""
    rows = lists.groupBy("qid", "id").agg(F.array_sort(F.collect_list(F.struct("list_no", "rank"))).alias("l"))
    return rows.select("qid", "id", F.transform("l", lambda x: x["rank"]).alias("positions"))


def complete(chunks: DataFrame, needed: tuple[str, ...] = ("title", "link")) -> tuple[DataFrame, DataFrame]:
    """Chunks whose needed columns are not blank, and the others with missing, the names of those that are."""
    blank = F.array_compact(F.array(*(F.when(F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0, F.lit(c)) for c in needed)))
    marked = chunks.withColumn("missing", blank)
    return marked.where(F.size("missing") == 0).drop("missing"), marked.where(F.size("missing") > 0)


def warm_up_statistics(done: DataFrame) -> DataFrame:
    """One row: total, ok, failed and success_rate of rows with error (null if all went well)."""
    ok = F.count_if(F.col("error").isNull())
    return done.agg(F.count("*").alias("total"), ok.alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.round(F.when(F.count("*") > 0, ok / F.count("*")).otherwise(0.0), 6).alias("success_rate"))
