"""Generic table access: filters, paging, nesting, upserts, deletes, collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pattern(text: str) -> str:
    """text as a LIKE pattern for a substring, its own wild cards escaped."""
    return "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def select_rows(df: DataFrame, equal: dict | None = None, search: str | None = None, search_in: tuple[str, ...] = ()) -> DataFrame:
    """Rows equal in all known columns (unknown keys are ignored) that hold the text in one of the searched columns, in any case."""
    for name, value in (equal or {}).items():
        if name in df.columns:
            df = df.where(F.col(name) == value)
    if search and search_in:
        df = df.where(reduce(Column.__or__, (F.col(c).ilike(pattern(search)) for c in search_in)))
    return df


def metadata_filter(given: dict, date_col: str = "published") -> Column:
    """published_after and published_before bound the date; lists match on any common element; other values on equality; all hold together."""
    out = F.lit(True)
    for key, value in given.items():
        if key == "published_after":
            out &= F.col(date_col) >= value
        elif key == "published_before":
            out &= F.col(date_col) <= value
        elif isinstance(value, (list, tuple)):
            out &= F.arrays_overlap(F.col(key), F.array(*map(F.lit, value)))
        else:
            out &= F.col(key) == value
    return out


def ordered(df: DataFrame, by: str, descending: bool, tie: str) -> DataFrame:
    """Sorted by a column, nulls last, ties by another; an unknown column is ignored."""
    if by not in df.columns:
        return df.orderBy(tie)
    return df.orderBy(F.desc_nulls_last(by) if descending else F.asc_nulls_last(by), tie)


def page(df: DataFrame, by: str, tie: str, size: int, number: int, descending: bool = False) -> DataFrame:
    """The rows of one page (from 1) with total, page, total_pages, has_next and has_prev."""
    total = df.agg(F.count("*").alias("total"))
    rows = ordered(df, by, descending, tie).offset((number - 1) * size).limit(size)
    out = rows.crossJoin(F.broadcast(total)).withColumn("page", F.lit(number).cast("long")).withColumn("total_pages", F.ceil(F.col("total") / size).cast("long"))  # one row is broadcast
    return out.withColumn("has_next", F.col("page") < F.col("total_pages")).withColumn("has_prev", F.lit(number > 1))


def with_children(parents: DataFrame, children: DataFrame, on: str, child_col: Column, order: str) -> DataFrame:
    """Each parent with the list of its children in order; parents without any have an empty list."""
    lists = children.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), child_col.alias("c")))).alias("l"))
    joined = parents.join(lists, on, "left")
    return joined.withColumn("children", F.coalesce(F.transform("l", lambda x: x["c"]), F.array())).drop("l")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The latest version of each key from both tables; of equal versions the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    names = [c for c in both.columns if c not in ("_new",)]
    last = both.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(version, "_new")).alias("r"))
    return last.select("r.*")


def delete(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_anti")


def collection_order(added: DataFrame) -> DataFrame:
    """collection_id, paper_id, order_index (from 0, by first addition) and the latest notes; rows: collection_id, paper_id, added_at, notes."""
    once = added.groupBy("collection_id", "paper_id").agg(F.min("added_at").alias("first_added"), F.max_by("notes", "added_at").alias("notes"))
    w = Window.partitionBy("collection_id").orderBy("first_added", "paper_id")
    return once.withColumn("order_index", (F.row_number().over(w) - 1).cast("long"))


def visible(collections: DataFrame, user: int | None) -> DataFrame:
    """A user's own collections and public ones; without a user, public ones."""
    return collections.where(F.col("is_public") if user is None else (F.col("user_id") == user) | F.col("is_public"))
