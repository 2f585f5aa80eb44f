"""Conversations: context windows, roll-ups, search, summaries, titles. A row has conv_id, turn, role, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_messages(talk: DataFrame, n: int = 20) -> DataFrame:
    """The last n messages of each conversation with their place (from 1, in order of time)."""
    late = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = talk.withColumn("back", F.row_number().over(late)).where(F.col("back") <= n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")).drop("back")


def roll_up(talk: DataFrame, most_messages: int = 10, most_tokens: int = 8000) -> DataFrame:
    """Messages and tokens (four characters each, null text none) of each conversation, and whether it should be summarised."""
    out = talk.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.sum(F.coalesce(F.floor(F.length("text") / 4), F.lit(0))).cast("long").alias("n_tokens"))
    return out.withColumn("summarise", (F.col("n_messages") >= most_messages) | (F.col("n_tokens") > 0.7 * most_tokens))


def first_match(talk: DataFrame, needle: str) -> DataFrame:
    """The first message of each conversation that holds needle in any case."""
    found = talk.where(F.contains(F.lower("text"), F.lit(needle.lower())))
    return found.groupBy("conv_id").agg(F.min("turn").alias("turn"), F.min_by(F.substring("text", 1, 100), "turn").alias("preview"))


def summary(talk: DataFrame, n: int = 20) -> DataFrame:
    """Of the last n messages: how many are the user's, and how the first of these begins."""
    return last_messages(talk, n).groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n_user"), F.min_by(F.when(F.col("role") == "user", F.substring("text", 1, 100)), F.when(F.col("role") == "user", F.col("turn"))).alias("first_user"))


def titles(talk: DataFrame) -> DataFrame:
    """The first user message as a title: 100 characters, with dots if it is longer."""
    first = talk.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return first.select("conv_id", F.when(F.length("t") > 100, F.concat(F.substring("t", 1, 100), F.lit("..."))).otherwise(F.col("t")).alias("title"))
