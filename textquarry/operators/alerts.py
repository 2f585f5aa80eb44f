"""Alerts: which papers match which standing searches.

An alert has alert_id, keywords, categories and authors (arrays). An empty list matches everything. All keywords of a batch of
alerts are looked for in one pass over each text; alerts then meet papers by equality only: on a keyword that was found, on a
category or on an author. Alerts that ask for nothing match every paper.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.operators.blocks import batches_of
from textquarry.operators.storage import spread


def finder(words: list[str]) -> Callable[[str], set[str]]:
    """The words that a text holds, found in one pass."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: {w for w in words if w in text}
    tree = ahocorasick.Automaton()
    for w in filter(None, words):
        tree.add_word(w, w)
    tree.make_automaton()
    always = {w for w in words if not w}
    return lambda text: always | ({w for _, w in tree.iter(text)} if len(tree) else set())


def found_words(texts: DataFrame, words: DataFrame) -> DataFrame:
    """paper_id and keyword for each word (column keyword, lower case) that a text (paper_id, low) holds."""

    def one(part: DataFrame) -> DataFrame:
        held = texts.sparkSession.sparkContext.broadcast([r["keyword"] for r in part.select("keyword").distinct().collect()])  # one batch

        def run(batches):
            find = finder(held.value)
            for b in batches:
                hits = [sorted(find(t)) for t in b.column(1).to_pylist()]
                of = [i for i, h in enumerate(hits) for _ in h]
                yield pa.record_batch([b.column(0).take(pa.array(of, pa.int64())), pa.array([w for h in hits for w in h], pa.string())], ["paper_id", "keyword"])

        return texts.mapInArrow(run, texts.select("paper_id").withColumn("keyword", F.lit("")).schema)

    return reduce(DataFrame.unionByName, map(one, batches_of(words, "keyword")))


def matches(alerts: DataFrame, papers: DataFrame) -> DataFrame:
    """alert_id and paper_id of each match; papers have paper_id, title, summary, categories, authors."""
    asked = alerts.select("alert_id", "keywords", F.col("categories").alias("alert_categories"), F.col("authors").alias("alert_authors"))
    texts = spread(papers.select("paper_id", F.coalesce(F.lower(F.concat_ws(" ", "title", "summary")), F.lit("")).alias("low")))
    rows = papers.select("paper_id", "categories", "authors")
    fits = lambda mine, theirs: (F.size(mine) == 0) | F.coalesce(F.arrays_overlap(mine, theirs), F.lit(False))
    rest = fits("alert_categories", "categories") & fits("alert_authors", "authors")

    keyed = asked.select("alert_id", F.explode(F.array_distinct(F.transform("keywords", F.lower))).alias("keyword"))
    by_word = found_words(texts, keyed).join(keyed, "keyword").select("alert_id", "paper_id").distinct()
    first = by_word.join(asked, "alert_id").join(rows, "paper_id").where(rest)

    def met(some: DataFrame, theirs: str, mine: str) -> DataFrame:
        """Alerts that share a value with a paper. A few categories hold most papers, so papers stay where they are and a batch of alerts goes to them."""
        each = rows.withColumn("v", F.explode(F.array_distinct(theirs)))
        parts = [each.join(F.broadcast(p.withColumn("v", F.explode(F.array_distinct(mine)))), "v").where(rest) for p in batches_of(some, "alert_id")]
        return reduce(DataFrame.unionByName, parts).select("alert_id", "paper_id").distinct()

    open_ = asked.where(F.size("keywords") == 0)
    second = met(open_.where(F.size("alert_categories") > 0), "categories", "alert_categories")
    open_ = open_.where(F.size("alert_categories") == 0)
    third = met(open_.where(F.size("alert_authors") > 0), "authors", "alert_authors")
    pairs = first.select("alert_id", "paper_id").unionByName(second).unionByName(third)
    for part in batches_of(open_.where(F.size("alert_authors") == 0), "alert_id"):  # the result itself is all pairs here
        pairs = pairs.unionByName(rows.select("paper_id").crossJoin(F.broadcast(part.select("alert_id"))).select("alert_id", "paper_id"))
    return pairs


def events(found: DataFrame) -> DataFrame:
    """A row for each alert with its number of papers and the first of them."""
    return found.groupBy("alert_id").agg(F.count("*").alias("paper_count"), F.min("paper_id").alias("first_paper"), F.max("paper_id").alias("last_paper"))
