"""Connected components of a table of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import hot_keys, salted_join, scratch, shared_path, written


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the smallest node reachable) for all ends of the edges (a, b), both long and not null.

    Each round takes the smallest label among a node's neighbours and then the label's own label, so
    long chains shrink by halves. Rounds start from written tables, which are removed at the end. Nodes with very many links
    and labels of very many nodes are dealt over several tasks. An empty table of edges gives no rows.
    """
    spark = edges.sparkSession
    folder = shared_path(spark, "components")
    with scratch(spark):
        both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
        degrees = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("c"))
        labels = written(degrees.select(F.col("a").alias("node"), F.least("low", "a").alias("comp"), "c"), "labels")
        hubs = hot_keys(labels.select(F.col("node").alias("far"), "c"), "far", "c")
        both = both.withColumnRenamed("b", "far")
        labels, large = labels.select("node", "comp"), None
        while True:
            near = salted_join(both, labels.select(F.col("node").alias("far"), "comp"), "far", hubs, ["a"]).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
            low = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
            jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
            moved = written(salted_join(low, jump, "comp", large, ["node"]).select("node", "old", F.least("comp", "further").alias("comp")), "labels")
            labels = moved.select("node", "comp")
            if moved.where("old != comp").isEmpty():
                return written(labels, "done", folder)
            large = hot_keys(labels.groupBy("comp").agg(F.count("*").alias("c")), "comp", "c")
