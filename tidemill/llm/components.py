"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.work import brief_shuffles, settled


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each node of edges (a, b), root being the smallest id of its component; nodes without edges have no row.

    Each round hangs a node's neighbours on the smallest of them: a minimum that
    Spark combines before the shuffle, and a join on the node, which AQE splits
    when one node has most of the edges. Edges shrink to one per node, and end as
    stars around the roots. No node's neighbours are gathered in one row.
    """
    e = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = settled(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))  # a table of its own, so that AQE can split a hub's join
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # large star
        e = e.where("a <> b").distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")  # small star
        e = settled(e.where("a <> b").distinct())
        with brief_shuffles(e.sparkSession):
            now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).union(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
