"""Connected components of a graph given as edges, by spreading the smallest id and jumping along pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.checkpoints import Stages


def components(edges: DataFrame, stages: Stages | None = None) -> DataFrame:
    """node, component (the smallest node of its component) for every node of `edges` (a, b); one column of any orderable type.

    Each round turns every node's edges into edges of its neighbours to the smallest of them (large-star, then small-star),
    so a path shortens by half; the rounds end when nothing changes. All state is in tables of the shared folder.
    """
    stages = stages or Stages(edges.sparkSession, "components")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        joined = both.join(low, "a")
        if large:
            made = joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            made = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(low.select("a", F.col("low").alias("b")))
        return made.filter("a != b").distinct()

    now = stages.write("edges", edges.select("a", "b").filter("a != b").distinct())
    nodes = stages.write("nodes", edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct())
    before = None
    while True:
        now = stages.write("edges", star(star(now, True), False))
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == before:
            break
        before = mark
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
