"""Graphs of named entities: edges through aliases, neighbours, shortest paths."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.checkpoints import Stages


def edges(links: DataFrame, names: DataFrame) -> DataFrame:
    """Symmetric distinct pairs (a, b) of nodes; `links`: node, target; `names`: name (a node's own or an alias), node."""
    found = links.join(names.select(F.col("name").alias("target"), F.col("node").alias("b")), "target").select(F.col("node").alias("a"), "b").filter("a != b")
    return found.unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def neighbours(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, degree and its neighbours in order, for each of `nodes`; a node without any has an empty list."""
    found = nodes.join(graph, nodes["node"] == graph["a"], "left").groupBy("node")
    return found.agg(F.count("b").alias("degree"), F.array_sort(F.collect_list("b")).alias("neighbours"))


def distances(graph: DataFrame, start: DataFrame, hops: int | None = None) -> DataFrame:
    """node, distance and parent (the smallest neighbour one step nearer, null at the start) of what `start` (node) leads to, within `hops` steps if given.

    One join of the frontier a step; what is known is a table in the shared folder, so the plan doesn't grow.
    """
    stages = Stages(graph.sparkSession, "bfs")
    known = stages.write("known", start.select("node", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("parent")))
    for step in itertools.count(1) if hops is None else range(1, hops + 1):
        frontier = known.filter(F.col("distance") == step - 1).select(F.col("node").alias("a"))
        reached = graph.join(frontier, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        new = reached.join(known.select("node"), "node", "left_anti").select("node", F.lit(step).alias("distance"), "parent")
        new = stages.write("new", new)
        if new.isEmpty():
            break
        known = stages.write("known", known.unionByName(new))
    return known


def paths(graph: DataFrame, start: DataFrame) -> DataFrame:
    """node, hops and path (nodes from `start` to it) for every node of the graph and the start; hops and path are null where none leads to it.

    Of the shortest paths it is the first in the order of its nodes, which is the one that a queue over sorted neighbours finds.
    """
    stages = Stages(graph.sparkSession, "paths")
    graph = stages.write("graph", graph)
    steps = stages.write("steps", distances(graph, start).select("node", "distance"))
    level = stages.write("path0", start.select("node", F.array("node").alias("path")))
    done = level
    for step in itertools.count(1):
        ends = steps.filter(F.col("distance") == step).select(F.col("node").alias("b"))
        found = graph.join(level.select(F.col("node").alias("a"), "path"), "a").join(ends, "b").groupBy("b").agg(F.min("path").alias("path"))
        level = stages.write(f"path{step}", found.select(F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path")))
        if level.isEmpty():
            break
        done = done.unionByName(level)
    every = graph.select(F.col("a").alias("node")).unionByName(start.select("node")).distinct()
    return every.join(done.select("node", (F.size("path") - 1).alias("hops"), "path"), "node", "left")
