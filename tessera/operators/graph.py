"""Directed property graphs: edges (src, dst, ...), nodes (id, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import written


def neighbours(edges: DataFrame, node: object) -> DataFrame:
    """Targets of the node's edges, one row for each edge."""
    return edges.where(F.col("src") == node).select("dst")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def reach(edges: DataFrame, starts: DataFrame, depth: int | None) -> DataFrame:
    """(start, node, hops): nodes within depth hops and the fewest hops; each level joins the new frontier only, and is written.

    Without a depth all that can be reached.
    """
    steps = written(edges.select("src", "dst").distinct(), "steps")
    first = written(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).cast("long").alias("hops")).distinct(), "level")
    return _levels(steps, first, first, depth)


def _levels(steps: DataFrame, seen: DataFrame, frontier: DataFrame, depth: int | None, hop: int = 1) -> DataFrame:
    while depth is None or hop <= depth:
        found = frontier.join(steps, frontier["node"] == steps["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = written(found.join(seen, ["start", "node"], "left_anti").withColumn("hops", F.lit(hop).cast("long")), "level")
        if frontier.isEmpty():
            break
        seen, hop = seen.unionByName(frontier), hop + 1
    return seen


def shortest_path(edges: DataFrame, start: object, end: object, max_depth: int) -> DataFrame:
    """(path, hops): one shortest path, the first in the order of its nodes; no row if there is none."""
    steps = edges.select("src", "dst").distinct()
    kind = edges.schema["src"].dataType
    level = edges.sparkSession.range(1).select(F.array(F.lit(start).cast(kind)).alias("path"))
    found = []
    for _ in range(max_depth):
        level = level.join(steps, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        level = level.select(F.concat("path", F.array("dst")).alias("path"), "dst")
        # of the paths to a node the first is enough
        level = level.groupBy("dst").agg(F.min("path").alias("path")).select("path")
        found.append(level.where(F.element_at("path", -1) == F.lit(end)))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("path", (F.size("path") - 1).cast("long").alias("hops")).orderBy("hops", "path").limit(1)


def on_cycles(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id): nodes that reach themselves, within max_depth hops if given."""
    steps = written(edges.select("src", "dst").distinct(), "steps")
    walk = written(steps.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).cast("long").alias("hops")), "level")
    return _levels(steps, walk, walk, max_depth, 2).where("start = node").select(F.col("start").alias("id")).distinct()
