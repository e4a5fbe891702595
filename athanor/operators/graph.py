"""Graph tables: nodes and edges (columns src, dst) as DataFrames.

Level loops keep the driver's part to one count per level; what was seen is anti-joined, and every level is a
reliable checkpoint, so neither lineage nor a lost executor stops a long search.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def bfs_levels(edges: DataFrame, roots: DataFrame, max_depth: int, expands: Column | None = None, both_ways: bool = False) -> DataFrame:
    """(node, level) of what is reached from `roots` (column node) within `max_depth` steps.  Where `expands`, a
    predicate on `node`, is false a node is reached but not left."""
    if both_ways:
        edges = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return level_loop(lambda frontier: frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")), roots, max_depth, expands)


def level_loop(step: Callable[[DataFrame], DataFrame], roots: DataFrame, max_depth: int, expands: Column | None = None) -> DataFrame:
    """The fixpoint of `step`, which maps a frontier (node) to the nodes one step on."""
    frontier = cut(roots.select("node").distinct())
    seen = frontier.withColumn("level", F.lit(0))
    for level in range(1, max_depth + 1):
        leaving = frontier if expands is None else frontier.filter(expands)
        frontier = cut(step(leaving).filter("node is not null").distinct().join(seen.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("level", F.lit(level)))
    return seen


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out); parallel edges count each."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    return out.join(into, "node", "full").select("node", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def graph_stats(nodes: DataFrame, edges: DataFrame, rule: str = "rule", pattern: str = "pattern") -> DataFrame:
    """One row: n_nodes, n_edges, n_rule_patterns."""
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct(rule, pattern).alias("n_rule_patterns")))


def prune_to_targets(nodes: DataFrame, edges: DataFrame, keep: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Nodes that stay when sinks outside `keep` (column node: root and targets) are removed again and again.
    Cycles stay, since none of their nodes is a sink.  A round looks only at the parents of what the last one removed."""
    edges, kept = edges.select("src", "dst"), keep.select("node").distinct()
    every = nodes.select("node").distinct()
    gone = fresh = cut(every.join(edges.select(F.col("src").alias("node")), "node", "left_anti").join(kept, "node", "left_anti"))
    for _ in range(max_rounds):
        parents = edges.join(fresh.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        parents = cut(parents.join(kept, "node", "left_anti").join(gone, "node", "left_anti"))
        if parents.isEmpty():
            break
        alive = edges.join(parents.withColumnRenamed("node", "src"), "src", "left_semi").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        fresh = cut(parents.join(alive.select(F.col("src").alias("node")), "node", "left_anti"))
        if fresh.isEmpty():
            break
        gone = gone.unionByName(fresh)
    return every.join(gone, "node", "left_anti")


def shortest_hops(edges: DataFrame, target: DataFrame, max_depth: int) -> DataFrame:
    """(node, hops): least number of edges from a node to the target, by levels backwards."""
    return bfs_levels(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), target, max_depth).withColumnRenamed("level", "hops")


def step_path(edges: DataFrame, source: DataFrame, target: DataFrame, max_depth: int) -> DataFrame:
    """(step, src, dst) of one shortest path; at every step the least next node is taken."""
    hops = cut(shortest_hops(edges, target, max_depth))
    nxt = edges.join(hops.withColumnRenamed("node", "dst").withColumnRenamed("hops", "after"), "dst").join(hops.withColumnRenamed("node", "src"), "src").filter("after = hops - 1")
    nxt = cut(nxt.groupBy("src").agg(F.min("dst").alias("dst")))
    at = source.select("node")
    out: DataFrame | None = None
    for step in range(max_depth):
        one = cut(at.join(nxt, at["node"] == nxt["src"]).select(F.lit(step).alias("step"), "src", "dst"))
        if one.isEmpty():
            break
        out = one if out is None else out.unionByName(one)
        at = one.select(F.col("dst").alias("node"))
    return out if out is not None else nxt.select(F.lit(0).alias("step"), "src", "dst").limit(0)


def closest(costs: DataFrame, k: int, cost: str = "cost", tie: str = "node") -> DataFrame:
    """The k rows of least cost, ties by `tie`."""
    return costs.orderBy(cost, tie).limit(k)


def simple_paths(edges: DataFrame, source: DataFrame, max_depth: int) -> DataFrame:
    """(path, node) of the paths without a repeated node, the empty one included."""
    paths = source.select(F.array("node").alias("path"), "node")
    out = paths
    for _ in range(max_depth):
        paths = cut(paths.join(edges, paths["node"] == edges["src"]).filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node")))
        if paths.isEmpty():
            break
        out = out.unionByName(paths)
    return out


def transition_edges(walk: DataFrame, by: list[str], order: list[str], state: str) -> DataFrame:
    """Edges between consecutive states of ordered walks."""
    following = F.lead(state).over(Window.partitionBy(*by).orderBy(*order))
    return walk.select(*by, *order, F.col(state).alias("src"), following.alias("dst")).filter("dst is not null")


def upsert_nodes(nodes: DataFrame, fresh: DataFrame) -> DataFrame:
    """`nodes` (idx, node, ...) with those of `fresh` (column node) that are not there yet, numbered on from the largest
    index in the order of their text.  Only new nodes are sorted: by ranges, which number themselves after the counts of
    the ranges before them.  The sorted table is written first, so that a lost task can't deal the ranges anew."""
    first = nodes.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("first"))
    new = fresh.select("node").filter("node is not null").distinct().join(nodes.select("node"), "node", "left_anti")
    ranged = cut(new.repartitionByRange("node").sortWithinPartitions("node").select("node", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row")))
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # A row per range, that is per task, so one task may sum them up.
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = ranged.join(F.broadcast(before), "part").crossJoin(first)  # `first` is one row
    return nodes.unionByName(placed.select((F.col("first") + F.col("before") + F.col("row")).alias("idx"), "node"), allowMissingColumns=True)


def mark(nodes: DataFrame, which: DataFrame, flag: str) -> DataFrame:
    """`nodes` with a boolean column that is true for the nodes of `which` (column node), and stays true where it was."""
    hit = which.select("node").distinct().withColumn("__hit", F.lit(True))
    before = F.col(flag) if flag in nodes.columns else F.lit(False)
    return nodes.join(hit, "node", "left").withColumn(flag, F.coalesce(before, F.lit(False)) | F.coalesce("__hit", F.lit(False))).drop("__hit")


def neighbours(edges: DataFrame, nodes: DataFrame, children: bool = True) -> DataFrame:
    """(node, neighbour) of the given nodes, parallel edges as often as they occur."""
    here, there = ("src", "dst") if children else ("dst", "src")
    return nodes.select("node").join(edges.select(F.col(here).alias("node"), F.col(there).alias("neighbour")), "node")
