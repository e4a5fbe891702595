"""Closure and reduction of precedence edges (columns a, b) as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def transitive_closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """All (a, b) with a path from a to b.  Each round joins only the pairs that the last one found, on either side, with all
    that is known, so that paths double in length and no pair is made from old ones twice."""
    closed = fresh = cut(edges.select("a", "b").distinct())
    for _ in range(max_rounds):
        on = lambda x, y: x.alias("x").join(y.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        fresh = cut(on(fresh, closed).unionByName(on(closed, fresh)).distinct().join(closed, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            break
        closed = cut(closed.unionByName(fresh))
    return closed


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """The edges of an acyclic relation that no longer path implies."""
    closed = transitive_closure(edges)
    implied = closed.alias("x").join(closed.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b")).distinct()
    return edges.select("a", "b").distinct().join(implied, ["a", "b"], "left_anti")
