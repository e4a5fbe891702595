"""Connected components of a link table.

Tasks of at most LOCAL_LINKS links first contract what they hold by union-find, which leaves a star for every
local component.  One such task is the whole answer; with more, alternating large-star and small-star steps
join the local stars.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


#: Links that one task contracts; bounds its memory to about 100 MB.
LOCAL_LINKS = 500_000


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node that is not its component's smallest."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    parent = list(range(len(nodes)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    roots = np.array([top(x) for x in range(len(nodes))], np.int64)
    below = roots != np.arange(len(nodes))
    return nodes[below], nodes[roots[below]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) if held else np.zeros(0, np.int64) for k in (0, 1))
    node, root = contracted(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], ["u", "v"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node of `links` (columns a, b: long ids); the root is the component's smallest id.

    A step is a minimum per node (map-side combined) and a join of the links with it, so a node with very
    many links is no single task.  Every step is written to the shared folder; O(log^2 n) steps suffice.
    Roots themselves are no rows of the result.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    count = edges.count()
    local = max(1, math.ceil(count / LOCAL_LINKS))
    edges = edges.coalesce(1) if local == 1 else edges.repartition(local)
    edges = scratch.write(edges.mapInArrow(_contract, "u long, v long"), f"{name}-0")
    if local == 1:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before, step = _state(edges), 0
    while before[0]:
        step += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.filter("m < u").select("u", F.col("m").alias("v"))
        ).distinct()
        large = scratch.write(large, f"{name}-{step}a")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.write(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step}b")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
