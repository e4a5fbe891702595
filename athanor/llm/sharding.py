"""Sharding by histogram sort [native].

Rows are ordered by (hash of the text, hash of the id), so equal texts lie together.  The splitters
between shards are found before any row moves: each round counts the exact bytes that fall into bins
of the intervals that still hold a splitter, across all partitions with map-side sums, and narrows
every interval to the bin its target falls into.  When the bins are within tolerance (or hold one key)
the rows are exchanged once.

Cases: null text counts as empty and has size 1; a null id is a key like any other; rows with equal id
and equal text share a key and stay in one shard; an empty table gives an empty result; columns of the
input named like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .scratch import Scratch

RESULT = ("size", "text_crc32", "shard", "slot")
_MIN = -(2**63)
_K1, _K2, _SIZE = "__k1", "__k2", "__size"


@dataclass(frozen=True)
class Interval:
    """Keys lo..hi of one key part that hold a splitter; `below` bytes lie before it."""

    target: float
    below: int
    lo: int = _MIN
    hi: int = 2**63 - 1
    first: int | None = None  # the fixed first part once the second is searched

    def width(self, bins: int) -> int:
        return max(1, -(-(self.hi - self.lo + 1) // bins))

    def holds(self) -> Column:
        part = F.col(_K1 if self.first is None else _K2)
        inside = part.between(F.lit(self.lo), F.lit(self.hi))
        return inside if self.first is None else inside & (F.col(_K1) == F.lit(self.first))

    def bin(self, bins: int) -> Column:
        part = F.col(_K1 if self.first is None else _K2).cast("decimal(20,0)")
        return F.floor((part - F.lit(self.lo).cast("decimal(20,0)")) / F.lit(self.width(bins)).cast("decimal(20,0)")).cast("int")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumns({_K1: F.xxhash64(text), _K2: F.xxhash64(F.col(id_col)), _SIZE: F.octet_length(text).cast("long") + 1})


def splitters(slim: DataFrame, shards: int, tolerance: float, bins: int) -> list[tuple[int, int]]:
    """Upper bounds (k1, k2), exclusive, of shards 0 .. shards-2: exact byte counts choose them.

    Each round returns at most `bins` rows per open splitter to the driver, however large the table is.
    """
    total = slim.agg(F.sum(_SIZE)).first()[0] or 0
    allowed = tolerance * total / shards
    open_ = {j: Interval(total * j / shards, 0) for j in range(1, shards)}
    found: dict[int, tuple[int, int]] = {}
    while open_:
        spans = sorted({(x.first is not None, x.first or 0, x.lo, x.hi) for x in open_.values()})
        of = {s: k for k, s in enumerate(spans)}
        where = {of[(x.first is not None, x.first or 0, x.lo, x.hi)]: x for x in open_.values()}
        pick = F.lit(None).cast("struct<span:int,bin:int>")
        for k, x in where.items():
            pick = F.when(x.holds(), F.struct(F.lit(k).alias("span"), x.bin(bins).alias("bin"))).otherwise(pick)
        counted = (
            slim.select(pick.alias("at"), _K1, _K2, _SIZE)
            .filter("at is not null")
            .groupBy("at.span", "at.bin")
            .agg(F.sum(_SIZE).alias("bytes"), *(f(c).alias(n) for n, f, c in (("a1", F.min, _K1), ("z1", F.max, _K1), ("a2", F.min, _K2), ("z2", F.max, _K2))))
            .collect()
        )
        rows: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: (r["span"], r["bin"])):
            rows.setdefault(r["span"], []).append(r)
        for j, x in list(open_.items()):
            below = x.below
            for r in rows.get(of[(x.first is not None, x.first or 0, x.lo, x.hi)], ()):
                if below + r["bytes"] <= x.target and r is not rows[of[(x.first is not None, x.first or 0, x.lo, x.hi)]][-1]:
                    below += r["bytes"]
                    continue
                single = r["a1"] == r["z1"] and (x.first is not None or r["a2"] == r["z2"]) and (x.first is None or r["a2"] == r["z2"])
                if r["bytes"] <= allowed or single:
                    after = x.target - below > r["bytes"] / 2
                    key = (r["z1"], r["z2"]) if x.first is not None or r["a1"] == r["z1"] else (r["z1"], 2**63 - 1)
                    start = (r["a1"], r["a2"]) if x.first is not None or r["a1"] == r["z1"] else (r["a1"], _MIN)
                    found[j] = (key[0], key[1] + 1) if after else start
                    del open_[j]
                elif x.first is not None:
                    open_[j] = replace(x, below=below, lo=r["a2"], hi=r["z2"])
                elif r["a1"] == r["z1"]:
                    open_[j] = replace(x, below=below, first=r["a1"], lo=r["a2"], hi=r["z2"])
                else:
                    open_[j] = replace(x, below=below, lo=r["a1"], hi=r["z1"])
                break
            else:
                found[j] = (2**63 - 1, 2**63)
                del open_[j]
    return [found[j] for j in sorted(found)]


#: More cells than this are joined by the exchange that deals the rows, instead of by a broadcast of their first slots.
BROADCAST_CELLS = 200_000


def histogram_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, tolerance: float = 1e-3, bins: int = 1024, cell_rows: int = 4096) -> DataFrame:
    """`df` with size, text_crc32, shard (0 .. shards-1, bytes near equal) and slot (gapless from 0 in a
    shard, in key order).

    The exchange deals rows by (shard, cell): cells are leading ranges of the first key part, as many as leave about
    `cell_rows` rows in each, and a text that holds over 1/200 of the rows is cut alike by the id's hash, so a
    cell stays small however large the table is.  Row counts of cells give every cell its first slot.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "shards")
    names = [c for c in df.columns if c not in RESULT]
    slim = scratch.write(keyed(df, id_col, text_col).select(_K1, _K2, _SIZE), "keys")
    bounds = splitters(slim, shards, tolerance, bins)
    rows = slim.count()
    hot = sorted(r[0] for r in slim.groupBy(_K1).count().filter(F.col("count") > F.lit(max(64, rows // 200))).select(_K1).collect())

    shard = F.lit(0)
    for a, b in bounds:
        at_least = (F.col(_K1) > F.lit(a)) | ((F.col(_K1) == F.lit(a)) & (F.col(_K2) >= F.lit(b))) if b < 2**63 else F.col(_K1) > F.lit(a)
        shard = shard + at_least.cast("int")
    rank, is_hot = F.lit(0), F.lit(False)
    for v in hot:
        rank, is_hot = rank + F.when(F.col(_K1) > F.lit(v), 2).when(F.col(_K1) == F.lit(v), 1).otherwise(0), is_hot | (F.col(_K1) == F.lit(v))
    bits = max(1, (max(rows, 1) // cell_rows).bit_length())
    top = lambda c: F.shiftright(F.col(c), 64 - bits)
    cells = {"shard": shard.cast("int"), "__bin": top(_K1), "__rank": rank, "__sub": F.when(is_hot, top(_K2)).otherwise(F.lit(0).cast("long"))}
    cell = list(cells)
    # One row per cell, so a shard's window reads its rows / cell_rows.
    few = (len(hot) + 1) << bits <= BROADCAST_CELLS
    first = (
        slim.withColumns(cells).groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__first", F.sum("__n").over(Window.partitionBy("shard").orderBy(*cell[1:]).rowsBetween(Window.unboundedPreceding, -1)))
        .select(*cell, F.coalesce("__first", F.lit(0)).alias("__first"))
    )
    dealt = keyed(df.select(*names), id_col, text_col).withColumns({"text_crc32": F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), **cells})
    order = Window.partitionBy(*cell).orderBy(_K1, _K2, F.col(id_col))
    numbered = dealt.withColumn("__row", F.row_number().over(order))
    return numbered.join(F.broadcast(first) if few else first, cell).select(
        *names, F.col(_SIZE).alias("size"), "text_crc32", "shard", (F.col("__first") + F.col("__row") - 1).cast("long").alias("slot")
    )
