"""Heap scores and order keys of candidates, as fixed-point integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Millionths.
SCALE = 1_000_000


def fixed(x: Column) -> Column:
    """A number in millionths, halves away from zero."""
    return F.round(x * F.lit(float(SCALE))).cast("bigint")


def log_close(cost: Column) -> Column:
    """-ln(1 + cost): the closer, the larger."""
    return fixed(-F.log(F.lit(1.0) + cost))


def log_improve(before: Column, after: Column) -> Column:
    """ln of how much a step brings a walk closer."""
    return fixed(F.log((F.lit(1.0) + before) / (F.lit(1.0) + after)))


def linear(parts: dict[str, tuple[float, Column]]) -> Column:
    out = F.lit(0.0)
    for weight, column in parts.values():
        out = out + F.lit(weight) * column
    return fixed(out)


def diversity_penalty(seen: Column) -> Column:
    """One unit less for every earlier item of the same class."""
    return -seen.cast("bigint") * F.lit(SCALE)


def field_cost(cleaved: Column, extra: Column, bonds: Column, aromatic: Column) -> Column:
    """The cost of a difference: 3 per cleaved atom, 4 per extra atom, 3 per bond, 1 per aromatic change."""
    return 3 * cleaved + 4 * extra + 3 * bonds + aromatic


def class_key(*parts: Column) -> Column:
    """A coarse class as text; a null part is empty."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
