"""Bags: element -> count maps, their differences and distances.

A bag is a map<string,bigint> column without zero entries.  Charge units are the keys "+" and "-", an
unspecified atom is "*".  Keys compare as text; a missing key counts zero; a null bag gives null.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType

CHARGES = ("+", "-")
HYDROGEN = "H"


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("bigint")


def _without_zeros(bag: Column) -> Column:
    return F.map_filter(bag, lambda _, n: n != 0)


def bag_delta(a: Column, b: Column) -> Column:
    """What leads from `a` to `b`: b - a per key."""
    return _without_zeros(F.map_zip_with(a, b, lambda _, x, y: _zero(y) - _zero(x)))


def bag_apply(a: Column, delta: Column) -> Column:
    """`a` with a difference applied; counts may become negative."""
    return _without_zeros(F.map_zip_with(a, delta, lambda _, x, y: _zero(x) + _zero(y)))


def bag_sum(a: Column, b: Column) -> Column:
    return bag_apply(a, b)


def bag_negate(a: Column) -> Column:
    return F.transform_values(a, lambda _, n: -n)


def bag_l1(a: Column, b: Column, without: Iterable[str] = ()) -> Column:
    """Sum of absolute differences over the keys not in `without`."""
    parts = F.map_zip_with(a, b, lambda _, x, y: F.abs(_zero(y) - _zero(x)))
    kept = F.map_filter(parts, lambda k, _: ~k.isin(*without)) if without else parts
    return F.aggregate(F.map_values(kept), F.lit(0).cast("bigint"), lambda s, n: s + n)


def bag_heavy_l1(a: Column, b: Column) -> Column:
    """The distance that skips hydrogen and charge units."""
    return bag_l1(a, b, (HYDROGEN, *CHARGES))


def bag_size(a: Column, without: Iterable[str] = ()) -> Column:
    kept = F.map_filter(a, lambda k, _: ~k.isin(*without)) if without else a
    return F.aggregate(F.map_values(kept), F.lit(0).cast("bigint"), lambda s, n: s + n)


def bag_net(adds: Column, removes: Column, leave: Column) -> Column:
    """The net difference of an effect: adds - removes - what leaves."""
    return bag_delta(bag_sum(removes, leave), adds)


def character_bag(text: Column, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """Counts of the ASCII letters of `text` without regard to case, by one pass over the bytes of an Arrow batch: no row per
    character and no pass per letter.  A null text has the empty bag."""
    return _letter_counts(alphabet)(text)


@cache
def _letter_counts(alphabet: str):
    letters = alphabet.lower().encode("ascii")
    if len(set(letters)) < len(letters):
        raise ValueError("letters must differ")
    size = len(letters) + 1

    @F.arrow_udf(MapType(StringType(), LongType()))
    def count(texts: pa.Array) -> pa.Array:
        place = np.full(256, size - 1, np.uint8)
        for k, c in enumerate(letters):
            place[[c, ord(chr(c).upper())]] = k
        whole = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = whole.buffers()
        ends = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        table = np.zeros((len(whole), size), np.int64)
        i = 0
        while i < len(whole):  # texts of about a million bytes at once
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + (1 << 20), side="right")) - 1)
            row = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
            table[i:j] = np.bincount(row * size + place[raw[ends[i] : ends[j]]], minlength=(j - i) * size).reshape(j - i, size)
            i = j
        row, column = np.nonzero(table[:, :-1])
        names = np.array([chr(c) for c in letters])
        return pa.MapArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(whole) + 1)), pa.int32()), pa.array(names[column], pa.string()), pa.array(table[row, column]))

    return count


def collect_bag(df: DataFrame, by: list[str], key: str, n: str, name: str = "bag") -> DataFrame:
    """One bag per group from rows (key, count): partial sums per key come before any map is built, so a map
    holds distinct keys only."""
    sums = df.groupBy(*by, key).agg(F.sum(n).cast("bigint").alias("__n")).filter("__n <> 0")
    return sums.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("__n"))))).alias(name))


def bag_rows(df: DataFrame, bag: str, key: str = "key", n: str = "n") -> DataFrame:
    """A row per entry; rows with an empty or null bag give none."""
    rest = [c for c in df.columns if c != bag]
    return df.select(*rest, F.explode(bag).alias(key, n))
