"""Identifiers of rules and patterns resolved in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..chem.catalog import paths
from ..functions.curies import path_segments


def resolve_identifiers(df: DataFrame, column: str) -> DataFrame:
    """`df` with kind: rule, catalog or pattern, null where the identifier's path leads nowhere.  The paths are a constant
    table of a few hundred rows."""
    table = df.sparkSession.createDataFrame(sorted(paths().items()), "__path string, kind string")
    keyed = df.select(*(c for c in df.columns if c != "kind")).withColumn("__path", F.concat_ws("/", path_segments(F.col(column))))
    return keyed.join(F.broadcast(table), "__path", "left").drop("__path")


def formula_mismatches(sites: DataFrame, emissions: DataFrame, smiles: str = "smiles") -> DataFrame:
    """Emissions whose observed change of formula is not the declared one, hydrogens aside; they are reported, never dropped."""
    declared = sites.select(smiles, "ordinal", F.map_filter("delta", lambda k, _: ~k.isin("H", "*")).alias("declared"))
    observed = emissions.select(smiles, "ordinal", "leaf", "pattern", F.map_filter("delta", lambda k, _: ~k.isin("H", "*")).alias("observed"))
    same = lambda a, b: F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))
    return observed.join(declared, [smiles, "ordinal"]).filter(~same(F.col("declared"), F.col("observed")))
