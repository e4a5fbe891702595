"""Match sites: one representative per symmetry class, pairs of ends, and folded emissions.

Order always comes from an explicit ordinal; nothing depends on how rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_sites(matches: DataFrame, by: list[str], ordinal: str, member: str) -> DataFrame:
    """Per class (`by`) its first match's member as `site` and the sorted distinct members as `orbit`."""
    return matches.groupBy(*by).agg(F.min_by(member, ordinal).alias("site"), F.array_sort(F.collect_set(member)).alias("orbit"))


def dedup_emissions(rows: DataFrame, mol: str, leaf: str, pattern: str, key: str, ordinal: str) -> DataFrame:
    """The first leaf that makes a product keeps it, and within that leaf each pattern keeps its first; rows
    whose key is null are never merged."""
    group = Window.partitionBy(mol, key)
    first = Window.partitionBy(mol, key, leaf, pattern).orderBy(ordinal)
    known = (
        rows.filter(F.col(key).isNotNull())
        .withColumn("__leaf", F.min_by(leaf, ordinal).over(group))
        .withColumn("__row", F.row_number().over(first))
        .filter((F.col(leaf) == F.col("__leaf")) & (F.col("__row") == 1))
        .drop("__leaf", "__row")
    )
    return known.unionByName(rows.filter(F.col(key).isNull()))


def compose_pairs(ends: DataFrame, by: list[str], anchor: str, site: str, partner: str | None = None, exclusive: str | None = None) -> DataFrame:
    """Pairs of ends of one system (`by`), first anchor below second, on different sites; two ends that both
    are exclusive about the same partner make no pair.  Columns: `by`, i, j, site_i, site_j."""
    one = ends.select(*by, F.col(anchor).alias("i"), F.col(site).alias("site_i"), *([F.col(partner).alias("p_i"), F.col(exclusive).alias("x_i")] if partner else []))
    two = ends.select(*by, F.col(anchor).alias("j"), F.col(site).alias("site_j"), *([F.col(partner).alias("p_j"), F.col(exclusive).alias("x_j")] if partner else []))
    keep = (F.col("i") < F.col("j")) & (F.col("site_i") != F.col("site_j"))
    if partner:
        keep &= ~(F.col("x_i") & F.col("x_j") & F.col("p_i").eqNullSafe(F.col("p_j")))
    return one.join(two, by).filter(keep).select(*by, "i", "j", "site_i", "site_j").distinct()


def fold_key(fragments: Column, signature: Column | None = None) -> Column:
    """Equal for outcomes with the same fragments, however ordered, and the same side."""
    body = F.concat_ws(".", F.array_sort(fragments))
    return F.concat_ws("#", signature, body) if signature is not None else body


def fold_arms(arms: DataFrame, by: list[str], fragments: str, arm: str, signature: str | None = None, listed: bool = False) -> DataFrame:
    """One row per alternative: `by`, fold, first_arm (the least) and fan_in, summed before they are exchanged; with `listed`
    also arms, all of them sorted, for layers whose folds are small."""
    key = fold_key(F.col(fragments), F.col(signature) if signature else None)
    every = [F.array_sort(F.collect_list(arm)).alias("arms")] if listed else []
    return arms.withColumn("fold", key).groupBy(*by, "fold").agg(F.min(arm).alias("first_arm"), F.count(F.lit(1)).alias("fan_in"), *every)


def layer_stats(arms: DataFrame, fragments: str, arm: str, signature: str | None = None) -> DataFrame:
    """One row: alternatives, arms, the largest fan-in and the number of distinct fragments."""
    key = fold_key(F.col(fragments), F.col(signature) if signature else None)
    folds = arms.groupBy(key.alias("fold")).agg(F.count(F.lit(1)).alias("fan_in"))
    sums = folds.agg(F.count(F.lit(1)).alias("n_products"), F.coalesce(F.sum("fan_in"), F.lit(0)).alias("n_arms"), F.coalesce(F.max("fan_in"), F.lit(0)).alias("max_fan_in"))
    distinct = arms.select(F.explode(fragments).alias("f")).agg(F.countDistinct("f").alias("distinct_fragments"))
    return sums.crossJoin(distinct)  # one row each
