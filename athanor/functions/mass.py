"""Monoisotopic masses of bags, ion masses and tolerances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Monoisotopic masses (u) of the most abundant isotopes, and of particles.
ELEMENT_MASS = {
    "H": 1.00782503207, "B": 11.0093054, "C": 12.0, "N": 14.0030740048, "O": 15.99491461956, "F": 18.99840322,
    "Na": 22.9897692809, "Mg": 23.9850417, "Si": 27.9769265325, "P": 30.97376163, "S": 31.972071, "Cl": 34.96885268, "K": 38.96370668,
    "Ca": 39.96259098, "Fe": 55.9349375, "Cu": 62.9295975, "Zn": 63.9291422, "As": 74.9215965, "Se": 79.9165213, "Br": 78.9183371, "I": 126.904473,
}
ISOTOPE_MASS = {"2H": 2.0141017778, "3H": 3.0160492777, "13C": 13.0033548378, "15N": 15.0001088982, "18O": 17.9991610, "34S": 33.96786690, "37Cl": 36.96590259, "81Br": 80.9162906}
PROTON = 1.00727646688
ELECTRON = 0.00054857990946
#: Adduct -> what it adds to a neutral mass, for ions of one charge.
ADDUCTS = {"[M]": 0.0, "[M+H]+": PROTON, "[M-H]-": -PROTON, "[M+Na]+": 22.9897692809 - ELECTRON, "[M+NH4]+": 14.0030740048 + 4 * 1.00782503207 - ELECTRON}
#: Adduct -> (what it adds to a neutral mass, charge number), for ions of several charges.
MULTIPLE = {"[M+2H]2+": (2 * PROTON, 2), "[M+3H]3+": (3 * PROTON, 3), "[M-2H]2-": (-2 * PROTON, 2), "[M+H+Na]2+": (PROTON + 22.9897692809 - ELECTRON, 2)}


def ion(neutral: float, adduct: str) -> float:
    """m/z of an ion, of one charge or of several."""
    added, charges = MULTIPLE[adduct] if adduct in MULTIPLE else (ADDUCTS[adduct], 1)
    return (neutral + added) / charges


_MASSES = ELEMENT_MASS | ISOTOPE_MASS


def bag_mass(bag: Column, masses: dict[str, float] | None = None) -> Column:
    """Sum of count x mass, null where a key has no mass (charge units and unspecified atoms have none)."""
    table = F.create_map(*(F.lit(x) for kv in (masses or _MASSES).items() for x in kv))
    parts = F.transform(F.map_entries(bag), lambda e: F.try_element_at(table, e["key"]) * e["value"])
    return F.when(F.exists(parts, lambda x: x.isNull()), F.lit(None)).otherwise(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def ion_mz(neutral: Column, adduct: str) -> Column:
    added, charges = MULTIPLE[adduct] if adduct in MULTIPLE else (ADDUCTS[adduct], 1)
    return (neutral + F.lit(added)) / F.lit(charges)


def mz_error(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def within(a: Column, b: Column, tolerance: float | Column) -> Column:
    return mz_error(a, b) <= tolerance
