"""Compact identifiers: prefix rewriting and path segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expand_curie(curie: Column, prefixes: dict[str, str]) -> Column:
    """prefix:rest -> IRI; an unknown prefix gives null, text without one stays."""
    table = F.create_map(*(F.lit(x) for kv in prefixes.items() for x in kv))
    prefix = F.regexp_extract(curie, r"^([A-Za-z0-9_.-]+):", 1)
    known = F.concat(F.try_element_at(table, prefix), F.substr(curie, F.length(prefix) + 2))
    return F.when(prefix == "", curie).when(F.contains(curie, F.lit("://")), curie).otherwise(known)


def to_curie(iri: Column, prefixes: dict[str, str]) -> Column:
    """IRI -> prefix:rest for the longest known base, else unchanged."""
    out = iri
    for prefix, base in sorted(prefixes.items(), key=lambda kv: len(kv[1])):
        out = F.when(F.startswith(iri, F.lit(base)), F.concat(F.lit(prefix + ":"), F.substr(iri, F.lit(len(base) + 1)))).otherwise(out)
    return out


def path_segments(curie: Column) -> Column:
    """The segments after the prefix, empty ones dropped."""
    return F.filter(F.split(F.regexp_replace(curie, r"^[A-Za-z0-9_.-]+:/*", ""), "/"), lambda s: s != "")
