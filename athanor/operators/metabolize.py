"""Rules applied to tables of molecules.

Matching and applying are kernels in plain Python, one molecule at a time, inside `mapInPandas`; everything
around them (element filter, user predicates, duplicates, levels, masses) is DataFrame work.  The unit of
parallelism is a molecule, or a query for searches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..chem import search
from ..chem.catalog import as_catalog
from ..chem.molecule import SYMBOLS, ParseError, canonical, formula, parse, stable_key, symmetry_classes
from ..chem.query import parse_query
from ..chem.reactions import Reactant, candidates, emissions
from ..chem.stereo import stereo_smiles
from ..session import cut
from .sites import dedup_emissions

MOLECULE = "csmi string, stable_key string, formula map<string,bigint>, charge int, heavy_atoms int, n_symmetry_classes int, mass double, parse_error string"
SITE = "ordinal int, leaf string, rule_path array<string>, pattern string, site array<int>, orbit array<int>, delta map<string,bigint>, cleaves boolean"
EMISSION = "ordinal int, leaf string, rule_path array<string>, pattern string, site array<int>, orbit array<int>, products array<string>, product_key string, cleaves boolean, delta map<string,bigint>"
OUTCOME = "found int, smiles string, exact boolean, cost int, rules array<string>, patterns array<string>, precedes array<struct<a:int,b:int>>, n_linearizations bigint, discarded array<string>"
COUNTERS = "nodes int, edits int, billed int, gated int, seen int, timed_out boolean"


def _names(ddl: str) -> list[str]:
    """Column names of a DDL list without nested commas."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i].split()[0])
            start = i + 1
    return out


def _rows_udf(df: DataFrame, text: str, ddl: str, make) -> DataFrame:
    """`df` without columns of the new names, and for each row the rows that `make` gives of its text."""
    new = _names(ddl)
    kept = df.select(*(c for c in df.columns if c not in new))
    old = kept.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*row, *made) for row in batch.itertuples(index=False, name=None) for made in make(row[old.index(text)])]
            yield pd.DataFrame(rows, columns=[*old, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), ddl])
    return kept.mapInPandas(run, schema)


def parse_molecules(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """Canonical text, keys, formula and mass; unreadable text gives parse_error and nulls."""

    def one(text: str | None):
        try:
            mol = parse(text or "")
        except (ParseError, RecursionError) as e:
            return [(None, None, None, None, None, None, None, str(e) or "unreadable")]
        f = formula(mol)
        return [(canonical(mol), stable_key(mol), f, sum(a.charge for a in mol.atoms), len(mol.atoms), len(set(symmetry_classes(mol))), search.exact_mass(mol), None)]

    return _rows_udf(df, smiles, MOLECULE, one)


def with_stereo(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """`df` with stereo_smiles, canonical text with the marks of tetrahedral centres and double bonds; null where the text can't
    be read."""

    def one(text: str | None):
        try:
            return [(stereo_smiles(text or ""),)]
        except (ParseError, RecursionError):
            return [(None,)]

    return _rows_udf(df, smiles, "stereo_smiles string", one)


def pattern_table(spark: SparkSession, catalog="PhaseOne") -> DataFrame:
    """The catalog as rows: ordinal, leaf, rule_path (leaf first), pattern, query, kind, site_map, adds, removes, elements."""
    rows = []
    for path, rule in as_catalog(catalog).leaves():
        for p in rule.patterns:
            needs = sorted(SYMBOLS[z] for z in parse_query(p.query).required_elements())
            rows.append((len(rows), rule.name, list(path), p.name, p.query, p.kind, list(p.site), p.adds, p.removes, needs))
    return spark.createDataFrame(rows, "ordinal int, leaf string, rule_path array<string>, pattern string, query string, kind string, site_map array<int>, adds string, removes string, elements array<string>")


def applicable(molecules: DataFrame, patterns: DataFrame) -> DataFrame:
    """(molecule, pattern) pairs whose molecule has every element that the pattern needs: a scan of the molecules
    against the catalog, which is a small constant table."""
    return molecules.crossJoin(F.broadcast(patterns)).filter(F.forall("elements", lambda e: F.map_contains_key("formula", e)))


def find_sites(df: DataFrame, smiles: str = "smiles", catalog="PhaseOne") -> DataFrame:
    """A row per candidate: what could be applied where, with the declared change of formula; no edit runs."""
    rules = as_catalog(catalog)

    def one(text: str | None):
        try:
            r = Reactant(text or "")
        except ParseError:
            return
        for c in candidates(r, rules):
            yield c.ordinal, c.leaf, list(c.path), c.name, list(c.site), list(c.orbit), c.delta(), any(p.cleaves for p in c.patterns)

    return _rows_udf(df, smiles, SITE, one)


def apply_sites(sites: DataFrame, smiles: str = "smiles", catalog="PhaseOne", star: bool = False) -> DataFrame:
    """The emissions of candidate rows (smiles, ordinal) that a filter left; no other candidate is edited."""
    rules = as_catalog(catalog)
    wanted = sites.groupBy(smiles).agg(F.array_sort(F.collect_set("ordinal")).alias("ordinals"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, ordinals in zip(batch[smiles], batch["ordinals"]):
                r = Reactant(text)
                rows += [(text, *_emission(e, r.mol)) for e in emissions(r, rules, star=star, ordinals=set(ordinals))]
            yield pd.DataFrame(rows, columns=[smiles, *_names(EMISSION)])

    return wanted.mapInPandas(run, f"`{smiles}` string, {EMISSION}")


def _emission(e, reactant) -> tuple:
    return e.ordinal, e.leaf, list(e.path), e.pattern, list(e.site), list(e.orbit), e.texts, e.key, e.cleaves, e.delta(reactant)


@lru_cache(maxsize=256)
def _emitted(text: str, catalog: str, star: bool) -> tuple:
    r = Reactant(text)
    return tuple(_emission(e, r.mol) for e in emissions(r, as_catalog(catalog), star=star))


def emit(df: DataFrame, smiles: str = "smiles", catalog="PhaseOne", star: bool = False) -> DataFrame:
    """Every accepted outcome, before duplicates are dropped."""
    rules = as_catalog(catalog)

    def one(text: str | None):
        if isinstance(catalog, str):
            try:
                return _emitted(text or "", catalog, star)
            except ParseError:
                return ()
        try:
            r = Reactant(text or "")
        except ParseError:
            return ()
        return [_emission(e, r.mol) for e in emissions(r, rules, star=star)]

    return _rows_udf(df, smiles, EMISSION, one)


def metabolize(df: DataFrame, smiles: str = "smiles", catalog="PhaseOne", rules: Column | None = None, sites: Column | None = None, star: bool = False, unique: bool = True) -> DataFrame:
    """Products of every molecule in one step.  `rules` and `sites` are predicates on the columns of `find_sites`; they
    are applied between matching and editing, so refused candidates cost no edit."""
    if rules is None and sites is None:
        found = emit(df, smiles, catalog, star)
    else:
        at = find_sites(df.select(smiles).distinct(), smiles, catalog)
        for predicate in (rules, sites):
            at = at if predicate is None else at.filter(predicate)
        found = df.join(apply_sites(at, smiles, catalog, star), smiles)
    return dedup_emissions(found, smiles, "leaf", "pattern", "product_key", "ordinal") if unique else found


def expand_graph(roots: DataFrame, catalog="ProductGraph", max_depth: int = 2, max_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, level; edges: src, dst, leaf, pattern, site, cleaves) of what `roots` (column smiles) reach.

    Each level applies the rules to the frontier and drops what is known by an anti-join.  With `max_nodes`, no
    further level begins once so many nodes are known."""
    frontier = cut(parse_molecules(roots).filter("csmi is not null").select(F.col("csmi").alias("node")).distinct())
    nodes, edges = frontier.withColumn("level", F.lit(0)), None
    for level in range(1, max_depth + 1):
        made = metabolize(frontier.select(F.col("node").alias("smiles")), catalog=catalog)
        step = cut(made.select(F.col("smiles").alias("src"), F.explode("products").alias("dst"), "leaf", "pattern", "site", "cleaves"))
        edges = step if edges is None else edges.unionByName(step)
        frontier = cut(step.select(F.col("dst").alias("node")).distinct().join(nodes.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        nodes = nodes.unionByName(frontier.withColumn("level", F.lit(level)))
        if max_nodes and nodes.count() >= max_nodes:
            break
    return nodes, edges


def _outcomes(found: list[search.Outcome]):
    for k, o in enumerate(found):
        yield k, o.smiles, o.exact, o.cost, [h.rule for h in o.hops], [h.pattern for h in o.hops], [{"a": a, "b": b} for a, b in o.plan.precedes], o.plan.n_linearizations, [x for h in o.hops for x in h.discarded]


def _search(queries: DataFrame, run, given: list[str]) -> tuple[DataFrame, DataFrame]:
    """(outcomes, counters) of one search per row; a search is one task's work, rows are dealt by query_id."""
    ddl = f"query_id string, kind string, {OUTCOME}, {COUNTERS}, error string"
    names = _names(ddl)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                try:
                    found, count = run(r)
                    none = (None,) * 6
                    rows += [(r["query_id"], "outcome", *o, *none, None) for o in _outcomes(found)]
                    rows.append((r["query_id"], "counters", *(None,) * 9, count.nodes, count.edits, count.billed, count.gated, count.seen, count.timed_out, None))
                except ParseError as e:
                    rows.append((r["query_id"], "counters", *(None,) * 9, 0, 0, 0, 0, 0, False, str(e)))
            yield pd.DataFrame(rows, columns=names).astype(object)

    table = cut(queries.select(F.col("query_id").cast("string").alias("query_id"), *given).repartition("query_id").mapInPandas(each, ddl))
    return table.filter("kind = 'outcome'").select("query_id", *_names(OUTCOME)), table.filter("kind = 'counters'").select("query_id", *_names(COUNTERS), "error")


def find_paths(queries: DataFrame, catalog="Default", config: search.Search = search.Search()) -> tuple[DataFrame, DataFrame]:
    """Walks for rows (query_id, reactant, target).  An unreadable molecule is an error in the counters."""
    return _search(queries, lambda r: search.find_path(r["reactant"], r["target"], catalog, config), ["reactant", "target"])


def find_masses(queries: DataFrame, tolerance: float = 0.005, adduct: str = "[M]", catalog="PhaseOne", config: search.Search = search.Search()) -> tuple[DataFrame, DataFrame]:
    """Walks for rows (query_id, reactant, mz)."""
    return _search(queries, lambda r: search.find_mass(r["reactant"], r["mz"], tolerance, adduct, catalog, config), ["reactant", "mz"])


def random_walks(queries: DataFrame, steps: int, catalog="PhaseOne") -> DataFrame:
    """(query_id, step, rule, pattern, product) of seeded walks for rows (query_id, reactant, seed)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(str(r["query_id"]), k, h.rule, h.pattern, h.product) for r in batch.to_dict("records") for k, h in enumerate(search.random_path(r["reactant"], steps, int(r["seed"]), catalog))]
            yield pd.DataFrame(rows, columns=["query_id", "step", "rule", "pattern", "product"])

    return queries.select("query_id", "reactant", "seed").mapInPandas(each, "query_id string, step int, rule string, pattern string, product string")
