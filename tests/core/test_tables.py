"""DataFrame operators and queries: against SQL, brute force and worked examples."""

import itertools
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from athanor import queries
from athanor.chem.molecule import canonical_smiles
from athanor.functions import bags, curies, mass
from athanor.operators import graph, joins, metabolize
from athanor.plans import algebra
from athanor.sources.readers import read_mapping, read_sections, read_smiles

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in want.columns)) for r in got.collect())


def test_masses_and_bags(spark):
    row = spark.sql("select map('C', 2L, 'H', 6L, 'O', 1L) as a, map('C', 2L, '+', 1L) as b")
    got = row.select(mass.bag_mass(F.col("a")).alias("m"), mass.bag_mass(F.col("b")).alias("n"), bags.bag_l1(F.col("a"), F.col("b")).alias("l"), bags.bag_heavy_l1(F.col("a"), F.col("b")).alias("h")).first()
    assert abs(got.m - 46.0418648) < 1e-6 and got.n is None and (got.l, got.h) == (8, 1)


def test_band_join_equals_nested_loop(spark):
    left = spark.range(300).select((F.col("id") * 0.37).alias("x"), F.col("id").alias("a"))
    right = spark.range(300).select((F.col("id") * 0.41 - 5).alias("y"), F.col("id").alias("b"))
    got = {(r.a, r.b) for r in joins.band_join(left, right, "x", "y", 0.25).collect()}
    want = {(a, b) for a in range(300) for b in range(300) if abs(a * 0.37 - (b * 0.41 - 5)) <= 0.25}
    assert got == want


def test_linear_extensions_against_permutations():
    for n, edges in ((4, []), (4, [(0, 1), (1, 2), (0, 2)]), (5, [(0, 2), (1, 2), (2, 3)]), (3, [(0, 1), (1, 0)])):
        want = [p for p in itertools.permutations(range(n)) if all(p.index(a) < p.index(b) for a, b in edges)]
        assert algebra.count_linear_extensions(n, edges) == len(want)
        assert [tuple(x) for x in algebra.linear_extensions(n, edges)] == sorted(want)
    assert algebra.count_linear_extensions(8, []) == math.factorial(8)
    assert algebra.reduced_edges(3, [(0, 1), (1, 2), (0, 2)]) == [(0, 1), (1, 2)]


def test_plans():
    plan = algebra.Plan.bind([("A", ["a1"], ["n1"]), ("B", ["a2"], []), ("C", ["n1"], [])])
    assert plan.precedes == ((0, 2),) and plan.n_linearizations == 3
    assert plan.same_linearizations(plan) and plan.same_skeleton(plan) and plan.dominates(plan)
    loose = algebra.Plan(plan.steps)
    assert loose.linearization_overlap(plan) == 3 and not loose.same_linearizations(plan)
    maybe = algebra.Maybe((algebra.Side((1, 2), (3, 4)),))
    assert maybe.allows([3]) and not maybe.allows([1, 2]) and not maybe.allows([9])


def test_metabolize_table(spark):
    df = spark.createDataFrame([("a", "CC"), ("b", "not a molecule"), ("c", "c1ccccc1"), ("d", None)], "name string, smiles string")
    rows = metabolize.metabolize(df, catalog="Hydroxylation").collect()
    assert {(r.name, tuple(r.products)) for r in rows} == {("a", (canonical_smiles("CCO"),)), ("c", (canonical_smiles("Oc1ccccc1"),))}
    filtered = metabolize.metabolize(df, catalog="PhaseOne", rules=F.col("leaf") == "Epoxidation", sites=F.size("site") == 2).collect()
    assert filtered and {r.leaf for r in filtered} == {"Epoxidation"}
    parsed = {r.name: r for r in metabolize.parse_molecules(df).collect()}
    assert parsed["b"].parse_error and parsed["c"].formula == {"C": 6, "H": 6} and parsed["c"].n_symmetry_classes == 1
    table = metabolize.applicable(metabolize.parse_molecules(df).filter("formula is not null"), metabolize.pattern_table(spark, "SulfurReduction"))
    assert table.count() == 0


def test_product_graph_table(spark):
    nodes, edges = metabolize.expand_graph(spark.createDataFrame([("CC",)], "smiles string"), ["Hydroxylation"], 2)
    levels = {r.node: r.level for r in nodes.collect()}
    assert levels == {canonical_smiles("CC"): 0, canonical_smiles("CCO"): 1, canonical_smiles("OCCO"): 2, canonical_smiles("CC(O)O"): 2}
    assert edges.count() == 3
    hops = {r.node: r.hops for r in graph.shortest_hops(edges, spark.createDataFrame([(canonical_smiles("OCCO"),)], "node string"), 5).collect()}
    assert hops[canonical_smiles("CC")] == 2


def test_search_tables(spark):
    q = spark.createDataFrame([("1", "Oc1ccc(O)cc1", "O=C1C=CC(=O)C=C1"), ("2", "CC", "nonsense(")], "query_id string, reactant string, target string")
    outcomes, counters = metabolize.find_paths(q, "PhaseOne")
    assert [(r.query_id, r.exact, r.rules) for r in outcomes.collect()] == [("1", True, ["QuinoneFormation"])] or outcomes.count() == 1
    errors = {r.query_id: r.error for r in counters.collect()}
    assert errors["1"] is None and errors["2"]
    mz, _ = metabolize.find_masses(spark.createDataFrame([("1", "CC", 46.0418648)], "query_id string, reactant string, mz double"))
    assert mz.first().smiles == canonical_smiles("CCO")
    walks = metabolize.random_walks(spark.createDataFrame([("1", "CCO", 5)], "query_id string, reactant string, seed long"), 2)
    assert walks.count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "mols.txt").write_text("# list\nCCO ethanol\nbad( x\n")
    rows = {r.smiles: r for r in read_smiles(spark, str(tmp_path / "mols.txt")).collect()}
    assert rows["CCO"].csmi == canonical_smiles("OCC") and rows["bad("].parse_error
    (tmp_path / "sections.txt").write_text("[one]\nCC\nCCC\n[two]\nCO\n")
    assert [(r.section, r.ord, r.smiles) for r in read_sections(spark, str(tmp_path / "sections.txt")).orderBy("section", "ord").collect()] == [("one", 0, "CC"), ("one", 1, "CCC"), ("two", 0, "CO")]
    (tmp_path / "map.tsv").write_text("#note\nsubject_id\tpredicate_id\tobject_id\tmapping_justification\tsubject_label\tobject_label\talways_with\nx:1\tp\ty:2\tj\ta\tb\t\n")
    assert read_mapping(spark, str(tmp_path / "map.tsv")).first().object_id == "y:2"


def test_curies(spark):
    df = spark.createDataFrame([("ex:a/b",), ("https://x.org/a/b",), ("other:c",)], "c string")
    p = {"ex": "https://x.org/"}
    got = df.select(curies.expand_curie(F.col("c"), p).alias("e"), curies.to_curie(F.col("c"), p).alias("t"), curies.path_segments(F.col("c")).alias("s")).collect()
    assert [(r.e, r.t) for r in got] == [("https://x.org/a/b", "ex:a/b"), ("https://x.org/a/b", "ex:a/b"), (None, "other:c")]
    assert got[0].s == ["a", "b"]


def test_stream(spark, tmp_path):
    from athanor.streaming.incremental import expand_stream

    spark.createDataFrame([("CC",), ("CCC",)], "smiles string").write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("smiles string").parquet(str(tmp_path / "in"))
    expand_stream(arriving, str(tmp_path / "out"), str(tmp_path / "check"), "Hydroxylation", once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_identifiers_and_formula_check(spark):
    from athanor.operators.catalogs import formula_mismatches, resolve_identifiers

    df = spark.createDataFrame([("x:PhaseOne/StableOxygenation/Hydroxylation/h",), ("x:Tautomerization",), ("x:PhaseOne/Dehydrogenation/Dehydrogenation",), ("x:Nothing/here",)], "c string")
    assert [r.kind for r in resolve_identifiers(df, "c").orderBy("c").collect()] == [None, "rule", "pattern", "rule"]
    mols = spark.createDataFrame([("CCO",), ("c1ccccc1",)], "smiles string")
    rules = ["Hydroxylation", "Epoxidation"]
    assert formula_mismatches(metabolize.find_sites(mols, catalog=rules), metabolize.emit(mols, catalog=rules)).count() == 0


def test_command_line(capsys):
    from athanor.__main__ import main

    assert main(["find", "Oc1ccc(O)cc1", "O=C1C=CC(=O)C=C1"]) == 0
    assert capsys.readouterr().out.startswith("exact")
    assert main(["products", "CC", "--rules", "Hydroxylation"]) == 0
    assert main(["find", "CC", "c1ccccc1", "--rules", "Hydroxylation", "--max-nodes", "3"]) == 1


def test_graph_upserts(spark):
    nodes = spark.createDataFrame([(0, "a")], "idx long, node string")
    more = graph.upsert_nodes(nodes, spark.createDataFrame([("c",), ("a",), ("b",), (None,), ("b",)], "node string"))
    assert sorted((r.idx, r.node) for r in more.collect()) == [(0, "a"), (1, "b"), (2, "c")]
    flagged = graph.mark(more, spark.createDataFrame([("b",)], "node string"), "target")
    assert {r.node: r.target for r in flagged.collect()} == {"a": False, "b": True, "c": False}
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "src string, dst string")
    assert sorted(tuple(r) for r in graph.neighbours(edges, nodes).collect()) == [("a", "b"), ("a", "b")]
    assert graph.neighbours(edges, nodes, children=False).count() == 0
