"""Relational analogues of the operators on the star-schema tables, each with equivalent SQL."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chem import examples
from .chem.molecule import canonical_smiles
from .chem.search import Search
from .functions import bags, curies, mass, scores
from .operators import catalogs, graph, joins, metabolize, sites
from .plans import relations
from .plans.algebra import count_linear_extensions
from .session import shared_folder
from .sources import readers

LETTERS = "abcdefghijklmnopqrstuvwxyz"
SKIPPED = ("h",)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


# --- bags -------------------------------------------------------------------------------------------------

_BAG_SQL = "bag AS (SELECT doc_id, lower(l) AS key, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents) GROUP BY ALL)"
_PAIR_SQL = f"""{_BAG_SQL}, ids AS (SELECT a.doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
side AS (SELECT i.doc_id, key, -n AS n FROM ids i JOIN bag USING (doc_id) UNION ALL SELECT i.doc_id, key, n FROM ids i JOIN bag b ON b.doc_id = i.doc_id + 1),
delta AS (SELECT doc_id, key, sum(n)::BIGINT AS delta FROM side GROUP BY ALL)"""


def _letter_bags(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", bags.character_bag(F.col("text"), LETTERS).alias("bag"))


def _neighbours(spark, sf):
    one = _letter_bags(spark, sf).withColumnRenamed("bag", "a")
    two = _letter_bags(spark, sf).select((F.col("doc_id") - 1).alias("doc_id"), F.col("bag").alias("b"))
    return one.join(two, "doc_id")


def bag_formula(spark, sf):
    return bags.bag_rows(_letter_bags(spark, sf), "bag")


def bag_delta(spark, sf):
    return bags.bag_rows(_neighbours(spark, sf).select("doc_id", bags.bag_delta(F.col("a"), F.col("b")).alias("bag")), "bag", n="delta")


def bag_l1(spark, sf):
    return _neighbours(spark, sf).select("doc_id", bags.bag_l1(F.col("a"), F.col("b")).alias("l1"))


def bag_heavy_l1(spark, sf):
    return _neighbours(spark, sf).select("doc_id", bags.bag_l1(F.col("a"), F.col("b"), SKIPPED).alias("l1"))


def bag_apply_delta(spark, sf):
    """The neighbour's bag with the same difference applied once more."""
    delta = bags.bag_delta(F.col("a"), F.col("b"))
    return bags.bag_rows(_neighbours(spark, sf).select("doc_id", bags.bag_apply(F.col("b"), delta).alias("bag")), "bag")


def weighted_mass(spark, sf):
    """Quantity x price per order, null where a part has no price (sizes over 45)."""
    price = _t(spark, sf, "part").filter("p_size <= 45").select(F.col("p_partkey").alias("l_partkey"), _cents("p_retailprice").alias("price"))
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("bigint").alias("q")).join(price, "l_partkey", "left")
    total = F.when(F.count(F.lit(1)) == F.count("price"), F.sum(F.col("q") * F.col("price")))
    return rows.groupBy("l_orderkey").agg(total.cast("bigint").alias("mass"))


def mz_within(spark, sf):
    one = _t(spark, sf, "orders").select("o_orderkey", _cents("o_totalprice").alias("mz"))
    two = _t(spark, sf, "events").select("event_id", (_cents("value") * 100).alias("peak"))
    return joins.band_join(one, two, "mz", "peak", 50).select("o_orderkey", "event_id", (F.col("mz") - F.col("peak")).alias("error"))


# --- sites and emissions ----------------------------------------------------------------------------------


def unique_sites(spark, sf):
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey")
    ordinal = F.struct("l_linenumber", "l_partkey")
    found = sites.unique_sites(rows.withColumn("ord", ordinal), ["l_orderkey", "l_returnflag", "l_linestatus"], "ord", "l_partkey")
    return found.select("l_orderkey", "l_returnflag", "l_linestatus", "site", F.explode("orbit").alias("member"))


def emission_dedup(spark, sf):
    rows = _t(spark, sf, "orders").select(
        F.col("o_custkey").alias("mol"), F.col("o_orderpriority").alias("leaf"), F.col("o_orderstatus").alias("pattern"), F.col("o_orderkey").alias("ord"),
        F.when(F.col("o_orderkey") % 5 != 0, F.floor(F.col("o_totalprice") / 100000).cast("bigint")).alias("key"),
    )
    return sites.dedup_emissions(rows, "mol", "leaf", "pattern", "key", "ord")


def _arms(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_partkey") % 7).cast("string")).alias("fragments")).withColumn("side", (F.col("l_orderkey") % 3).cast("string"))


def fold_or(spark, sf):
    return sites.fold_arms(_arms(spark, sf), ["side"], "fragments", "l_orderkey").select("side", "fold", "fan_in", "first_arm")


def layer_stats(spark, sf):
    return sites.layer_stats(_arms(spark, sf), "fragments", "l_orderkey", "side")


def pair_compose(spark, sf):
    ends = _t(spark, sf, "lineitem").select("l_orderkey", "l_linestatus", "l_linenumber", "l_suppkey", (F.col("l_partkey") % 4).alias("partner"), (F.col("l_returnflag") == "R").alias("exclusive"))
    return sites.compose_pairs(ends, ["l_orderkey", "l_linestatus"], "l_linenumber", "l_suppkey", "partner", "exclusive")


# --- graphs -----------------------------------------------------------------------------------------------


def _supply(spark, sf):
    return _t(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()


def _root(spark, sf):
    """The least part of the table, as the start."""
    return _t(spark, sf, "lineitem").agg(F.concat(F.lit("p"), F.min("l_partkey")).alias("node"))


def bfs_levels(spark, sf):
    return graph.bfs_levels(_supply(spark, sf), _root(spark, sf), 3, both_ways=True)


def bfs_target_gate(spark, sf):
    return graph.bfs_levels(_supply(spark, sf), _root(spark, sf), 3, expands=F.substr("node", F.lit(2)).cast("int") % 3 != 1, both_ways=True)


def _hierarchy(spark, sf):
    c, n = _t(spark, sf, "customer"), _t(spark, sf, "nation")
    edge = lambda df, a, x, b, y, rule: df.select(F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"), F.lit(rule).alias("rule"))
    out = edge(n, "r", "n_regionkey", "n", "n_nationkey", "region").unionByName(edge(c, "n", "c_nationkey", "c", "c_custkey", "nation"))
    return out.unionByName(edge(_t(spark, sf, "orders"), "c", "o_custkey", "o", "o_orderkey", "customer"))


_HIERARCHY_SQL = """edge AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'region' AS rule FROM nation
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'nation' FROM customer
UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'customer' FROM orders)"""


def net_parents(spark, sf):
    return _hierarchy(spark, sf).filter("dst like 'o%'").select(F.col("dst").alias("node"), F.col("src").alias("parent"))


def net_children(spark, sf):
    return _hierarchy(spark, sf).filter("src like 'n%'").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_children"), F.min("dst").alias("first_child"))


def net_counts(spark, sf):
    edges = _hierarchy(spark, sf).withColumn("pattern", F.substr("dst", F.lit(1), F.lit(2)))
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return graph.graph_stats(nodes, edges)


def net_degrees(spark, sf):
    return graph.degrees(_hierarchy(spark, sf))


def net_prune(spark, sf):
    edges = _hierarchy(spark, sf)
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    targets = _t(spark, sf, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    root = spark.range(1).select(F.lit("r0").alias("node"))
    return graph.prune_to_targets(nodes, edges, root.unionByName(targets))


def net_reaches(spark, sf):
    edges = _hierarchy(spark, sf)
    wanted = _t(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return wanted.join(edges.select(F.col("src").alias("node")), "node", "left_semi")


def net_closest(spark, sf):
    v = _t(spark, sf, "embeddings").select("vec_id", "embedding")
    zero = v.filter("vec_id = 0").select(F.col("embedding").alias("target"))
    micro = F.zip_with("embedding", "target", lambda a, b: F.round(F.abs(a.cast("double") - b.cast("double")) * 1e6).cast("bigint"))
    costs = v.join(F.broadcast(zero)).select(F.col("vec_id").alias("node"), F.aggregate(micro, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("cost"))  # the target is one row
    return graph.closest(costs, 10)


def net_step_path(spark, sf):
    edges = _hierarchy(spark, sf).select("src", "dst")
    target = _t(spark, sf, "orders").agg(F.concat(F.lit("o"), F.min("o_orderkey")).alias("node"))
    root = graph.shortest_hops(edges, target, 5).orderBy(F.desc("hops"), "node").limit(1).select("node")
    return graph.step_path(edges, root, target, 5)


def net_simple_paths(spark, sf):
    roots = _t(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    paths = graph.simple_paths(_hierarchy(spark, sf).select("src", "dst"), roots, 3)
    return paths.select(F.concat_ws(">", "path").alias("path"))


def transition_edges(spark, sf):
    walk = _t(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return graph.transition_edges(walk, ["user_id"], ["ts", "event_id"], "event_type").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


# --- plans ------------------------------------------------------------------------------------------------


def _precedes(spark, sf):
    edges = _hierarchy(spark, sf).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    shortcut = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("r"), "n_regionkey").alias("a"), F.concat(F.lit("c"), "c_custkey").alias("b"), "c_mktsegment")
    return edges.unionByName(shortcut.filter("c_mktsegment = 'BUILDING'").select("a", "b"))


def plan_closure(spark, sf):
    return relations.transitive_closure(_precedes(spark, sf))


def plan_reduction(spark, sf):
    return relations.transitive_reduction(_precedes(spark, sf))


def plan_linearizations(spark, sf):
    """Orders of a region before its nations, and of the nations before two customers each."""
    n = _t(spark, sf, "nation").select("n_regionkey", "n_nationkey", (F.col("n_nationkey") % 3).alias("below"))

    @F.pandas_udf("long")
    def count(below: pd.Series) -> pd.Series:
        out = []
        for kids in below:
            edges, at = [], 1
            for k in kids:
                top, at = at, at + 1
                edges.append((0, top))
                for _ in range(k):
                    edges.append((top, at))
                    at += 1
            out.append(count_linear_extensions(at, edges))
        return pd.Series(out)

    return n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("below")).alias("below")).select("n_regionkey", count("below").alias("n"))


def maybe_allows(spark, sf):
    """Orders whose parts meet a span of parts; an order with exactly the span's own part is not allowed."""
    parts = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey") % 50)).alias("parts"))
    span = F.array(*(F.lit(x).cast("bigint") for x in (3, 4, 5)))
    own = (F.size("parts") == 1) & F.array_contains("parts", F.lit(4).cast("bigint"))
    return parts.select("l_orderkey", (F.arrays_overlap("parts", span) & ~own).alias("allowed"))


# --- scores and strings -----------------------------------------------------------------------------------


def residual_class(spark, sf):
    key = scores.class_key(F.col("o_orderstatus"), F.col("o_orderpriority"), F.floor(F.col("o_totalprice") / 50000).cast("bigint"))
    return _t(spark, sf, "orders").groupBy(key.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def score_log_neg_pc(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", scores.log_close(F.floor(F.col("o_totalprice") / 1000).cast("double")).alias("score"))


def field_cost(spark, sf):
    c = scores.field_cost(F.col("l_linenumber"), F.col("l_quantity").cast("bigint") % 5, F.col("l_suppkey") % 3, F.col("l_partkey") % 2)
    return _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min(c).alias("cost"), F.max(F.col("l_quantity").cast("bigint") % 5).alias("n_extra"))


def order_key_topk(spark, sf):
    rows = _t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", _cents("l_extendedprice").alias("price"), "l_orderkey", "l_linenumber")
    return rows.orderBy("l_returnflag", F.desc("l_linestatus"), F.desc("price"), "l_orderkey", "l_linenumber").limit(25)


def diversity_rank(spark, sf):
    before = F.count(F.lit(1)).over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return _t(spark, sf, "events").select("event_id", scores.diversity_penalty(before).alias("penalty"))


PREFIXES = {"ex": "https://", "plain": "http://"}


def sssom_resolve(spark, sf):
    curie = curies.to_curie(F.col("url"), PREFIXES)
    steps = curies.path_segments(curie)
    return _t(spark, sf, "pages").select("page_id", curie.alias("curie"), curies.expand_curie(curie, PREFIXES).alias("iri"), F.size(steps).cast("bigint").alias("n_segments"), F.coalesce(F.try_element_at(steps, F.lit(1)), F.lit("")).alias("root"))


def counters_rollup(spark, sf):
    e = _t(spark, sf, "events")
    return e.groupBy("user_id").agg(*(F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in ("click", "view", "purchase")), F.count(F.lit(1)).alias("billed"))


# --- molecules --------------------------------------------------------------------------------------------


def chem_products(spark, sf):
    """Every outcome of the worked molecules under their rules: as the examples write it, or as it was made where they don't
    have it.  A rule that makes more, or less, gives other rows."""
    rows = [(r, m, [".".join(canonical_smiles(x) for x in p.split(".")) for p in every], list(every)) for r, m, every in examples.EXACT]
    table = spark.createDataFrame(rows, "rule string, smiles string, known array<string>, written array<string>")
    made = metabolize.emit(table, catalog="All").filter("leaf = rule")
    outcome = F.concat_ws(".", F.array_sort("products"))
    sorted_known = F.transform("known", lambda x: F.concat_ws(".", F.array_sort(F.split(x, r"\."))))
    at = F.array_position(sorted_known, outcome).cast("int")
    return made.select("rule", F.col("smiles").alias("reactant"), F.when(at > 0, F.get("written", at - 1)).otherwise(outcome).alias("product")).distinct()


def chem_examples(spark, sf):
    """The worked examples whose product the rule gives, among others."""
    rows = [(k, *r, canonical_smiles(r[2])) for k, r in enumerate(examples.PRODUCTS)]
    table = spark.createDataFrame(rows, "case int, rule string, smiles string, product string, want string")
    made = metabolize.emit(table, catalog=sorted({r[0] for r in examples.PRODUCTS})).filter("leaf = rule")
    return made.filter(F.array_contains("products", F.col("want"))).select("rule", F.col("smiles").alias("reactant"), "product").distinct()


def chem_paths(spark, sf):
    """Which of the worked searches reach their target."""
    cases = [c for suite in (examples.MID, examples.LARGER, examples.HARD) for c in suite]
    found, _ = metabolize.find_paths(spark.createDataFrame(cases, "query_id string, reactant string, target string"), "Default", Search(max_nodes=800))
    return found.filter("exact").select(F.col("query_id").alias("name")).distinct()


def chem_first_products(spark, sf):
    """The products of ethane and of propane under hydroxylation, by number."""
    df = spark.createDataFrame([("CC",), ("CCC",), ("c1ccccc1",)], "smiles string")
    return metabolize.metabolize(df, catalog="Hydroxylation").groupBy("smiles").agg(F.count(F.lit(1)).alias("n_products"), F.max(F.size("orbit")).cast("bigint").alias("largest_orbit"))


def _molecules(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "smiles string")


def _joined(column: str):
    return F.concat_ws(" ", F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], e["value"].cast("string"))))


def table_molecules(spark, sf):
    """Formula, charge, atoms and symmetry of read molecules; what can't be read is an error row."""
    found = metabolize.parse_molecules(_molecules(spark, "CCO", "c1ccccc1", "C[N+](C)(C)C", "bad(", "[13CH4]"))
    return found.select("smiles", _joined("formula").alias("formula"), "charge", "heavy_atoms", "n_symmetry_classes", F.round("mass", 3).alias("mass"), F.col("parse_error").isNotNull().alias("failed"))


def table_bag_mass(spark, sf):
    """Masses of formulas, null where a part has none, and m/z of two ions."""
    known = metabolize.parse_molecules(_molecules(spark, "CCO", "c1ccccc1", "C[N+](C)(C)C", "[13CH4]", "OCC1OC(O)C(O)C(O)C1O"))
    neutral = mass.bag_mass(F.col("formula"))
    return known.select("smiles", F.round(neutral, 3).alias("mass"), F.round(mass.ion_mz(neutral, "[M+H]+"), 3).alias("one"), F.round(mass.ion_mz(neutral, "[M+2H]2+"), 3).alias("two"))


def table_applicable(spark, sf):
    """Patterns of a rule whose elements a molecule has."""
    known = metabolize.parse_molecules(_molecules(spark, "CCO", "CC", "CCN"))
    return metabolize.applicable(known, metabolize.pattern_table(spark, "Sulfation")).select("smiles", "leaf", "pattern")


def table_sites(spark, sf):
    """Candidates before any edit."""
    found = metabolize.find_sites(_molecules(spark, "CCO", "c1ccccc1"), catalog="Hydroxylation")
    return found.select("smiles", "leaf", "pattern", F.concat_ws(",", F.transform("site", lambda x: x.cast("string"))).alias("site"), F.size("orbit").alias("orbit"), _joined("delta").alias("delta"))


def table_filtered(spark, sf):
    """Products at kept sites of kept rules."""
    found = metabolize.metabolize(_molecules(spark, "CCO", "CCC"), catalog="PhaseOne", rules=F.col("leaf") == "Hydroxylation", sites=F.array_contains("site", F.lit(0)))
    return found.select("smiles", "leaf", "pattern", F.size("products").alias("parts"))


def table_graph(spark, sf):
    """Nodes by level of the graph that two steps of a rule make."""
    nodes, _ = metabolize.expand_graph(_molecules(spark, "CC", "c1ccccc1"), "Hydroxylation", 2)
    return nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def table_graph_edges(spark, sf):
    _, edges = metabolize.expand_graph(_molecules(spark, "CC", "c1ccccc1"), "Hydroxylation", 2)
    return edges.groupBy("leaf", "pattern", "cleaves").agg(F.count(F.lit(1)).alias("n"))


def table_masses(spark, sf):
    """Searches to a mass, one of them unreadable."""
    asked = spark.createDataFrame([("ethanol", "CCO", 62.0368), ("benzene", "c1ccccc1", 94.0419), ("none", "CC", 500.0), ("bad", "C(", 1.0)], "query_id string, reactant string, mz double")
    found, counters = metabolize.find_masses(asked, 0.002, config=Search(max_nodes=50))
    exact = found.filter("exact").groupBy("query_id").agg(F.first("rules").alias("rules"))
    return counters.join(exact, "query_id", "left").select("query_id", F.concat_ws(">", "rules").alias("rules"), F.col("error").isNotNull().alias("failed"))


def table_walks(spark, sf):
    """Seeded walks: two of equal seeds are equal."""
    asked = spark.createDataFrame([("a", "CCO", 5), ("b", "CCO", 5), ("c", "c1ccccc1", 9)], "query_id string, reactant string, seed long")
    steps = metabolize.random_walks(asked, 3)
    one, two = (steps.filter(F.col("query_id") == q).select("step", "rule", "product") for q in "ab")
    return steps.groupBy("query_id").agg(F.count(F.lit(1)).alias("steps")).crossJoin(one.join(two, ["step", "rule", "product"]).agg(F.count(F.lit(1)).alias("equal")))  # one row


def table_mismatches(spark, sf):
    """Emissions whose change of formula is not the declared one."""
    df, rules = _molecules(spark, "CCO", "CC(=O)OC", "c1ccccc1", "[O-][N+](=O)c1ccccc1"), ["Hydrolysis", "NitroaromaticReduction"]
    sites_, made = metabolize.find_sites(df, catalog=rules), metabolize.emit(df, catalog=rules)
    return catalogs.formula_mismatches(sites_, made).groupBy("leaf", "pattern").agg(F.count(F.lit(1)).alias("n"))


def table_resolved(spark, sf):
    """Identifiers whose path leads to a rule, a catalog or a pattern."""
    df = spark.createDataFrame([("x:Hydroxylation/h2",), ("x:PhaseOne/StableOxygenation",), ("x:Epoxidation",), ("x:Nothing/there",)], "id string")
    return catalogs.resolve_identifiers(df, "id").select("id", "kind")


def io_smiles(spark, sf):
    """A list of molecules written and read back, a comment and an unreadable line among them."""
    folder = f"{shared_folder(spark)}/io-{uuid.uuid4().hex[:12]}"
    lines = metabolize.parse_molecules(_molecules(spark, "OCC", "c1ccccc1", "C1CC1")).unionByName(spark.createDataFrame([("C(", "C(")], "smiles string, csmi string"), allowMissingColumns=True)
    readers.write_smiles(lines.coalesce(1), f"{folder}/list", name="smiles")
    found = readers.read_smiles(spark, f"{folder}/list")
    return found.select("name", F.col("parse_error").isNull().alias("read"), "heavy_atoms")


def io_mapping(spark, sf):
    """A mapping table with comment lines, written as text and read back."""
    folder = f"{shared_folder(spark)}/io-{uuid.uuid4().hex[:12]}"
    rows = ["#curie_map: x", "subject_id\tpredicate_id\tobject_id\tmapping_justification\tsubject_label\tobject_label\talways_with", "x:1\tp\ty:2\tj\ta\tb\t", "x:3\tq\ty:4\tj\tc\td\tx:1"]
    spark.createDataFrame([("\n".join(rows),)], "value string").coalesce(1).write.text(f"{folder}/map")
    return readers.read_mapping(spark, f"{folder}/map").select("subject_id", "predicate_id", "object_id", "always_with")


def io_sections(spark, sf):
    """Substrates by section."""
    folder = f"{shared_folder(spark)}/io-{uuid.uuid4().hex[:12]}"
    spark.createDataFrame([("[one]\nCC\nCCC\n[two]\nCO",)], "value string").coalesce(1).write.text(f"{folder}/sections")
    return readers.read_sections(spark, f"{folder}/sections").filter("section is not null").select("section", F.col("ord").cast("int").alias("ord"), "smiles")


def io_emissions(spark, sf):
    """Emissions as JSON lines, read back with their nested fields."""
    folder = f"{shared_folder(spark)}/io-{uuid.uuid4().hex[:12]}"
    readers.write_emissions(metabolize.emit(_molecules(spark, "CCO", "C=C"), catalog=["Hydroxylation", "Epoxidation"]), f"{folder}/json")
    found = spark.read.schema(f"smiles string, {metabolize.EMISSION}").json(f"{folder}/json")
    return found.select("smiles", "leaf", "pattern", F.size("products").alias("parts"), _joined("delta").alias("delta"))


QUERIES = {
    f.__name__: f
    for f in (
        bag_formula, bag_delta, bag_l1, bag_heavy_l1, bag_apply_delta, weighted_mass, mz_within, unique_sites, emission_dedup, fold_or, layer_stats, pair_compose, bfs_levels, bfs_target_gate,
        net_parents, net_children, net_counts, net_degrees, net_prune, net_reaches, net_closest, net_step_path, net_simple_paths, transition_edges, plan_closure, plan_reduction, plan_linearizations,
        maybe_allows, residual_class, score_log_neg_pc, field_cost, order_key_topk, diversity_rank, sssom_resolve, counters_rollup,
        chem_products, chem_examples, chem_paths, chem_first_products, table_molecules, table_bag_mass, table_applicable, table_sites, table_filtered, table_graph, table_graph_edges, table_masses, table_walks,
        table_mismatches, table_resolved, io_smiles, io_mapping, io_sections, io_emissions,
    )
}

_SUPPLY_SQL = """e0 AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0)"""
_BFS_SQL = f"""WITH RECURSIVE {_SUPPLY_SQL}, walk(node, level) AS (SELECT 'p' || min(l_partkey), 0 FROM lineitem
UNION SELECT e.b, level + 1 FROM walk JOIN e ON e.a = node WHERE level < 3 {{gate}}) SELECT node, min(level) AS level FROM walk GROUP BY node"""
_PRECEDES_SQL = """p AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders
UNION SELECT 'r' || n_regionkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING')"""
_quoted = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)
_ARMS_SQL = "arm AS (SELECT l_orderkey, (l_orderkey % 3)::VARCHAR AS side, string_agg((l_partkey % 7)::VARCHAR, '.' ORDER BY (l_partkey % 7)::VARCHAR) AS fold FROM lineitem GROUP BY l_orderkey)"

ORACLES = {
    "bag_formula": f"WITH {_BAG_SQL} SELECT doc_id, key, n FROM bag",
    "bag_delta": f"WITH {_PAIR_SQL} SELECT doc_id, key, delta FROM delta WHERE delta <> 0",
    "bag_l1": f"WITH {_PAIR_SQL} SELECT i.doc_id, coalesce(sum(abs(delta)), 0)::BIGINT AS l1 FROM ids i LEFT JOIN delta d USING (doc_id) GROUP BY 1",
    "bag_heavy_l1": f"WITH {_PAIR_SQL} SELECT i.doc_id, coalesce(sum(abs(delta)) FILTER (WHERE key <> 'h'), 0)::BIGINT AS l1 FROM ids i LEFT JOIN delta d USING (doc_id) GROUP BY 1",
    "bag_apply_delta": f"""WITH {_PAIR_SQL}, again AS (SELECT doc_id, key, delta AS n FROM delta UNION ALL SELECT i.doc_id, key, n FROM ids i JOIN bag b ON b.doc_id = i.doc_id + 1)
SELECT doc_id, key, sum(n)::BIGINT AS n FROM again GROUP BY ALL HAVING sum(n) <> 0""",
    "weighted_mass": """SELECT l_orderkey, CASE WHEN count(*) = count(p_partkey) THEN sum(l_quantity::BIGINT * round(p_retailprice * 100)::BIGINT)::BIGINT END AS mass
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 45) ON l_partkey = p_partkey GROUP BY l_orderkey""",
    "mz_within": """SELECT o_orderkey, event_id, mz - peak AS error FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS mz FROM orders)
JOIN (SELECT event_id, round(value * 100)::BIGINT * 100 AS peak FROM events) ON mz BETWEEN peak - 50 AND peak + 50""",
    "unique_sites": """SELECT l_orderkey, l_returnflag, l_linestatus, arg_min(l_partkey, (l_linenumber, l_partkey)) AS site, unnest(list_sort(list(DISTINCT l_partkey))) AS member
FROM lineitem GROUP BY l_orderkey, l_returnflag, l_linestatus""",
    "emission_dedup": """WITH r AS (SELECT o_custkey AS mol, o_orderpriority AS leaf, o_orderstatus AS pattern, o_orderkey AS ord, CASE WHEN o_orderkey % 5 <> 0 THEN floor(o_totalprice / 100000)::BIGINT END AS key FROM orders),
w AS (SELECT *, first_value(leaf) OVER (PARTITION BY mol, key ORDER BY ord) AS won, row_number() OVER (PARTITION BY mol, key, leaf, pattern ORDER BY ord) AS rn FROM r WHERE key IS NOT NULL)
SELECT mol, leaf, pattern, ord, key FROM w WHERE leaf = won AND rn = 1 UNION ALL SELECT * FROM r WHERE key IS NULL""",
    "fold_or": f"WITH {_ARMS_SQL} SELECT side, fold, count(*) AS fan_in, min(l_orderkey) AS first_arm FROM arm GROUP BY side, fold",
    "layer_stats": f"""WITH {_ARMS_SQL}, g AS (SELECT count(*) AS c FROM arm GROUP BY side, fold)
SELECT count(*) AS n_products, sum(c)::BIGINT AS n_arms, max(c) AS max_fan_in, (SELECT count(DISTINCT l_partkey % 7) FROM lineitem) AS distinct_fragments FROM g""",
    "pair_compose": """SELECT DISTINCT a.l_orderkey, a.l_linestatus, a.l_linenumber AS i, b.l_linenumber AS j, a.l_suppkey AS site_i, b.l_suppkey AS site_j
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linestatus = b.l_linestatus AND a.l_linenumber < b.l_linenumber AND a.l_suppkey <> b.l_suppkey
WHERE NOT (a.l_returnflag = 'R' AND b.l_returnflag = 'R' AND a.l_partkey % 4 = b.l_partkey % 4)""",
    "bfs_levels": _BFS_SQL.format(gate=""),
    "bfs_target_gate": _BFS_SQL.format(gate="AND substr(node, 2)::INT % 3 <> 1"),
    "net_parents": f"WITH {_HIERARCHY_SQL} SELECT dst AS node, src AS parent FROM edge WHERE dst LIKE 'o%'",
    "net_children": f"WITH {_HIERARCHY_SQL} SELECT src AS node, count(*) AS n_children, min(dst) AS first_child FROM edge WHERE src LIKE 'n%' GROUP BY 1",
    "net_counts": f"""WITH {_HIERARCHY_SQL} SELECT (SELECT count(*) FROM (SELECT src FROM edge UNION SELECT dst FROM edge)) AS n_nodes, count(*) AS n_edges, count(DISTINCT (rule, substr(dst, 1, 2))) AS n_rule_patterns FROM edge""",
    "net_degrees": f"""WITH {_HIERARCHY_SQL}, s AS (SELECT src AS node, 0 AS i, 1 AS o FROM edge UNION ALL SELECT dst, 1, 0 FROM edge) SELECT node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM s GROUP BY node""",
    "net_prune": f"""WITH RECURSIVE {_HIERARCHY_SQL}, up(node) AS (SELECT 'o' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' UNION SELECT src FROM up JOIN edge ON dst = node) SELECT node FROM up UNION SELECT 'r0'""",
    "net_reaches": "SELECT 'c' || c_custkey AS node FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "net_closest": """WITH z AS (SELECT embedding AS t FROM embeddings WHERE vec_id = 0), p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS a, unnest(t)::DOUBLE AS b FROM embeddings, z)
SELECT vec_id AS node, sum(round(abs(a - b) * 1e6)::BIGINT)::BIGINT AS cost FROM p GROUP BY vec_id ORDER BY cost, node LIMIT 10""",
    "net_step_path": f"""WITH RECURSIVE {_HIERARCHY_SQL}, up(src, dst, d) AS (SELECT src, dst, 0 FROM edge WHERE dst = (SELECT 'o' || min(o_orderkey) FROM orders)
UNION ALL SELECT edge.src, edge.dst, d + 1 FROM up JOIN edge ON edge.dst = up.src) SELECT (SELECT max(d) FROM up)::INT - d::INT AS step, src, dst FROM up""",
    "net_simple_paths": f"""WITH RECURSIVE {_HIERARCHY_SQL}, w(path, node, d) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region
UNION ALL SELECT path || '>' || dst, dst, d + 1 FROM w JOIN edge ON src = node WHERE d < 3) SELECT path FROM w""",
    "transition_edges": "WITH w AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) SELECT src, dst, count(*) AS n FROM w WHERE dst IS NOT NULL GROUP BY src, dst",
    "plan_closure": f"WITH RECURSIVE {_PRECEDES_SQL}, c(a, b) AS (SELECT a, b FROM p UNION SELECT c.a, p.b FROM c JOIN p ON p.a = c.b) SELECT a, b FROM c",
    "plan_reduction": f"WITH {_PRECEDES_SQL} SELECT a, b FROM p EXCEPT (SELECT x.a, y.b FROM p x JOIN p y ON x.b = y.a UNION SELECT x.a, z.b FROM p x JOIN p y ON x.b = y.a JOIN p z ON y.b = z.a)",
    "plan_linearizations": """WITH t AS (SELECT n_regionkey, count(*) AS k, sum(n_nationkey % 3) AS leaves, product(1 + n_nationkey % 3) AS hooks FROM nation GROUP BY n_regionkey)
SELECT n_regionkey, (factorial((1 + k + leaves)::INT) / ((1 + k + leaves) * hooks))::BIGINT AS n FROM t""",
    "maybe_allows": """SELECT l_orderkey, list_has_any(list(DISTINCT l_partkey % 50), [3, 4, 5]) AND NOT (count(DISTINCT l_partkey % 50) = 1 AND bool_and(l_partkey % 50 = 4)) AS allowed FROM lineitem GROUP BY l_orderkey""",
    "residual_class": "SELECT concat_ws('|', coalesce(o_orderstatus, ''), coalesce(o_orderpriority, ''), floor(o_totalprice / 50000)::BIGINT::VARCHAR) AS class, count(*) AS n FROM orders GROUP BY 1",
    "score_log_neg_pc": "SELECT o_orderkey, round(-ln(1 + floor(o_totalprice / 1000)) * 1e6)::BIGINT AS score FROM orders",
    "field_cost": """SELECT l_orderkey, min(3 * l_linenumber + 4 * (l_quantity::BIGINT % 5) + 3 * (l_suppkey % 3) + l_partkey % 2)::BIGINT AS cost, max(l_quantity::BIGINT % 5) AS n_extra FROM lineitem GROUP BY l_orderkey""",
    "order_key_topk": "SELECT l_returnflag, l_linestatus, round(l_extendedprice * 100)::BIGINT AS price, l_orderkey, l_linenumber FROM lineitem ORDER BY l_returnflag, l_linestatus DESC, price DESC, l_orderkey, l_linenumber LIMIT 25",
    "diversity_rank": "SELECT event_id, -1000000 * (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1)::BIGINT AS penalty FROM events",
    "sssom_resolve": """WITH c AS (SELECT page_id, url, CASE WHEN starts_with(url, 'https://') THEN 'ex:' || substr(url, 9) WHEN starts_with(url, 'http://') THEN 'plain:' || substr(url, 8) ELSE url END AS curie FROM pages),
s AS (SELECT *, list_filter(string_split(regexp_replace(curie, '^[A-Za-z0-9_.-]+:/*', ''), '/'), lambda x: x <> '') AS steps FROM c)
SELECT page_id, curie, url AS iri, len(steps)::BIGINT AS n_segments, coalesce(steps[1], '') AS root FROM s""",
    "chem_products": f"SELECT * FROM (VALUES {_quoted([(r, m, p) for r, m, every in examples.EXACT for p in every])}) v(rule, reactant, product)",
    "chem_examples": f"SELECT * FROM (VALUES {_quoted(examples.PRODUCTS)}) v(rule, reactant, product)",
    "chem_paths": f"SELECT * FROM (VALUES {_quoted([c[:1] for s in (examples.MID, examples.LARGER, examples.HARD) for c in s])}) v(name)",
    "table_molecules": """SELECT * REPLACE (mass::DOUBLE AS mass) FROM (VALUES ('CCO', 'C2 H6 O1', 0, 3, 3, 46.042, false), ('c1ccccc1', 'C6 H6', 0, 6, 1, 78.047, false), ('C[N+](C)(C)C', '+1 C4 H12 N1', 1, 5, 2, 74.097, false),
('bad(', '', NULL, NULL, NULL, NULL, true), ('[13CH4]', 'C1 H4', 0, 1, 1, 17.035, false)) v(smiles, formula, charge, heavy_atoms, n_symmetry_classes, mass, failed)""",
    "table_bag_mass": """SELECT smiles, mass::DOUBLE AS mass, one::DOUBLE AS one, two::DOUBLE AS two FROM (VALUES ('CCO', 46.042, 47.049, 24.028), ('c1ccccc1', 78.047, 79.054, 40.031),
('C[N+](C)(C)C', NULL, NULL, NULL), ('[13CH4]', 16.031, 17.039, 9.023), ('OCC1OC(O)C(O)C(O)C1O', 180.063, 181.071, 91.039)) v(smiles, mass, one, two)""",
    "table_applicable": "SELECT * FROM (VALUES ('CCO', 'Sulfation', 'alcohol'), ('CCO', 'Sulfation', 'epoxide_methyl_sulfone')) v(smiles, leaf, pattern)",
    "table_sites": "SELECT * FROM (VALUES ('CCO', 'Hydroxylation', 'h2', '0', 1, 'O1'), ('CCO', 'Hydroxylation', 'h2', '1', 1, 'O1'), ('c1ccccc1', 'Hydroxylation', 'h', '0', 6, 'O1')) v(smiles, leaf, pattern, site, orbit, delta)",
    "table_filtered": "SELECT * FROM (VALUES ('CCO', 'Hydroxylation', 'h2', 1), ('CCC', 'Hydroxylation', 'h2', 1)) v(smiles, leaf, pattern, parts)",
    "table_graph": "SELECT * FROM (VALUES (0, 2), (1, 2), (2, 5)) v(level, n)",
    "table_graph_edges": "SELECT * FROM (VALUES ('Hydroxylation', 'h', false, 4), ('Hydroxylation', 'h2', false, 3)) v(leaf, pattern, cleaves, n)",
    "table_masses": "SELECT * FROM (VALUES ('ethanol', 'Hydroxylation', false), ('benzene', 'Hydroxylation', false), ('none', '', false), ('bad', '', true)) v(query_id, rules, failed)",
    "table_walks": "SELECT * FROM (VALUES ('a', 3, 3), ('b', 3, 3), ('c', 3, 3)) v(query_id, steps, equal)",
    "table_mismatches": "SELECT 'NitroaromaticReduction' AS leaf, 'nitro_neutral' AS pattern, 1::BIGINT AS n",
    "table_resolved": "SELECT * FROM (VALUES ('x:Hydroxylation/h2', 'pattern'), ('x:PhaseOne/StableOxygenation', 'catalog'), ('x:Epoxidation', 'rule'), ('x:Nothing/there', NULL)) v(id, kind)",
    "io_smiles": "SELECT * FROM (VALUES ('OCC', true, 3), ('c1ccccc1', true, 6), ('C1CC1', true, 3), ('C(', false, NULL)) v(name, read, heavy_atoms)",
    "io_mapping": "SELECT * FROM (VALUES ('x:1', 'p', 'y:2', NULL), ('x:3', 'q', 'y:4', 'x:1')) v(subject_id, predicate_id, object_id, always_with)",
    "io_sections": "SELECT * FROM (VALUES ('one', 0, 'CC'), ('one', 1, 'CCC'), ('two', 0, 'CO')) v(section, ord, smiles)",
    "io_emissions": "SELECT * FROM (VALUES ('CCO', 'Hydroxylation', 'h2', 1, 'O1'), ('CCO', 'Hydroxylation', 'h2', 1, 'O1'), ('C=C', 'Hydroxylation', 'h2', 1, 'O1'), ('C=C', 'Epoxidation', 'epoxide', 1, 'O1')) v(smiles, leaf, pattern, parts, delta)",
    "chem_first_products": "SELECT * FROM (VALUES ('CC', 1, 2), ('CCC', 2, 2), ('c1ccccc1', 1, 6)) v(smiles, n_products, largest_orbit)",
    "counters_rollup": """SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'view') AS n_view,
count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase, count(*) AS billed FROM events GROUP BY user_id""",
}
