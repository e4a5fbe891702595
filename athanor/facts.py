"""Queries that hold an operator against known answers: a table of cases goes through the operator, a row at a time on the
executors, and the SQL is the list of answers, which come from graph theory, chemistry and the rules' definitions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .chem import catalog, difference, guidance, search, structure
from .chem.edits import accepts_loss_of_oxygen, has_ketene, reject_reason
from .chem.molecule import aromatic_bonds, canonical, canonical_smiles, count_kekule, formula, kekule_forms, labelled, parse, stable_key, symmetry_classes
from .chem.network import Network
from .chem.query import View, parse_query
from .chem.reactions import Reactant, apply_n, candidates, metabolize, unique_sites
from .chem.stereo import product_texts_with_stereo, stereo_smiles
from .functions.mass import ADDUCTS, ion
from .plans.algebra import ApplyN, Maybe, Plan, Side, and_or_tree
from .sources import export

Cases = tuple[tuple[str, str], ...]


def _sizes(parts) -> str:
    return ",".join(str(n) for n in sorted(len(p) for p in parts))


def _split(case: str) -> list[str]:
    return case.split(" | ")


def _same(case: str) -> str:
    a, b = _split(case)
    return str(canonical_smiles(a) == canonical_smiles(b)).lower()


def _key(case: str) -> str:
    mol = parse(case)
    return str(stable_key(mol) == canonical(mol)).lower()


def _matches(case: str) -> str:
    query, text = _split(case)
    view = View(parse(text))
    return str(len({tuple(sorted(m.items())) for m in parse_query(query).matches(view)}))


def _sites(case: str) -> str:
    rule, pattern, text = _split(case)
    found = list(unique_sites(Reactant(text), catalog.rules()[rule][pattern]))
    return ",".join(str(len(orbit)) for *_, orbit in sorted(found, key=lambda x: x[2]))


def _orbit(case: str) -> str:
    text, atom = _split(case)
    return ",".join(map(str, structure.atom_orbit(parse(text), int(atom))))


def _subsets(case: str) -> str:
    text, k = _split(case)
    mol = parse(text)
    return _sizes(structure.set_orbits(mol, range(len(mol.atoms)), int(k)))


def _one_site(case: str) -> str:
    text, site = _split(case)
    mol, atoms = parse(text), [int(x) for x in site.split(",")]
    return ",".join(map(str, structure.canonical_site(mol, atoms)))


def _same_signature(case: str) -> str:
    one, a, two, b = _split(case)
    sign = lambda t, s: structure.site_signature(parse(t), [int(x) for x in s.split(",")])
    return str(sign(one, a) == sign(two, b)).lower()


def _pi(case: str) -> str:
    return _sizes(structure.pi_components(structure.pi_graph(parse(case))))


def _core(case: str) -> str:
    return str(len(structure.two_core(structure.pi_graph(parse(case)))))


def _formula(case: str) -> str:
    f = formula(parse(case))
    return " ".join(f"{k}{f[k]}" for k in sorted(f))


def _mass(case: str) -> str:
    text, adduct = _split(case)
    return f"{ion(search.exact_mass(parse(text)), adduct):.3f}"


def _gate(case: str) -> str:
    return reject_reason(parse(case)) or "accepted"


def _leaves(case: str) -> str:
    return ",".join(r.name for _, r in catalog.as_catalog(case).leaves())


def _members(case: str) -> str:
    what = catalog.resolve(case)
    return f"{len(what)} {isinstance(what, catalog.Catalog)}".lower()


def _resolved(case: str) -> str:
    root, *path = case.split("/")
    found = catalog.resolve(root)
    found = found.resolve(path) if isinstance(found, catalog.Catalog) else found[path[0]] if path else found
    return "none" if found is None else f"{type(found).__name__} {found.name}"


def _colour(case: str) -> str:
    return ";".join(sorted({"+".join(catalog.colour_labels(p)) or "none" for p, r in catalog.as_catalog("PhaseOne").leaves() if r.name == case}))


def _arms(case: str) -> str:
    text, atom = _split(case)
    arms = [guidance.When(((1, frozenset({"N"})),), (("N", 1),)), guidance.When(((1, frozenset({"O", "S"})),), (("O", 1),))]
    arm = guidance.resolve_arm(arms, parse(text), {1: int(atom)})
    return "none" if arm is None else arm.delta[0][0]


def _user_rule(case: str) -> str:
    rule = catalog.rule_from_rows("Own", [{"name": "chlorinate", "query": "[#6H3:1]", "edit": "add 1 Cl", "adds": "Cl", "removes": None}])
    return ".".join(sorted(canonical_smiles(t) for e in metabolize(case, rule) for t in e.texts))


def _star(case: str) -> str:
    rule, text = _split(case)
    return ";".join(sorted({labelled(m) for e in metabolize(text, rule, star=True) for m in e.products}))


def _o_dealkylation(case: str) -> str:
    return ".".join(sorted(t for e in metabolize(case, catalog.o_dealkylation()) for t in e.texts))


def _kept_rules(case: str) -> str:
    text, rule = _split(case)
    return ",".join(sorted({e.leaf for e in metabolize(text, "PhaseOne", rules=lambda r, leaf, p: leaf.name == rule)}))


def _kept_sites(case: str) -> str:
    text, rule, atom = _split(case)
    return str(len(list(metabolize(text, rule, sites=lambda r, site, p: int(atom) in site))))


def _trace(case: str) -> str:
    text, rule, pattern = _split(case)
    r = Reactant(text)
    e = next(e for e in metabolize(r, rule) if e.pattern == pattern)
    return "{} {}".format(*e.trace(r.mol))


def _delta(case: str) -> str:
    text, rule, pattern = _split(case)
    r = Reactant(text)
    e = next(e for e in metabolize(r, rule) if e.pattern == pattern)
    declared = next(c.delta() for c in candidates(r, catalog.as_catalog(rule)) if c.name == pattern)
    seen = e.delta(r.mol)
    return f"{seen == declared} ".lower() + " ".join(f"{k}{n:+d}" for k, n in sorted(seen.items()))


def _counted(case: str) -> str:
    text, rule, n = _split(case)
    return str(len(apply_n(text, rule, int(n))))


def _enumerated(case: str) -> str:
    text, rule, depth, first = _split(case)
    return str(len(search.enumerate_products(text, rule, int(depth), depth_first=first == "deep")))


def _path(case: str) -> str:
    reactant, target, rules = _split(case)
    found, _ = search.find_path(reactant, target, rules.split(",") if "," in rules else rules, search.Search(max_nodes=300))
    return ">".join(h.rule for h in found[0].hops) if found else "none"


def _searched(case: str) -> str:
    """A path under an option, or none."""
    reactant, target, option = _split(case)
    more = {
        "score": lambda: {"score": guidance.Score.from_label("close-both")}, "log": lambda: {"score": guidance.Score()}, "diversity": lambda: {"diversity": 2}, "tautomers": lambda: {"tautomers": True},
        "fragments": lambda: {"fragments": 2}, "plain": dict, "single": lambda: {"options": guidance.WalkOptions(single=True)}, "monotone": lambda: {"monotone": True},
    }[option]()
    found, _ = search.find_path(reactant, target, "Default", search.Search(max_nodes=300, **more))
    return str(bool(found)).lower()


def _pooled(case: str) -> str:
    """A mass search that may apply two hydroxylations, or one, and nothing else."""
    text, mz, n = _split(case)
    found, _ = search.find_mass(text, float(mz), 0.002, "[M]", "PhaseOne", search.Search(max_nodes=100, pools=(ApplyN(("Hydroxylation",), int(n)),)))
    return "+".join(h.rule for h in found[0].hops) if found else "none"


def _identified(case: str) -> str:
    rule, _, pattern = case.partition("/")
    try:
        return catalog.identifier(rule, pattern)
    except KeyError:
        return "none"


def _carbonyl(case: str) -> str:
    a, b, atom = _split(case)
    one, two = parse(a), parse(b)
    return str(guidance.needs_carbonyl(one, two, difference.common_substructure(one, two), int(atom))).lower()


def _toward(case: str) -> str:
    text, target, depth = _split(case)
    wide, near = (len(search.product_graph(text, "PhaseOne", 500, int(depth), t)[0]) for t in (None, target))
    return str(near < wide).lower()


def _ketene(case: str) -> str:
    before, *parts = _split(case)
    return f"{any(has_ketene(parse(p)) for p in parts)} {accepts_loss_of_oxygen(parse(before), list(map(parse, parts)))}".lower()


def _asked(case: str) -> str:
    r = Reactant(case)
    return f"{r.key == r.text} {r.formula == formula(parse(case))} {r.text is r.text}".lower()


def _stereo(case: str) -> str:
    a, b = _split(case)
    return str(stereo_smiles(a) == stereo_smiles(b)).lower()


def _kept_stereo(case: str) -> str:
    """How many products of a step have marks, of how many."""
    text, rule = _split(case)
    made = product_texts_with_stereo(text, rule)
    return f"{sum('@' in t or '/' in t for _, t in made)} {len(made)}"


def _exported(case: str) -> str:
    found, count = search.find_path("CC", "CCO", "PhaseOne")
    raw = json.loads(export.to_json(found, count))
    first = raw["outcomes"][0]
    return str({
        "outcome": lambda: first["exact"] and [h["rule"] for h in first["hops"]] == ["Hydroxylation"] and first["orders"] == 1, "plan": lambda: Plan.from_json(json.dumps(first["plan"])) == found[0].plan,
        "counters": lambda: raw["counters"]["billed"] == count.nodes + count.edits, "molecule": lambda: export.molecule_dict(parse("CCO")) == {"smiles": canonical_smiles("CCO"), "key": canonical_smiles("CCO"), "formula": {"C": 2, "H": 6, "O": 1}, "heavy_atoms": 3},
        "emission": lambda: [export.emission_dict(e)["pattern"] for e in metabolize("C=C", "Epoxidation")] == ["epoxide"], "html": lambda: export.outcomes_html(found).count("<tr>") == 2 and "&gt;" not in export.outcomes_html(found),
    }[case]()).lower()


def _shuffled(case: str) -> str:
    one, two = (search.enumerate_products(case, "PhaseOne", 1, shuffle=s) for s in (3, 11))
    plain = search.enumerate_products(case, "PhaseOne", 1)
    return f"{sorted(one) == sorted(two) == sorted(plain)} {one != two} {len(search.enumerate_products(case, 'PhaseOne', 1, limit=2))}".lower()


def _replayed(case: str) -> str:
    reactant, target = _split(case)
    hops = search.find_path(reactant, target, "Default", search.Search(max_nodes=300))[0][0].hops
    return str(search.replay(reactant, hops, "Default") == canonical_smiles(target)).lower()


def _walked(case: str) -> str:
    text, seed = _split(case)
    hops = search.random_path(text, 3, int(seed))
    again = search.random_path(text, 3, int(seed))
    return f"{len(hops)} {hops == again}".lower()


def _weighed(case: str) -> str:
    text, mz = _split(case)
    found, _ = search.find_mass(text, float(mz), 0.002, "[M+H]+", "PhaseOne", search.Search(max_nodes=100))
    return f"{search.exact_mass(parse(found[0].smiles)) + ADDUCTS['[M+H]+']:.3f}" if found else "none"


def _partial(case: str) -> str:
    reactant, target = _split(case)
    found, _ = search.find_path(reactant, target, "Hydroxylation", search.Search(max_nodes=30, partial=True, max_paths=1))
    return f"{found[0].exact} {len(found)}".lower()


def _difference(case: str) -> str:
    a, b = _split(case)
    d = difference.atom_difference(parse(a), parse(b))
    return f"{d.cost} {'+'.join(d.residual()) or 'none'}"


def _mapped(case: str) -> str:
    a, b = _split(case)
    return str(len(difference.common_substructure(parse(a), parse(b))))


def _needs(case: str) -> str:
    a, b = _split(case)
    d = difference.atom_difference(parse(a), parse(b))
    gains, losses = (sum(abs(n) for n in d.hydrogens.values() if n * sign > 0) for sign in (1, -1))
    return f"oxygen {len(d.needs_oxygen)} gain {gains} loss {losses}"


def _helpful(case: str) -> str:
    a, b, rule = _split(case)
    r = Reactant(a)
    d = difference.atom_difference(r.mol, parse(b))
    keep = guidance.keep_against(d)
    return ",".join(sorted({"-".join(map(str, c.site)) for c in candidates(r, catalog.as_catalog(rule)) if keep(c)})) or "none"


def _progress(case: str) -> str:
    a, b, h, atom = _split(case)
    return str(guidance.site_progress({"H": int(h)}, [int(atom)], difference.atom_difference(parse(a), parse(b))))


def _first_key(case: str) -> str:
    a, b = _split(case)
    r = Reactant(a)
    d = difference.atom_difference(r.mol, parse(b))
    return min(candidates(r, catalog.as_catalog("PhaseOne")), key=lambda c: guidance.order_key(c, d)).leaf


def _undone(case: str) -> str:
    walk = guidance.OxygenWalk()
    for change, site in (x.split("@") for x in case.split()[:-1]):
        walk = walk.after(int(change), map(int, site.split(",")))
    change, site = case.split()[-1].split("@")
    return str(walk.undone_by(int(change), map(int, site.split(",")))).lower()


def _ends(case: str) -> str:
    product, target, ends = _split(case)
    return str(guidance.ends_match(parse(product), [int(x) for x in ends.split(",")], parse(target))).lower()


def _merged(case: str) -> str:
    a, *targets = _split(case)
    m = guidance.merge_differences([difference.atom_difference(parse(a), parse(b)) for b in targets])
    return f"{len(m.active)} {m.extra} {m.cost}"


def _site_cost(case: str) -> str:
    a, b, atom = _split(case)
    one, two = parse(a), parse(b)
    return f"{guidance.site_cost(one, two, difference.common_substructure(one, two), [int(atom)]):.3f}"


def _shell(case: str) -> str:
    a, b, atom = _split(case)
    bags = [guidance.site_bag(parse(t), [int(atom)]) for t in (a, b)]
    try:
        guidance.check_site("site", *bags, strict=True)
    except guidance.SiteMismatch:
        return "mismatch"
    return "equal"


def _ring_break(case: str) -> str:
    text, a, b = _split(case)
    return str(guidance.breaks_ring(parse(text), int(a), int(b))).lower()


def _allowed(case: str) -> str:
    text, seen, which = _split(case)
    return str(guidance.WalkOptions(single="single" in which, fresh="fresh" in which).allows(text, seen.split(","))).lower()


def _predicted(case: str) -> str:
    text, delta = _split(case)
    got = guidance.predicted_mass(search.exact_mass(parse(text)), json.loads(delta))
    return "none" if got is None else f"{got:.3f}"


def _parent(case: str) -> str:
    text, query, atoms = _split(case)
    r = Reactant(text)
    a, b = map(int, atoms.split(","))
    form = guidance.reactant_parent(r.forms, query, {1: a, 2: b})
    return "none" if form is None else str(form.mol.order(a, b))


def _settled(case: str) -> str:
    text, a, b, order = _split(case)
    mol = parse(text)
    before = {i: mol.bond_sum(i) for i in (int(a), int(b))}
    mol.set_bond(int(a), int(b), int(order))
    return canonical(guidance.settle_charges(mol, before))


def _score_label(case: str) -> str:
    try:
        s = guidance.Score.from_label(case)
    except ValueError:
        return "none"
    return f"{s.combine} {s.metric} {s.label == case}".lower()


def _network(case: str) -> str:
    """A small network: a chain of three hops with a shortcut, a side branch and a target that isn't reached."""
    n = Network()
    n.ensure_root("C")
    for a, b, rule in (("C", "CC", "a"), ("CC", "CCC", "b"), ("CCC", "CCCC", "c"), ("C", "CCC", "d"), ("CC", "CO", "e"), ("C", "CC", "a")):
        n.record_hop(a, b, rule, "p")
    n.mark("CCCC", target=True, cost=0)
    n.mark("CCC", cost=3, expanded=True)
    n.mark("CN", target=True)
    n.mark("CO", sealed=True, cost=5)
    again = Network.from_json(n.to_json())
    plan = n.step_plan("C", "CCCC")
    return str({
        "nodes": lambda: len(n.nodes), "edges": lambda: len(n.edges), "rule_patterns": lambda: n.n_rule_patterns, "children": lambda: ",".join(n.children("C")), "parents": lambda: ",".join(n.parents("CCC")),
        "reaches": lambda: f"{n.reaches('CC', 'CCCC')} {n.reaches('CO', 'CCCC')}".lower(), "cost_to": lambda: n.cost_to("C", "CCCC"), "closest": lambda: n.closest(2), "missed": lambda: ",".join(n.missed()),
        "simple_paths_0": lambda: len(list(n.simple_paths("C", "CCCC"))), "simple_paths_1": lambda: len(list(n.simple_paths("C", "CCCC", 1))), "plan": lambda: ">".join(s.rule for s in plan.steps),
        "expandable_first": lambda: ",".join(n.expandable_first()), "prune": lambda: ",".join(n.prune_to_targets()), "sealed": lambda: str(n.is_sealed("OC")).lower(), "json": lambda: str(again.to_json() == n.to_json()).lower(),
    }[case]())


def _shared(case: str) -> str:
    """A search that records its hops, and a second one in the same network."""
    n = Network()
    search.find_path("CC", "CCO", "PhaseOne", search.Search(), network=n)
    first = len(n.edges)
    search.find_path("CC", "CC=O", "PhaseOne", search.Search(max_nodes=40), network=n)
    return str({"reaches": n.reaches("CC", "CCO"), "grows": len(n.edges) > first, "targets": sum(x.target for x in n.nodes) == 2, "expanded": n.nodes[0].expanded}[case]).lower()


def _sealed(case: str) -> str:
    limit = int(case)
    _, count = search.find_path("c1ccccc1", "CCCCCCCCN", "PhaseOne", search.Search(max_nodes=60, seal_after=limit))
    return str(count.sealed > 0).lower()


def _folds(case: str) -> str:
    text, rule = _split(case)
    folds = difference.cleavage_layer(text, rule)
    s = difference.layer_stats(folds)
    return f"{s['n_products']} {s['n_arms']} {s['max_fan_in']} {s['distinct_fragments']}"


def _chosen(case: str) -> str:
    text, rule, kept = _split(case)
    kept = canonical_smiles(kept)
    fold = next((f for f in difference.cleavage_layer(text, rule) if kept in f.fragments), None)
    got = fold.choose(0, kept) if fold else None
    return "none" if got is None else f"{got[0][0]} {len(got[1].sides)}"


def _seeds(case: str) -> str:
    reactant, target = _split(case)
    best = difference.first_seeds(reactant, target, "Dealkylation", 1)[0]
    return f"{best.depth} {best.cost} {best.text == canonical_smiles(target)}".lower()


def _fragments(case: str) -> str:
    text, rule, depth = _split(case)
    depths, folds = difference.cleavage_graph(text, rule, max_depth=int(depth))
    return f"{len(depths)} {len(folds)}"


def _graph(case: str) -> str:
    text, rule, depth = _split(case)
    nodes, edges = search.product_graph(text, rule, max_depth=int(depth))
    return f"{len(nodes)} {len(edges)}"


_DIAMOND = (("a", ["x"], ["n1"]), ("b", ["n1"], ["n2"]), ("c", ["n1"], ["n3"]), ("d", ["n2", "n3"], []))


def _plan(case: str) -> str:
    plan, chain = Plan.bind(_DIAMOND), Plan.bind(_DIAMOND[:2])
    return str({
        "edges": lambda: plan.precedes, "linearizations": lambda: plan.n_linearizations, "listed": lambda: len(plan.linearizations()), "overlap": lambda: plan.linearization_overlap(plan),
        "same": lambda: plan.same_linearizations(Plan.bind(_DIAMOND)), "skeleton": lambda: plan.same_skeleton(Plan.bind([(r, [f"y{x}" for x in u], [f"y{x}" for x in a]) for r, u, a in _DIAMOND])),
        "dominates": lambda: chain.dominates(chain), "longer": lambda: plan.dominates(chain), "json": lambda: Plan.from_json(plan.to_json()) == plan,
        "and": lambda: len(and_or_tree([plan])["and"]), "or": lambda: len(and_or_tree([plan, chain])["or"]), "maybe": lambda: Maybe((Side((1, 2), (2, 3)),)).allows((3,)), "maybe_own": lambda: Maybe((Side((1, 2), (2, 3)),)).allows((1, 2)),
        "apply_n": lambda: ApplyN(("a", "b"), 2).allows("b"), "elementary": lambda: len(search.elementary_plan(search.find_path("c1ccccc1", "O=C1C=CC(=O)C=C1", "QuinoneFormation")[0][0]).steps),
    }[case]()).lower()


def _tautomer(case: str) -> str:
    return difference.normalised_tautomer(case)[0]


def _written(text: str) -> str:
    return canonical_smiles(text)


def _texts(*some: str) -> str:
    return ",".join(map(canonical_smiles, some))


BENZENE, NAPHTHALENE, ANTHRACENE = "c1ccccc1", "c1ccc2ccccc2c1", "c1ccc2cc3ccccc3cc2c1"
PHENANTHRENE, PYRENE, BIPHENYL = "c1ccc2c(c1)ccc1ccccc12", "c1cc2ccc3cccc4ccc(c1)c2c34", "c1ccc(-c2ccccc2)cc1"
BUCKYBALL = "c12c3c4c5c1c1c6c7c2c2c8c3c3c9c4c4c%10c5c5c1c1c6c6c%11c7c2c2c7c8c3c3c8c9c4c4c9c%10c5c5c1c1c6c6c%11c2c2c7c3c3c8c4c4c9c5c1c1c6c2c3c41"
CUBANE, NEOPENTANE = "C12C3C4C1C5C2C3C45", "CC(C)(C)C"

#: Name -> (operator, cases with their answers).
FACTS: dict[str, tuple[Callable[[str], str], Cases]] = {
    "mol_canonical": (_same, (("OCC | CCO", "true"), (f"{BENZENE} | C1=CC=CC=C1", "true"), ("CCO | COC", "false"), ("C(C)(C)C | CC(C)C", "true"), ("Oc1ccccc1C | Cc1ccccc1O", "true"), ("[O-][N+](=O)C | C[N+]([O-])=O", "true"))),
    "mol_stable_key": (_key, ((BENZENE, "true"), ("CC(=O)Nc1ccc(O)cc1", "true"), ("C[N+](C)(C)[O-]", "true"))),
    "mol_aromatic_bonds": (lambda t: str(len(aromatic_bonds(parse(t)))), ((BENZENE, "6"), ("C1=CC=CC=C1", "6"), (NAPHTHALENE, "11"), ("c1cc[nH]c1", "5"), ("c1ccsc1", "5"), ("C1=CC=CC=CC=C1", "0"), ("C1=CCC=C1", "0"), ("O=C1C=CC(=O)C=C1", "0"))),
    "mol_symmetry_classes": (lambda t: str(len(set(symmetry_classes(parse(t))))), ((BENZENE, "1"), ("Cc1ccccc1", "5"), ("Cc1ccc(C)cc1", "3"), ("CCC", "2"), (NEOPENTANE, "2"), (NAPHTHALENE, "3"), (ANTHRACENE, "4"), (PYRENE, "5"))),
    "mol_group_order": (lambda t: str(structure.group_order(parse(t))), ((BENZENE, "12"), (NAPHTHALENE, "4"), (ANTHRACENE, "4"), (NEOPENTANE, "24"), (CUBANE, "48"), ("CCO", "1"), ("C1CC1", "6"), ("CC", "2"), (BIPHENYL, "8"), (BUCKYBALL, "120"))),
    "mol_atom_orbit": (_orbit, (("CCC | 0", "0,2"), ("CCC | 1", "1"), (f"{BENZENE} | 3", "0,1,2,3,4,5"), ("CCO | 0", "0"), (f"{NEOPENTANE} | 0", "0,2,3,4"))),
    "mol_pair_orbits": (lambda t: _sizes(structure.pair_orbits(parse(t))), ((BENZENE, "3,6,6"), ("C1CCC1", "2,4"), ("CCC", "1,2"), (CUBANE, "4,12,12"))),
    "mol_set_orbits": (_subsets, ((f"{BENZENE} | 3", "2,6,12"), (f"{BENZENE} | 4", "3,6,6"), ("C1CCC1 | 2", "2,4"))),
    "mol_bond_orbits": (lambda t: _sizes(structure.bond_orbits(parse(t))), ((BENZENE, "6"), (NAPHTHALENE, "1,2,4,4"), ("CCC", "2"), (CUBANE, "12"), ("CCO", "1,1"))),
    "mol_bond_pair_orbits": (lambda t: _sizes(structure.bond_pair_orbits(parse(t))), ((BENZENE, "3,6,6"), ("CCC", "1"), ("C1CCC1", "2,4"))),
    "mol_canonical_site": (_one_site, (("CCC | 2", "0"), (f"{BENZENE} | 3,4", "0,1"), (f"{BENZENE} | 2,5", "0,3"), ("CCO | 2", "2"))),
    "mol_site_signature": (_same_signature, (("CCO | 2 | OCC | 0", "true"), ("CCO | 0 | OCC | 0", "false"), (f"{BENZENE} | 0,3 | {BENZENE} | 1,4", "true"), (f"{BENZENE} | 0,3 | {BENZENE} | 1,3", "false"))),
    "mol_kekule_count": (lambda t: str(count_kekule(parse(t))), ((BENZENE, "2"), (NAPHTHALENE, "3"), (ANTHRACENE, "4"), (PHENANTHRENE, "5"), (PYRENE, "6"), (BIPHENYL, "4"), ("c1ccc2c(c1)c1ccccc1c1ccccc21", "9"), (BUCKYBALL, "12500"), ("CCO", "1"))),
    "mol_kekule_forms": (lambda t: str(len(kekule_forms(parse(t)))), ((BENZENE, "2"), (NAPHTHALENE, "3"), (BIPHENYL, "3"), (PHENANTHRENE, "5"), ("CCO", "1"))),
    "mol_matches": (_matches, (("[#6H2,#6H3:1] | CCC", "3"), (f"[c:1] | {BENZENE}", "6"), ("[#6:1]-[#8H1:2] | OCCO", "2"), ("[#6:1]=[#8:2] | CC(=O)OC", "1"), ("[#7:1] | CCO", "0"), ("[!#6:1] | CC(=O)N", "2"))),
    "mol_unique_sites": (_sites, (("Hydroxylation | h2 | CCC", "2,1"), (f"Hydroxylation | h | {BENZENE}", "6"), ("Hydroxylation | h2 | CCO", "1,1"), (f"Epoxidation | epoxide | {BENZENE}", "6"))),
    "mol_pi_components": (_pi, (("C=CC=C", "4"), ("C=CCC=C", "2,2"), (BENZENE, "6"), (f"{BENZENE}CCc1ccccc1", "6,6"), ("CCO", ""))),
    "mol_forced_doubles": (lambda t: str(len(structure.forced_doubles(parse(t)))), (("C=CC=C", "2"), (BENZENE, "0"), ("C=Cc1ccccc1", "1"), (NAPHTHALENE, "0"), ("O=C1C=CC(=O)C=C1", "4"))),
    "mol_two_core": (_core, ((BENZENE, "6"), ("C=Cc1ccccc1", "6"), ("C=CC=C", "0"), (NAPHTHALENE, "10"))),
    "mol_reactant_parent": (_parent, ((f"{BENZENE} | [#6:1]=[#6:2] | 0,1", "2"), (f"{BENZENE} | [#6:1]=[#6:2] | 1,2", "2"), ("C=CC | [#6:1]=[#6:2] | 1,2", "none"))),
    "mol_settle_charges": (_settled, (("CC | 0 | 1 | 2", canonical_smiles("C=C")), ("C=C | 0 | 1 | 1", canonical_smiles("CC")), ("C=N | 0 | 1 | 1", canonical_smiles("C[NH-]")), ("C=[N+](C)C | 0 | 1 | 1", canonical_smiles("CN(C)C")))),
    "mol_gate": (_gate, (("CCO", "accepted"), ("CC=[NH+]C", "iminium"), ("C[O-]", "oxygen anion on carbon"), ("C[N-]C", "nitrogen anion"), ("C[N+](C)(C)[O-]", "accepted"))),
    "mol_formula": (_formula, (("CCO", "C2 H6 O1"), ("[O-][N+](=O)c1ccccc1", "+1 -1 C6 H5 N1 O2"), ("CC.O", "C2 H8 O1"), ("ClCCBr", "Br1 C2 Cl1 H4"))),
    "mol_mass": (_mass, (("CCO | [M]", "46.042"), (f"{BENZENE} | [M]", "78.047"), ("OCC1OC(O)C(O)C(O)C1O | [M]", "180.063"), ("Cn1cnc2c1c(=O)n(C)c(=O)n2C | [M+H]+", "195.088"), ("CC(=O)Nc1ccc(O)cc1 | [M-H]-", "150.056"), ("CC(=O)Nc1ccc(O)cc1 | [M+Na]+", "174.053"), ("OCC1OC(O)C(O)C(O)C1O | [M+2H]2+", "91.039"))),
    "mol_star": (_star, (("Acetylation | CCO", f"{canonical_smiles('CCO*')} |$Ac$|"), ("Sulfation | CO", f"{canonical_smiles('CO*')} |$SO3H$|"))),
    "mol_tautomer": (_tautomer, (("OC1=CCCCC1", canonical_smiles("O=C1CCCCC1")), ("CC(O)=C", canonical_smiles("CC(C)=O")))),
    "catalog_leaves": (_leaves, (("StableOxygenation", "Hydroxylation,Epoxidation,NitrogenOxidation,SulfurOxidation"), ("UnstableOxygenation", "Dealkylation,OxidativeDehalogenation"), ("Reactivity", "GSH,Protein,DNA,Cyanide"), ("TT", "Tautomerization"), ("TSO", "ThiopheneSulfurOxidation"),
        ("CJ", "Acetylation,Glucuronidation,Glutathionation,Sulfation"), ("Bioactivation", "QuinoneFormation,Epoxidation,ThiopheneSulfurOxidation,NitroaromaticReduction"), ("Reduction", "Hydrogenation,Dehydration,NitrogenReduction,SulfurReduction,OxygenReduction,ReductiveDehalogenation"), ("Hydrolysis", "Hydrolysis"))),
    "catalog_members": (_members, (("PhaseOne", "7 true"), ("Default", "8 true"), ("PhaseOneRS", "5 true"), ("PhaseOneQF", "2 true"), ("Full", "8 true"), ("All", "33 true"), ("Hydroxylation", "2 false"), ("Glutathionation", "13 false"), ("Cyanide", "12 false"), ("Dealkylation", "15 false"))),
    "catalog_resolve": (_resolved, (("PhaseOne/Hydroxylation/h2", "Pattern h2"), ("Default/StableOxygenation", "Catalog StableOxygenation"), ("Hydroxylation/h", "Pattern h"), ("PhaseOne/Nothing", "none"))),
    "catalog_colours": (_colour, (("Hydroxylation", "SO"), ("Dealkylation", "UO"), ("Dehydrogenation", "DH"), ("Hydrolysis", "HD"), ("OxygenReduction", "RD"), ("QuinoneFormation", "none"))),
    "catalog_arms": (_arms, (("CN | 1", "N"), ("CO | 1", "O"), ("CS | 1", "O"), ("CC | 1", "none"))),
    "catalog_user_rule": (_user_rule, (("CCO", canonical_smiles("ClCCO")), ("CO", canonical_smiles("ClCO")), ("OCCO", ""))),
    "catalog_o_dealkylation": (_o_dealkylation, (("COc1ccccc1", ".".join(sorted((canonical_smiles("OC=O"), canonical_smiles("Oc1ccccc1"))))), ("CCOCC", ""))),
    "step_filter_rules": (_kept_rules, (("CCO | Hydroxylation", "Hydroxylation"), ("CCO | Dehydration", "Dehydration"), ("CCO | Epoxidation", ""))),
    "step_filter_sites": (_kept_sites, (("CCO | Hydroxylation | 0", "1"), ("CCO | Hydroxylation | 1", "1"), ("CCO | Hydroxylation | 2", "0"))),
    "step_trace": (_trace, (("CCO | Hydroxylation | h2", "3 1"), ("COC | Dealkylation | methyl_carboxylic", "3 2"), ("CCO | Dehydrogenation | alcohol", "3 0"))),
    "step_delta": (_delta, (("CCO | Hydroxylation | h2", "true O+1"), ("CCO | Dehydrogenation | alcohol", "true H-2"), ("CC(=O)OC | Hydrolysis | add_water", "true H+2 O+1"), ("C=C | Hydrogenation | alkene", "true H+2"))),
    "step_apply_n": (_counted, ((f"{BENZENE} | Hydroxylation | 1", "1"), (f"{BENZENE} | Hydroxylation | 2", "3"), (f"{BENZENE} | Hydroxylation | 3", "3"), (f"{BENZENE} | Hydroxylation | 6", "1"), ("C=CC=C | Epoxidation | 2", "1"))),
    "step_enumerate": (_enumerated, ((f"{BENZENE} | Hydroxylation | 2 | wide", "4"), (f"{BENZENE} | Hydroxylation | 6 | wide", "12"), (f"{BENZENE} | Hydroxylation | 6 | deep", "12"))),
    "graph_products": (_graph, (("CC | Hydroxylation | 1", "2 1"), ("CC | Hydroxylation | 2", "4 3"), (f"{BENZENE} | Hydroxylation | 2", "5 4"))),
    "graph_fragments": (_fragments, (("COC | Dealkylation | 1", "4 3"),)),
    "fold_layer": (_folds, (("COC | Dealkylation", "3 3 1 3"), ("CC(=O)OC | Hydrolysis", "2 2 1 3"))),
    "fold_choose": (_chosen, (("COc1ccccc1 | Dealkylation | Oc1ccccc1", "Dealkylation 1"), ("CC(=O)OC | Hydrolysis | CO", "Hydrolysis 1"), ("CC(=O)OC | Hydrolysis | CCC", "none"))),
    "fold_seeds": (_seeds, (("COc1ccccc1 | Oc1ccccc1", "1 0 true"), ("Oc1ccccc1 | Oc1ccccc1", "0 0 true"))),
    "search_paths": (_path, (("CC | CCO | PhaseOne", "Hydroxylation"), ("CCO | CC=O | PhaseOne", "Dehydrogenation"), ("CCC | C1OC1C | Dehydrogenation,Epoxidation", "Dehydrogenation>Epoxidation"), (f"{BENZENE} | C1=CC=CC(O)C1O | Epoxidation,EpoxideOpening", "Epoxidation>EpoxideOpening"),
        ("Oc1ccc(O)cc1 | O=C1C=CC(=O)C=C1 | QuinoneFormation", "QuinoneFormation"), (f"{BENZENE} | Oc1ccccc1 | Hydroxylation", "Hydroxylation"), ("CCO | CCCN | Hydroxylation", "none"))),
    "search_options": (_searched, tuple((f"COc1ccccc1 | O=C1C=CC(=O)C=C1 | {o}", "true") for o in ("plain", "score", "log", "diversity", "fragments")) + (("COc1ccccc1 | Oc1ccccc1 | single", "false"), ("CC=O | C=CO | tautomers", "true"), ("CCO | CC=O | monotone", "true"))),
    "search_pools": (_pooled, (("CCO | 62.0368 | 1", "Hydroxylation"), ("CCO | 78.0317 | 2", "Hydroxylation+Hydroxylation"), ("CCO | 62.0368 | 2", "none"))),
    "io_export": (_exported, tuple((c, "true") for c in ("outcome", "plan", "counters", "molecule", "emission", "html"))),
    "search_toward": (_toward, (("CCO | CC=O | 2", "true"), ("COc1ccccc1 | Oc1ccccc1 | 2", "true"))),
    "search_heavy": (lambda c: str(guidance.not_farther(*map(int, c.split()))).lower(), (("3 4 4", "true"), ("3 2 4", "false"), ("5 4 4", "true"), ("4 4 4", "true"))),
    "catalog_identifier": (_identified, (("Hydroxylation/h2", "x:Hydroxylation/h2"), ("PhaseOne", "x:PhaseOne"), ("Hydroxylation/none", "none"))),
    "mol_stereo": (_stereo, (("N[C@@H](C)C(=O)O | C[C@H](N)C(=O)O", "true"), ("N[C@@H](C)C(=O)O | N[C@H](C)C(=O)O", "false"), ("N[C@@H](C)C(=O)O | OC(=O)[C@@H](N)C", "true"), ("F/C=C/F | F\\C=C\\F", "true"), ("F/C=C/F | F/C=C\\F", "false"),
        ("F/C=C/F | C(\\F)=C/F", "true"), ("C[C@H](C)O | CC(C)O", "true"), ("F/C(F)=C/F | FC(F)=CF", "true"), ("C[C@H]1CC[C@@H](C)CC1 | C[C@@H]1CC[C@H](C)CC1", "true"), ("C[C@H]1CC[C@@H](C)CC1 | C[C@H]1CC[C@H](C)CC1", "false"),
        ("O[C@H](C(=O)O)[C@@H](O)C(=O)O | O[C@@H](C(=O)O)[C@H](O)C(=O)O", "true"), ("O[C@H](C(=O)O)[C@H](O)C(=O)O | O[C@@H](C(=O)O)[C@@H](O)C(=O)O", "false"), ("[H][C@](F)(Cl)Br | F[C@@]([H])(Cl)Br", "true"), ("C/C=C/C=C\\C | C/C=C\\C=C\\C", "true"))),
    "mol_stereo_products": (_kept_stereo, (("C[C@H](O)CC | Hydroxylation", "3 4"), ("C/C=C/CO | Hydroxylation", "4 4"), ("CCO | Hydroxylation", "0 2"))),
    "mol_ketene": (_ketene, (("O=C(O)c1ccccc1 | O | O=C=C1CCCCC1", "true false"), ("CC(=O)O | O | C=C=O", "true true"), ("CCO | O | C=C", "false true"))),
    "mol_asked": (_asked, (("CCO", "true true true"), (BENZENE, "true true true"))),
    "diff_carbonyl": (_carbonyl, (("CCC | CC(C)=O | 1", "true"), ("CCC | CC(C)O | 1", "false"), ("CC | CC=O | 0", "true"))),
    "search_shuffle": (_shuffled, (("CCCO", "true true 2"),)),
    "search_replay": (_replayed, (("CC | CCO", "true"), ("c1ccccc1 | O=C1C=CC(=O)C=C1", "true"))),
    "search_random": (_walked, (("CCO | 1", "3 true"), ("c1ccccc1 | 7", "3 true"))),
    "search_mass": (_weighed, (("CCO | 63.0441", "63.044"), ("c1ccccc1 | 95.0492", "95.049"), ("CCO | 500.0", "none"))),
    "search_partial": (_partial, (("CC | OCCO", "true 1"), ("CC | OCCN", "false 1"))),
    "search_seal": (_sealed, (("1", "true"), ("1000", "false"))),
    "search_network": (_shared, (("reaches", "true"), ("grows", "true"), ("targets", "true"), ("expanded", "true"))),
    "diff_cost": (_difference, (("CCO | CCO", "0 none"), ("CC | CCO", "4 add+oxygen"), ("CCO | CC", "3 cleave"), ("CCO | CC=O", "3 raise"), ("CC=O | CCO", "3 lower"))),
    "diff_mapping": (_mapped, (("CCO | CCO", "3"), (f"C{BENZENE} | {BENZENE}", "6"), ("CCCC | CCC", "3"), ("O | N", "0"))),
    "diff_needs": (_needs, (("CC | CCO", "oxygen 1 gain 0 loss 1"), ("CCO | CC=O", "oxygen 0 gain 0 loss 2"), ("CC=O | CCO", "oxygen 0 gain 2 loss 0"))),
    "diff_keep": (_helpful, (("CCCO | OCCCO | Hydroxylation", "0"), ("CCO | CC=O | Hydroxylation", "none"), ("CCO | CCO | Dehydration", "none"))),
    "diff_progress": (_progress, (("CCO | CC=O | -2 | 1", "1"), ("CCO | CC=O | 2 | 1", "0"), ("CC=O | CCO | 2 | 1", "1"), ("CCO | CC=O | -2 | 0", "0"))),
    "diff_order": (_first_key, (("COc1ccccc1 | Oc1ccccc1", "Dealkylation"),)),
    "diff_undone": (_undone, (("1@3 -1@3", "true"), ("1@3 -1@4", "false"), ("-1@2,5 1@5,2", "true"), ("1@3 1@3", "false"))),
    "diff_ends": (_ends, (("CC=O | CCC=O | 1,2", "true"), ("CC=O | CCCO | 1,2", "false"))),
    "diff_merged": (_merged, (("CC | CCO | CCN", "1 1 4"), ("CCO | CCO | CCO", "0 0 0"))),
    "diff_site_cost": (_site_cost, (("CCO | CCO | 1", "0.000"), ("CCC | CCC | 0", "0.000"))),
    "diff_site_check": (_shell, (("CCO | CCN | 0", "equal"), ("CCO | CCN | 1", "mismatch"))),
    "diff_ring_break": (_ring_break, (("C1CCCO1 | 0 | 4", "true"), ("CCO | 1 | 2", "false"), ("c1ccccc1C | 5 | 6", "false"))),
    "walk_options": (_allowed, (("CCO |  | single", "true"), ("CCO.O |  | single", "false"), ("CCO | CC,CCO | fresh", "false"), ("CCO.O | CCO.O | any", "true"))),
    "walk_mass": (_predicted, (('CCO | {"O": 1}', "62.037"), ('CCO | {"H": -2}', "44.026"), ('CCO | {"*": 1}', "none"))),
    "score_labels": (_score_label, (("close-atom", "close atom true"), ("log-neg-pc", "log-neg-pc both true"), ("lin-neg-c-atom", "lin-neg-c atom true"), ("add-both", "add both true"), ("nothing", "none"))),
    "network_views": (_network, (("nodes", "6"), ("edges", "5"), ("rule_patterns", "5"), ("children", _texts("CC", "CCC")), ("parents", _texts("CC", "C")), ("reaches", "true false"), ("cost_to", "2"), ("closest", str([(_written("CCCC"), 0), (_written("CCC"), 3)])), ("missed", "CN"), ("simple_paths_0", "1"), ("simple_paths_1", "2"), ("plan", "d>c"),
        ("expandable_first", _texts("C", "CC", "CCCC", "CN", "CCC", "CO")), ("prune", _texts("C", "CC", "CCC", "CCCC", "CN")), ("sealed", "true"), ("json", "true"))),
    "plan_algebra": (_plan, (("edges", "((0, 1), (0, 2), (1, 3), (2, 3))"), ("linearizations", "2"), ("listed", "2"), ("overlap", "2"), ("same", "true"), ("skeleton", "true"), ("dominates", "true"), ("longer", "false"), ("json", "true"), ("and", "4"), ("or", "2"), ("maybe", "true"), ("maybe_own", "false"), ("apply_n", "true"), ("elementary", "2"))),
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            operator = FACTS[name][0]  # looked up where it runs
            for batch in batches:
                yield pd.DataFrame({"subject": batch["subject"], "answer": [operator(x) for x in batch["subject"]]})

        table = spark.createDataFrame([(subject,) for subject, _ in FACTS[name][1]], "subject string")
        return table.mapInPandas(answers, "subject string, answer string")

    run.__name__ = name
    return run


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


QUERIES = {name: _query(name) for name in FACTS}
ORACLES = {name: "SELECT * FROM (VALUES " + ", ".join(f"({_sql(a)}, {_sql(b)})" for a, b in cases) + ") v(subject, answer)" for name, (_, cases) in FACTS.items()}
