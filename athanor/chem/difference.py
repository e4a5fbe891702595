"""Differences between a molecule and a target by a common substructure."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..plans.algebra import Maybe, Side
from .molecule import Mol, ParseError, aromatic_bonds, canonical, parse, stable_key, symmetry_classes
from .reactions import metabolize


def common_substructure(a: Mol, b: Mol) -> dict[int, int]:
    """A large common connected substructure as atom pairs; elements must agree, bond orders need not.

    Seeds are pairs of alike atoms, one for each pair of symmetry classes, the most alike first; each is grown by the pair
    of neighbours with most surroundings in common, and the largest result wins.  The result depends on the
    molecules only; it need not be the largest that exists."""
    alike = _likeness(a, b)
    classes = symmetry_classes(a), symmetry_classes(b)
    seeds: dict[tuple[int, int], tuple[int, int, int]] = {}
    for (i, j), s in alike.items():
        key = classes[0][i], classes[1][j]
        seeds[key] = max(seeds.get(key, (0, 0, 0)), (s, -i, -j))
    best: dict[int, int] = {}
    for _, i, j in sorted(seeds.values(), reverse=True):
        grown = _grown(a, b, -i, -j, alike)
        if len(grown) > len(best) or len(grown) == len(best) and _bonds(a, b, grown) > _bonds(a, b, best):
            best = grown
        if len(best) == min(len(a.atoms), len(b.atoms)) and _bonds(a, b, best) == len(b.bonds):
            break
    return best


def _likeness(a: Mol, b: Mol) -> dict[tuple[int, int], int]:
    """Rounds of shared surroundings per pair of equal elements."""
    now = [[m.atoms[i].z for i in range(len(m.atoms))] for m in (a, b)]
    score = {(i, j): 1 for i in range(len(a.atoms)) for j in range(len(b.atoms)) if now[0][i] == now[1][j]}
    for _ in range(4):
        now = [[hash((x[i], tuple(sorted(x[j] for j in m.near(i))))) for i in range(len(x))] for m, x in zip((a, b), now)]
        for i, j in score:
            score[i, j] += now[0][i] == now[1][j]
    return score


def _grown(a: Mol, b: Mol, i: int, j: int, alike: dict[tuple[int, int], int]) -> dict[int, int]:
    at, used = {i: j}, {j}
    while True:
        options = [
            (alike[x, y] + 2 * sum(a.order(x, p) > 0 and b.order(y, q) > 0 for p, q in at.items()), -x, -y)
            for p, q in at.items() for x in a.near(p) for y in b.near(q) if x not in at and y not in used and (x, y) in alike
        ]
        if not options:
            return at
        _, x, y = max(options)
        at[-x] = -y
        used.add(-y)


def _bonds(a: Mol, b: Mol, at: dict[int, int]) -> int:
    return sum(1 for x, y in a.bonds if x in at and y in at and b.order(at[x], at[y]))


@dataclass
class Difference:
    mapping: dict[int, int]
    cleaved: list[int]  # atoms of the molecule without a partner
    cleavage_bonds: list[tuple[int, int]]
    extra: int  # atoms of the target without a partner
    raised: list[tuple[int, int]]  # bonds whose order rises
    lowered: list[tuple[int, int]]
    aromatic: int  # atoms whose aromaticity changes
    needs_oxygen: list[int] = field(default_factory=list)
    hydrogens: dict[int, int] = field(default_factory=dict)  # by atom: target less molecule
    grows: list[int] = field(default_factory=list)  # atoms that get a neighbour

    changed: set[int] = field(default_factory=set)  # atoms whose aromaticity or charge changes

    def active(self) -> set[int]:
        """The molecule's atoms where something is to be done: ends of bonds that go or change, places of new neighbours,
        changes of hydrogens, charge and aromaticity, and all that has no partner."""
        out = {*self.cleaved, *self.hydrogens, *self.grows, *self.changed}
        for pair in (*self.cleavage_bonds, *self.raised, *self.lowered):
            out.update(pair)
        return out

    @property
    def cost(self) -> int:
        """3 per cleaved atom, 4 per extra atom, 3 per changed bond, 1 per aromatic change."""
        return 3 * len(self.cleaved) + 4 * self.extra + 3 * (len(self.raised) + len(self.lowered)) + self.aromatic

    def residual(self) -> tuple[str, ...]:
        """What is left to do, as categories."""
        out = []
        for name, on in (("cleave", self.cleaved), ("add", self.extra), ("oxygen", self.needs_oxygen), ("raise", self.raised), ("lower", self.lowered), ("aromatic", self.aromatic)):
            if on:
                out.append(name)
        return tuple(out)

    def class_key(self) -> str:
        return "|".join(map(str, (len(self.cleaved), self.extra, len(self.raised), len(self.lowered), self.aromatic)))


def atom_difference(mol: Mol, target: Mol) -> Difference:
    at = common_substructure(mol, target)
    back = {j: i for i, j in at.items()}
    gone = [i for i in range(len(mol.atoms)) if i not in at]
    arom = [{i for e in aromatic_bonds(m) for i in e} for m in (mol, target)]
    aromatic_pairs = [aromatic_bonds(m) for m in (mol, target)]

    def order(m: int, a: int, b: int) -> float:
        return 1.5 if (min(a, b), max(a, b)) in aromatic_pairs[m] else (mol, target)[m].order(a, b)

    pairs = {(min(a, b), max(a, b)) for a, b in mol.bonds if a in at and b in at} | {(min(back[a], back[b]), max(back[a], back[b])) for a, b in target.bonds if a in back and b in back}
    change = {(a, b): order(1, at[a], at[b]) - order(0, a, b) for a, b in pairs}
    both_ring = lambda a, b: a in arom[0] and b in arom[0] or at[a] in arom[1] and at[b] in arom[1]
    return Difference(
        at, gone, [(a, b) for a, b in sorted(mol.bonds) if (a in at) != (b in at)], len(target.atoms) - len(at),
        [p for p in sorted(change) if change[p] > 0 and not both_ring(*p)], [p for p in sorted(change) if change[p] < 0 and not both_ring(*p)],
        sum((i in arom[0]) != (j in arom[1]) for i, j in at.items()),
        sorted(i for i, j in at.items() if any(target.atoms[k].z == 8 and k not in back for k in target.near(j))),
        {i: target.atoms[j].h - mol.atoms[i].h for i, j in sorted(at.items()) if target.atoms[j].h != mol.atoms[i].h},
        sorted(i for i, j in at.items() if any(k not in back for k in target.near(j))),
        {i for i, j in at.items() if (i in arom[0]) != (j in arom[1]) or mol.atoms[i].charge != target.atoms[j].charge},
    )


def normalised_tautomer(text: str, limit: int | None = None) -> tuple[str, bool]:
    """(the tautomer that stands for all, whether it differs): of those that moving one hydrogen at a time reaches, the one
    with most aromatic atoms, then most C=O bonds, then least text.  More than `limit` of them are an error."""
    start = canonical(parse(text))
    seen, todo = {start}, [start]
    while todo:
        for e in metabolize(todo.pop(0), "Tautomerization"):
            for t in e.texts:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        if limit is not None and len(seen) > limit:
            raise OverflowError(f"more than {limit} tautomers of {text}")

    def rank(t: str) -> tuple:
        try:
            m = parse(t)
        except ParseError:
            return (1, 0, t)
        return -len({i for e in aromatic_bonds(m) for i in e}), -sum(o == 2 and {m.atoms[a].z, m.atoms[b].z} == {6, 8} for (a, b), o in m.bonds.items()), t

    best = min(seen, key=rank)
    return best, best != start


@dataclass
class Fold:
    """Cleavages with one outcome: the fragments, and the arms (rule, pattern, site) that give it."""

    fragments: tuple[str, ...]
    arms: list[tuple[str, str, tuple[int, ...]]]

    def maybe_for(self, arm: int, kept: str) -> Maybe | None:
        """What stays optional when the walk goes on with one fragment: the others, at this arm's site; None if there is no
        such arm or fragment."""
        if not 0 <= arm < len(self.arms) or kept not in self.fragments:
            return None
        others = list(self.fragments)
        others.remove(kept)
        return Maybe(tuple(Side(self.arms[arm][2]) for _ in others))

    def choose(self, arm: int, kept: str) -> tuple[tuple[str, str, tuple[int, ...]], Maybe] | None:
        """The arm with what then stays optional."""
        maybe = self.maybe_for(arm, kept)
        return None if maybe is None else (self.arms[arm], maybe)


def cleavage_layer(text: str, catalog="PhaseOne") -> list[Fold]:
    """One step of cleaving edits, equal outcomes together, in the order found."""
    out: dict[tuple[str, ...], Fold] = {}
    for e in metabolize(text, catalog, unique=False):
        if e.cleaves and len(e.products) > 1:
            out.setdefault(key := tuple(sorted(e.texts)), Fold(key, [])).arms.append((e.leaf, e.pattern, e.site))
    return list(out.values())


def layer_stats(folds: list[Fold]) -> dict[str, int]:
    return {"n_products": len(folds), "n_arms": sum(len(f.arms) for f in folds), "max_fan_in": max((len(f.arms) for f in folds), default=0), "distinct_fragments": len({x for f in folds for x in f.fragments})}


def cleavage_graph(text: str, catalog="PhaseOne", max_nodes: int = 50, max_depth: int = 2) -> tuple[dict[str, int], list[tuple[str, Fold]]]:
    """(fragment -> depth, (molecule, fold)) breadth first over fragments."""
    start = canonical(parse(text))
    depth, folds, queue = {start: 0}, [], [start]
    for t in queue:
        if depth[t] >= max_depth:
            continue
        for f in cleavage_layer(t, catalog):
            folds.append((t, f))
            for x in f.fragments:
                if x not in depth and len(depth) < max_nodes and stable_key(parse(x)):
                    depth[x] = depth[t] + 1
                    queue.append(x)
    return depth, folds


@dataclass(frozen=True)
class Seed:
    """A fragment to begin a search from: how it was cut free, and what it still lacks."""

    text: str
    depth: int
    cost: int
    hops: tuple[tuple[str, str], ...]


def first_seeds(reactant: str, target: str, catalog="PhaseOne", max_depth: int = 2, max_nodes: int = 50) -> list[Seed]:
    """The fragments that cleaving alone gives, the molecule itself among them, by their remaining difference to the target."""
    goal, start = parse(target), canonical(parse(reactant))
    hops: dict[str, tuple[tuple[str, str], ...]] = {start: ()}
    queue = [start]
    for text in queue:
        if len(hops[text]) < max_depth:
            for fold in cleavage_layer(text, catalog):
                for part in dict.fromkeys(fold.fragments):
                    if part not in hops and len(hops) < max_nodes:
                        hops[part] = (*hops[text], fold.arms[0][:2])
                        queue.append(part)
    return sorted((Seed(t, len(h), atom_difference(parse(t), goal).cost, h) for t, h in hops.items()), key=lambda s: (s.cost, s.depth, s.text))
