"""Substructure queries: a subset of SMARTS, matched by backtracking.

Atoms: #n, element symbols (upper case: not aromatic, lower case: aromatic), *, a, A, Hn, hn, Dn, Xn, vn, R, charges, recursive
$(...), with !, &, comma and semicolon.  Bonds: - = # : ~ and comma lists; an unmarked bond is single or
aromatic.  Map numbers name the atoms of the result.  A molecule is matched in one of its alternating forms: "="
takes the form's double bonds, aromatic ones too, "-" takes single bonds outside aromatic rings.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

from .molecule import AROMATIC, NUMBER, Mol, ParseError, aromatic_bonds, rings


class View:
    """A molecule with the facts that queries ask for, worked out once."""

    def __init__(self, mol: Mol):
        self.mol = mol
        self.aromatic_bonds = aromatic_bonds(mol)
        self.aromatic = {i for e in self.aromatic_bonds for i in e}
        self.ring_sets = [set(r) for r in rings(mol)]
        self.in_ring = set().union(*self.ring_sets) if self.ring_sets else set()
        self.ring_bonds = {tuple(sorted((r[i], r[i - 1]))) for r in rings(mol) for i in range(len(r))}

    def matches_bond(self, a: int, b: int, kinds: frozenset[str]) -> bool:
        order = self.mol.order(a, b)
        aromatic = (min(a, b), max(a, b)) in self.aromatic_bonds
        for k in kinds:
            if k == "~" or k == "" and (order == 1 or aromatic) or k == "-" and order == 1 and not aromatic:
                return True
            if k == "=" and order == 2 or k == "#" and order == 3 or k == ":" and aromatic:
                return True
        return False


AtomTest = Callable[[View, int], bool]


@dataclass
class Node:
    test: AtomTest
    number: int = 0
    elements: frozenset[int] | None = None  # what the atom must be, where the query says so


@dataclass
class Query:
    nodes: list[Node] = field(default_factory=list)
    edges: list[tuple[int, int, frozenset[str]]] = field(default_factory=list)

    @property
    def has_double(self) -> bool:
        """Whether the choice of alternating form matters."""
        return any(k & {"="} for _, _, k in self.edges)

    def matches(self, view: View) -> Iterator[dict[int, int]]:
        """Map number -> atom, in the order of the first atoms."""
        near: dict[int, list[tuple[int, frozenset[str]]]] = {i: [] for i in range(len(self.nodes))}
        for a, b, k in self.edges:
            near[a].append((b, k))
            near[b].append((a, k))
        order, seen = [], set()

        def visit(i: int) -> None:
            order.append(i)
            seen.add(i)
            for j, _ in near[i]:
                if j not in seen:
                    visit(j)

        for i in range(len(self.nodes)):
            if i not in seen:
                visit(i)
        at: dict[int, int] = {}
        taken: set[int] = set()

        def place(k: int) -> Iterator[dict[int, int]]:
            if k == len(order):
                yield {self.nodes[i].number: x for i, x in at.items() if self.nodes[i].number}
                return
            i = order[k]
            known = [(j, kinds) for j, kinds in near[i] if j in at]
            options = view.mol.near(at[known[0][0]]) if known else range(len(view.mol.atoms))
            for x in sorted(options):
                if x not in taken and self.nodes[i].test(view, x) and all(view.mol.order(x, at[j]) and view.matches_bond(x, at[j], kinds) for j, kinds in known):
                    at[i] = x
                    taken.add(x)
                    yield from place(k + 1)
                    taken.discard(x)
                    del at[i]

        yield from place(0)

    def required_elements(self) -> frozenset[int]:
        """Elements that every match holds: the filter before any matching."""
        return frozenset(next(iter(n.elements)) for n in self.nodes if n.elements and len(n.elements) == 1)


_PRIMITIVE = re.compile(r"#\d+|\$\(|[HhDXvR]\d*|r\d*|\+\d*|-\d*|Cl|Br|[A-Z][a-z]?|[a-z]|\*")


def _count(text: str, default: int) -> int:
    return int(text) if text else default


def _primitive(t: str) -> tuple[AtomTest, frozenset[int] | None]:
    if t[0] == "#":
        z = int(t[1:])
        return (lambda v, i: v.mol.atoms[i].z == z), frozenset({z})
    if t == "*":
        return (lambda v, i: True), None
    if t == "a":
        return (lambda v, i: i in v.aromatic), None
    if t == "A":
        return (lambda v, i: i not in v.aromatic), None
    if t[0] in "+-":
        sign = 1 if t[0] == "+" else -1
        n = sign * _count(t[1:], 1)
        return (lambda v, i: v.mol.atoms[i].charge == n), None
    if t[0] in "Hh" and (len(t) == 1 or t[1:].isdigit()):
        n = _count(t[1:], 1)
        return (lambda v, i: v.mol.atoms[i].h == n), None
    if t[0] == "D" and (len(t) == 1 or t[1:].isdigit()):
        n = _count(t[1:], 1)
        return (lambda v, i: len(v.mol.near(i)) == n), None
    if t[0] == "X" and (len(t) == 1 or t[1:].isdigit()):
        n = _count(t[1:], 1)
        return (lambda v, i: len(v.mol.near(i)) + v.mol.atoms[i].h == n), None
    if t[0] == "v" and (len(t) == 1 or t[1:].isdigit()):
        n = _count(t[1:], 1)
        return (lambda v, i: v.mol.bond_sum(i) + v.mol.atoms[i].h == n), None
    if t[0] == "R" and (len(t) == 1 or t[1:].isdigit()):
        if t[1:]:
            n = int(t[1:])
            return (lambda v, i: sum(i in r for r in v.ring_sets) == n), None
        return (lambda v, i: i in v.in_ring), None
    if t[0] == "r" and (len(t) == 1 or t[1:].isdigit()):
        n = _count(t[1:], 0)
        return (lambda v, i: any(i in r and (not n or len(r) == n) for r in v.ring_sets)), None
    if t in AROMATIC:
        z = AROMATIC[t]
        return (lambda v, i: v.mol.atoms[i].z == z and i in v.aromatic), frozenset({z})
    if t in NUMBER:
        z = NUMBER[t]
        return (lambda v, i: v.mol.atoms[i].z == z and i not in v.aromatic), frozenset({z})
    raise ParseError(f"query atom {t} not supported")


def _all(parts: list) -> tuple[AtomTest, frozenset[int] | None]:
    tests = [p[0] for p in parts]
    known = [p[1] for p in parts if p[1] is not None]
    return (lambda v, i: all(t(v, i) for t in tests)), (known[0] if known else None)


def _any(parts: list) -> tuple[AtomTest, frozenset[int] | None]:
    tests = [p[0] for p in parts]
    known = [p[1] for p in parts]
    return (lambda v, i: any(t(v, i) for t in tests)), (frozenset().union(*known) if all(k is not None for k in known) else None)


def _atom(text: str) -> tuple[AtomTest, frozenset[int] | None]:
    """; binds least, then comma, then & or nothing, then !."""
    at = 0

    def primitive() -> tuple[AtomTest, frozenset[int] | None]:
        nonlocal at
        if text[at] == "!":
            at += 1
            inner = primitive()[0]
            return (lambda v, i: not inner(v, i)), None
        m = _PRIMITIVE.match(text, at)
        if not m:
            raise ParseError(f"query atom [{text}] not supported")
        if m[0] == "$(":
            depth, end = 1, m.end()
            while depth:
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                end += 1
            inner = parse_query(text[m.end() : end - 1])
            at = end
            return (lambda v, i: any(True for _ in _anchored(inner, v, i))), None
        t = m[0]
        # Two letters are an element only where there is one; H after an element is a count.
        if len(t) == 2 and t[1].islower() and t not in NUMBER:
            t = t[0]
        at += len(t)
        return _primitive(t)

    def high() -> tuple[AtomTest, frozenset[int] | None]:
        nonlocal at
        parts = [primitive()]
        while at < len(text) and text[at] not in ",;":
            if text[at] == "&":
                at += 1
            parts.append(primitive())
        return _all(parts)

    def alternatives() -> tuple[AtomTest, frozenset[int] | None]:
        nonlocal at
        parts = [high()]
        while at < len(text) and text[at] == ",":
            at += 1
            parts.append(high())
        return _any(parts)

    parts = [alternatives()]
    while at < len(text) and text[at] == ";":
        at += 1
        parts.append(alternatives())
    return _all(parts)


def _anchored(query: Query, view: View, atom: int) -> Iterator[dict[int, int]]:
    first = query.nodes[0]
    pinned = Query([Node(lambda v, i: i == atom and first.test(v, i), 1), *query.nodes[1:]], query.edges)
    return pinned.matches(view)


@cache
def parse_query(text: str) -> Query:
    out, stack, open_ = Query(), [], {}
    last, kinds, at = -1, frozenset({""}), 0
    while at < len(text):
        c = text[at]
        if c == "(":
            stack.append(last)
        elif c == ")":
            last = stack.pop()
        elif c in "-=#:~":
            found = {c}
            while at + 2 < len(text) and text[at + 1] == "," and text[at + 2] in "-=#:~":
                at += 2
                found.add(text[at])
            kinds = frozenset(found)
        elif c.isdigit():
            if c in open_:
                a, k = open_.pop(c)
                out.edges.append((a, last, k if k != frozenset({""}) else kinds))
            else:
                open_[c] = last, kinds
            kinds = frozenset({""})
        else:
            if c == "[":
                depth, end = 1, at + 1
                while depth:
                    depth += {"[": 1, "]": -1}.get(text[end], 0)
                    end += 1
                body = text[at + 1 : end - 1]
                m = re.search(r":(\d+)$", body)
                test, elements = _atom(body[: m.start()] if m else body)
                node = Node(test, int(m[1]) if m else 0, elements)
                at = end - 1
            else:
                m = re.match(r"Cl|Br|[A-Za-z*]", text[at:])
                if not m:
                    raise ParseError(f"query {text} not supported at {at}")
                node = Node(*(_primitive(m[0])[:1]), 0, _primitive(m[0])[1])
                at += len(m[0]) - 1
            out.nodes.append(node)
            i = len(out.nodes) - 1
            if last >= 0:
                out.edges.append((last, i, kinds))
            last, kinds = i, frozenset({""})
        at += 1
    if open_ or stack:
        raise ParseError(f"query {text} ends too early")
    return out
