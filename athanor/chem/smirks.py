"""Edits written as a product template after ">>", as in SMIRKS.

Atoms of the template are [*:n], the matched atom n with what the brackets change of it (charge, H0), or new ones ([#8], O,
[O-]).  Bonds are as in queries; an unmarked bond or "-,:" between matched atoms keeps what they have where the query leaves
that open, and is single otherwise.  Bonds between matched atoms that only the query has are cut, matched atoms that only the query has go.
Charges follow the bonds that an atom loses, so that shells stay closed.  Parts may stand in one pair of parentheses.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import cache

from .edits import refill
from .molecule import NUMBER, Atom, Mol, ParseError
from .query import parse_query

_ORDERS = {"-": 1, "=": 2, "#": 3}
_INNER = re.compile(r"^(?:#(\d+)|(\*)|([A-Z][a-z]?))((?:&?(?:H\d*|[+-]\d*))*)(?::(\d+))?$")


@dataclass
class Template:
    numbers: list[int] = field(default_factory=list)  # the map number, or 0 for a new atom
    elements: list[int] = field(default_factory=list)  # 0: as matched
    charges: list[int | None] = field(default_factory=list)
    bare: list[bool] = field(default_factory=list)  # without hydrogens
    bonds: dict[tuple[int, int], int | None] = field(default_factory=dict)  # None: as it was, or single


@cache
def parse_template(text: str) -> Template:
    if text.startswith("(") and text.endswith(")") and _closes(text) == len(text) - 1:
        text = text[1:-1]
    out, stack, open_ = Template(), [], {}
    last, order, at = -1, None, 0
    while at < len(text):
        c = text[at]
        if c == "(":
            stack.append(last)
        elif c == ")":
            last = stack.pop()
        elif c == ".":
            last = -1
        elif c in _ORDERS:
            order = _ORDERS[c]
            if text[at : at + 3] == "-,:":
                order, at = None, at + 2
        elif c.isdigit():
            if c in open_:
                a, o = open_.pop(c)
                out.bonds[min(a, last), max(a, last)] = order if order is not None else o
            else:
                open_[c] = last, order
            order = None
        else:
            if c == "[":
                end = text.index("]", at)
                m = _INNER.match(text[at + 1 : end])
                if not m:
                    raise ParseError(f"template atom {text[at : end + 1]} not supported")
                z, star, symbol, marks, number = m.groups()
                charge = re.search(r"([+-])(\d*)", marks)
                out.numbers.append(int(number or 0))
                out.elements.append(int(z) if z else 0 if star else NUMBER[symbol])
                out.charges.append((1 if charge[1] == "+" else -1) * int(charge[2] or 1) if charge else None)
                out.bare.append("H0" in marks)
                at = end
            else:
                m = re.match(r"Cl|Br|[A-Z]", text[at:])
                if not m or m[0] not in NUMBER:
                    raise ParseError(f"template {text} not supported at {at}")
                out.numbers.append(0)
                out.elements.append(NUMBER[m[0]])
                out.charges.append(None)
                out.bare.append(False)
                at += len(m[0]) - 1
            i = len(out.numbers) - 1
            if last >= 0:
                out.bonds[last, i] = order
            last, order = i, None
        at += 1
    if open_ or stack:
        raise ParseError(f"template {text} ends too early")
    return out


def _closes(text: str) -> int:
    """Where the parenthesis that opens the text closes."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if not depth:
            return i
    return -1


def apply_template(mol: Mol, query: str, template: str, mapped: dict[int, int]) -> Mol | None:
    """The molecule after the change from the query to the template at the matched atoms, parts together."""
    t, q = parse_template(template), parse_query(query)
    out = mol.copy()
    at: list[int] = []
    for number, z, charge in zip(t.numbers, t.elements, t.charges):
        if number:
            at.append(mapped[number])
        else:
            at.append(out.add(Atom(z, charge or 0)))
    made = {(min(at[a], at[b]), max(at[a], at[b])): o for (a, b), o in t.bonds.items()}
    for a, b, kinds in q.edges:
        one, two = q.nodes[a].number, q.nodes[b].number
        if one and two and one in t.numbers and two in t.numbers:
            pair = min(mapped[one], mapped[two]), max(mapped[one], mapped[two])
            if pair not in made:
                out.set_bond(*pair, 0)
            elif made[pair] is None and not kinds & {"", "-", ":", "~"}:
                made[pair] = 1
    for (a, b), order in made.items():
        out.set_bond(a, b, order if order is not None else max(out.order(a, b), 1))
    gone = {mapped[n] for n in mapped if n not in t.numbers}
    for i in gone:
        for j in list(out.near(i)):
            out.set_bond(i, j, 0)
    given = {at[k]: c for k, c in enumerate(t.charges) if t.numbers[k] and c is not None}
    for i in set(at):
        a = out.atoms[i]
        if i in given:
            out.atoms[i] = replace(a, charge=given[i])
        elif i < len(mol.atoms) and a.charge:
            lost = mol.bond_sum(i) - out.bond_sum(i)
            out.atoms[i] = replace(a, charge=max(0, a.charge - lost) if a.charge > 0 else min(0, a.charge + lost))
    refill(out, [i for i in set(at) if out.atoms[i].z])
    for k, i in enumerate(at):
        if t.bare[k]:
            out.atoms[i] = replace(out.atoms[i], h=0)
    return out.subset(i for i in range(len(out.atoms)) if i not in gone) if gone else out
