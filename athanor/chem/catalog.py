"""The rule catalog: leaf rules, their patterns, and nested catalogs.

A pattern is a query and an edit program (see `query` and `edits`), or the description of one end of a pair.
`site` names the map numbers that identify the place; `adds` and `removes` declare the change of formula for
the bag algebra (H as hydrogens, + and - as charge units).  Names and queries are fixed values, written out as they
are published; an edit program, the sites and the changes of formula are this catalog's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cache


@dataclass(frozen=True)
class Pattern:
    name: str
    query: str
    edit: str = ""  # an edit program, or ">>" and a product template (see `smirks`); empty for an end of a pair
    site: tuple[int, ...] = (1,)
    kind: str = "atom"  # atom, bond, directed bond, atom pair
    end: str = ""  # what happens at this end of a pair
    roles: tuple[int, ...] = ()  # map numbers of an end's (anchor, partner, third)
    adds: str = ""
    removes: str = ""
    leave: int | None = None  # heavy atoms of the fragment that goes
    exclusive: bool = False

    @property
    def cleaves(self) -> bool:
        return "cut" in self.edit or self.edit.startswith(">>") and "." in self.edit or self.end in ("dealkylate", "replace_halogen")

    def delta(self) -> dict[str, int]:
        """The declared change of formula."""
        out: dict[str, int] = {}
        for sign, text in ((1, self.adds), (-1, self.removes)):
            for symbol in re.findall(r"[A-Z][a-z]?|[+*-]", text):
                out[symbol] = out.get(symbol, 0) + sign
        return {k: n for k, n in out.items() if n}


@dataclass(frozen=True)
class Rule:
    """A leaf: patterns in order; `star` labels the conjugate that stands for the added group."""

    name: str
    patterns: tuple[Pattern, ...]
    star: str = ""
    examples: tuple[str, ...] = ()

    def __len__(self) -> int:
        return len(self.patterns)

    def __getitem__(self, name: str) -> Pattern:
        return next(p for p in self.patterns if p.name == name)

    def __contains__(self, name: str) -> bool:
        return any(p.name == name for p in self.patterns)


@dataclass(frozen=True)
class Catalog:
    """A named tree of rules; members keep their order and names are not flattened."""

    name: str
    members: tuple[Rule | Catalog, ...] = field(default_factory=tuple)

    def leaves(self, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Rule]]:
        """(path from the leaf outwards, rule) in order."""
        for m in self.members:
            own = (self.name, *path)
            if isinstance(m, Catalog):
                yield from m.leaves(own)
            else:
                yield (m.name, *own), m

    def compose(self, *others: Rule | Catalog, name: str = "") -> Catalog:
        return Catalog(name or self.name, (*self.members, *others))

    def only(self, *names: str) -> Catalog:
        return Catalog(self.name, tuple(m.only(*names) if isinstance(m, Catalog) else m for m in self.members if isinstance(m, Catalog) or m.name in names))

    def patterns(self) -> Iterator[Pattern]:
        for _, rule in self.leaves():
            yield from rule.patterns

    def __len__(self) -> int:
        return len(self.members)

    def __getitem__(self, name: str) -> Rule | Catalog:
        return next(m for m in self.members if m.name == name)

    def __contains__(self, name: str) -> bool:
        return any(m.name == name for m in self.members)

    def resolve(self, path: list[str]) -> Rule | Catalog | Pattern | None:
        """The member at a path of names, where catalogs on the way may be left out."""
        now: Rule | Catalog | Pattern = self
        for name in path:
            if isinstance(now, Pattern):
                return None
            if isinstance(now, Rule):
                now = now[name] if name in now else None
            elif name in now:
                now = now[name]
            else:
                now = next((r for _, r in now.leaves() if r.name == name), None) or next((m for m in now.members if isinstance(m, Catalog) and name in m), None)
                if isinstance(now, Catalog) and now.name != name:
                    now = now[name]
            if now is None:
                return None
        return now


def atom(name, query, edit, **more):
    return Pattern(name, query, edit, **more)


def bond(name, query, edit, **more):
    return Pattern(name, query, edit, site=more.pop("site", (1, 2)), kind="bond", **more)


def arrow(name, query, edit, **more):
    return Pattern(name, query, edit, site=(1, 2), kind="directed bond", **more)


def pair(name, query, edit, **more):
    return Pattern(name, query, edit, site=(1, 2), kind="atom pair", **more)


def end(name, query, what, roles, site, **more):
    return Pattern(name, query, site=site, kind="atom pair", end=what, roles=roles, **more)


#: What the leaving carbon becomes: the edit, and what it adds.
_LEAVES = {"carboxylic": ("cut 1 2; add 1 =O; add 1 O", "OO"), "carbonyl": ("cut 1 2; add 1 =O", "O"), "alcohol": ("cut 1 2; add 1 O", "OHH")}


def _leaving(name: str, query: str, **more) -> Pattern:
    """A cut of the matched bond; the name's last word says what becomes of the carbon."""
    edit, adds = _LEAVES[name.rpartition("_")[2]]
    return arrow(name, query, edit, adds=adds, leave=1 if name.startswith("methyl_") else None, **more)


_DEALKYLATION = (
    _leaving("methyl_carboxylic", "[#6H3:1][#7,#8H0,#16:2]"),
    _leaving("methyl_carbonyl", "[#6H3:1][#7,#8H0,#16:2]"),
    _leaving("methyl_alcohol", "[#6H3:1][#7,#8H0,#16:2]"),
    _leaving("methylene_carboxylic", "[#6H2:1][#7,#8H0,#16:2]"),
    _leaving("methylene_carbonyl", "[#6H2:1][#7,#8H0,#16:2]"),
    _leaving("methylene_alcohol", "[#6H2:1][#7,#8H0,#16:2]"),
    _leaving("methine_carbonyl", "[#6H1:1][#7,#8H0,#16:2]"),
    _leaving("methine_alcohol", "[#6H1:1][#7,#8H0,#16:2]"),
    _leaving("quaternary_alcohol", "[#6H0:1][#8H0,#16:2]"),
    arrow("quaternary_alcohol_n", "[#6H0:1][#7;!+:2]", "cut 1 2; add 1 O", adds="OHH"),
    arrow("quaternary_alcohol_nitro", "[#6H0:1][#7+:2]", "cut 1 2; add 1 O; charge 2 -", adds="OH", removes="+"),
    _leaving("cc_quaternary_alcohol", "[#6H0:1][#6:2]"),
    _leaving("cc_alcohol", "[#6h1,#6h2,#6h3:1][#6:2]"),
    _leaving("cc_carbonyl", "[#6h1,#6h2,#6h3:1][#6:2]"),
    arrow("hemiaminal", "[#8H1:3]-[#6:1]-[#7,#8,#16:2]", "cut 1 2; bond 3 1 ="),
)
_N_DEALKYLATION = (
    _leaving("methyl_carboxylic", "[#6H3:1][#7:2]"),
    _leaving("methyl_carbonyl", "[#6H3:1][#7:2]"),
    _leaving("methyl_alcohol", "[#6H3:1][#7:2]"),
    _leaving("methylene_carboxylic", "[#6H2:1][#7:2]"),
    _leaving("methylene_carbonyl", "[#6H2:1][#7:2]"),
    _leaving("methylene_alcohol", "[#6H2:1][#7:2]"),
    _leaving("methine_carbonyl", "[#6H1:1][#7:2]"),
    _leaving("methine_alcohol", "[#6H1:1][#7:2]"),
    _leaving("quaternary_alcohol", "[#6H0:1][#7;!+:2]"),
    arrow("quaternary_alcohol_nitro", "[#6H0:1][#7+:2]", "cut 1 2; add 1 O; charge 2 -", adds="OH", removes="+"),
    arrow("hemiaminal", "[#8H1:3]-[#6:1]-[#7:2]", "cut 1 2; bond 3 1 ="),
)


def _trapping(group: str, thiol: bool) -> tuple[Pattern, ...]:
    """Electrophiles that a nucleophile's group takes."""
    g = f"group 1 {group}"
    arms = [
        atom("epoxide_ch", "[#6H1:1]1[#8:2][#6:3]1", f"cut 1 2; {g}", adds="*H"),
        atom("epoxide_ch2", "[#6H2:1]1[#8:2][#6:3]1", f"cut 1 2; {g}", adds="*H"),
        atom("epoxide_c", "[#6H0:1]([!#1:4])1[#8:2][#6:3]1", f"cut 1 2; {g}", adds="*H"),
        atom("halide", "[#6:1][#9,#17,#35,#53:2]", f"cut 1 2; {g}", adds="*H"),
        atom("thiol", "[#16h1:1]", g, adds="*", removes="H"),
        atom("alkene", "[#6H2:1]=[#6:2]", f"bond 1 2 -; {g}", adds="*H"),
        atom("michael", "[#6H1:1]=[#6:2][#6:3]=[#8,#7:4]", f"bond 1 2 -; bond 2 3 =; bond 3 4 -; {g}", adds="*H"),
        atom("carbonyl", "[#6;H1,H2:1]=[#8:2]", f"bond 1 2 -; {g}", adds="*H"),
        atom("aziridine_ch", "[#6H1:1]1[#7:2][#6:3]1", f"cut 1 2; {g}", adds="*H"),
        atom("aziridine_ch2", "[#6H2:1]1[#7:2][#6:3]1", f"cut 1 2; {g}", adds="*H"),
        atom("aziridine_c", "[#6H0:1]([!#1:4])1[#7:2][#6:3]1", f"cut 1 2; {g}", adds="*H"),
        atom("mesylate", "[#6:1][#8:2]S(=O)(=O)", f"cut 1 2; {g}", adds="*H"),
        atom("isocyanate", "[#7:1]=[#6:2]=[#8,#16:3]", f"bond 1 2 -; {g.replace('1', '2', 1)}", adds="*H"),
    ]
    return tuple(p for p in arms if thiol or p.name != "thiol")


@cache
def rules() -> dict[str, Rule]:
    """The leaf rules by name."""
    leaf = [
        Rule("Hydroxylation", (atom("h", "[#6h1:1]", "add 1 O", adds="O"), atom("h2", "[#6h2,#6h3:1]", "add 1 O", adds="O")), examples=("CC", "c1ccccc1")),
        Rule(
            "Dehydrogenation",
            (
                pair("sulfoxide", "[#16v4:1]-[#8H1:2]", "bond 1 2 ="),
                pair("alcohol", "[#6h1,#6h2,#6h3:1]-[#8H1:2]", "bond 1 2 =", removes="HH"),
                pair("amine", "[#6h1,#6h2,#6h3:1]-[#7D1H2,#7D2H1:2]", "bond 1 2 =", removes="HH"),
                pair("alkyl", "[#6h1,#6h2,#6h3:1]-[#6D1H3,#6D2H2,#6D3H1:2]", "bond 1 2 =", removes="HH"),
                end("phenol_end", "[#6:1]-[#8H:2]", "single_to_double", (1, 2), (2,), removes="H"),
                end("amine_end", "[#6:1]-[#7D1H2,#7D2H1:2]", "single_to_double", (1, 2), (2,), removes="H"),
                end("methide_end", "[#6:1]-[#6D1H3,#6D2H2,#6D3H1:2]", "single_to_double", (1, 2), (1,), removes="H"),
            ),
            examples=("CCO", "CCC"),
        ),
        Rule(
            "QuinoneFormation",
            (
                end("single_to_double", "[#6R:1][#8H,#7D1H2,#7D2H1:2]", "single_to_double", (1, 2), (1,), removes="H", exclusive=True),
                end("methide_end", "[#6R:1][#6D1H3,#6D2H2,#6D3H1:2]", "single_to_double", (1, 2), (1,), removes="H"),
                end("add_carbonyl_o", "[#6D2H1;R:1]", "add_carbonyl_o", (1,), (1,), adds="O", removes="H"),
                end("replace_halogen", "[#6H0R:1]-[F,Cl,Br,I:2]", "replace_halogen", (1, 2), (1,), adds="O", exclusive=True),
                end("iminium", "[#6H0R:1][#7D3:2]", "iminium", (1, 2), (1,), adds="+", exclusive=True),
                end("dealkylate", "[#6R:1]~[#7,#8:2]~[#6X3,#6X4:3]", "dealkylate", (1, 2, 3), (1,), adds="H", exclusive=True),
                end("dealkylate_cumulated", "[#6R:1]~[#7,#8:2]=[#6X2:3]=[#7,#8,#16]", "dealkylate", (1, 2, 3), (1,), adds="HHH", exclusive=True),
            ),
            examples=("Oc1ccc(O)cc1",),
        ),
        Rule("Dealkylation", _DEALKYLATION, examples=("CN(C)c1ccccc1",)),
        Rule("NDealkylation", _N_DEALKYLATION, examples=("CN(C)c1ccccc1",)),
        Rule("AzoSplitting", (bond("azo", "[#7:1]=,:[#7:2]", "cut 1 2", adds="HHHH"),), examples=("c1ccccc1N=Nc1ccccc1",)),
        Rule("BenzodioxoleReduction", (arrow("dioxole_methylene", "[#6R:1]-[#8R:2]-[#6H2R:3]-[#8R:4]-[#6R:5]", "cut 2 3; cut 4 3", adds="HHHH"),), examples=("C1Oc2ccccc2O1",)),
        Rule(
            "NitroaromaticReduction",
            (
                arrow("nitro_charged", "[#8-1:1]-[#7+1:2]([#6R:4])=[#8:3]", "cut 1 2; charge 1 +; charge 2 -", adds="HH", removes="+-"),
                arrow("nitro_neutral", "[#8:1]-[#7:2]([#6R:4])=[#8:3]", "cut 1 2; neutral 1; neutral 2", adds="HH"),
            ),
            examples=("O=[N+]([O-])c1ccccc1",),
        ),
        Rule("ThiopheneSulfurOxidation", (atom("thiophene_s_oxide", "[#6:2]1=,:[#6:3][#6:4]=,:[#6:5][#16;v2,v4:1]1", "add 1 O-; charge 1 +; bare 1", adds="O+-"),), examples=("c1ccsc1",)),
        Rule("Dephosphorylation", (atom("phosphate_ester", "[#8;$([#8][#6]):1][#15:2](=[#8:3])([#8:4])[#8:5]", "cut 1 2", adds="HH"),), examples=("COP(=O)(O)O",)),
        Rule("EpoxideOpening", (atom("rearrange", "[#6:1]1[#8:2][#6:3]1", "cut 1 2", adds="HH"), atom("hydrate", "[#6:1]1[#8:2][#6:3]1", "cut 1 2; add 1 O", adds="OHH")), examples=("C1OC1C",)),
        Rule(
            "Hydrolysis",
            (
                bond("add_water", "[#8,#16:1]=[#6:2]-[#7,#16,#8H0:3]", "cut 2 3; add 2 O", site=(2, 3), adds="OHH"),
                bond("cleave", "[#8,#16:1]=[#6:2]-[#7,#8,#16:3]", "cut 2 3", site=(2, 3), adds="HH"),
            ),
            examples=("CC(=O)OC",),
        ),
        Rule(
            "Dehydration",
            (
                atom("alcohol", "[#6,#7:1]-[#8H1:2]", "cut 1 2", adds="HH"),
                atom("beta_elimination", "[#6:3]-[#6X4:1]-[#8H1:2]", "cut 1 2; bond 3 1 ="),
                atom("beta_elimination_acid", "[#6:3]-[#6X3:1]-[#8H1:2]", "cut 1 2; bond 3 1 ="),
                atom("carbonyl", "[#6:1]=[#8:2]", "cut 1 2", adds="HHHH"),
                atom("nitroso", "[#7X2:1]=[#8:2]", "cut 1 2", adds="HHHH"),
                atom("nitro", "[#7+:1]=[#8:2]", "cut 1 2; charge 1 -", adds="HHH", removes="+"),
            ),
            examples=("CCO",),
        ),
        Rule(
            "Hydrogenation",
            (
                pair("alkyne", "[#6:1]#[#6:2]", "bond 1 2 =", adds="HH"),
                pair("alkene", "[#6X3:1]=,:[#6X3:2]", "bond 1 2 -", adds="HH"),
                pair("alkene_cumulene", "[#6:1]=[#6X2:2]=[#8,#7,#16]", "bond 1 2 -", adds="HH"),
                end("path_end", "[*:1]", "saturate", (1,), (1,), adds="H"),
            ),
            examples=("C=CC", "O=C1C=CC(=O)C=C1"),
        ),
        Rule(
            "NitrogenReduction",
            (
                atom("nitro_charged", "[#8:3]=[#7+1:1]-[#8-1:2]", "cut 1 2; charge 1 -; charge 2 +", adds="HH", removes="+-"),
                atom("nitro_anion", "[#8:3]=[#7:1]-[#8-1:2]", "cut 1 2; neutral 1; neutral 2", adds="HH", removes="-"),
                atom("nitro_neutral", "[#8:3]=[#7:1]-[#8:2]", "cut 1 2; neutral 1; neutral 2", adds="HH"),
                atom("nitro_to_amine", "[#7:1](=[#8:2])-[#8:3]", "cut 1 2; cut 1 3; neutral 1; neutral 3", adds="HHHHHH", removes="+-"),
                atom("nitro_both", "[#8:3]=[#7:1]-[#8:2]", "cut 1 2; cut 1 3; neutral 1; neutral 2", adds="HHHHHH", removes="+-"),
                atom("hydroxylamine", "[#7:1]-[#8H1:2]", "cut 1 2", adds="HH"),
                atom("nitroso", "[#7D2:1]=[#8:2]", "cut 1 2", adds="HHHH"),
                atom("nitro_both_any", "[#7:1](~[#8:2])~[#8:3]", "cut 1 2; cut 1 3; neutral 1; neutral 2; neutral 3", adds="HHHHHH", removes="+-"),
            ),
            examples=("O=[N+]([O-])c1ccccc1",),
        ),
        Rule(
            "Tautomerization",
            (
                end("tautomer_h", "[#6,#7,#8:1]-,:[#6h3,#6h2,#6h1,#7h2,#7h1,#8H:2]", "unsaturate", (1, 2), (2,), removes="H"),
                end("path_partner", "[*:1]", "far", (1,), (1,), adds="H"),
            ),
            examples=("CC(C)=O",),
        ),
        Rule(
            "OxygenReduction",
            (
                atom("carbonyl", "[#8:1]=[#6:2]", "bond 1 2 -", adds="HH"),
                atom("nitroso", "[#8:1]=[#7X2:2]", "bond 1 2 -", adds="HH"),
                atom("nitro", "[#8:1]=[#7+:2]", "bond 1 2 -; charge 2 -", adds="H", removes="+"),
                atom("peroxide", "[#8:1]-[#8:2]", "cut 1 2", adds="HH"),
            ),
            examples=("CC=O",),
        ),
        Rule("ReductiveDehalogenation", (atom("cleave", "[#9,#17,#35,#53,#85:1]-[#6:2]", "cut 1 2", adds="HH"), atom("alkene", "[#9,#17,#35,#53,#85:1]-[#6:2]-[#6;!a:3]", "cut 1 2; bond 2 3 =")), examples=("CCCl",)),
        Rule(
            "SulfurReduction",
            (atom("sulfoxide", "[#16:1]=[#8:2]", "cut 1 2", adds="HH"), atom("disulfide", "[#16:1]-[#16:2]", "cut 1 2", adds="HH"), atom("thioether", "[#16:1]-[#6,#8:2]", "cut 1 2", adds="HH")),
            examples=("CS(C)=O",),
        ),
        Rule("Epoxidation", (bond("epoxide", "[#6:1]=[#6,#7:2]", "bond 1 2 -; ring 1 2 O", adds="O"),), examples=("C=C", "c1ccccc1")),
        Rule("EpoxideHydration", (bond("diol", "[#6:1]=[#6,#7:2]", "bond 1 2 -; add 1 O; add 2 O", adds="OOHH"),), examples=("C=C",)),
        Rule(
            "SulfurOxidation",
            (
                atom("zwitterion", "[#16;v2,v4:1]", "add 1 O-; charge 1 +; bare 1", adds="O+-"),
                atom("hydroxy", "[#16;v2,v4:1]", "add 1 O", adds="O"),
                atom("oxo", "[#16;v2,v4:1]", "add 1 =O", adds="O"),
            ),
            examples=("CSC",),
        ),
        Rule(
            "NitrogenOxidation",
            (
                atom("hydroxylamine", "[#7v3h1,#7v3h2:1]", "add 1 O", adds="O"),
                atom("nitroso", "[#7v3H2:1]", "add 1 =O", adds="O", removes="HH"),
                atom("n_oxide", "[#7v3H0,#7X2H0:1]", "add 1 O-; charge 1 +; bare 1", adds="O+-"),
            ),
            examples=("CN(C)C", "c1ccncc1"),
        ),
        Rule(
            "OxidativeDehalogenation",
            (
                atom("alcohol", "[#9,#17,#35,#53,#85:1]-[#6:2]", "cut 1 2; add 2 O", adds="OHH"),
                atom("carbonyl", "[#9,#17,#35,#53,#85:1]-[#6h1:2]", "cut 1 2; add 2 =O", adds="O"),
                atom("carboxylic", "[#9,#17,#35,#53,#85:1]-[#6H2:2]", "cut 1 2; add 2 O; add 2 =O", adds="OO"),
                atom("rearrange", "[#9,#17,#35,#53,#85:1]-[#6:2][#6H1:3]", "cut 1 2; add 2 O; bond 3 1 -", adds="O"),
                atom("gem_carboxylic", "[#9,#17,#35,#53,#85:1]-[#6:2]-[#9,#17,#35,#53,#85:3]", "cut 1 2; cut 2 3; add 2 O; add 2 =O", adds="OOHH"),
                atom("gem_hydrate", "[#9,#17,#35,#53,#85:1]-[#6:2]-[#9,#17,#35,#53,#85:3]", "cut 1 2; cut 2 3; add 2 O; add 2 O", adds="OOHHHH"),
            ),
            examples=("CCCl",),
        ),
        Rule("Acetylation", (atom("acetyl", "[#7h1,#7h2,#8h1,#16h1:1]", "group 1 acetyl", adds="*", removes="H"),), "Ac", examples=("CCO",)),
        Rule(
            "Sulfation",
            (
                atom("alcohol", "[#6:1][#8H1:2]", "group 2 sulfo", site=(2,), adds="*", removes="H"),
                atom("epoxide_methyl_sulfone", "[#6:1]1=[#6:2][#6:3]2[#8:7][#6:4]2[#6:5]=[#6:6]1", "cut 3 7; cut 4 7; drop 7; bond 3 4 =; group 4 methylsulfonyl", adds="*", removes="HO"),
            ),
            "SO3H",
            examples=("CCO",),
        ),
        Rule(
            "Glucuronidation",
            (atom("alcohol", "[#8H1:1][#6:2]", "group 1 glucuronyl", adds="*", removes="H"), atom("carboxylate", "[#8H1,#8-:1][#6:2](=[#8:3])[#6:4]", "neutral 1; group 1 glucuronyl", adds="*", removes="H")),
            "Glc",
            examples=("CCO",),
        ),
        Rule("Glutathionation", _trapping("glutathionyl", True), "GS", examples=("C1OC1C",)),
        Rule("GlutathionationNoThiol", _trapping("glutathionyl", False), "GS", examples=("C1OC1C",)),
        Rule("GSH", _trapping("glutathionyl", True), "GSH", examples=("C1OC1C",)),
        Rule("Protein", _trapping("protein", True), "Protein", examples=("C1OC1C",)),
        Rule("DNA", _trapping("dna", False), "DNA", examples=("C1OC1C",)),
        Rule("Cyanide", _trapping("cyano", False), "CN", examples=("C1OC1C",)),
    ]
    return {r.name: r for r in leaf}


def leaf(name: str) -> Rule:
    return rules()[name]


def _set(name: str, *names: str) -> Catalog:
    return Catalog(name, tuple(rules()[n] for n in names))


@cache
def catalogs() -> dict[str, Catalog]:
    """The composed catalogs by name."""
    stable = _set("StableOxygenation", "Hydroxylation", "Epoxidation", "NitrogenOxidation", "SulfurOxidation")
    unstable = _set("UnstableOxygenation", "Dealkylation", "OxidativeDehalogenation")
    dehydrogenation = _set("Dehydrogenation", "Dehydrogenation")
    hydrolysis = _set("Hydrolysis", "Dephosphorylation", "EpoxideOpening", "Hydrolysis")
    reduction = _set("Reduction", "Hydrogenation", "Dehydration", "NitrogenReduction", "SulfurReduction", "OxygenReduction", "ReductiveDehalogenation")
    core = Catalog("PhaseOneCore", (stable, unstable, dehydrogenation, hydrolysis, reduction))
    r = rules()
    conjugation = _set("Conjugation", "Acetylation", "Glucuronidation", "Glutathionation", "Sulfation")
    phase_one = core.compose(r["QuinoneFormation"], r["EpoxideHydration"], name="PhaseOne")
    return {
        c.name: c
        for c in (
            stable, unstable, dehydrogenation, hydrolysis, reduction, core, phase_one,
            phase_one.compose(r["Tautomerization"], name="Default"),
            replace(phase_one, name="ProductGraph"),
            _set("Reactivity", "GSH", "Protein", "DNA", "Cyanide"),
            _set("All", *r),
            # The older named sets; conjugation has the four adducts, bioactivation the routes to reactive products.
            replace(core, name="PhaseOneRS"),
            Catalog("PhaseOneQF", (r["QuinoneFormation"], replace(core, name="PhaseOneRS"))),
            conjugation, replace(conjugation, name="CJ"), _set("TT", "Tautomerization"), _set("TSO", "ThiopheneSulfurOxidation"),
            _set("Bioactivation", "QuinoneFormation", "Epoxidation", "ThiopheneSulfurOxidation", "NitroaromaticReduction"),
            Catalog("Full", (stable, unstable, dehydrogenation, replace(hydrolysis, members=(*hydrolysis.members, r["AzoSplitting"])), replace(reduction, members=(*reduction.members, r["BenzodioxoleReduction"])), conjugation, r["QuinoneFormation"], r["Tautomerization"])),
        )
    }


def resolve(name: str) -> Rule | Catalog:
    """A leaf rule or a catalog by name; a leaf goes before a group of its name."""
    return rules().get(name) or catalogs()[name]


def o_dealkylation() -> Rule:
    """Loss of a methyl group from oxygen, as formic acid, alone."""
    return Rule("Dealkylation", (arrow("O-Me", "[#6H3:1][#8H0:2]", "cut 1 2; add 1 =O; add 1 O", adds="OO", leave=1),), examples=("COc1ccccc1",))


#: The five classes of phase I by the catalogs that hold them, with their colours.
COLOURS = {
    "StableOxygenation": ("SO", "#D55E00"),
    "UnstableOxygenation": ("UO", "#E69F00"),
    "Dehydrogenation": ("DH", "#009E73"),
    "Hydrolysis": ("HD", "#56B4E9"),
    "Reduction": ("RD", "#CC79A7"),
}


def colour_labels(path: tuple[str, ...]) -> tuple[str, ...]:
    """The classes on an emission's path of names, leaf first; a leaf that has a class's name counts by its catalog."""
    return tuple(COLOURS[name][0] for name in path[1:] if name in COLOURS)


def rule_from_rows(name: str, rows: list[dict]) -> Rule:
    """A rule of the user's own from rows (name, query, edit and further fields of a pattern), as a table or JSON holds them."""
    patterns = []
    for row in rows:
        more = {k: tuple(v) if isinstance(v, list) else v for k, v in row.items() if v is not None}
        patterns.append(Pattern(**more))
    return Rule(name, tuple(patterns))


def identifier(rule: str, pattern: str = "", prefix: str = "x") -> str:
    """A rule's, catalog's or pattern's compact identifier; an unknown one is an error."""
    if pattern and pattern not in rules()[rule]:
        raise KeyError(pattern)
    return f"{prefix}:{resolve(rule).name}" + (f"/{pattern}" if pattern else "")


def rule_from_smirks(name: str, **patterns: str) -> Rule:
    """A rule of the user's own from SMIRKS texts by pattern name; the first map number is the site."""
    return Rule(name, tuple(Pattern(n, text.split(">>")[0], ">>" + text.split(">>")[1]) for n, text in patterns.items()))


def bound(rule: str, pattern: str) -> Rule:
    """The rule with one of its patterns alone (an end of a pair meets only ends of that pattern)."""
    whole = rules()[rule]
    return replace(whole, patterns=(whole[pattern],))


def paths() -> dict[str, str]:
    """Every path of names that leads somewhere, from a leaf or a catalog on, with what is there."""
    out: dict[str, str] = {}

    def walk(at: Rule | Catalog, path: str) -> None:
        out[path] = "rule" if isinstance(at, Rule) else "catalog"
        if isinstance(at, Rule):
            out.update({f"{path}/{p.name}": "pattern" for p in at.patterns})
        else:
            for m in at.members:
                walk(m, f"{path}/{m.name}")

    for c in catalogs().values():
        walk(c, c.name)
    for r in rules().values():
        walk(r, r.name)
    return out


def as_catalog(what: str | Rule | Catalog | list[str]) -> Catalog:
    if isinstance(what, list | tuple):
        return _set("Chosen", *what)
    found = resolve(what) if isinstance(what, str) else what
    return found if isinstance(found, Catalog) else Catalog(found.name, (found,))
