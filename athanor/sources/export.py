"""Results as dictionaries, JSON and HTML."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence
from dataclasses import asdict

from ..chem.molecule import Mol, canonical, formula, stable_key
from ..chem.reactions import Emission
from ..chem.search import Counters, Hop, Outcome


def molecule_dict(mol: Mol) -> dict:
    return {"smiles": canonical(mol), "key": stable_key(mol), "formula": dict(sorted(formula(mol).items())), "heavy_atoms": len(mol.atoms)}


def emission_dict(e: Emission) -> dict:
    return {"rule": e.leaf, "path": list(e.path), "pattern": e.pattern, "site": list(e.site), "orbit": list(e.orbit), "products": list(e.texts), "key": e.key, "cleaves": e.cleaves}


def hop_dict(h: Hop) -> dict:
    return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(h).items()}


def outcome_dict(o: Outcome) -> dict:
    """The molecule reached, its hops, and the plan with steps, order and optional sides."""
    return {"smiles": o.smiles, "exact": o.exact, "cost": o.cost, "hops": [hop_dict(h) for h in o.hops], "plan": json.loads(o.plan.to_json()), "orders": o.plan.n_linearizations}


def counters_dict(c: Counters) -> dict:
    return asdict(c) | {"billed": c.billed}


def to_json(found: Sequence[Outcome], count: Counters) -> str:
    return json.dumps({"outcomes": [outcome_dict(o) for o in found], "counters": counters_dict(count)}, sort_keys=True)


def outcomes_html(found: Sequence[Outcome]) -> str:
    """A table with a row per outcome, for notebooks; texts are escaped."""
    rows = "".join(f"<tr><td>{html.escape(o.smiles)}</td><td>{'exact' if o.exact else o.cost}</td><td>{html.escape(' > '.join(h.rule for h in o.hops))}</td><td>{o.plan.n_linearizations}</td></tr>" for o in found)
    return f"<table><tr><th>molecule</th><th>cost</th><th>rules</th><th>orders</th></tr>{rows}</table>"
