"""Command line: products of a molecule, or walks from one to another.

    python -m athanor products "CCO" --rules PhaseOne --depth 1
    python -m athanor find "c1ccccc1" "O=C1C=CC(=O)C=C1" --max-nodes 200 --max-paths 2
"""

from __future__ import annotations

import argparse

from .chem.molecule import ParseError
from .chem.search import Search, find_path, product_graph


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="athanor")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("products")
    one.add_argument("molecule")
    one.add_argument("--depth", type=int, default=1)
    two = commands.add_parser("find")
    two.add_argument("molecule")
    two.add_argument("target")
    two.add_argument("--max-paths", type=int, default=1)
    two.add_argument("--timeout", type=float, default=60.0)
    two.add_argument("--partial", action="store_true")
    for p, nodes in ((one, 1000), (two, 200)):
        p.add_argument("--rules", default="PhaseOne")
        p.add_argument("--max-nodes", type=int, default=nodes)
    a = parser.parse_args(argv)
    try:
        if a.command == "products":
            depth, edges = product_graph(a.molecule, a.rules, a.max_nodes, a.depth)
            for src, dst, rule, pattern in edges:
                print(depth[dst], src, dst, rule, pattern, sep="\t")
            return 0
        hits, count = find_path(a.molecule, a.target, a.rules, Search(a.max_paths, a.max_nodes, a.timeout, a.partial))
    except ParseError as error:
        parser.error(str(error))
    for h in hits:
        print("exact" if h.exact else f"cost {h.cost}", h.smiles, " > ".join(f"{x.rule}.{x.pattern}" for x in h.hops), f"orders {h.plan.n_linearizations}", sep="\t")
    print(f"{count.nodes} molecules opened, {count.edits} edits")
    return int(not any(h.exact for h in hits))


if __name__ == "__main__":
    raise SystemExit(main())
