"""Command line: check, skeleton, contract, slice, graph, impact, refs, patch, mcp."""

from __future__ import annotations

import argparse
import os
import sys

from .api import Engine, FileError, read_text
from .sources.code_files import write_text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codemosaic", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *places: [c := sub.add_parser(name), [c.add_argument(x) for x in places]][0]
    add("check", "file")
    add("skeleton", "file")
    c = add("contract", "intent")
    c.add_argument("--lang", default="rust")
    c.add_argument("--target")
    add("slice", "symbol", "file").add_argument("--depth", type=int, default=2)
    add("graph", "dir")
    add("impact", "symbol", "path").add_argument("--depth", type=int, default=2)
    add("refs", "symbol", "dir")
    c = add("patch", "file")
    c.add_argument("--symbol", required=True)
    c.add_argument("--with", dest="new_code", required=True)
    sub.add_parser("mcp")
    return p


def _language(path: str) -> str:
    return os.path.splitext(path)[1][1:]


def main(argv: list[str], engine: Engine) -> int:
    """Runs a command; 0 if it went well, 2 for a safety violation, 1 for other failures."""
    a = parser().parse_args(argv)
    try:
        return _run(a, engine)
    except FileError as e:
        print(e, file=sys.stderr)
        return 1


def _run(a: argparse.Namespace, engine: Engine) -> int:
    if a.command == "check":
        r = engine.check_safety(read_text(a.file))
        print("passed" if r["passed"] else f"{r['violation']}: {r['detail']}")
        return 0 if r["passed"] else 2
    if a.command == "skeleton":
        print(engine.skeletonize(read_text(a.file), _language(a.file)))
    elif a.command == "contract":
        made = engine.synthesize_contract(a.intent, a.target, a.lang)
        print(made["type_scaffolding"], *(f"- {x}" for x in made["invariant_checklist"]), sep="\n")
    elif a.command == "slice":
        print(engine.slice_code(read_text(a.file), a.symbol, a.depth, _language(a.file))["sliced_code"])
    elif a.command == "graph":
        h = engine.health(a.dir)
        print(f"files {h['total_files']}, symbols {h['total_symbols']}, edges {h['total_edges']}")
        print(f"cycles {len(h['circular_dependencies'])}", *(" -> ".join(c) for c in h["circular_dependencies"]), sep="\n  ")
        print(f"orphan exports {len(h['orphan_exports'])}", *h["orphan_exports"][:5], sep="\n  ")
    elif a.command == "impact":
        file, root = (None, a.path) if os.path.isdir(a.path) else (a.path, os.path.dirname(a.path) or ".")
        r = engine.blast_radius(a.symbol, file, root, a.depth)
        print(f"{r['symbol']} ({r['origin_file']}): risk {r['risk_score']}, references {r['reference_count']}")
        for title in ("direct_dependents", "transitive_dependents", "affected_files"):
            print(f"{title} {len(r[title])}", *r[title], sep="\n  ")
    elif a.command == "refs":
        found = engine.find_references(a.symbol, a.dir)
        print(f"{len(found)} references", *(f"{r['file']}:{r['line']}: {r['context_snippet']}" for r in found), sep="\n  ")
    elif a.command == "patch":
        new = read_text(a.new_code) if os.path.isfile(a.new_code) else a.new_code
        out = engine.patch_symbol(read_text(a.file), a.symbol, new, _language(a.file))
        if out["error"]:
            print(out["error"], file=sys.stderr)
            return 1
        write_text(a.file, out["patched"])
        print(f"patched {a.symbol} in {a.file}")
    else:
        from .rpc import serve

        serve(engine)
    return 0
