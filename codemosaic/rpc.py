"""JSON-RPC 2.0 over lines of standard input and output: the engine's questions as tools."""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from typing import Any, TextIO

from .api import Engine, FileError, read_text
from .functions.languages import language_named

PROTOCOL, NAME, VERSION = "2024-11-05", "codemosaic", "1.0.0"

_LANGUAGES = ["rust", "typescript", "javascript", "tsx", "jsx", "svelte", "astro", "vue", "python"]
_TEXT, _DEPTH, _BOOL, _OBJECT, _LANG = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}, {"type": "object"}, {"type": "string", "enum": _LANGUAGES}


class Missing(Exception):
    """An argument that a tool cannot do without."""


class Tools:
    """name -> (what it does, arguments, those required, function of the arguments)."""

    def __init__(self, engine: Engine):
        e = self.engine = engine
        self.table: dict[str, tuple[str, dict, list[str], Callable[[dict], Any]]] = {
            "check_safety": ("Checks code or a file against the safety passes; reports the first violation.", {"path": _TEXT, "code": _TEXT}, [], self._check),
            "skeletonize": ("Signatures of code in place of its bodies.", {"code": _TEXT, "language": _LANG}, ["code"], lambda a: e.skeletonize(a["code"], a.get("language", "rust"))),
            "patch_symbol": ("Replaces a symbol's declaration within a source text.", {"source": _TEXT, "symbol": _TEXT, "new_code": _TEXT, "language": _LANG}, ["source", "symbol", "new_code"], self._patch),
            "index_graph": ("Indexes a folder: counts and symbols.", {"path": _TEXT}, ["path"], lambda a: e.index_graph(a["path"])),
            "synthesize_contract": ("Names, scaffolding and invariants for a statement of intent.", {"intent": _TEXT, "target_path": _TEXT, "context": _TEXT, "language": _LANG}, ["intent"], lambda a: e.synthesize_contract(a["intent"], a.get("target_path"), a.get("language", "rust"))),
            "extract_intent_slice": ("A symbol with what it needs, from code, a file or a folder.", {"symbol": _TEXT, "code": _TEXT, "path": _TEXT, "depth": _DEPTH, "language": _LANG}, ["symbol"], self._slice),
            "verify_contract": ("Checks code against a contract.", {"generated_code": _TEXT, "contract": _OBJECT, "intent": _TEXT, "language": _LANG}, ["generated_code"], self._verify),
            "resolve_symbol": ("Where a symbol is declared.", {"symbol": _TEXT, "from_file": _TEXT, "target_path": _TEXT}, ["symbol"], lambda a: e.resolve_symbol(a["symbol"], a.get("from_file"), a.get("target_path", "."))),
            "get_blast_radius": ("What depends on a symbol, and the risk of changing it.", {"symbol": _TEXT, "file": _TEXT, "path": _TEXT, "depth": _DEPTH}, ["symbol"], lambda a: e.blast_radius(a["symbol"], a.get("file"), a.get("path", "."), a.get("depth", 2))),
            "find_references": ("All lines that name a symbol.", {"symbol": _TEXT, "target_path": _TEXT}, ["symbol"], lambda a: e.find_references(a["symbol"], a.get("target_path", "."))),
            "prepare_context": ("A file's skeleton and, for a symbol, its slice, declaration and dependents.", {"target_file": _TEXT, "symbol": _TEXT, "depth": _DEPTH, "budget": _DEPTH}, ["target_file"], lambda a: e.prepare_context(a["target_file"], a.get("symbol"), a.get("depth", 2))),
            "verified_patch": ("Checks new code, puts it into a file, checks the whole, and writes it.", {"file_path": _TEXT, "symbol": _TEXT, "new_code": _TEXT, "language": _LANG, "dry_run": _BOOL}, ["file_path", "symbol", "new_code"], lambda a: e.verified_patch(a["file_path"], a["symbol"], a["new_code"], a.get("language"), a.get("dry_run", False))),
        }

    def listing(self) -> list[dict]:
        out = []
        for name, (what, arguments, required, _) in self.table.items():
            schema: dict = {"type": "object", "properties": arguments}
            if required:
                schema["required"] = required
            out.append({"name": name, "description": what, "inputSchema": schema})
        return out

    def call(self, name: str, given: Any) -> dict:
        if name not in self.table:
            return _content(f"Unknown tool: {name}", True)
        _, kinds, required, run = self.table[name]
        python = {"string": str, "integer": int, "boolean": bool, "object": dict}
        arguments = {k: v for k, v in (given or {}).items() if k not in kinds or isinstance(v, python[kinds[k]["type"]])} if isinstance(given, dict) else {}
        began = time.monotonic()
        try:
            for r in required:
                if r not in arguments:
                    raise Missing(f"Argument '{r}' is missing")
            out = run(arguments)
        except (Missing, FileError) as e:
            return _content(str(e), True)
        if isinstance(out, dict) and name in ("prepare_context", "verified_patch", "check_safety", "get_blast_radius"):
            out = out | {"latency_ms": (time.monotonic() - began) * 1000}
        return _content(out if isinstance(out, str) else json.dumps(out, indent=2), isinstance(out, dict) and out.get("success") is False)

    def _check(self, a: dict) -> dict:
        if "code" not in a and "path" not in a:
            raise Missing("Give one of the arguments 'code' and 'path'")
        return self.engine.check_safety(a["code"] if "code" in a else read_text(a["path"]))

    def _patch(self, a: dict) -> str:
        out = self.engine.patch_symbol(a["source"], a["symbol"], a["new_code"], a.get("language", "rust"))
        if out["error"]:
            raise Missing(f"Not patched: {out['error']}")
        return out["patched"]

    def _slice(self, a: dict) -> dict:
        depth, language = a.get("depth", 2), a.get("language", "rust")
        if "code" in a:
            return self.engine.slice_code(a["code"], a["symbol"], depth, language)
        if "path" not in a:
            raise Missing("Give one of the arguments 'code' and 'path' to slice")
        if os.path.isdir(a["path"]):
            return self.engine.slice_corpus(a["path"], a["symbol"], depth)
        return self.engine.slice_code(read_text(a["path"]), a["symbol"], depth, os.path.splitext(a["path"])[1][1:] or language)

    def _verify(self, a: dict) -> dict:
        language, given = a.get("language", "rust"), a.get("contract")
        if isinstance(given, dict) and {"intent", "language", "primary_symbol", "required_symbols"} <= given.keys():
            contract = given | {"language": language_named(str(given["language"]))}
        elif isinstance(given, dict):
            # What is meant where nothing says so (fixed value).
            contract = self.engine.synthesize_contract(str(given.get("intent", "general implementation")), None, language)
        elif "intent" in a:
            contract = self.engine.synthesize_contract(a["intent"], None, language)
        else:
            contract = self.engine.synthesize_contract("verified component", None, "rust")
        return self.engine.verify_contract(a["generated_code"], contract)


def _content(text: str, failed: bool = False) -> dict:
    return {"content": [{"type": "text", "text": text}]} | ({"isError": True} if failed else {})


def handle(tools: Tools, raw: str) -> str | None:
    """The answer to one message; None to a notification that needs none. A null id counts as no id."""
    try:
        request = json.loads(raw)
        method, number = request["method"], request.get("id")
        if not isinstance(method, str):
            raise TypeError("method is no text")
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": f"Parse error: {e}"}})
    answer = lambda **what: json.dumps({"jsonrpc": "2.0", "id": number} | what)
    if method == "initialize":
        return answer(result={"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": NAME, "version": VERSION}})
    if method == "ping":
        return answer(result={})
    if method == "tools/list":
        return answer(result={"tools": tools.listing()})
    if method == "tools/call":
        params = request.get("params") if isinstance(request.get("params"), dict) else {}
        return answer(result=tools.call(params.get("name") if isinstance(params.get("name"), str) else "", params.get("arguments")))
    if number is None:
        return None
    if method in ("initialized", "notifications/initialized"):
        return answer(result={})
    return answer(error={"code": -32601, "message": f"Method not found: {method}"})


def serve(engine: Engine, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    """Answer messages, one a line, until the input ends."""
    tools = Tools(engine)
    for line in source:
        if line.strip() and (out := handle(tools, line.strip())) is not None:
            sink.write(out + "\n")
            sink.flush()
