"""Symbols and imports of source files: files(path, language, content) -> rows.

One Arrow generator reads each file once and gives its declarations with byte spans; everything that follows (which of equal
symbols stands, doc comments, exports) is DataFrame work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bounded
from ..functions.hashing import fnv1a64
from ..functions.languages import FRONTEND
from ..functions.strings import ByteOffsets
from . import scanners

# Declarations of a line: (pattern behind the white space that begins it, kind), in the order in which they are extracted (fixed
# values). VISIBLE stands for ``pub`` with or without a list in parentheses, ARROW for what follows the name of an arrow function:
# both may run on to a character far away, which a pattern would look for anew at every line.
VISIBLE, ARROW = object(), object()
RUST = (
    (VISIBLE, r"(?:async\s+)?fn\s+([a-zA-Z_][a-zA-Z0-9_]*)", "Function"),
    (VISIBLE, r"struct\s+([a-zA-Z_][a-zA-Z0-9_]*)", "Struct"),
    (VISIBLE, r"enum\s+([a-zA-Z_][a-zA-Z0-9_]*)", "Enum"),
    (VISIBLE, r"trait\s+([a-zA-Z_][a-zA-Z0-9_]*)", "Trait"),
    (VISIBLE, r"type\s+([a-zA-Z_][a-zA-Z0-9_]*)", "TypeAlias"),
)
TYPESCRIPT = (
    (None, r"(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s+([a-zA-Z_$][a-zA-Z0-9_$]*)", "Function"),
    (ARROW, r"(?:export\s+)?(?:const|let|var)\s+([a-zA-Z_$][a-zA-Z0-9_$]*+)\s*+(:)?", "Function"),
    (None, r"(?:export\s+(?:default\s+)?)?class\s+([a-zA-Z_$][a-zA-Z0-9_$]*)", "Struct"),
    (None, r"(?:export\s+)?interface\s+([a-zA-Z_$][a-zA-Z0-9_$]*)", "Trait"),
    (None, r"(?:export\s+)?type\s+([a-zA-Z_$][a-zA-Z0-9_$]*)", "TypeAlias"),
)
PYTHON = (
    (None, r"(?:async\s+)?def\s+([a-zA-Z_][a-zA-Z0-9_]*)", "Function"),
    (None, r"class\s+([a-zA-Z_][a-zA-Z0-9_]*)", "Struct"),
)
# Imports, behind the white space that begins a line; a ``use`` runs on to the next semicolon (fixed values).
RUST_USE, RUST_MOD = r"(?:pub\s+)?use\s+((?s:.+))\z", r"(?:pub\s+)?mod\s+([a-zA-Z_][a-zA-Z0-9_]*);"
TYPESCRIPT_IMPORTS = (r"""import\s+[^;\n]+?from\s*['"]([^'"]+)['"]""", r"""export\s+(?:\*|\{[^}]*\})\s*from\s*['"]([^'"]+)['"]""")
PYTHON_IMPORTS = (r"(?:from\s+([a-zA-Z0-9_.]+)\s+import\s+[^#\n]+|import\s+([a-zA-Z0-9_.]+))",)

#: Kind -> what it is called in reports (fixed values).
DISPLAY = {"Function": "fn", "Struct": "struct", "Enum": "enum", "Trait": "trait", "TypeAlias": "type", "Const": "const", "Impl": "impl", "Module": "mod"}

SYMBOLS = "symbol_id string, name string, kind string, file string, byte_start long, byte_end long, signature string, pattern_ord int, text string, doc_comment string"

_PATTERNS = {"rust": RUST, "python": PYTHON} | dict.fromkeys(FRONTEND, TYPESCRIPT)
_LINE = r"(?m)^[^\S\n]*+"
_HEADS = {VISIBLE: lambda p: rf"{_LINE}(?:(pub\()|(?:pub\s+)?{p})", ARROW: lambda p: _LINE + p, None: lambda p: _LINE + p}
_COMPILED = {language: [(how, re.compile(_HEADS[how](p)), re.compile(rf"\s+{p}"), kind) for how, p, kind in patterns] for language, patterns in _PATTERNS.items()}
_BLANK_LINES = re.compile(r"(?m)^(?:[^\S\n]*+\n)+")
_ARROW = re.compile(r"\s*(?:async\s*)?(?:(\()|[a-zA-Z_$][a-zA-Z0-9_$]*\s*=>)")
_ARROW_END = re.compile(r"\s*=>")


class _Next:
    """Where a character comes next, asked for ascending places: each stretch of the text is read once."""

    def __init__(self, text: str, c: str):
        self.text, self.c, self.at = text, c, -1

    def __call__(self, start: int) -> int:
        if self.at < start:
            found = self.text.find(self.c, start)
            self.at = len(self.text) if found < 0 else found
        return self.at


def _found(content: str, how: object, head: re.Pattern, rest: re.Pattern) -> Iterator[tuple[int, str]]:
    """(start of the line, name) of the declarations of one pattern, none within another."""
    close, equals = _Next(content, ")"), _Next(content, "=")
    at, n = 0, len(content)
    while m := head.search(content, at):
        end, name = m.end(), m[1]
        if how is VISIBLE:
            name = m[2]
            if m[1]:
                stop = close(end)
                listed = rest.match(content, stop + 1) if end < stop < n else None
                end, name = (listed.end(), listed[1]) if listed else (0, None)
        elif how is ARROW:
            end = _arrow_end(content, m, close, equals)
        if end and name:
            yield m.start(), name
            at = end
        else:  # the next line may begin one
            at = content.find("\n", m.start()) + 1
            if not at:
                return


def _arrow_end(content: str, m: re.Match, close: _Next, equals: _Next) -> int:
    """Where the arrow function whose name ends here has its arrow; 0 if it is none."""
    value = m.end()
    if m[2]:  # a type: up to the next equals sign
        value = equals(m.end())
        if value == m.end():
            return 0
    if content[value : value + 1] != "=":
        return 0
    value = _ARROW.match(content, value + 1)
    if value and value[1]:
        stop = close(value.end())
        value = _ARROW_END.match(content, stop + 1) if stop < len(content) else None
    return value.end() if value else 0


def declarations(path: str, language: str, content: str, with_text: bool = True, with_docs: bool = False) -> list[tuple]:
    """Rows of SYMBOLS of one file; texts and doc comments only where wanted. In time linear in the file."""
    out = []
    offset = structure = blank = None  # read on the first declaration
    for order, (how, head, rest, kind) in enumerate(_COMPILED.get(language, ())):
        for line, name in _found(content, how, head, rest):
            if structure is None:
                structure, offset = (scanners.Indents if language == "python" else scanners.Structure)(content), ByteOffsets(content)
                blank = {m.end(): m.start() for m in _BLANK_LINES.finditer(content)}
            start = blank.get(line, line)  # a declaration begins with the blank lines before it
            end = structure.closing(start)
            marks = ":" if language == "python" else "{;" if language == "rust" else ""
            if marks:
                stop = next((i for c in marks if (i := content.find(c, start, end)) >= 0), None)
                signature = _whole(content, start, line, head, rest, how) if stop is None else content[start:stop].strip()
            else:
                signature = content[start : structure.signature(start, end)].strip()
            docs = _doc_comment(content, start) if with_docs else None
            out.append((fnv1a64(f"{path}:{name}:{kind}".encode()), name, kind, path, offset(start), offset(end), signature, order, content[start:end] if with_text else None, docs))
    return out


def _whole(content: str, start: int, line: int, head: re.Pattern, rest: re.Pattern, how: object) -> str:
    """What the pattern matched, with the blank lines before it."""
    m = head.match(content, line)
    if how is VISIBLE and m[1]:
        m = rest.match(content, content.find(")", m.end()) + 1)
    return content[start : m.end()]


def extract_symbols(files: DataFrame, with_text: bool = False, with_docs: bool = False) -> DataFrame:
    """All declarations of files(path, language, content); null content has none. with_text: also their whole text; with_docs:
    also the doc comment before each."""
    names = [c.split()[0] for c in SYMBOLS.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in SYMBOLS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "content"):
            rows = [r for p, lang, c in zip(*(x.to_pylist() for x in b.columns), strict=True) if c for r in declarations(p, lang, c, with_text, with_docs)]
            for i in range(0, len(rows), 4096):
                part = zip(*rows[i : i + 4096], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, types, strict=True)], names)

    found = files.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), "language", "content").mapInArrow(run, SYMBOLS)
    return found.drop(*[c for c, wanted in (("text", with_text), ("doc_comment", with_docs)) if not wanted])


def nodes_of(symbols: DataFrame) -> DataFrame:
    """One row per symbol id: of equal ids the last pattern's last declaration stands."""
    rest = [c for c in symbols.columns if c not in ("symbol_id", "pattern_ord", "byte_start")]
    last = F.max_by(F.struct("pattern_ord", "byte_start", *rest), F.struct("pattern_ord", "byte_start")).alias("s")
    return symbols.groupBy("symbol_id").agg(last).select("symbol_id", "s.*").select(*symbols.columns)


def display_kind(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in DISPLAY.items() for x in pair])[kind]


def is_exported(signature: Column) -> Column:
    starts = signature.startswith("pub ") | signature.startswith("pub(") | signature.startswith("export ")
    return starts | signature.contains("export function") | signature.contains("export const")


def _doc_comment(content: str, end: int) -> str | None:
    """The comment lines that end before a place; blank lines between are passed over."""
    docs: list[str] = []
    while end >= 0:
        begin = content.rfind("\n", 0, end) + 1
        text = content[begin:end].strip()
        if text.startswith(("///", "//!", "*")):
            docs.append(text)
        elif text:
            break
        end = begin - 1
    return "\n".join(reversed(docs)) or None


def resolved(nodes: DataFrame) -> DataFrame:
    """Nodes of symbols that were extracted with their doc comments, and is_exported."""
    return nodes.select(*[c for c in nodes.columns if c != "doc_comment"], "doc_comment", is_exported(F.col("signature")).alias("is_exported"))


# --- imports ---


_JAVA_LINE = r"(?Udm)^[\s&&[^\n]]*+"


def _all(content: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(content, F.lit(_JAVA_LINE + pattern), F.lit(group))


def _uses(content: Column) -> Column:
    """What stands between a ``use`` that begins a line and the next semicolon: the text is cut at semicolons first, so each part is
    read once. A mark before the later parts keeps them from beginning a line."""
    parts = F.split(content, ";", -1)
    parts = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(";"), x)))
    return F.filter(F.transform(parts, lambda x: F.regexp_extract(x, _JAVA_LINE + RUST_USE, 1)), lambda x: x != "")


def _relative(path: Column, spec: Column) -> Column:
    """A relative import joined to its file's folder (dots stay as they are)."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    joined = F.when(folder == "", spec).otherwise(F.concat(folder, F.lit("/"), spec))
    joined = F.when(joined.startswith("./"), joined.substr(F.lit(3), F.length(joined))).otherwise(joined)
    return F.when(spec.startswith("."), F.replace(joined, F.lit("\\"), F.lit("/"))).otherwise(spec)


def imports(files: DataFrame) -> DataFrame:
    """file, ord (0-based), target of every import, in the order of the patterns."""
    c, path = F.col("content"), F.replace("path", F.lit("\\"), F.lit("/"))
    uses = F.transform(_uses(c), lambda x: F.replace(F.replace(F.regexp_replace(x, r"(?Ud)^\s+|\s+\z", ""), F.lit("crate::"), F.lit("")), F.lit("super::"), F.lit("")))
    mods = F.transform(_all(c, RUST_MOD), lambda x: F.concat(x, F.lit(".rs")))
    specs = F.transform(F.concat(*[_all(c, p) for p in TYPESCRIPT_IMPORTS]), lambda x: _relative(path, x))
    modules = F.transform(F.arrays_zip(_all(c, PYTHON_IMPORTS[0], 1).alias("a"), _all(c, PYTHON_IMPORTS[0], 2).alias("b")), lambda x: F.coalesce(F.nullif(x["a"], F.lit("")), x["b"]))
    found = F.when(F.col("language") == "rust", F.concat(uses, mods)).when(F.col("language").isin(*FRONTEND), specs).when(F.col("language") == "python", modules)
    return files.select(path.alias("file"), F.posexplode(found).alias("ord", "target"))


def rollup_by_kind(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Extension: symbols by language and kind, with totals."""
    languages = files.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("file"), "language")
    return nodes.join(languages, "file").rollup("language", "kind").agg(F.count(F.lit(1)).alias("n_symbols"))
