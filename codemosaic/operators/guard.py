"""Safety checks of code: eleven passes in a fixed order, the first violation is reported.

Passes that expressions can state are columns; the five that need scanners (balance, unwraps, nested quantifiers, deep access, tags)
come from one Arrow batch function, so Python is entered once a batch. ``coalesce`` over the passes keeps the order and
stops at the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from ..functions.strings import UNICODE, lines_column, match_start, trimmed
from . import scanners

#: Violation codes, in the order of the passes (fixed values).
CODES = (
    "UNBALANCED_DELIMITERS", "ASYNC_MUTEX_DEADLOCK", "DIV_BY_ZERO", "ARRAY_OOB", "UNSAFE_UNWRAP", "REDOS_PATTERN",
    "NULL_DEREF", "CONDITIONAL_HOOK_CALL", "CLIENT_SECRET_LEAK", "UNSAFE_INNER_HTML", "JSX_TAG_MISMATCH",
)

# Patterns (fixed values).
# A name begins behind digits at most, so a long run of name characters is entered once.
_NAME = r"(?<![a-zA-Z0-9_])([0-9]*+)([a-zA-Z_][a-zA-Z0-9_]*+"
DIVISION = _NAME + r"\s*+/\s*+[a-zA-Z_][a-zA-Z0-9_]*+)"
LITERAL_DIVISOR = r"/\s*[0-9]+(?:\.[0-9]+)?"
ARRAY_INDEX = _NAME + r"\s*+\[\s*+[a-zA-Z_][a-zA-Z0-9_]*+\s*+\])"
BOUND_CHECK = r"\.len\(\)|\.get\s*\(|\.is_empty\(\)|assert!\s*\("
SYNC_MUTEX = r"std\s*::\s*sync\s*::\s*Mutex|sync::Mutex"
AWAIT = r"\.await"
HOOK_IN_IF = r"(?s)\bif\s*\([^)]*\)\s*\{[^}]*\buse[A-Z][a-zA-Z0-9_]*\s*\("
HOOK_IN_LOOP = r"(?s)\b(for|while)\s*\([^)]*\)\s*\{[^}]*\buse[A-Z][a-zA-Z0-9_]*\s*\("
HOOK_IN_TERNARY = r"\?[^:;\n]*\buse[A-Z][a-zA-Z0-9_]*\s*\("
CLIENT_ENV = r"(?:process\.env|import\.meta\.env)\.([A-Z0-9_]+)"
INNER_HTML = r"dangerouslySetInnerHTML\s*=\s*\{\{\s*__html\s*:\s*([^}]+)\}\}"
PUBLIC_PREFIXES = ("NEXT_PUBLIC_", "VITE_", "PUBLIC_", "REACT_APP_")
PUBLIC_NAMES = ("NODE_ENV", "BASE_URL", "DEV", "PROD", "SSR", "MODE")
TYPED_MARKS = (": string", "interface ", "export ")
RUST_MARKS = ("fn ", "impl ", "pub struct ", "pub enum ")


def _has(code: Column, pattern: str) -> Column:
    return code.rlike(UNICODE + pattern)


def _any(code: Column, texts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in texts:
        out = out | code.contains(t)
    return out


def _first_where(code: Column, pattern: str, group: int, wanted) -> Column:
    """The first of all matches for which wanted holds; null if none."""
    return F.get(F.filter(F.regexp_extract_all(code, F.lit(UNICODE + pattern), F.lit(group)), wanted), F.lit(0))


def before_tests(code: Column) -> Column:
    return F.substring_index(code, scanners.TEST_MARK, 1)


def async_mutex(code: Column) -> Column:
    """A standard mutex and an await on lines of the same file."""
    # Lines that begin so do not count (fixed values).
    skip = ("//", "*", '"', "static", "Regex::new")

    def live(line: Column) -> Column:
        out = ~line.contains("checklist.push")
        for s in skip:
            out = out & ~line.startswith(s)
        return out

    kept = F.filter(F.transform(lines_column(before_tests(code)), trimmed), live)
    both = F.exists(kept, lambda x: _has(x, SYNC_MUTEX)) & F.exists(kept, lambda x: _has(x, AWAIT))
    return F.when(code.contains(".await") & code.contains("Mutex") & both, "Blocking sync mutex in a file that awaits; an async mutex is meant")


def _place(code: Column, pattern: str) -> tuple[Column, Column]:
    """The byte and the text of the first match of a pattern that begins with a name."""
    return match_start(code, UNICODE + pattern) + F.octet_length(F.regexp_extract(code, UNICODE + pattern, 1)), F.regexp_extract(code, UNICODE + pattern, 2)


def division(code: Column) -> Column:
    byte, text = _place(code, DIVISION)
    at = F.concat(F.lit("Division at byte "), byte, F.lit(": `"), text, F.lit("`; the divisor may be zero"))
    return F.when(_has(code, DIVISION) & ~_has(code, LITERAL_DIVISOR) & ~_any(code, ("!= 0", "assert!")), at)


def array_bounds(code: Column) -> Column:
    byte, text = _place(code, ARRAY_INDEX)
    at = F.concat(F.lit("Index at byte "), byte, F.lit(": `"), text, F.lit("`; no bound is checked"))
    return F.when(_has(code, ARRAY_INDEX) & ~_has(code, BOUND_CHECK), at)


def _not_rust(code: Column) -> Column:
    return ~_any(code, (*RUST_MARKS, "use std::"))


def conditional_hooks(code: Column) -> Column:
    own = before_tests(code)
    found = (
        F.when(_has(own, HOOK_IN_IF), "Hook called within an `if` block")
        .when(_has(own, HOOK_IN_LOOP), "Hook called within a loop")
        .when(_has(own, HOOK_IN_TERNARY), "Hook called within a ternary branch")
    )
    return F.when(_not_rust(code) & code.contains("use"), found)


def client_secret(code: Column) -> Column:
    def secret(name: Column) -> Column:
        out = ~name.isin(*PUBLIC_NAMES)
        for p in PUBLIC_PREFIXES:
            out = out & ~name.startswith(p)
        return out

    full = _first_where(code, CLIENT_ENV, 0, lambda x: secret(F.regexp_extract(x, CLIENT_ENV, 1)))
    gate = _not_rust(code) & _any(code, ('"use client"', "'use client'"))
    return F.when(gate, F.concat(F.lit("Secret `"), full, F.lit("` read in a client file without a public prefix")))


def inner_html(code: Column) -> Column:
    def raw(x: Column) -> Column:
        x = trimmed(x)
        return ~x.contains("sanitize") & ~x.startswith('"') & ~x.startswith("'")

    found = trimmed(_first_where(before_tests(code), INNER_HTML, 1, raw))
    return F.when(_not_rust(code) & code.contains("dangerouslySetInnerHTML"), F.concat(F.lit("Raw `"), found, F.lit("` set as inner HTML without being sanitized")))


SCANNED = ("balanced", "unwrap", "redos", "deref", "tags")


def _scanner(name: str, text: str) -> str | None:
    """The detail of a pass that needs a scanner, if it finds something. What a text must hold for that is looked for first."""
    if name == "balanced":
        return None if scanners.balanced(text) else "Braces, brackets or parentheses do not pair up"
    if name == "unwrap":
        at = scanners.first_unguarded_unwrap(text) if "unwrap" in text or "expect" in text else None
        return None if at is None else f"Unguarded `.unwrap()` at byte {at}"
    if name == "redos":
        nested = scanners.first_nested_quantifier(text) if ("+" in text or "*" in text) and ("'" in text or '"' in text) else None
        return nested and f"Nested repetition at byte {nested[0]}: `{nested[1]}`"
    rust = any(m in text for m in RUST_MARKS)
    if name == "deref":
        deref = scanners.first_deep_access(text) if not rust and any(m in text for m in TYPED_MARKS) else None
        return deref and f"Deep access at byte {deref[0]}: `{deref[1]}`; optional chaining is meant"
    return None if rust or "use std::" in text or "<" not in text or ">" not in text else scanners.tag_mismatch(text)


SCAN_TYPE = T.StructType([T.StructField("balanced", T.BooleanType()), *(T.StructField(n, T.StringType()) for n in SCANNED[1:])])


@arrow_udf(SCAN_TYPE)
def scan(code):
    """What every scanner finds, whatever the others do."""
    import pyarrow as pa

    rows = []
    for text in code.to_pylist():
        found = None if text is None else {n: _scanner(n, text) for n in SCANNED}
        rows.append(found and found | {"balanced": found["balanced"] is None})
    return pa.array(rows, pa.struct([("balanced", pa.bool_()), *((n, pa.string()) for n in SCANNED[1:])]))


_FIRST = T.StructType([T.StructField("code", T.StringType()), T.StructField("detail", T.StringType())])


@arrow_udf(_FIRST)
def first_scanned(code, before):
    """The first finding among the passes that need a scanner, of those that come before a place in the order of all; no scanner
    runs after the first finding."""
    import pyarrow as pa

    rows = []
    for text, place in zip(code.to_pylist(), before.to_pylist(), strict=True):
        found = None
        if text is not None:
            for k, name in _SCANNER_AT:
                if k >= place:
                    break
                if (detail := _scanner(name, text)) is not None:
                    found = {"code": CODES[k], "detail": detail}
                    break
        rows.append(found)
    return pa.array(rows, pa.struct([("code", pa.string()), ("detail", pa.string())]))


#: Passes in the order of CODES: scanners by name, the others as columns.
_PASSES = ("balanced", async_mutex, division, array_bounds, "unwrap", "redos", "deref", conditional_hooks, client_secret, inner_html, "tags")
_SCANNER_AT = [(k, p) for k, p in enumerate(_PASSES) if isinstance(p, str)]


def verify(files: DataFrame, content: str = "content", prefix: str = "") -> DataFrame:
    """files with passed, violation and detail (with a prefix, if given) of a column of code; null code passes.

    The passes that are expressions run first; scanners, in Python, only for what comes before the first of their findings.
    """
    code = F.col(content)
    plain = F.coalesce(*[F.when((d := p(code)).isNotNull(), F.struct(F.lit(k).alias("k"), F.lit(CODES[k]).alias("code"), d.alias("detail"))) for k, p in enumerate(_PASSES) if not isinstance(p, str)])
    out = files.withColumn("__plain", plain)
    out = out.withColumn("__scanned", first_scanned(code, F.coalesce("__plain.k", F.lit(len(_PASSES)))))
    first = lambda field: F.coalesce(f"__scanned.{field}", f"__plain.{field}")
    return out.withColumns({f"{prefix}passed": first("code").isNull(), f"{prefix}violation": first("code"), f"{prefix}detail": first("detail")}).drop("__plain", "__scanned")


def violation_histogram(verified: DataFrame) -> DataFrame:
    """Files per violation code (``none`` for those that pass)."""
    return verified.groupBy(F.coalesce("violation", F.lit("none")).alias("violation")).agg(F.count(F.lit(1)).alias("n_files"))
