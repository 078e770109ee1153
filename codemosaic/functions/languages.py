"""Languages of source files: names, extensions, families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language -> extensions and names that mean it (fixed values).
EXTENSIONS = {
    "rust": ("rs", "rust"),
    "tsx": ("tsx", "react-tsx"),
    "jsx": ("jsx", "react-jsx"),
    "svelte": ("svelte",),
    "astro": ("astro",),
    "vue": ("vue",),
    "typescript": ("ts", "typescript"),
    "javascript": ("js", "javascript", "mjs", "cjs"),
    "python": ("py", "python"),
}
UNKNOWN = "unknown"
FRONTEND = ("typescript", "javascript", "tsx", "jsx", "svelte", "astro", "vue")

_BY_EXTENSION = {e: language for language, names in EXTENSIONS.items() for e in names}


def language_named(extension: str | None) -> str:
    return _BY_EXTENSION.get((extension or "").lower().strip(), UNKNOWN)


def language_of(extension: Column) -> Column:
    """The language that an extension or name means; ``unknown`` for others."""
    e = F.trim(F.lower(F.coalesce(extension, F.lit(""))))
    out = F.lit(UNKNOWN)
    for language, names in reversed(EXTENSIONS.items()):
        out = F.when(e.isin(*names), language).otherwise(out)
    return out


def is_frontend(language: Column) -> Column:
    return language.isin(*FRONTEND)


def extension_of(path: Column) -> Column:
    """What follows the last dot of the file name; empty without one (a leading dot starts a name)."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
