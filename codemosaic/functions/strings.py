"""Text helpers with the line and trim rules of the data model: lines end at a line feed, with a carriage return before it
or not; trims take all Unicode white space; offsets count UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Before Java patterns: Unicode classes; only a line feed ends a line.
UNICODE = "(?Ud)"


def lines(text: str) -> list[str]:
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p.removesuffix("\r") for p in parts]


def lines_column(text: Column) -> Column:
    parts = F.split(text, "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.when(x.endswith("\r"), x.substr(F.lit(1), F.length(x) - 1)).otherwise(x))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"{UNICODE}^\s+|\s+\z", "")


def left_trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"{UNICODE}^\s+", "")


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def match_start(text: Column, pattern: str) -> Column:
    """The byte at which the first match starts, where there is one."""
    return F.octet_length(F.element_at(F.split(text, pattern, 2), 1))


class ByteOffsets:
    """Bytes before each character of a text."""

    def __init__(self, text: str):
        self.plain = text.isascii()
        if not self.plain:
            self.at = [0]
            for c in text:
                self.at.append(self.at[-1] + (1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4))

    def __call__(self, i: int) -> int:
        return i if self.plain else self.at[i]
