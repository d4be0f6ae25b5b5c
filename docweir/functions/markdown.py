"""Markdown expressions: titles, front matter, JSX residue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweir.functions.text import strip

_YAML = r"(?sd)^---\s*\n(.+?)\n---\s*\n"
_TOML = r"(?sd)^\+\+\+\s*\n(.+?)\n\+\+\+\s*\n"


def title(md: Column) -> Column:
    """Front-matter title, else the first level-one heading, else an empty string."""
    yaml, toml = F.regexp_extract(md, _YAML, 1), F.regexp_extract(md, _TOML, 1)
    named = F.when(yaml != "", F.regexp_extract(yaml, r"(?md)^title:\s*(.+)$", 1)).otherwise(
        F.regexp_extract(toml, r"(?md)^title\s*=\s*(.+)$", 1)
    )
    quoted = F.regexp_replace(strip(named), "^[\"']+|[\"']+$", "")
    heading = strip(F.regexp_extract(md, r"(?md)^[^\S\n]*# [^\S\n]*(\S[^\n]*)", 1))
    return F.when(named != "", quoted).otherwise(heading)


def strip_front_matter(md: Column) -> Column:
    return F.when(md.rlike(_YAML), F.regexp_replace(md, _YAML, "")).otherwise(
        F.regexp_replace(md, _TOML, "")
    )


def strip_jsx(md: Column) -> Column:
    """Remove import and export lines, JSX tags and JSX comments outside fenced code.

    The text is cut in front of every fence line, which makes every second piece
    code and lets each piece be cleaned by patterns in one pass. A line break in front
    gives a text that opens with a fence its first, empty piece.
    """
    pieces = F.split(F.concat(F.lit("\n"), md), r"(?m)(?=^[^\S\n]*```)")

    def clean(piece: Column) -> Column:
        for pattern in (
            r"(?m)^[^\S\n]*(?:import|export)[^\S\n]+\S[^\n]*\n?",
            r"\{/\*[^\n]*?\*/\}",
            r"<[A-Z][A-Za-z0-9.]*\b[^>\n]*>[^\S\n]*",
            r"</[A-Z][A-Za-z0-9.]*>[^\S\n]*",
        ):
            piece = F.regexp_replace(piece, pattern, "")
        return piece

    def cleaned(piece: Column, i: Column) -> Column:
        fence = F.regexp_extract(piece, r"^([^\S\n]*```[^\n]*\n?)", 1)
        behind = F.regexp_replace(piece, r"^[^\S\n]*```[^\n]*\n?", "")
        return F.when(i % 2 == 1, piece).otherwise(F.concat(fence, clean(behind)))

    text = F.array_join(F.transform(pieces, cleaned), "")
    # comments over several lines go everywhere but between two fence marks
    spans = F.transform(
        F.split(text, "```"),
        lambda s, i: F.when(i % 2 == 1, s).otherwise(F.regexp_replace(s, r"(?s)\{/\*.*?\*/\}", "")),
    )
    return strip(F.regexp_replace(F.array_join(spans, "```"), r"\n{3,}", "\n\n"))
