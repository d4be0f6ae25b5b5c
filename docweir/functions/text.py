"""Text expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweir import params

# Model families whose texts are counted without the extra factor.
PLAIN_COUNT_FAMILIES = ("gpt-", "text-embedding-", "claude-", "gemini-")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body's lambdas read it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Cut white space, line ends included, off both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"\S")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\S+)"), F.lit(1))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def token_estimate(c: Column) -> Column:
    """Token count without a tokenizer: words times a constant, rounded down."""
    return F.floor(word_count(c) * F.lit(params.TOKENS_PER_WORD)).cast("bigint")


def model_tokens(c: Column, model: Column) -> Column:
    """Token estimate for a model: other families than the listed ones count more."""
    plain = F.lit(False)
    for family in PLAIN_COUNT_FAMILIES:
        plain = plain | F.startswith(model, F.lit(family))
    base = token_estimate(c)
    return F.when(plain, base).otherwise(F.floor(base * F.lit(params.TOKEN_FACTOR)).cast("bigint"))


def truncate_words(c: Column, limit: int) -> Column:
    """Cut a text to its first ``limit`` tokens; shorter texts stay as they are."""
    if limit <= 0:
        return F.lit("")
    parts = words(c)
    return F.when(F.size(parts) <= limit, c).otherwise(F.array_join(F.slice(parts, 1, limit), " "))


def ellipsis(c: Column, limit: int) -> Column:
    """Longer texts end in three dots and are ``limit`` characters long."""
    return F.when(
        F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))
    ).otherwise(c)


def title(c: Column, limit: int = 50) -> Column:
    """Dialogue title: short texts whole, others cut at the last space plus three dots."""
    bare = strip(c)
    head = F.substring(bare, 1, limit)
    return F.when(F.length(bare) <= limit, bare).otherwise(
        F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit("..."))
    )
