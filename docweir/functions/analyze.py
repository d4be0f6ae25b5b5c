"""Analyzers: text -> lexemes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docweir.functions.stem import stem

TOKEN = r"([\p{L}\p{N}]+)"

# English stop words.
ENGLISH_STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is "
    "are was were be been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

# Letters with marks and their plain forms.
MARKED = "ąćęłńóśźżáàâäãåçéèêëíìîïñôöòõúùûüýÿ"
PLAIN = "acelnoszzaaaaaaceeeeiiiinoooouuuuyy"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(1))


def unaccent(c: Column) -> Column:
    return F.translate(c, MARKED, PLAIN)


def _stem_all(words: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        # stems are memoised per worker, so each distinct word is computed once
        return lists.map(lambda ws: [stem(w) for w in ws] if ws is not None else None)

    return run(words)


def simple(c: Column) -> Column:
    return tokens(c)


def english(c: Column) -> Column:
    """Lower-case tokens without stop words, stemmed."""
    return _stem_all(F.filter(tokens(c), lambda w: ~w.isin(*ENGLISH_STOP)))


def polish(stop_words: list[str] | None = None) -> Callable[[Column], Column]:
    """Tokens without accents and without the given stop words, which are unaccented too.

    The lemma dictionary is not part of this package; words stay as written.
    """

    stop = [w.translate(str.maketrans(MARKED, PLAIN)) for w in stop_words or ()]

    def analyzer(c: Column) -> Column:
        words = tokens(unaccent(F.lower(c)))
        if not stop:
            return words
        return F.filter(words, lambda w: ~w.isin(*stop))

    return analyzer
