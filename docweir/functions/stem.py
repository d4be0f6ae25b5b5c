"""English stemming (the Porter2 rules) for distinct words of an Arrow batch."""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values of the published algorithm.
SPECIAL = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEEP_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
    ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"),
    ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
)
STEP3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP4 = (
    "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic"
).split()
REGION_EXCEPTIONS = ("gener", "commun", "arsen")

_V = "aeiouy"
_REGION = re.compile(f"[{_V}][^{_V}]")
_DOUBLE = re.compile("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_SHORT = re.compile(f"(?:^|[^{_V}])[{_V}][^{_V}wxY]$|^[{_V}][^{_V}]$")


def _has_vowel(s: str) -> bool:
    return any(c in _V for c in s)


def _regions(word: str) -> tuple[int, int]:
    prefix = next((p for p in REGION_EXCEPTIONS if word.startswith(p)), None)
    if prefix:
        r1 = len(prefix)
    else:
        m = _REGION.search(word)
        r1 = m.end() if m else len(word)
    m = _REGION.search(word, r1)
    return r1, m.end() if m else len(word)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith(("us", "ss")):
        return w
    if w.endswith("s") and _has_vowel(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    for end in ("eedly", "eed"):
        if w.endswith(end):
            return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    for end in ("ingly", "edly", "ing", "ed"):
        if w.endswith(end):
            base = w[: -len(end)]
            if not _has_vowel(base):
                return w
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if _DOUBLE.search(base):
                return base[:-1]
            return base + "e" if r1 >= len(base) and _SHORT.search(base) else base
    return w


def _suffix(w: str, r1: int, r2: int) -> str:
    for end, new in STEP2:
        if w.endswith(end):
            return w[: -len(end)] + new if len(w) - len(end) >= r1 else w
    if w.endswith("ogi"):
        return w[:-1] if len(w) - 3 >= r1 and w[-4:-3] == "l" else w
    if w.endswith("li"):
        return w[:-2] if len(w) - 2 >= r1 and w[-3:-2] and w[-3] in "cdeghkmnrt" else w
    return w


def _derived(w: str, r1: int, r2: int) -> str:
    for end, new in STEP3:
        if w.endswith(end):
            return w[: -len(end)] + new if len(w) - len(end) >= r1 else w
    if w.endswith("ative"):
        return w[:-5] if len(w) - 5 >= r2 else w
    return w


def _residue(w: str, r2: int) -> str:
    for end in STEP4:
        if w.endswith(end):
            return w[: -len(end)] if len(w) - len(end) >= r2 else w
    if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
        return w[:-3]
    return w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = re.sub(f"(^y|(?<=[{_V}])y)", "Y", word)
    r1, r2 = _regions(w)
    w = _plural(w)
    if w in KEEP_AFTER_1A:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    w = _suffix(w, r1, r2)
    w = _derived(w, r1, r2)
    w = _residue(w, r2)
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
