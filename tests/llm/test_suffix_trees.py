"""Repeated passages against a plain version over all windows."""

import hashlib
import random
from collections import Counter

import brute
import numpy as np
import pytest

from docweir.llm import suffix_trees


def plain(rows, window):
    largest = 2**63 - 1
    texts = [(largest if i is None else i, i, brute.words(t)) for i, t in rows]
    first = {}
    for own, _, words in texts:
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            first[key] = min(first.get(key, largest), own)
    out = []
    for own, doc_id, words in texts:
        gone = np.zeros(len(words), dtype=bool)
        for at in range(len(words) - window + 1):
            if first[tuple(words[at : at + window])] < own:
                gone[at : at + window] = True
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check(docs, window=50, **options):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = suffix_trees.without_repeats(docs, window=window, **options).collect()
    want = plain(rows, window)
    assert Counter(tuple(r) for r in got) == Counter(want)
    return sum(w[2] for w in want)


@pytest.mark.parametrize("name", ["edges", "empty", "documents"])
def test_tables(request, name):
    removed = check(request.getfixturevalue(name).repartition(3))
    assert removed or name != "documents"


def passages(seed, n=120):
    draw, rows = random.Random(seed), []
    shared = [[f"p{p}w{i}" for i in range(draw.choice([7, 12, 60]))] for p in range(6)]
    for i in range(n):
        words = [draw.choice("abcd") for _ in range(draw.choice([0, 3, 30]))]
        for _ in range(draw.choice([0, 1, 2, 4])):
            part = draw.choice(shared)
            lo = draw.choice([0, 0, draw.randrange(len(part))])
            words += part[lo : lo + draw.choice([6, 9, 200])] + [f"own{i}x{draw.randrange(99)}" for _ in range(draw.choice([0, 1, 9]))]
        rows.append((draw.choice([i, i, i, None, i // 2]), draw.choice([" ", "\n", "\t  "]).join(words)))
    return rows


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"gram": 1}), (3, {"gram": 6}), (4, {"group_contexts": 1}), (5, {"group_contexts": 6, "gram": 2})])
def test_passages(spark, seed, options):
    docs = spark.createDataFrame([(*r, "x", 1) for r in passages(seed)], "doc_id long, text string, anchor string, ord int").repartition(3)
    assert check(docs, window=6, **({"gram": 3} | options)) > 0


def test_periodic_and_equal_texts(spark):
    rows = [(3, "a " * 90), (2, "a " * 60), (1, "a b " * 40), (4, "b a " * 45 + "c"), (5, "a b " * 30), (5, "a b " * 30), (6, "x " + "a b " * 30), (None, "a " * 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (1, 2, 7, 50):
        assert check(docs, window=window)


def test_kept_text(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x  a b c\ny")], "doc_id long, text string")
    got = suffix_trees.without_repeats(docs, window=3, gram=2, kept_text=True).collect()
    assert {r.doc_id: r.kept for r in got} == {1: "a b c d", 2: "x y"}


def test_pieces_do_not_change_hashes(monkeypatch):
    text = ("word " * 50 + "x" * 300 + " ü " * 20 + "y" * 700 + "\t\n end").encode()
    monkeypatch.setattr(suffix_trees, "PIECE_BYTES", 400)
    small = suffix_trees.hashed_words(text)
    monkeypatch.setattr(suffix_trees, "PIECE_BYTES", 650)
    assert (small == suffix_trees.hashed_words(text)).all() and len(small) == len(text.split())
    assert len(suffix_trees.hashed_words(b"")) == len(suffix_trees.hashed_words(b" \n")) == 0


def test_stretches_in_steps(monkeypatch):
    words = np.random.default_rng(1).integers(0, 2**63, 900, dtype=np.uint64)
    whole = {(int(a), int(lo)) for s in suffix_trees.stretches(words) for a, lo in zip(s[0], s[2], strict=True)}
    monkeypatch.setattr(suffix_trees, "STEP", 256)
    parts = [s for s in suffix_trees.stretches(words)]
    assert sum(int((s[3] - s[2] + 1).sum()) for s in parts) == 851
    assert whole <= {(int(a), int(lo)) for s in parts for a, lo in zip(s[0], s[2], strict=True)}
