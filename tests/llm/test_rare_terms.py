"""Terms beside personal data that are rare or part of the match itself."""

import math
import random
import re
from collections import Counter

import brute

from docweir.llm import disclosure


def test_matches_hide_no_term(spark):
    """A match's own characters leave a name's total alone; terms seen once or twice prove nothing."""
    rows = [(i, f"John Smith john.smith{i}@x.org") for i in range(1, 9)] + [(17, "mail john.smith@x.org"), (18, "Zoë a@b.c Zoë d@e.f"), (19, "seen by Smith")]
    rows += [(i, "seen by them and many other people mail") for i in range(30, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in disclosure.find(docs).collect()}
    # john 8 of 8, smith 8 of 9, zoë 2 of 2; mail 1 of 51
    assert got[1] == "cue:0:4,cue:5:10,email:11:28" and got[17] == "email:5:21" and got[19] == "cue:8:13" and got[30] == ""
    assert got[18] == "email:4:9,email:14:19"


PIECES = ["ann", "bob", "carl", "zoë", "the", "of", "a", "x@y.org", "1.2.3.4", "+1 (234) 555-0000", ",", "\n", "99", "Ann", "ünder"]


def plain_counts(texts):
    """near and total of each term, straight from the text."""
    near, total = Counter(), Counter()
    for text in texts:
        spans = [tuple(map(int, s.split(":")[1:])) for s in brute.personal(text)]
        covered = sorted({i for start, end in spans for i in range(start, end)})
        blank = "".join(" " if i in set(covered) else c for i, c in enumerate(text))
        places = [(m.start(), m[0].translate({c: c + 32 for c in range(65, 91)})) for m in re.finditer(r"[A-Za-z\x80-\U0010ffff]+", blank)]
        marked = set()
        for i, (at, _) in enumerate(places):
            before = [c for c in covered if c < at]
            behind = [c for c in covered if c > at]
            # terms between this one and the match before and behind it
            if before and sum(before[-1] < p < at for p, _ in places) < 3 or behind and sum(at < p < behind[0] for p, _ in places) < 3:
                marked.add(i)
        total.update(t for _, t in places)
        near.update(t for i, (_, t) in enumerate(places) if i in marked)
    return near, total


def test_counts_and_strength_against_plain(spark):
    draw = random.Random(9)
    texts = [" ".join(draw.choices(PIECES, weights=[3, 2, 2, 2, 30, 30, 30, 2, 1, 1, 5, 5, 5, 1, 4], k=draw.randint(0, 40))) for _ in range(150)]
    texts += [f"carl x{i}@y.org" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    near, total = plain_counts(texts)
    base = sum(near.values()) / sum(total.values())
    want = []
    for term, n in near.items():
        p, z, t = n / total[term], disclosure.CONFIDENCE, total[term]
        low = (p + z * z / 2 / t - z * math.sqrt(p * (1 - p) / t + z * z / 4 / t / t)) / (1 + z * z / t)
        want.append((n, t, round(low, 9), round(math.log2(low / base), 9)))
    found = disclosure.detected(docs)
    got = [(r.near, r.total, round(r.strength, 9), round(r.bits, 9)) for r in disclosure.risky_terms(docs, found, generalise=0.0, min_bits=-99.0).collect()]
    assert sorted(got) == sorted(want) and len(got) > 5
    strong = disclosure.risky_terms(docs, found, generalise=0.3).collect()
    assert sorted((r.near, r.total) for r in strong) == sorted(w[:2] for w in want if w[2] >= 0.3 and w[3] >= disclosure.MIN_BITS)


def test_least_near_is_what_the_bound_implies():
    for strength in (0.1, 0.5, 0.52, 0.9):
        n, z2 = disclosure.least_near(strength), disclosure.CONFIDENCE**2
        assert n / (n + z2) >= strength > (n - 1) / (n - 1 + z2)


def test_an_occurrence_is_near_once():
    text = "far one two three 1.2.3.4@b.com mid +1 (234) 555-0000 four é five six"
    near = sorted(disclosure.context_terms(text, disclosure.base_spans(text)))
    assert near == sorted(disclosure.signed(disclosure.terms("one two three mid four é five")[3]).tolist())
