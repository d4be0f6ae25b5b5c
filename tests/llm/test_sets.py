"""Exact duplicates and the Jaccard join against brute force."""

import random
from collections import Counter

import brute
import pytest

from docweir.llm import exact_merge, relations
from docweir.llm.components import components


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["edges", "empty", "documents"])
@pytest.mark.parametrize("fan", [2, 8])
def test_exact_groups(request, name, fan):
    docs = request.getfixturevalue(name).repartition(5)
    got = exact_merge.exact_groups(docs, fan=fan).collect()
    want = brute.exact_groups(rows_of(docs))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(want)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept) == {w[3] for w in want} and set(kept.values()) <= {1}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def near_copies(seed):
    draw, rows = random.Random(seed), []
    for group in range(12):
        base = [draw.choice("abcdefgh") * draw.randint(1, 4) + str(draw.randint(0, 400)) for _ in range(draw.choice([5, 12, 40, 200, 700]))]
        for _ in range(draw.choice([1, 3, 25])):
            text = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, max(1, len(text) // 60), max(1, len(text) // 25)])):
                at = draw.randrange(len(text))
                text[at : at + draw.randint(0, 2)] = [f"new{draw.randint(0, 9)}"] * draw.randint(0, 2)
            rows.append((len(rows) * 7 % 1000 + 1000 * group, " ".join(text)))
    # chains: each text differs a little from the one before
    text = [f"c{i}" for i in range(300)]
    for i in range(30):
        text[i * 9 : i * 9 + 2] = [f"x{i}", f"y{i}"]
        rows.append((90_000 - i, " ".join(text)))
    # a passage shared by many otherwise different texts
    passage = " ".join(f"p{i}" for i in range(150))
    rows += [(95_000 + i, " ".join([f"o{i}x{j}" for j in range(draw.choice([5, 9, 30, 200]))]) + " " + passage) for i in range(40)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_near_copies(spark, seed):
    rows = near_copies(seed)
    got = relations.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute.jaccard_components(rows))


@pytest.mark.parametrize("name", ["edges", "empty", "documents"])
def test_components_of_tables(request, name):
    docs = request.getfixturevalue(name)
    got = relations.jaccard_components(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute.jaccard_components(rows_of(docs)))


def test_blocks_agree_for_every_linked_pair():
    draw = random.Random(3)
    for _ in range(300):
        x = {draw.getrandbits(64) for _ in range(draw.choice([9, 19, 20, 33, 150, 900]))}
        y = set(x)
        for _ in range(draw.randint(0, max(1, len(x) // 8))):
            y.discard(draw.choice(sorted(y)))
            if draw.random() < 0.5:
                y.add(draw.getrandbits(64))
        if x != y and 100 * len(x & y) >= 90 * len(x | y):
            keys = [set(relations.block_keys(relations.np.array(sorted(s), dtype="u8")).tolist()) for s in (x, y)]
            assert keys[0] & keys[1]


def test_component_rounds(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200)]
    got = dict(components(spark.createDataFrame(path, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys((100, 101, 103), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
