"""Merkle manifests against a plain version, tampered rows and subsets of requests."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docweir.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def up(nodes):
    return [h("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]


def siblings(nodes, at):
    out = []
    while len(nodes) > 1:
        out.append((nodes[at ^ 1] if at ^ 1 < len(nodes) else None, at % 2))
        nodes, at = up(nodes), at // 2
    return out, nodes[0]


def plain(rows):
    """(doc_id, source, lang, n_chars, text) -> the query's rows."""
    trees = defaultdict(list)
    for r in rows:
        shown = leaf(*r[:3], r[3] + 1, r[4]) if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(*r)
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), shown, r[0]))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    tops = [siblings([x[2] for x in sorted(trees[n])], 0)[1] for n in names]
    out = []
    for i, name in enumerate(names):
        members = sorted(trees[name])
        above, root = siblings(tops, i)
        for at, (_, _, own, shown, doc_id) in enumerate(members):
            path = siblings([x[2] for x in members], at)[0] + above
            node = shown
            for s, right in path:
                node = h(node if s is None else s + node if right else node + s)
            out.append((doc_id, own, tops[i], root, h("".join(s for s, _ in path if s)), node, node == root))
    return out


def found(docs, segment):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    shown = merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), tampered, F.col("text"))
    made = merkle.manifest(docs, carry={"shown": shown}, segment=segment)
    return made, merkle.verified(made, segment=segment)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, rank int, levels int, path int")


@pytest.mark.parametrize("segment", [1, 2, 8])
def test_against_plain(spark, segment):
    rows = [(i, "s", "en", i, f"text {i}") for i in range(37)] + [(i, None, "de", None, "ä" * i) for i in range(100, 105)] + [(7, "a", "fr", 1, "x")]
    rows += [(None, None, None, None, None), (3, "", "", 0, ""), (3, "", "", 0, ""), (3, "a", "", 0, ""), (None, "b", "en", 5, "y"), (-9, "c", "é", 2, "z")]
    made, got = found(table(spark, rows).repartition(3), segment)
    want = plain(rows)
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    assert made.root == want[0][3] and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("rows", [[], [(7, "a", "fr", 1, "x")], [(1, "a", None, 1, "x"), (2, "a", "b", 1, "x")]])
def test_small(spark, rows):
    _, got = found(table(spark, rows), 8)
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain(rows))


def test_repeated_subtrees(spark):
    """Rows repeated in full make records with one digest; each still has its own path."""
    rows = [(5, "s", "en", 3, "abc")] * 21
    _, got = found(table(spark, rows), 2)
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain(rows))


def test_requests_of_some_leaves(spark, documents):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in documents.collect()]
    made = merkle.manifest(documents, carry={"shown": F.sha2(F.lit("forged"), 256)})
    asked = made.leaves.filter("doc_id % 9 = 0")
    got = merkle.verified(made, asked, shown="digest").collect()
    want = {r[:5] for r in plain(rows) if r[0] % 9 == 0}
    assert {tuple(r)[:5] for r in got} == want and all(r.verified for r in got)
    assert not any(r.verified for r in merkle.verified(made, asked).collect())
