"""The pipeline stage by stage against brute force, and its registration."""

import hashlib
from collections import Counter, defaultdict

import brute
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from docweir.llm import exact_merge, queries, tournament
from docweir.llm.tokens import vocabulary


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def staged(spark, docs, name):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, "")


@pytest.mark.parametrize("name", ["documents", "edges", "empty"])
def test_stages(request, spark, name):
    docs = request.getfixturevalue(name)
    at = {c: i for i, c in enumerate(docs.columns)}
    text, key = at["text"], at["doc_id"]
    known = staged(spark, docs, "language ID")
    assert known.columns == docs.columns
    assert Counter(rows_of(known)) == Counter(r for r in rows_of(docs) if any(c.isalpha() for c in r[text] or ""))
    known = spark.createDataFrame(known.collect(), docs.schema)

    single = spark.createDataFrame(staged(spark, known, "exact dedup").collect(), docs.schema)
    largest = {}
    for r in rows_of(known):
        k = brute.fold(r[text])
        largest[k] = max(largest.get(k, r[key]), r[key], key=lambda x: (x is not None, x or 0))
    assert Counter((r[key], brute.fold(r[text])) for r in rows_of(single)) == Counter((v, k) for k, v in largest.items())

    apart = spark.createDataFrame(staged(spark, single, "n-gram Jaccard join").collect(), docs.schema)
    parts = defaultdict(list)
    for i, r in enumerate(brute.jaccard_components([(r[key], r[text]) for r in rows_of(single)])):
        parts[r[2] if r[1] else ("empty", i)].append(r[0])
    assert sorted(map(str, (r[key] for r in rows_of(apart)))) == sorted(str(min((i for i in ids if i is not None), default=None)) for ids in parts.values())

    mixed = spark.createDataFrame(staged(spark, apart, "mixing sources to target weights").collect(), docs.schema)
    assert mixed.columns == docs.columns
    source = at["source"]
    assert Counter((r[key], r[source], r[text]) for r in rows_of(mixed)) == plain_mix([(r[key], r[source], r[text]) for r in rows_of(apart)])

    tokenizer = Tokenizer.from_file(vocabulary())
    want = Counter()
    for r in rows_of(mixed):
        ids = [*tokenizer.encode(r[text] or "", add_special_tokens=False).ids, 1]
        want.update((r[key], i, len(ids[i : i + 2048]), len(ids)) for i in range(0, len(ids), 2048))
    pieces = staged(spark, mixed, "packing").collect()
    assert Counter((r.doc_id, r.start, r.length, r.doc_tokens) for r in pieces) == want


def plain_mix(rows):
    """How often each (doc_id, source, text) is read: passes through its source until the target, the last one if it takes half."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((hashlib.md5(str(r[0]).encode()).hexdigest() if r[0] is not None else None, r[0], len(brute.words(r[2])), r))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    total = {s: sum(x[2] for x in by[s]) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    # targets by filling up the capped ones
    target, open_ = {}, set(names)
    while open_:
        rest, shares = sum(total.values()) - sum(target.values()), sum(weight[s] for s in open_)
        full = {s for s in open_ if rest * weight[s] / shares > 3 * total[s]}
        target |= {s: float(3 * total[s]) for s in full} if full else {s: rest * weight[s] / shares for s in open_}
        open_ = open_ - full if full else set()
    out = Counter()
    for s in names:
        if not total[s]:
            continue
        wanted, before = round(target[s]), 0
        # null ids have no draw and stand first; they don't meet in these tables
        for _, _, size, r in sorted(by[s], key=lambda x: (x[0] is not None, x[0] or "", x[1] or 0)):
            part = max(0, min(size, wanted % total[s] - before))
            times = wanted // total[s] + (2 * part >= size)
            if wanted // total[s] * size + part > 0 and times:
                out[r] += times
            before += size
    return out


def test_texts_like_no_language_go(spark, documents):
    strange = "Ωκεανός Ξενοφών Ψυχή Θάλασσα " * 12
    docs = documents.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame([(-1, strange, None, "x"), (-2, "short Ω", None, "x")], "doc_id long, text string, lang string, source string"))
    kept = {r.doc_id for r in staged(spark, docs, "language ID").collect()}
    assert -1 not in kept and -2 in kept and len(kept) == len([1 for r in documents.collect() if any(c.isalpha() for c in r.text or "")]) + 1


def test_tables_of_lazy_frames_survive_stages(spark, documents):
    """Stages delete the tables of the stage before them and nobody else's."""
    groups = exact_merge.exact_groups(documents.select("doc_id", "text"))
    for name in ("exact dedup", "language ID"):
        assert staged(spark, documents, name).count()
    assert groups.count() == documents.count()


def test_run_and_registration(spark, sf):
    assert {f"op{n}_" for n in range(1, 14)} == {q[: q.index("_") + 1] for q in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())
    result = entry.queries()["pipeline"](spark, sf)
    assert result.columns == [c.split()[0] for c in tournament.PLACED_SCHEMA.split(", ")] and result.count() > 0


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracles(spark, sf, name):
    from compare import compare

    line, good = compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], sf)
    assert good, line
