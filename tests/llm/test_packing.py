"""Both packings by exact round trip against the tokenizer, and the mix against its targets."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import brute
from docweir.llm import bestfit, curriculum, tournament
from docweir.llm.tokens import vocabulary, word_ids


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_word_ids_equal_whole_texts(plain):
    draw = random.Random(4)
    parts = ["a", "it's", "'s", " ", "  ", "\n", "\n\n", "\t", "\x0b", "\x1c", " ", " ", ".", "1", "é", "日本", "ß!", "\x00", "<|endoftext|>", " word", "don't", "\U0001f600"]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert word_ids(vocabulary()).ids(text).tolist() == plain(text), repr(text)


@pytest.mark.parametrize("name", ["edges", "documents", "empty"])
def test_tournament_pack(request, name, plain):
    docs = request.getfixturevalue(name)
    rows = tournament.pack(docs, group_pieces=50).collect()
    want = defaultdict(int)
    for r in docs.select("doc_id", "text").collect():
        ids = np.array(plain(r.text), dtype="<u4")
        for at in range(0, len(ids), 2048):
            want[r.doc_id, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048]), len(ids)] += 1
    for r in rows:
        want[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] -= 1
    assert not any(want.values())
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        ends = np.cumsum([0] + [n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 2048


def test_first_fit_is_first_and_padding_is_small(spark, documents):
    draw, room = random.Random(1), [100] * 64
    tree = tournament.Tournament(64, 100)
    for n in sorted((draw.randint(1, 100) for _ in range(64)), reverse=True):
        first = next(i for i, r in enumerate(room) if r >= n)
        assert tree.place(n) == (first, room[first])
        room[first] -= n
    rows = tournament.pack(documents).collect()
    used = sum(r.length for r in rows)
    assert used / (2048 * len({r.sequence_id for r in rows})) > 0.97


@pytest.mark.parametrize("name", ["edges", "documents", "empty"])
def test_matrices_round_trip(request, name, plain):
    docs = request.getfixturevalue(name)
    packed = bestfit.packed_matrices(docs, group_bytes=200_000)
    rows = packed.collect()
    want = defaultdict(int)
    for r in docs.select("doc_id", "text").collect():
        ids = plain(r.text)
        for at in range(0, len(ids), 2048):
            want[r.doc_id, at, tuple(ids[at : at + 2048])] += 1
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(positions) == 2048 and r.n_segments == len(r.doc_ids) == len(r.cu_seqlens) - 1 and r.cu_seqlens[-1] == r.n_tokens
        for d, s, n, a, b in zip(r.doc_ids, r.starts, r.lengths, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert positions[a:b].tolist() == list(range(n))
            want[d, s, tuple(ids[a:b].tolist())] -= 1
    assert not any(want.values()) and len({r.sequence_id for r in rows}) == len(rows)
    parts = bestfit.unpacked(packed).collect()
    assert sum(r.length for r in parts) == sum(r.n_tokens for r in rows) and all(len(r.ids) == 2 * r.length for r in parts)


def test_best_fit_is_best():
    draw = random.Random(2)
    lengths = sorted((draw.randint(1, 60) for _ in range(200)), reverse=True)
    bins, opened = bestfit.best_fit(lengths, 60)
    room: dict[int, int] = {}
    for n, b in zip(lengths, bins, strict=True):
        fits = [r for r in room.values() if r >= n]
        assert room.get(b, 60) == (min(fits) if fits else 60) and (b in room) == bool(fits)
        room[b] = room.get(b, 60) - n
    assert opened == len(room)


@pytest.mark.parametrize("name", ["edges", "documents", "empty"])
def test_mix_meets_targets(request, name):
    docs = request.getfixturevalue(name)
    rows = curriculum.mix(docs).collect()
    source = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in source:
        sizes[r.source] += len(brute.words(r.text))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, rest, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in full} if full else {s: weight[s] * level for s in open_}
        rest -= sum(target[s] for s in full)
        open_ -= full or open_
    assert len(rows) == len(source)
    taken = defaultdict(int)
    of = defaultdict(list)
    for r in source:
        of[r.doc_id, len(brute.words(r.text))].append(r.source)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        s = next(x for x in of[r.doc_id, r.size] if sizes[x] == r.source_size)
        assert r.target == pytest.approx(target[s])
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    again = curriculum.mix(docs.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    places = [r.position for r in curriculum.in_training_order(curriculum.mix(docs)).collect() if r.position is not None]
    assert places == sorted(places)
