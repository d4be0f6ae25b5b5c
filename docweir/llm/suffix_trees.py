"""Repeated passages by suffix trees over prefix partitions of sampled suffixes.

A window is ``window`` consecutive words. Of the grams in a window, the one of smallest hash (the
last of equal ones) is its anchor: equal windows have equal anchors at equal places, and
neighbouring windows mostly share one. So a document's suffixes come in stretches, one for each
anchor, and the words from a window's start to the end of its anchor are its
variable-length prefix: only suffixes under one anchor can have a window in common.

* Anchors that stand in one document only are dropped before any text moves.
* Suffix stretches that are equal as a whole fold into one context by a partial aggregate, however
  many copies a corpus holds; a context keeps its smallest document.
* The contexts under one anchor are a group of bounded size: their suffixes are sorted (prefix doubling),
  the common prefixes of neighbours make the tree, and each inner node as deep as a window gives
  the smallest document that holds it. Beyond GROUP_CONTEXTS contexts, as at the edges of
  a passage that a good part of all documents quote, prefixes are lengthened to the whole window; such a prefix
  is one node by itself and is folded by an aggregate.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir.llm.common import gram_hashes, mix, signed, slices, span_hashes, stored

WINDOW = 50
GRAM = 8
#: Contexts of one anchor that are put into one tree, and words of the trees built at once.
GROUP_CONTEXTS = 4096
TREE_WORDS = 1 << 20
#: Bytes of a text hashed at once, and windows of a text sampled at once; a longer word has a hash of its own kind.
PIECE_BYTES = 1 << 20
STEP = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def hashed_words(text: bytes) -> np.ndarray:
    """A hash of each white-space separated word; beside one number a word, memory does not grow with the text."""
    data = np.frombuffer(text, dtype=np.uint8)
    spaces = np.flatnonzero(_SPACE[data])
    starts, ends = np.concatenate(([0], spaces + 1)), np.append(spaces, len(data))
    starts, ends = starts[starts < ends], ends[starts < ends]
    out, at = np.empty(len(starts), dtype=np.uint64), 0
    while at < len(starts):
        first = starts[at]
        if ends[at] - first > PIECE_BYTES:
            out[at] = int.from_bytes(hashlib.blake2b(text[first : ends[at]], digest_size=8).digest(), "little")
            at += 1
            continue
        # words that end in the piece; the first one does
        to = int(np.searchsorted(ends, first + PIECE_BYTES, "right"))
        out[at:to] = span_hashes(data[first : ends[to - 1]], starts[at:to] - first, ends[at:to] - first)
        at = to
    return out


@functools.lru_cache(maxsize=8)
def _powers(bits: int, base: int) -> np.ndarray:
    out = np.full(1 << bits, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, from prefix sums."""
    bits = max(12, int(len(words)).bit_length())
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * _powers(bits, int(_BASE))[: len(words)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(bits, int(_INVERSE))[starts] + (ends - starts).astype(np.uint64))


def stretches(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor, context hash, first and last window of each stretch of a document, STEP windows at a time."""
    gram = min(gram, window)
    width = window - gram + 1
    for base in range(0, len(words) - window + 1, STEP):
        part = words[base : base + STEP + window - 1]
        grams = gram_hashes(part, gram)
        places = np.arange(len(grams), dtype=np.uint64)
        # the hash with the place below it: of equal hashes the last one is the smallest
        low = np.uint64(2 * STEP - 1)
        best, size = (grams & ~low) | (low - places), 1
        while 2 * size <= width:
            best, size = np.minimum(best[:-size], best[size:]), 2 * size
        if size < width:
            best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
        at = (low - (best & low)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at)) - 1
        context = _run_hashes(part, first, last + window) + mix(((at[first] - first) << 32) + (last - first))
        yield grams[at[first]], mix(context), first + base, last + base


SPOT_SCHEMA = "ord long, text_key long, anchor long, ctx long, lo int, hi int"


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """A null id stands behind all others. Rows that repeat id and text are told apart by nobody and share one answer."""
    own = F.col(doc_id).cast("long")
    largest = F.lit((1 << 63) - 1)
    return docs.select(own.alias("doc_id"), F.coalesce(own, largest).alias("ord"), F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("text_key"), F.col(text).alias("text"))


def _bytes(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def spots(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    """The stored suffix stretches of all documents."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SPOT_SCHEMA.split(", ")]
        for part in (p for batch in batches for p in slices(batch)):
            out: list[list[np.ndarray]] = []
            for own, key, text in zip(part["ord"].to_numpy(), part["text_key"].to_numpy(), _bytes(part["text"]), strict=True):
                for anchor, context, first, last in stretches(hashed_words(text), window, gram):
                    out.append([np.full(len(first), own), np.full(len(first), key), signed(anchor), signed(context), first.astype(np.int32), last.astype(np.int32)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    return stored(keyed.select("ord", "text_key", "text").mapInArrow(sample, SPOT_SCHEMA))


CONTEXT_SCHEMA = "anchor long, ctx long, least long, size long, words binary"


def _with_words(keyed: DataFrame, contexts: DataFrame, window: int) -> DataFrame:
    """The words of each context, from the document that stands for it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, before = [x.split()[0] for x in CONTEXT_SCHEMA.split(", ")], None
        for part in (p for batch in batches for p in slices(batch)):
            rows = []
            for own, key, asked, text in zip(part["ord"].to_pylist(), part["text_key"].to_pylist(), part["asked"].to_pylist(), _bytes(part["text"]), strict=True):
                # rows repeated in full stand next to each other
                if (own, key) == before:
                    continue
                before, words = (own, key), hashed_words(text)
                rows += [(a["anchor"], a["ctx"], own, a["size"], words[a["lo"] : a["hi"] + window].tobytes()) for a in asked]
            if rows:
                types = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    asked = contexts.groupBy("ord", "text_key").agg(F.collect_list(F.struct("anchor", "ctx", "size", "lo", "hi")).alias("asked"))
    return keyed.select("ord", "text_key", "text").join(asked, ["ord", "text_key"]).mapInArrow(cut, CONTEXT_SCHEMA)


def deep_nodes(words: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes ``starts`` in the order of a suffix tree, and where each of its topmost nodes of that depth begins.

    Names of runs of 1, 2, 4, ... words keep the order of the runs; two names at most order
    the suffixes to ``depth``. The common prefix of two neighbours adds up runs of falling length. A
    node as deep as ``depth`` is a stretch of neighbours that share so much.
    """
    names, size = [np.unique(words, return_inverse=True)[1]], 1
    while 2 * size <= depth:
        last = names[-1]
        pairs = last[:-size] * (len(words) + 1) + last[size:]
        names.append(np.unique(pairs, return_inverse=True)[1])
        size *= 2
    order = starts[np.lexsort((names[-1][starts + depth - size], names[-1][starts]))]
    common = np.zeros(max(0, len(order) - 1), dtype=np.int64)
    for level in range(len(names) - 1, -1, -1):
        run = names[level]
        a, b = order[:-1] + common, order[1:] + common
        inside = (common + (1 << level) <= depth) & (np.maximum(a, b) < len(run))
        common[inside] += (run[a[inside]] == run[b[inside]]) << level
    # what the largest runs leave over below the depth
    a, b = order[:-1] + depth - size, order[1:] + depth - size
    common = np.where((common >= size) & (names[-1][a] == names[-1][b]), depth, np.minimum(common, depth - 1)) if depth > size else common
    return order, np.flatnonzero(np.concatenate(([True], common < depth)))


TREE_SCHEMA = "anchor long, ctx long, mins array<long>"


def _trees(contexts: DataFrame, window: int, tree_words: int) -> DataFrame:
    """Per context the smallest document that holds each of its windows; whole anchors are built together."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        words = np.frombuffer(b"".join(h[3] for h in held), dtype=np.uint64)
        lengths = np.array([len(h[3]) // 8 for h in held])
        counts = lengths - window + 1
        at = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(held)), counts)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = at[owner] + inside
        order, nodes = deep_nodes(words, starts, window)
        # where each suffix lies among the windows
        window_of = np.full(len(words), -1)
        window_of[starts] = np.arange(len(starts))
        ranked = window_of[order]
        least = np.array([h[2] for h in held], dtype=np.int64)
        smallest = np.minimum.reduceat(least[owner[ranked]], nodes)
        mins = np.empty(len(starts), dtype=np.int64)
        mins[ranked] = np.repeat(smallest, np.diff(np.append(nodes, len(ranked))))
        offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
        columns = [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.ListArray.from_arrays(offsets, mins)]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "ctx", "mins"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("anchor", "ctx", "least", "words")), strict=True):
                if held and n > tree_words and row[0] != held[-1][0]:
                    yield solve(held)
                    held, n = [], 0
                if not held or row[:2] != held[-1][:2]:
                    held.append(row)
                    n += len(row[3]) // 8
        if held:
            yield solve(held)

    dealt = contexts.select("anchor", "ctx", "least", "words").repartition("anchor").sortWithinPartitions("anchor", "ctx")
    return dealt.mapInArrow(build, TREE_SCHEMA)


def _lengthened(contexts: DataFrame, window: int) -> DataFrame:
    """The same for anchors with too many contexts for one tree: each whole window is a prefix, folded by an aggregate."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            out = []
            for anchor, context, least, body in zip(*(part[c].to_pylist() for c in ("anchor", "ctx", "least", "words")), strict=True):
                words = np.frombuffer(body, dtype=np.uint64)
                first = np.arange(len(words) - window + 1)
                # a second hash over other word values makes collisions as rare as for 128 bits
                keys = _run_hashes(words, first, first + window), _run_hashes(mix(words + np.uint64(1)), first, first + window)
                out.append([np.full(len(first), anchor), np.full(len(first), context), np.full(len(first), least), first.astype(np.int32), *map(signed, keys)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["anchor", "ctx", "least", "at", "key", "check"])

    windows = stored(contexts.select("anchor", "ctx", "least", "words").mapInArrow(explode, "anchor long, ctx long, least long, at int, key long, check long"))
    nodes = windows.groupBy("key", "check").agg(F.min("least").alias("smallest"), F.max("least").alias("largest")).filter("smallest < largest")
    met = windows.join(nodes, ["key", "check"], "left").groupBy("anchor", "ctx")
    pairs = F.array_sort(F.collect_set(F.struct("at", F.coalesce("smallest", "least").alias("least"))))
    return met.agg(F.transform(pairs, lambda p: p["least"]).alias("mins"))


def repeated_spans(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM, group_contexts: int = GROUP_CONTEXTS, tree_words: int = TREE_WORDS) -> DataFrame:
    """(ord, text_key, spans): stretches of words whose windows also start in a document of smaller id."""
    sampled = spots(keyed, window, gram)
    # stored, so that joins on a frequent anchor deal both sides and may split it
    shared = stored(sampled.groupBy("anchor").agg(F.min("ord").alias("least"), F.max("ord").alias("largest")).filter("least < largest").select("anchor"))
    members = stored(sampled.join(shared, "anchor", "left_semi"))
    place = F.min(F.struct("ord", "text_key", "lo", "hi")).alias("place")
    contexts = stored(members.groupBy("anchor", "ctx").agg(place).select("anchor", "ctx", "place.*"))
    several = stored(contexts.groupBy("anchor").agg(F.count("*").alias("size")).filter("size > 1"))
    bodies = stored(_with_words(keyed, contexts.join(several, "anchor"), window))
    small = _trees(bodies.filter(F.col("size") <= group_contexts), window, tree_words)
    large = _lengthened(bodies.filter(F.col("size") > group_contexts), window)
    nodes = stored(contexts.select("anchor", "ctx", F.col("ord").alias("least")).join(small.unionByName(large), ["anchor", "ctx"], "left"))

    def span(start: Column, end: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))

    late = F.filter(F.sequence(F.lit(0), F.col("hi") - F.col("lo")), lambda i: F.get("mins", i) < F.col("ord"))
    found = F.when(F.col("mins").isNotNull(), F.transform(late, lambda i: span(F.col("lo") + i, F.col("lo") + i + window)))
    found = found.when(F.col("least") < F.col("ord"), F.array(span(F.col("lo"), F.col("hi") + window)))
    spans = members.join(nodes, ["anchor", "ctx"]).withColumn("found", found).filter(F.size("found") > 0)
    return spans.groupBy("ord", "text_key").agg(F.flatten(F.collect_set("found")).alias("spans"))


def without_repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM, group_contexts: int = GROUP_CONTEXTS, kept_text: bool = False
) -> DataFrame:
    """Every document without the words that a repeated window covers: n_words, n_removed, kept_sha256, and ``kept`` if asked for.

    A word goes if it lies in a run of ``window`` words that also starts in a document of smaller id; all
    runs are judged on the input. The words that stay are joined by one space. A null text has no words. A null id
    is larger than any other, so that its repeats go, and two null ids leave each other
    alone, as do rows that repeat an id. An empty table gives no rows.
    """
    keyed = _keyed(docs, text, doc_id)
    spans = repeated_spans(keyed, window, gram, group_contexts)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if kept_text else "")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            rows = []
            for own, found, body in zip(part["doc_id"].to_pylist(), part["spans"].to_pylist(), _bytes(part["text"]), strict=True):
                words = body.split()
                left = words
                if found:
                    edges = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edges, [s["start"] for s in found], 1)
                    np.add.at(edges, [s["end"] for s in found], -1)
                    left = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                kept = b" ".join(left)
                rows.append((own, len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), *([kept] if kept_text else [])))
            types = [pa.int64()] * 3 + [pa.string()] * (2 if kept_text else 1)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    joined = keyed.join(spans, ["ord", "text_key"], "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(remove, schema)
