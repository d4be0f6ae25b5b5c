"""Exact Jaccard join over word shingles by set relations.

A set's shingles stand in the order of their hashes, which cuts into position blocks.
Two sets that may link differ in at most ``d`` shingles, so of ``d + 1`` blocks one agrees as a
whole: index lists are kept per (size class, block position, block content), and all
other blocks are skipped without being compared. Answers are derived from sets
already answered: equal sets share one entry, every set of a list is first compared with
the list's leader, and sets known to be in the leader's component need no answers of
their own. Only members of one list that are still apart are compared with each other,
in one of the blocks that they share, less those that their distances to the leader, or the
parities of their members in a small bitmap, rule out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweir.llm.common import gram_hashes, key_filter, maybe_in, mix, numbered, row_of, signed, slices, stored, word_hashes
from docweir.llm.components import components

SHINGLE = 3
PERCENT = 90
#: Largest size of a class over its smallest.
CLASS_RATIO = 1.25
#: Low bits of a key that hold the class; 1.25 to the power of 255 is beyond any text.
CLASS_MASK = 255
#: Blocks before a block in which a pair that also agrees there has met already.
LOOK_BACK = 16


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles of a text."""
    return np.unique(gram_hashes(word_hashes(text or ""), k))


def size_classes(percent: int, ratio: float, n: int) -> list[tuple[int, int]]:
    """(class number, its number of blocks) for every class that a set of ``n`` shingles takes part in.

    Classes cover sizes from ``lows[c]`` to ``lows[c + 1] - 1``. The smaller set of a pair decides the class;
    the larger one also enters the classes of the sets that it may be the larger one to.
    """
    out, low, number = [], 1, 0
    while low <= n:
        high = max(low, int(low * ratio))
        largest = high * 100 // percent
        if n <= largest:
            # |x - y| + |y - x| <= (100 - p) / (100 + p) * (|x| + |y|)
            apart = (100 - percent) * (high + largest) // (100 + percent)
            out.append((number, apart + 1))
        low, number = high + 1, number + 1
    return out


def block_keys(hashes: np.ndarray, percent: int = PERCENT, ratio: float = CLASS_RATIO) -> np.ndarray:
    """Keys of a set's index lists: one per class and block, from the block's place and all shingles in it."""
    out = []
    for number, blocks in size_classes(percent, ratio, len(hashes)):
        if blocks == 1:
            # sets of this class link only when equal, and equal sets are one entry
            continue
        block = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        edges = np.searchsorted(block, np.arange(blocks, dtype=np.uint64))
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(hashes), dtype=np.uint64)))
        ends = np.append(edges[1:], len(hashes))
        content = sums[ends] - sums[edges]
        place = np.arange(blocks, dtype=np.uint64) + np.uint64(number << 32)
        keys = mix(mix(content + (ends - edges).astype(np.uint64)) + mix(place + np.uint64(1)))
        # the class can be read from the key
        out.append((keys & ~np.uint64(CLASS_MASK)) | np.uint64(number))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _features(k: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1024)):
            sets = [shingle_set(value.as_py(), k) for value in batch["text"]]
            keys = [signed(block_keys(x, percent)) for x in sets]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            columns = [batch["doc_id"], batch["row"], pa.array([len(x) for x in sets], pa.int64())]
            # two independent sums over the members tell sets apart
            for salt in (0, 77):
                sums = np.array([np.add.reduce(mix(x + np.uint64(salt)), dtype=np.uint64) for x in sets], dtype=np.uint64)
                columns.append(pa.array(signed(sums)))
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n", "sum_one", "sum_two", "keys"])

    return run


def _sets(bits: np.ndarray, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(maybe_in(bits, batch["spread"].to_numpy())))
            for part in slices(batch, 1024):
                sets = [shingle_set(value.as_py(), k).tobytes() for value in part["text"]]
                yield pa.RecordBatch.from_arrays([part["row"], pa.array(sets, pa.binary())], names=["id", "members"])

    return run


def parities(hashes: np.ndarray, bits: int) -> np.ndarray:
    """How many members fall on each of ``bits`` places, odd or even, as 64-bit words.

    Two sets differ in at least as many members as their bitmaps do in bits.
    """
    odd = (np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _bitmaps(percent: int, ratio: float = CLASS_RATIO) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, classes, maps, keys, home = [], [], [], [], []
            for key, value in zip(batch["id"].to_pylist(), batch["members"], strict=True):
                hashes = np.frombuffer(value.as_buffer(), dtype=np.uint64)
                own = block_keys(hashes, percent, ratio)
                taken = size_classes(percent, ratio, len(hashes))
                for number, blocks in taken:
                    # wide enough to tell sets apart that differ in a little more than a link allows
                    bits = max(256, 1 << (10 * blocks).bit_length())
                    ids.append(key)
                    classes.append(number)
                    maps.append(parities(hashes, bits))
                    keys.append(signed(own[own & np.uint64(CLASS_MASK) == np.uint64(number)]))
                    # the last class is the one that the set's own size is in
                    home.append(number == taken[-1][0])
            columns = [pa.array(ids, pa.int64()), pa.array(classes, pa.int64()), pa.array(maps, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(home, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "class", "bitmap", "class_keys", "home"])

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def members(value: pa.Scalar) -> np.ndarray:
        return np.frombuffer(value.as_buffer(), dtype=np.uint64)

    for batch in batches:
        n_a, n_b, common = [], [], []
        for one, two in zip(batch["members_a"], batch["members_b"], strict=True):
            x, y = members(one), members(two)
            n_a.append(len(x))
            n_b.append(len(y))
            common.append(len(np.intersect1d(x, y, assume_unique=True)))
        columns = [batch["a"], batch["b"], *(pa.array(c, pa.int64()) for c in (n_a, n_b, common))]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n_a", "n_b", "common"])


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stored pairs (a, b) with their exact Jaccard distance and whether they link.

    A leader with many pairs is one row of ``sets``: the join may split its pairs.
    """
    rows = pairs.join(sets.toDF("a", "members_a"), "a").join(sets.toDF("b", "members_b"), "b")
    counts = rows.select("a", "b", "members_a", "members_b").mapInArrow(_common, "a long, b long, n_a long, n_b long, common long")
    either = F.col("n_a") + F.col("n_b") - F.col("common")
    distance = (1 - F.col("common") / either).alias("distance")
    return stored(counts.select("a", "b", "n_b", distance, (F.col("common") * 100 >= either * percent).alias("linked")))


def still_apart(lists: DataFrame, answers: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of one list in different components that neither the leader's answers nor the bitmaps rule out.

    At least one of a pair is not in the leader's component. Jaccard distance obeys the triangle
    inequality, so members whose distances to the leader differ by more than a link
    allows do not link; nor do sets whose bitmaps differ in more places than linked sets in members.
    A pair meets in the class of its smaller set alone, and not in a block behind which,
    within LOOK_BACK blocks, another one agrees: there it has met before, with each other or with a leader.
    """
    known = answers.select(F.col("a").alias("leader"), F.col("b").alias("id"), F.col("n_b").alias("n"), "distance")
    part, first = F.coalesce("part", "id"), F.coalesce("leader_part", "leader")
    known = known.join(parts.toDF("id", "part"), "id", "left").join(parts.toDF("leader", "leader_part"), "leader", "left")
    known = known.select("leader", "id", "n", "distance", part.alias("part"), (part != first).alias("away"))
    rows = lists.filter("id <> leader").join(known, ["leader", "id"]).drop("leader")
    mixed = rows.filter("away").select("key").distinct()
    rows = rows.join(mixed, "key").withColumn("class", F.col("key").bitwiseAND(F.lit(CLASS_MASK).cast("long")))
    rows = stored(rows)
    schema = "id long, class long, bitmap array<long>, class_keys array<long>, home boolean"
    bitmaps = sets.join(rows.select("id").distinct(), "id", "left_semi").mapInArrow(_bitmaps(percent), schema)
    place = F.array_position("class_keys", F.col("key")).cast("int")
    rows = rows.join(stored(bitmaps), ["id", "class"]).withColumn("place", place)
    back = F.slice("class_keys", F.greatest(F.lit(1), F.col("place") - LOOK_BACK), F.least(F.lit(LOOK_BACK), F.col("place") - 1))
    rows = rows.select("key", "id", "n", "part", "away", "distance", "bitmap", "home", back.alias("back"))
    other = rows.toDF(*[f"{c}_b" if c != "key" else c for c in rows.columns])
    near = F.abs(F.col("distance") - F.col("distance_b")) <= (100 - percent) / 100 + 1e-9
    differ = F.aggregate(F.zip_with("bitmap", "bitmap_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    close = differ * (100 + percent) <= (F.col("n") + F.col("n_b")) * (100 - percent)
    once = ~F.col("away_b") | (F.col("id") < F.col("id_b"))
    new = (F.col("home") | F.col("home_b")) & ~F.arrays_overlap("back", "back_b")
    pairs = rows.filter("away").join(other, "key").filter((F.col("part") != F.col("part_b")) & once & near & new & close)
    return pairs.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct()


def entry_components(source: DataFrame, entries: DataFrame, features: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of the entries that link with another one."""
    own = features.join(entries.select(F.col("id").alias("row")), "row", "left_semi")
    postings = own.select(F.explode("keys").alias("key"), F.col("row").alias("id"))
    leaders = postings.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("length")).filter("length > 1").drop("length")
    lists = stored(postings.join(leaders, "key"))
    # row numbers stand in few residues; their hashes spread
    bits = key_filter(lists.select(F.xxhash64("id").alias("spread")), "spread")
    sets = stored(source.select("row", F.xxhash64("row").alias("spread"), "text").mapInArrow(_sets(bits, k), "id long, members binary"))
    first = compared(lists.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), sets, percent)
    links = first.filter("linked").select("a", "b")
    parts = components(links)
    more = compared(still_apart(lists, first, parts, sets, percent), sets, percent).filter("linked").select("a", "b")
    return components(links.union(more)) if more.head(1) else parts


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = SHINGLE, percent: int = PERCENT, row: str | None = None) -> DataFrame:
    """Every document with the size of its shingle set and its component.

    Sets link when 100 * |both| >= percent * |either|. A text of fewer than ``k`` words is one
    shingle; null or without words it is an empty set and links with nothing.
    ``component_id`` is the smallest id reachable by links; rows count by themselves when ids
    repeat, and a null id is a component's only where it has no other. Nothing is capped: lists of any
    length are folded by aggregates and joined by key. An empty table gives no rows.
    ``component`` numbers the components by row. ``row`` names a column that numbers the rows of a
    stored table, if there is one.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *([] if row is None else [row_of(row)]))
    source = numbered(source) if row is None else source
    schema = "doc_id long, row long, n long, sum_one long, sum_two long, keys array<long>"
    features = stored(source.select("doc_id", "row", "text").mapInArrow(_features(k, percent), schema))
    same = ["n", "sum_one", "sum_two"]
    entries = stored(features.filter("n > 0").groupBy(*same).agg(F.min("row").alias("id"), F.min("doc_id").alias("least")))
    parts = entry_components(source, entries, features, k, percent)
    labelled = entries.join(parts.toDF("id", "part"), "id", "left").withColumn("part", F.coalesce("part", "id"))
    least = labelled.filter("part is not null").groupBy("part").agg(F.min("least").alias("component_id"))
    labelled = labelled.join(least, "part").select(*same, "part", "component_id")
    return features.join(labelled, same, "left").select(
        "doc_id", "row", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("part", "row").alias("component"),
    )
