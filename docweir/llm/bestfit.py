"""Packed token-id matrices: best-fit decreasing with a segment tree over free capacities."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweir.llm.tokens import vocabulary, word_ids

MAX_LEN = 2048
GROUP_BYTES = 8 << 20
SEGMENT_SCHEMA = "doc_id long, start long, length int, ids binary"
MATRIX_SCHEMA = (
    "sequence_id long, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, position_ids binary, "
    "doc_ids array<long>, starts array<long>, lengths array<int>"
)


class Capacities:
    """A segment tree over capacities 0..top that counts open bins; finds the smallest capacity that suffices."""

    def __init__(self, top: int) -> None:
        self.leaves = 1 << top.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(top + 1)]

    def add(self, capacity: int, number: int) -> None:
        self.bins[capacity].append(number)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at //= 2

    def take(self, length: int) -> tuple[int, int] | None:
        """Removes the fullest bin that still has ``length``: its number and capacity, or None."""
        count, at = self.count, length + self.leaves
        if not count[at]:
            # up to the first right neighbour that holds bins, then down to its leftmost leaf
            while at > 1 and (at & 1 or not count[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at *= 2
                if not count[at]:
                    at += 1
        capacity = at - self.leaves
        self._change(capacity, -1)
        return self.bins[capacity].pop(), capacity


def best_fit(lengths: list[int], max_len: int) -> tuple[list[int], int]:
    """The bin of each length, given in decreasing order, and the number of bins."""
    tree, bins, opened = Capacities(max_len), [], 0
    for n in lengths:
        found = tree.take(n)
        if found is None:
            found, opened = (opened, max_len), opened + 1
        tree.add(found[1] - n, found[0])
        bins.append(found[0])
    return bins, opened


def segments(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, max_len: int = MAX_LEN, special: bool = False) -> DataFrame:
    """Every document's ids with its end id, overlong ones split into runs of ``max_len``, as little-endian bytes."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path or vocabulary(), special)
        for batch in batches:
            rows = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(body.as_py())
                rows += [(key, at, len(part := ids[at : at + max_len]), part.tobytes()) for at in range(0, len(ids), max_len)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "length", "ids"])
        # a worker goes on to other stages; what is kept for the words of this task is not theirs
        encoder.clear()

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(tokenise, SEGMENT_SCHEMA)


def _matrix(max_len: int, pad: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "row"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        bins, opened = best_fit(group["length"].tolist(), max_len)
        lengths, bodies, starts = group["length"].tolist(), group["ids"].tolist(), group["start"].tolist()
        docs = [None if pd.isna(x) else int(x) for x in group["doc_id"].tolist()]
        members: list[list[int]] = [[] for _ in range(opened)]
        for at, number in enumerate(bins):
            members[number].append(at)
        steps = np.arange(max_len, dtype="<u4").tobytes()
        fill_id = np.array([pad], dtype=f"<u{len(bodies[0]) // lengths[0]}").tobytes()
        rows = []
        for number, part in enumerate(members):
            sizes = [lengths[i] for i in part]
            ends = [0, *itertools.accumulate(sizes)]
            room = max_len - ends[-1]
            ids = b"".join([*(bodies[i] for i in part), fill_id * room])
            positions = b"".join([*(steps[: 4 * n] for n in sizes), bytes(4 * room)])
            rows.append(((int(key[0]) << 32) + number, ends[-1], len(part), ids, ends, positions, [docs[i] for i in part], [starts[i] for i in part], sizes))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in MATRIX_SCHEMA.split(", ")])

    return fill


def packed_matrices(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, max_len: int = MAX_LEN, pad: int = 0, group_bytes: int = GROUP_BYTES, special: bool = False) -> DataFrame:
    """One row per packed sequence: ids padded to ``max_len``, cumulative segment lengths, positions from 0 in each segment.

    Ids stand as little-endian integers of two bytes (four beyond 65536 ids), positions of
    four. Segments go to groups of about ``group_bytes`` of text by a hash of their row, so a
    task holds one group however large a source or document is; within a group the longest
    goes first, each into the fullest sequence that has room. Nothing is dropped:
    ``doc_ids``, ``starts`` and ``lengths`` tell where each segment comes from. A null text is its end
    id alone; an empty table gives no rows. With ``special``, the content of an added token
    in a text is that token.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text)) + F.lit(1))).first()[0] or 0
    groups = max(1, round(size / group_bytes))
    rows = segments(docs, text, doc_id, path, max_len, special).withColumn("row", F.monotonically_increasing_id())
    dealt = rows.withColumn("group", F.pmod(F.xxhash64(F.col("row"), F.lit("group")), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(_matrix(max_len, pad), MATRIX_SCHEMA)


def unpacked(packed: DataFrame) -> DataFrame:
    """The segments of packed sequences again: doc_id, start, length and their ids as bytes."""
    width = F.octet_length("ids") * 4 / F.octet_length("position_ids")
    parts = packed.select("ids", width.cast("int").alias("width"), F.inline(F.arrays_zip("doc_ids", "starts", "lengths", F.slice("cu_seqlens", 1, F.size("doc_ids")).alias("at"))))
    return parts.select(
        F.col("doc_ids").alias("doc_id"), F.col("starts").alias("start"), F.col("lengths").alias("length"),
        F.expr("substring(ids, at * width + 1, lengths * width)").alias("ids"),
    )
