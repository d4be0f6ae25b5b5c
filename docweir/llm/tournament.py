"""Packing by first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweir.llm.common import numbered
from docweir.llm.tokens import vocabulary, word_ids

MAX_LEN = 2048
GROUP_PIECES = 4096
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"


class Tournament:
    """Bins as leaves, each inner node holding the larger capacity of its two; finds the first bin that is wide enough."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """Takes ``length`` from the first bin that has it: the bin and its room before."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < length:
                at += 1
        before, leaf = room[at], at - self.leaves
        room[at] = before - length
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return leaf, before


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, max_len: int = MAX_LEN, special: bool = False) -> DataFrame:
    """One row per piece of at most ``max_len`` ids: every document's ids and its end id, cut where a sequence is full."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path or vocabulary(), special)
        for batch in batches:
            rows = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(body.as_py()).astype("<u4")
                rows += [(key, at, len(part := ids[at : at + max_len]), zlib.crc32(part), len(ids)) for at in range(0, len(ids), max_len)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
        # a worker goes on to other stages; what is kept for the words of this task is not theirs
        encoder.clear()

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(tokenise, PIECE_SCHEMA)


def _first_fit(max_len: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "row"], ascending=[False, True, True, True], kind="stable")
        tree = Tournament(len(group), max_len)
        placed = [tree.place(n) for n in group["length"].tolist()]
        bins, before = np.array(placed, dtype=np.int64).T
        return group.assign(sequence_id=(int(key[0]) << 32) + bins, offset=max_len - before).drop(columns=["row", "group"])

    return fill


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, max_len: int = MAX_LEN, group_pieces: int = GROUP_PIECES, special: bool = False) -> DataFrame:
    """Every piece with its sequence and its place there.

    Pieces are dealt to groups of about ``group_pieces`` by a hash of their row number, so
    no document, source or length fills a group; each group is packed by itself, longest
    piece first, into the first sequence with room. A null text has its end id alone; rows
    that repeat an id are documents of their own. An empty table gives no rows. With
    ``special``, the content of an added token in a text is that token.
    """
    table = numbered(pieces(docs, text, doc_id, path, max_len, special))
    groups = max(1, round(table.count() / group_pieces))
    dealt = table.withColumn("group", F.pmod(F.xxhash64(F.col("row"), F.lit("group")), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(_first_fit(max_len), PLACED_SCHEMA)
