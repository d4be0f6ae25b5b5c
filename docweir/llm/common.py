"""Shared pieces of the operators: row numbers, ASCII folding, word hashes and fixed-size filters."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from contextvars import ContextVar
from string import ascii_lowercase, ascii_uppercase

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweir.session import shared_folder

WHITE_SPACE = r"[\x20\x09-\x0D]+"
FILTER_BITS = 1 << 23
_WORD_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
# the inverse of the base modulo 2**64, by Newton's iteration
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)


@contextlib.contextmanager
def owned(paths: list[str]) -> Iterator[None]:
    """Notes the tables that operators store in the block in ``paths``, whose owner may delete them later.

    Tables stored outside such a block belong to the frames made from them and are never deleted here.
    """
    token = _owner.set(paths)
    try:
        yield
    finally:
        _owner.reset(token)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder; a lost executor reads it again instead of what led to it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    if (paths := _owner.get()) is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_stored(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of an owner that has written every result made from them."""
    context = spark.sparkContext
    while paths:
        path = context._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null becomes the empty string."""
    return F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)


def row_of(row: str | None) -> Column:
    """The caller's own row number, or a new one."""
    return F.monotonically_increasing_id().alias("row") if row is None else F.col(row).alias("row")


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """The rows as a stored table with a unique long per row, so that rows repeated in full stay apart.

    The numbers are taken before the write and read back from it: later stages and
    retries see the same ones.
    """
    return stored(df.withColumn(name, F.monotonically_increasing_id()))


def mix(values: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers one to one."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def spans_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums of a polynomial over random byte values."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_WORD_BYTES[data] * _powers(len(data), _BASE), out=sums[1:])
    own = (sums[ends] - sums[starts]) * _powers(len(data), _INVERSE)[starts]
    return mix(own + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the white-space separated words of a text with A-Z in lower case."""
    data = np.frombuffer(text.encode().lower(), dtype=np.uint8)
    starts, ends = spans_of(~_SPACE[data])
    return span_hashes(data, starts, ends)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words; a shorter text is one run as a whole, none without words."""
    k = min(k, len(words))
    if not k:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = mix(out + words[i : len(words) - k + 1 + i] * np.uint64(2 * i + 3))
    return out


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A membership filter of FILTER_BITS bits over long keys that are hashes: a megabyte at any number of keys.

    A word of 64 bits is one row of an aggregate, so at most FILTER_BITS / 64 rows reach the driver.
    """
    bit = F.pmod(F.col(column), F.lit(FILTER_BITS)).cast("int")
    rows = (
        keys.select(bit.alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits"))
        .collect()
    )
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in rows:
        out[r.word] = r.bits
    return out


def maybe_in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which signed long keys the filter may hold; never misses one that it does."""
    at = np.mod(signed(keys) if keys.dtype == np.uint64 else keys, FILTER_BITS)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def slices(batch, size: int = 256) -> Iterator:
    """Smaller record batches, so that what is built from long texts stays bounded."""
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)
