"""Neighbour rows inside large groups.

A plain window sorts a whole group in one task. Here a group is cut into blocks
of its order key, so a dialogue or job that holds a third of all rows is spread
over many tasks; only one edge row per block meets its neighbours again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
SLICES = 64


def first_rows(rows: DataFrame, key: str, order: list[Column], limit: int, rank: str, slice_by: str) -> DataFrame:
    """The first ``limit`` rows of each group, numbered by ``rank``.

    Slices of the groups are ranked first, so a huge group is cut by many tasks
    before one of them orders what is left.
    """
    part = Window.partitionBy(key, F.pmod(F.xxhash64(slice_by), F.lit(SLICES))).orderBy(*order)
    rows = rows.withColumn(rank, F.row_number().over(part)).where(F.col(rank) <= limit).drop(rank)
    whole = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= limit)


def with_neighbour(
    rows: DataFrame, key: str, order: str, name: str, value: Column, step: int = -1, block: int = BLOCK
) -> DataFrame:
    """Add ``name``: ``value`` of the previous (``step=-1``) or next (``step=1``) row of the group.

    ``order`` is an integer that numbers the rows of a group; gaps are fine.
    """
    if step not in (-1, 1):
        raise ValueError("step is -1 or 1")
    back = step == -1
    cut = rows.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_value", F.struct(value.alias("v")))
    near = Window.partitionBy(key, "_block").orderBy(order)
    pick = F.max_by if back else F.min_by
    edges = cut.groupBy(key, "_block").agg(pick("_value", order).alias("_edge"))
    far = Window.partitionBy(key).orderBy("_block")
    shift = F.lag if back else F.lead
    edges = edges.select(key, "_block", shift("_edge").over(far).alias("_edge"))
    return (
        cut.withColumn("_near", shift("_value").over(near))
        .join(edges, [key, "_block"])
        .withColumn(name, F.coalesce("_near", "_edge")["v"])
        .drop("_block", "_value", "_near", "_edge")
    )
