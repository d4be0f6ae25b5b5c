"""Operational listings: filtered, searched, newest first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def browse(
    rows: DataFrame,
    filters: dict | None = None,
    search: str = "",
    search_in: tuple[str, ...] = (),
    newest: str | None = None,
    order: tuple[str, ...] = (),
    hide: tuple[str, ...] = (),
    users: DataFrame | None = None,
) -> DataFrame:
    """Equality filters, a case-blind search over several columns, an order, hidden columns.

    With ``users(user_id, email)`` the owner's address joins in and can be searched.
    """
    out = rows.drop(*hide)
    if users is not None:
        out = out.join(users, "user_id", "left")
    for column, value in (filters or {}).items():
        out = out.where(F.col(column) == value)
    for word in search.split():
        # every word has to stand in one of the columns
        tests = [F.contains(F.lower(c), F.lit(word.lower())) for c in search_in]
        out = out.where(F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False)))
    if newest:
        out = out.orderBy(F.desc(newest), *order)
    elif order:
        out = out.orderBy(*order)
    return out


def preview(rows: DataFrame, column: str = "content", size: int = 100) -> DataFrame:
    return rows.withColumn("content_preview", F.substring(column, 1, size)).drop(column)
