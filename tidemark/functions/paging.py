"""One page of an ordered result, with the number of rows it was cut from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list[Column], *, limit: int, offset: int = 0,
         total: str | None = None) -> DataFrame:
    """``total`` names a column for the count of all rows. It is an aggregate of its own beside the top rows, as a
    window over everything would bring all rows into one task. A page without rows has no total.
    """
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    found = rows.orderBy(*order).offset(offset).limit(limit)
    if total is None:
        return found
    if total in rows.columns:
        raise ValueError(f"the rows have a column {total} already")
    return found.withColumn(total, rows.agg(F.count(F.lit(1))).scalar())
