"""Deterministic bottom-k samples by row hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DIGITS = 10


def hash_key(seed: int, columns: list[Column]) -> Column:
    """Uniform hex key of a row, the same in any engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns).cast("binary"))


def bottom_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows with the smallest hex keys.

    A global sort-and-limit would send k rows from every partition to one task. The keys
    are uniform, so a cut a little above k/n keeps just over k rows; it is checked, and
    widened until at least k rows (or all) are under it, so the result is exact.
    """
    if k <= 0:
        return df.limit(0)
    n = df.count()
    share = min(1.0, (k + 6 * k ** 0.5 + 16) / n) if n else 1.0
    while share < 1.0:
        cut = format(int(share * 16 ** _DIGITS), f"0{_DIGITS}x")
        under = df.where(F.col(key) < cut)
        if under.count() >= k:
            return under.orderBy(key).limit(k)
        share = min(1.0, share * 2)
    return df if n <= k else df.orderBy(key).limit(k)
