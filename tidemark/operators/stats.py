"""Per-account z-scores and interquartile bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import number
from tidemark.functions.quantiles import exact_quantiles
from tidemark.schema import require_columns


def iqr_bounds(normals: DataFrame, amount: str = "amount",
               multiplier: float = 1.5) -> tuple[float, float, float, float]:
    """(q1, q3, lower, upper) of the amounts."""
    found = exact_quantiles(normals, [amount], [0.25, 0.75])[amount]
    if found is None:
        raise ValueError("no normal amounts to take quartiles from")
    q1, q3 = found
    reach = multiplier * (q3 - q1)
    return q1, q3, q1 - reach, q3 + reach


def add_statistics(df: DataFrame, bounds: tuple[float, float], rows: DataFrame | None = None) -> DataFrame:
    """Add ``z_score`` (population deviation within the account), ``iqr_flag``, ``stat_score``.

    ``rows``: the same accounts and amounts from a cheaper frame, such as the input of the feature step; without
    it ``df`` is computed twice. Account means come from a partial aggregation and are joined back, so a large account
    is a skewed join side that adaptive execution can split, not one window task.
    """
    if "amount_paid" not in df.columns and "amount" in df.columns:
        df = df.withColumnRenamed("amount", "amount_paid")
    require_columns(df.columns, ["from_account", "amount_paid"], "statistics")
    value = F.col("amount_paid").try_cast("double")
    spread = (df if rows is None else rows).groupBy("from_account").agg(
        F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    named = spread.withColumnRenamed("from_account", "_acct")
    lower, upper = bounds
    joined = df.join(named, F.col("from_account").eqNullSafe(F.col("_acct")), "left")
    z = F.try_divide(value - F.col("_mean"), F.col("_std"))
    outside = F.coalesce((value < lower) | (value > upper), F.lit(False))
    return (joined.withColumn("_z", z)
                  .withColumn("z_score", number(joined.withColumn("_z", z), "_z"))
                  .withColumn("iqr_flag", outside)
                  .withColumn("stat_score", F.greatest(
                      F.least(F.abs("z_score") / 3, F.lit(1.0)),
                      F.col("iqr_flag").cast("double")))
                  .drop("_acct", "_mean", "_std", "_z"))
