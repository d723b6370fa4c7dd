"""Threshold aggregation and table summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schema import require_columns

GROUPS = ["from_account", "to_account"]
ORDERINGS = ["txn_count", "total_amount", "avg_amount", "min_amount", "max_amount",
             "distinct_counterparties"]


def threshold_groups(df: DataFrame, group_by: str = "from_account", *, min_count: int = 1,
                     max_amount: float | None = None, min_amount: float | None = None,
                     window_days: int | None = None) -> DataFrame:
    """All groups with at least ``min_count`` rows after the amount and recency filters.

    The trailing window ends at the newest row left by the amount filters.
    """
    require_columns(df.columns, [group_by, "amount_paid", "timestamp", "to_account"],
                    "aggregation")
    if group_by not in GROUPS:
        raise ValueError(f"group_by must be one of {', '.join(GROUPS)}")
    if min_count < 1:
        raise ValueError("min_count must be at least 1")
    rows = df.where(F.col(group_by).isNotNull() & F.col("amount_paid").isNotNull()
                    & F.col("timestamp").isNotNull())
    if max_amount is not None:
        rows = rows.where(F.col("amount_paid") <= max_amount)
    if min_amount is not None:
        rows = rows.where(F.col("amount_paid") >= min_amount)
    if window_days is not None:
        newest = rows.agg(F.max("timestamp")).first()[0]
        if newest is not None:
            edge = F.lit(newest) - F.make_dt_interval(F.lit(window_days))
            rows = rows.where(F.col("timestamp") >= edge.cast(rows.schema["timestamp"].dataType))
    return (rows.groupBy(group_by).agg(
                F.count("*").alias("txn_count"),
                F.sum("amount_paid").alias("total_amount"),
                F.avg("amount_paid").alias("avg_amount"),
                F.min("amount_paid").alias("min_amount"),
                F.max("amount_paid").alias("max_amount"),
                F.min("timestamp").alias("first_seen"),
                F.max("timestamp").alias("last_seen"),
                F.count_distinct("to_account").alias("distinct_counterparties"))
            .where(F.col("txn_count") >= min_count))


def top_groups(groups: DataFrame, group_by: str = "from_account", *,
               order_by: str = "txn_count", limit: int = 100) -> DataFrame:
    if order_by not in ORDERINGS:
        raise ValueError(f"order_by must be one of {', '.join(ORDERINGS)}")
    if limit < 1:
        raise ValueError("limit must be positive")
    return groups.orderBy(F.col(order_by).desc(), F.col(group_by)).limit(limit)


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: size, positives, dates and distinct ends."""
    return df.agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.sum(F.col("is_laundering").cast("long")), F.lit(0)).alias("positives"),
        F.min("txn_date").alias("date_min"), F.max("txn_date").alias("date_max"),
        *[F.count_distinct(c).alias(f"distinct_{c}")
          for c in ("from_account", "to_account", "from_bank", "to_bank")],
    ).withColumn("positive_rate_pct", F.round(
        F.coalesce(F.try_divide(F.col("positives") * 100.0, F.col("row_count")), F.lit(0.0)), 4))


def frequency(df: DataFrame, column: str) -> DataFrame:
    return (df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("row_count"))
              .orderBy(F.desc("row_count"), F.col("value").asc_nulls_last()))


def knowledge_summary(df: DataFrame) -> DataFrame:
    positive = F.col("is_laundering") == 1
    return df.agg(
        F.count("*").alias("row_count"),
        F.count_if(positive).alias("positives"),
        F.count_if(F.col("is_laundering") == 0).alias("normals"),
        F.count_distinct(F.when(positive, F.col("laundering_type"))).alias("typologies"),
        F.min("txn_date").alias("date_min"), F.max("txn_date").alias("date_max"))


def detection_spotcheck(scored: DataFrame) -> DataFrame:
    """One row of counts over scored transactions; model columns only where present."""
    parts = [F.count("*").alias("row_count"),
             F.count_if(F.size("rule_flags") > 0).alias("rule_flagged"),
             F.count_if("iqr_flag").alias("iqr_flagged")]
    if "ml_score" in scored.columns:
        parts += [F.count_if(F.col("anomaly_label") == 1).alias("anomalies"),
                  F.min("ml_score").alias("ml_min"), F.max("ml_score").alias("ml_max")]
    return scored.agg(*parts)
