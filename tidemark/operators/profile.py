"""Profiling aggregates behind the exploratory charts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.quantiles import exact_quantiles

CHART_PROBS = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def amount_percentiles(df: DataFrame, column: str = "amount_paid") -> DataFrame:
    found = exact_quantiles(df, [column], list(CHART_PROBS.values()))[column] or []
    return df.sparkSession.createDataFrame(
        [(n, float(v)) for n, v in zip(CHART_PROBS, found)], "percentile string, amount double")


def eda_summary(df: DataFrame, column: str = "amount_paid") -> DataFrame:
    """One row: amounts, distinct ends, span and label rate."""
    median, p90, p99 = (exact_quantiles(df, [column], [0.5, 0.9, 0.99])[column]
                        or (None, None, None))
    return df.agg(
        F.count("*").alias("row_count"), F.sum(column).alias("total_amount"),
        F.avg(column).alias("mean_amount"), F.lit(median).cast("double").alias("median_amount"),
        F.max(column).alias("max_amount"), F.lit(p90).cast("double").alias("p90_amount"),
        F.lit(p99).cast("double").alias("p99_amount"),
        F.count_distinct("from_account").alias("distinct_from"),
        F.count_distinct("to_account").alias("distinct_to"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.count_if(F.col("is_laundering") == 1).alias("positives"),
    ).withColumn("positive_rate_pct", F.round(
        F.coalesce(F.try_divide(F.col("positives") * 100.0, F.col("row_count")), F.lit(0.0)), 4))


def amount_histogram(df: DataFrame, column: str = "amount_paid", bins: int = 30) -> DataFrame:
    """Equal bins from the minimum to the 99th percentile, empty ones included.

    ``overflow`` repeats how many amounts lie above the last edge.
    """
    spark = df.sparkSession
    found = exact_quantiles(df, [column], [0.0, 0.99])[column]
    shape = "bin int, low double, high double, row_count long, overflow long"
    if found is None:
        return spark.createDataFrame([], shape)
    low, high = found
    if high <= low:
        high = low + max(abs(low) * 0.01, 1.0)
    step = (high - low) / bins
    place = F.least(F.floor((F.col(column) - low) / F.lit(step)), F.lit(bins - 1)).cast("int")
    over = df.where(F.col(column) > high).count()
    counted = (df.where(F.col(column) <= high).groupBy(place.alias("bin"))
                 .agg(F.count("*").alias("n")))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counted, "bin", "left")
            .select("bin", (F.lit(low) + F.col("bin") * F.lit(step)).alias("low"),
                    (F.lit(low) + (F.col("bin") + 1) * F.lit(step)).alias("high"),
                    F.coalesce("n", F.lit(0)).alias("row_count"),
                    F.lit(over).cast("long").alias("overflow")))


def daily_counts(df: DataFrame) -> DataFrame:
    return (df.where(F.col("timestamp").isNotNull())
              .groupBy(F.to_date("timestamp").alias("day"))
              .agg(F.count("*").alias("row_count")).orderBy("day"))


def category_top(df: DataFrame, column: str, k: int = 12) -> DataFrame:
    name = F.col(column)
    shown = F.when(name.isNull() | (name == ""), F.lit("Unknown")).otherwise(name)
    return (df.groupBy(shown.alias("category")).agg(F.count("*").alias("row_count"))
              .orderBy(F.desc("row_count"), "category").limit(k))


def customer_volume(df: DataFrame) -> DataFrame:
    """Five-number summary of transactions per sending account.

    Accounts fold to a count-of-counts first: that has at most sqrt(2 * rows) entries, so
    the weighted percentile stays small however many accounts there are.
    """
    counts = df.groupBy("from_account").agg(F.count("*").alias("c"))
    weights = counts.groupBy("c").agg(F.count("*").alias("w"))
    probs = F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)])
    box = weights.agg(F.sum("w").alias("accounts"),
                      F.percentile("c", probs, F.col("w")).alias("q"))
    return box.select("accounts", *[F.col("q")[i].alias(n) for i, n in enumerate(
        ("minimum", "lower_quartile", "median", "upper_quartile", "maximum"))])


def label_distribution(df: DataFrame) -> DataFrame:
    """Rows per risk band where scored, else per label."""
    if "risk_label" in df.columns:
        name = F.lower("risk_label")
    elif "is_laundering" in df.columns:
        name = F.when(F.col("is_laundering") == 1, "Labelled positive").otherwise("Not labelled")
    else:
        return df.sparkSession.createDataFrame([], "label string, row_count long")
    return df.groupBy(name.alias("label")).agg(F.count("*").alias("row_count"))


def risk_level_counts(df: DataFrame) -> DataFrame:
    """low, medium and high, absent ones as zero."""
    row = df.agg(*[F.count_if(F.lower("risk_label") == b).alias(b)
                   for b in ("low", "medium", "high")])
    return row.select(F.stack(F.lit(3), F.lit("low"), "low", F.lit("medium"), "medium",
                              F.lit("high"), "high").alias("label", "row_count"))


def weekday_hour_grid(df: DataFrame) -> DataFrame:
    """7 x 24 counts, Monday first, empty cells included."""
    cells = (df.where(F.col("timestamp").isNotNull())
               .groupBy(F.weekday("timestamp").alias("weekday"), F.hour("timestamp").alias("hour"))
               .agg(F.count("*").alias("n")))
    grid = df.sparkSession.range(168).select(
        (F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    return (grid.join(cells, ["weekday", "hour"], "left")
                .select("weekday", "hour", F.coalesce("n", F.lit(0)).alias("row_count")))


def missing_counts(df: DataFrame) -> DataFrame:
    """Nulls per column in one pass, most first."""
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = reduce(lambda a, c: a + [F.lit(c), F.col(f"`{c}`")], df.columns, [])
    return (row.select(F.stack(F.lit(len(df.columns)), *pairs).alias("column_name", "missing"))
               .orderBy(F.desc("missing"), "column_name"))
