"""Population stability between a baseline and a current set of features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import number
from tidemark.functions.quantiles import exact_quantiles
from tidemark.policy import MODEL_FEATURES, DriftPolicy


def inner_edges(baseline: DataFrame, features: list[str],
                buckets: int = 10) -> dict[str, list[float] | None]:
    """Distinct quantiles of each baseline feature without the open ends."""
    if not 2 <= buckets <= 50:
        raise ValueError("buckets must be between 2 and 50")
    found = exact_quantiles(baseline, features, [i / buckets for i in range(buckets + 1)])
    return {f: None if q is None else sorted(set(q))[1:-1] for f, q in found.items()}


def _status(psi: Column, policy: DriftPolicy, inclusive: bool) -> Column:
    drifted = psi >= policy.drift if inclusive else psi > policy.drift
    return F.when(drifted, "drift").when(psi >= policy.caution, "caution").otherwise("stable")


def drift_report(baseline: DataFrame, current: DataFrame, features: list[str] | None = None, *,
                 policy: DriftPolicy = DriftPolicy(), inclusive: bool = False) -> DataFrame:
    """PSI, status and means per feature.

    One narrow scan per side counts all features at once; the bucket edges of the baseline
    are a few numbers per feature.
    """
    features = list(features or MODEL_FEATURES)
    edges = inner_edges(baseline, features, policy.buckets)
    counted = _counts(baseline, features, edges, "expected").join(
        _counts(current, features, edges, "actual"), ["feature", "bucket"], "full")
    sizes = counted.groupBy("feature").agg(F.sum("expected").alias("e_all"),
                                           F.sum("actual").alias("a_all"))
    slots = [(f, b) for f in features for b in range(len(edges[f] or []) + 1)]
    grid = baseline.sparkSession.createDataFrame(slots, "feature string, bucket int")
    e, a = (F.greatest(F.coalesce(F.try_divide(n, t), F.lit(0.0)), F.lit(policy.floor))
            for n, t in ((F.col("expected"), F.col("e_all")), (F.col("actual"), F.col("a_all"))))
    empty = F.coalesce(F.col("e_all"), F.lit(0)) * F.coalesce(F.col("a_all"), F.lit(0)) == 0
    psi = (grid.join(counted, ["feature", "bucket"], "left").join(sizes, "feature", "left")
               .groupBy("feature")
               .agg(F.round(F.sum(F.when(empty, 0.0).otherwise((a - e) * F.ln(a / e))), 6)
                     .alias("psi")))
    means = _means(baseline, features, "baseline_mean").join(
        _means(current, features, "current_mean"), "feature")
    return (psi.withColumn("status", _status(F.col("psi"), policy, inclusive))
               .join(means, "feature"))


def overall_drift(report: DataFrame, *, policy: DriftPolicy = DriftPolicy(),
                  inclusive: bool = False) -> DataFrame:
    worst = report.agg(F.coalesce(F.max("psi"), F.lit(0.0)).alias("overall_psi"))
    return worst.withColumn("status", _status(F.col("overall_psi"), policy, inclusive))


def monitor_drift(baseline: DataFrame, current: DataFrame,
                  policy: DriftPolicy = DriftPolicy()) -> DataFrame | None:
    """Monitor variant: features present on both sides, at least two values each, and the
    drift limit itself counts as drift. None where there is nothing to compare."""
    shared = sorted(set(baseline.columns) & set(current.columns))
    if not shared:
        return None
    for df in (baseline, current):
        sizes = df.agg(*[F.count_if(_finite(c).isNotNull()).alias(c) for c in shared]).first()
        if min(sizes) < 2:
            raise ValueError("baseline and current need at least two values per feature")
    return drift_report(baseline, current, shared, policy=policy, inclusive=True)


def model_drift(model_id: str, baseline: DataFrame, current: DataFrame,
                policy: DriftPolicy = DriftPolicy()) -> DataFrame:
    """The monitor's report of a model: a row per shared feature with its counts, and the overall state.

    Where the sides share no feature, one row says ``not_evaluated`` and why.
    """
    shared = sorted(set(baseline.columns) & set(current.columns))
    kind = ("model_id string, feature string, psi double, status string, baseline_count long, current_count long, "
            "overall_psi double, overall_status string, note string")
    spark = baseline.sparkSession
    if not shared:
        return spark.createDataFrame([(model_id, None, None, "not_evaluated", None, None, None, "not_evaluated",
                                       "The two sides have no feature in common.")], kind)
    counts = [df.agg(*(F.count(_finite(c)).alias(c) for c in shared)).first() for df in (baseline, current)]
    if min(min(c) for c in counts) < 2:
        raise ValueError("baseline and current need at least two values per feature")
    sizes = spark.createDataFrame([(f, counts[0][f], counts[1][f]) for f in shared],
                                  "feature string, baseline_count long, current_count long")
    report = drift_report(baseline, current, shared, policy=policy, inclusive=True)
    worst = overall_drift(report, policy=policy, inclusive=True).withColumnRenamed("status", "overall_status")
    return (report.join(sizes, "feature").join(F.broadcast(worst))  # one row
            .select(F.lit(model_id).alias("model_id"), "feature", "psi", "status", "baseline_count", "current_count",
                    "overall_psi", "overall_status", F.lit(None).cast("string").alias("note")))


def _finite(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def _counts(df: DataFrame, features: list[str], edges: dict, name: str) -> DataFrame:
    slots = []
    for f in features:
        value = _finite(f)
        bucket = reduce(lambda x, y: x + y,
                        [(value >= e).cast("int") for e in edges[f] or []], F.lit(0))
        slots.append(F.when(value.isNotNull(),
                            F.struct(F.lit(f).alias("feature"), bucket.alias("bucket"))))
    return (df.select(F.explode(F.filter(F.array(*slots), lambda s: s.isNotNull())).alias("s"))
              .groupBy("s.feature", "s.bucket").agg(F.count("*").alias(name)))


def _means(df: DataFrame, features: list[str], name: str) -> DataFrame:
    row = df.agg(*[F.round(F.coalesce(F.avg(number(df, f)), F.lit(0.0)), 6).alias(f)
                   for f in features])
    pairs = [x for f in features for x in (F.lit(f), F.col(f))]
    return row.select(F.stack(F.lit(len(features)), *pairs).alias("feature", name))
