"""Score fusion, risk bands, escalation and entity-level decisions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import band, high_risk_country, number, rounded_text
from tidemark.policy import PEP_FLAGS, EntityRiskPolicy, RowRiskPolicy
from tidemark.schema import require_columns


def score_risk(df: DataFrame, detectors: Iterable[str] | None = None,
               policy: RowRiskPolicy = RowRiskPolicy()) -> DataFrame:
    """Add the weighted ``risk_score``, its band and the contribution record.

    Weights are shared among the detectors that ran and left a score column.
    """
    ran = set(policy.weights) if detectors is None else set(detectors)
    active = [d for d in policy.weights
              if d in ran and policy.score_columns[d] in df.columns]
    total = sum(policy.weights[d] for d in active)
    scores = {d: (F.greatest(F.least(number(df, policy.score_columns[d]), F.lit(1.0)), F.lit(0.0))
                  if d in active else F.lit(0.0)) for d in policy.weights}
    parts = {d: (scores[d] * F.lit(policy.weights[d]) / F.lit(total)
                 if d in active else F.lit(0.0)) for d in policy.weights}
    boost = F.when(high_risk_country(df), F.lit(policy.boost)).otherwise(F.lit(0.0))
    raw = reduce(lambda a, b: a + b, [parts[d] for d in active], F.lit(0.0))
    risk = F.round(F.greatest(F.least(raw + boost, F.lit(1.0)), F.lit(0.0)), 12)
    terms = [f"{policy.weights[d]:.2f}/{total:.2f}*{policy.score_columns[d]}" for d in active]
    formula = " + ".join([*(terms or ["no detectors"]), "country_boost"])
    record = []
    for d, prefix in (("rule_engine", "rule"), ("statistical", "stat"), ("ml_engine", "ml")):
        record += [scores[d].alias(f"{prefix}_score"),
                   F.lit(policy.weights[d]).alias(f"{prefix}_weight"),
                   parts[d].alias(f"{prefix}_contribution")]
    return (df.withColumn("country_risk_boost", boost)
              .withColumn("active_detector_count", F.lit(len(active)))
              .withColumn("risk_score", risk)
              .withColumn("risk_label", band(F.col("risk_score"), policy.medium, policy.high))
              .withColumn("risk_contribution", F.struct(
                  *record, F.col("country_risk_boost").alias("country_boost"),
                  F.col("active_detector_count"),
                  F.col("risk_score").alias("final_risk_score"),
                  F.lit(formula).alias("formula"))))


def customer_risk_label(score: Column, policy: RowRiskPolicy = RowRiskPolicy()) -> Column:
    return F.when(score.isNull(), "unscored").otherwise(band(score, policy.medium, policy.high))


def escalation_action(score: Column, flags: Column | None = None,
                      policy: RowRiskPolicy = RowRiskPolicy()) -> Column:
    """monitor / flag_for_review / report; a politically exposed person always reports."""
    action = (F.when(score.isNull() | (score < policy.review), "monitor")
               .when(score < policy.report, "flag_for_review").otherwise("report"))
    if flags is None:
        return action
    pep = F.coalesce(F.arrays_overlap(flags, F.array(*map(F.lit, PEP_FLAGS))), F.lit(False))
    return F.when(pep, "report").otherwise(action)


def recommend(df: DataFrame, policy: RowRiskPolicy = RowRiskPolicy()) -> DataFrame:
    flags = F.col("rule_flags") if "rule_flags" in df.columns else None
    return df.withColumn("escalation_action",
                         escalation_action(F.col("risk_score"), flags, policy))


def require_scores(df: DataFrame, column: str) -> DataFrame:
    """Rows with a custom detector's score, failing on one that is not finite in 0..1."""
    value = F.col(column).cast("double")
    good = F.coalesce((value >= 0) & (value <= 1), F.lit(False))
    return df.withColumn(column, F.when(good, value).otherwise(F.raise_error(
        F.lit(f"{column} must be finite and between 0 and 1"))))


SIGNAL_COLUMNS = ["entity_id", "detector", "score", "flags", "high_risk_country"]


def merge_signals(signals: dict[str, DataFrame]) -> DataFrame:
    """One row per entity from the signals of each detector.

    ``signals`` maps a detector name to rows of ``SIGNAL_COLUMNS``; a row labelled with
    another detector is an error (checked while the rows flow).
    """
    legs = []
    for name, df in signals.items():
        require_columns(df.columns, SIGNAL_COLUMNS, f"signals of {name}")
        wrong = F.raise_error(F.concat(F.lit(f"{name} returned a signal labelled "),
                                       F.coalesce("detector", F.lit("null"))))
        legs.append(df.select(
            "entity_id", F.when(F.col("detector") == name, F.col("detector"))
                          .otherwise(wrong).alias("detector"),
            "score", "flags", "high_risk_country"))
    long = reduce(lambda a, b: a.unionByName(b), legs)
    # Flag names are a small fixed vocabulary, so the set per entity stays small.
    flags = F.array_sort(F.array_distinct(F.flatten(F.collect_set("flags"))))
    return long.groupBy("entity_id").agg(
        F.max("score").alias("strongest_score"), flags.alias("flags"),
        *[F.sum(F.when(F.col("detector") == d, F.col("score"))).alias(f"_sum_{d}")
          for d in signals],
        *[F.count_if(F.col("detector") == d).alias(f"_n_{d}") for d in signals],
        F.coalesce(F.bool_or("high_risk_country"), F.lit(False)).alias("high_risk_country"))


def decide_entities(merged: DataFrame, policy: EntityRiskPolicy = EntityRiskPolicy()) -> DataFrame:
    """Entity risk from merged signals, with the reason in words."""
    names = [d for d in policy.weights if f"_n_{d}" in merged.columns]
    zero = F.lit(0.0)
    weight = reduce(lambda a, b: a + b,
                    [F.col(f"_n_{d}") * policy.weights[d] for d in names], zero)
    base = reduce(lambda a, b: a + b,
                  [F.coalesce(F.col(f"_sum_{d}"), zero) * policy.weights[d] for d in names], zero)
    active = weight > 0
    boost = F.when(active & F.col("high_risk_country"), policy.boost).otherwise(0.0)
    score = F.round(F.least(F.lit(1.0), F.coalesce(F.try_divide(base, weight), zero) + boost), 6)
    df = (merged.withColumn("country_boost", boost)
                .withColumn("risk_score", score)
                .withColumn("risk_label", band(F.col("risk_score"), policy.medium, policy.high))
                .withColumn("escalation_action",
                            F.when(F.col("risk_label") == "high", "report")
                             .when(F.col("risk_label") == "medium", "flag_for_review")
                             .otherwise("monitor")))
    listed = F.array_join(F.slice("flags", 1, 3), ", ")
    named = F.when(F.size("flags") == 0, F.lit("no named typology flag")).otherwise(listed)
    boosted = F.when(F.col("country_boost") > 0,
                     F.lit(f" A {policy.boost:.2f} jurisdiction boost was applied.")).otherwise("")
    reason = F.concat(F.lit("Risk is "), "risk_label", F.lit(" ("),
                      rounded_text(F.col("risk_score"), "0.00"),
                      F.lit(") based on selected detector evidence: "), named, F.lit("."), boosted)
    return (df.withColumn("policy_version", F.lit(policy.version))
              .withColumn("rationale", reason)
              .drop(*[c for c in merged.columns if c.startswith("_")], "high_risk_country"))
