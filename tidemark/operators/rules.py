"""Explainable detection rules over featured transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clean, high_risk_country, number
from tidemark.operators.features import features_for
from tidemark.policy import LABEL_RULES, PATTERN_RULES, RULE_ORDER, RulePolicy


def rule_conditions(df: DataFrame, policy: RulePolicy = RulePolicy()) -> dict[str, Column]:
    """One boolean expression per rule; absent features count as zero."""
    amount = number(df, "amount_paid")
    weekly, weekly_sum = number(df, "txn_count_7d"), number(df, "rolling_sum_7d")
    senders, inflow = number(df, "fan_in_count"), number(df, "recent_inflow_24h")
    how = F.lower(clean("payment_format")) if "payment_format" in df.columns else F.lit("")
    return {
        "structuring": ((amount >= policy.lower) & (amount < policy.threshold)
                        & (number(df, "near_threshold_count") >= policy.min_count)),
        "smurfing": (((senders >= policy.smurf_senders)
                      & (number(df, "fan_in_sum_48h") >= policy.smurf_total))
                     | ((how == policy.deposit_format) & (weekly >= policy.min_count)
                        & (weekly_sum >= policy.smurf_total))),
        "rapid_cashout": (how.isin(*policy.cash_formats)
                          & ((inflow > 0) | (weekly >= policy.min_count))),
        "single_large": amount >= policy.threshold,
        "deposit_send": inflow > 0,
        "fan_in": senders >= policy.fan_min,
        "fan_out": number(df, "fan_out_count") >= policy.fan_min,
        "high_risk_country": high_risk_country(df.drop("rule_flags")),
    }


def selected_rules(patterns: list[str] | None, has_country: bool) -> list[str]:
    """Rules a set of patterns asks for; all seven amount and flow rules without one."""
    wanted = {PATTERN_RULES[p] for p in patterns or [] if p in PATTERN_RULES}
    if not patterns:
        wanted = set(RULE_ORDER) - {"high_risk_country"}
    if has_country:
        wanted.add("high_risk_country")
    return [r for r in RULE_ORDER if r in wanted]


def apply_rules(df: DataFrame, patterns: list[str] | None = None,
                policy: RulePolicy = RulePolicy()) -> DataFrame:
    """Add ``rule_flags`` (in rule order) and ``rule_score`` (share of applicable rules)."""
    rules = selected_rules(patterns, bool({"from_country", "to_country"} & set(df.columns)))
    checks = rule_conditions(df, policy)
    fired = [F.when(checks[r], F.lit(r)) for r in rules]
    flags = (F.filter(F.array(*fired), lambda f: f.isNotNull()) if fired
             else F.array().cast("array<string>"))
    return (df.withColumn("rule_flags", flags)
              .withColumn("rule_score", F.size("rule_flags") / F.lit(float(max(len(rules), 1)))))


def rule_recall(knowledge: DataFrame, row_key: str | None = None) -> DataFrame:
    """Share of labelled positives per type that the matching rule fires on.

    Features see the positives only, as the calibration table holds all of those but just
    a sample of the rest.
    """
    positives = knowledge.where(F.col("is_laundering") == 1)
    if "amount_paid" not in positives.columns:
        positives = positives.withColumnRenamed("amount", "amount_paid")
    checks_on = features_for(positives, None, row_key=row_key)
    checks = rule_conditions(checks_on)
    hit = F.lit(False)
    for label, rule in LABEL_RULES.items():
        hit = hit | ((F.col("laundering_type") == label) & checks[rule])
    counted = (checks_on.where(F.col("laundering_type").isin(*LABEL_RULES))
                        .groupBy("laundering_type")
                        .agg(F.count("*").alias("total"), F.count_if(hit).alias("flagged")))
    labels = knowledge.sparkSession.createDataFrame(
        list(LABEL_RULES.items()), "laundering_type string, rule string")
    return (labels.join(counted, "laundering_type", "left")
                  .select("laundering_type", "rule",
                          F.coalesce("total", F.lit(0)).cast("long").alias("total"),
                          F.coalesce("flagged", F.lit(0)).cast("long").alias("flagged"),
                          F.round(F.coalesce(F.try_divide("flagged", "total"), F.lit(0.0)), 4)
                           .alias("recall")))
