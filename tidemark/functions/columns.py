"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.policy import HIGH_RISK_COUNTRIES


BLANKS = " \t\n\r\f\v"


def trimmed(text: Column) -> Column:
    """Without any white space at either end (``trim`` alone only takes spaces)."""
    return F.btrim(text, F.lit(BLANKS))


def clean(name: str) -> Column:
    """Trimmed text with null as ''."""
    return F.coalesce(trimmed(F.col(name)), F.lit(""))


def readable_number(text: Column) -> Column:
    """Text as double, null where it is no number."""
    value = trimmed(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def number(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """Column as double; the default where it is absent, unreadable or NaN."""
    if name not in df.columns:
        return F.lit(float(default))
    value = F.col(name).try_cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(float(default))).otherwise(value)


def high_risk_country(df: DataFrame) -> Column:
    """Either end in a high-risk country, or already flagged so by the rules."""
    hit = F.lit(False)
    for name in ("from_country", "to_country"):
        if name in df.columns:
            hit = hit | F.lower(clean(name)).isin(HIGH_RISK_COUNTRIES)
    if "rule_flags" in df.columns:
        hit = hit | F.coalesce(
            F.array_contains("rule_flags", "high_risk_country"), F.lit(False))
    return hit


def cross_border(df: DataFrame) -> Column:
    if not {"from_country", "to_country"} <= set(df.columns):
        return F.lit(0).cast("long")
    a, b = F.lower(clean("from_country")), F.lower(clean("to_country"))
    return F.when((a != "") & (b != "") & (a != b), 1).otherwise(0).cast("long")


def band(score: Column, medium: float, high: float) -> Column:
    return (F.when(score < medium, "low").when(score < high, "medium").otherwise("high"))


def plain_amount(name: str) -> Column:
    """Amount as text with two decimals (a double's own text differs between engines)."""
    return F.col(name).cast("decimal(18,2)").cast("string")


def transaction_id() -> Column:
    """Stable id of a transaction row: hash of when, where, who, how much and how."""
    parts = [F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col("from_bank"),
             F.col("from_account"), F.col("to_bank"), F.col("to_account"),
             plain_amount("amount_paid"), F.col("payment_format")]
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("TXN-"), F.upper(F.substring(digest, 1, 12)))


def joined(array: Column, sep: str = ",") -> Column:
    return F.array_join(array, sep)


def rounded_text(value: Column, pattern: str) -> Column:
    """Decimal pattern text; halves go to the even digit."""
    return F.call_function("format_number", value, F.lit(pattern))
