"""Filtered reads over transactions and customers."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paging import page
from tidemark.functions.columns import transaction_id
from tidemark.policy import RowRiskPolicy


@dataclass(frozen=True)
class TransactionFilter:
    """Predicates of a transaction read; None leaves one out."""

    start: date | None = None
    end: date | None = None
    entity_id: str | None = None
    from_bank: str | None = None
    to_bank: str | None = None
    payment_format: str | None = None
    currency: str | None = None
    min_amount: float | None = None
    max_amount: float | None = None
    is_laundering: int | None = None
    limit: int | None = None

    def __post_init__(self) -> None:
        if self.start and self.end and self.start > self.end:
            raise ValueError("start must not be after end")
        for name in ("min_amount", "max_amount"):
            if getattr(self, name) is not None and getattr(self, name) < 0:
                raise ValueError(f"{name} cannot be negative")
        if (self.min_amount is not None and self.max_amount is not None
                and self.min_amount > self.max_amount):
            raise ValueError("min_amount must not exceed max_amount")
        if self.is_laundering not in (None, 0, 1):
            raise ValueError("is_laundering must be 0 or 1")
        if self.limit is not None and self.limit < 1:
            raise ValueError("limit must be positive")


FIRST_ROWS = ("txn_date", "timestamp", "from_account", "to_account", "amount_paid", "payment_format")


def load_transactions(df: DataFrame, spec: TransactionFilter) -> DataFrame:
    """ANDed predicates, all of them plain comparisons that reach the Parquet scan."""
    tests: list[Column] = []
    if spec.start:
        tests.append(F.col("txn_date") >= F.lit(spec.start))
    if spec.end:
        tests.append(F.col("txn_date") <= F.lit(spec.end))
    if spec.entity_id is not None:
        tests.append((F.col("from_account") == spec.entity_id)
                     | (F.col("to_account") == spec.entity_id))
    for name in ("from_bank", "to_bank", "payment_format", "is_laundering"):
        if getattr(spec, name) is not None:
            tests.append(F.col(name) == getattr(spec, name))
    if spec.currency is not None:
        tests.append((F.col("paying_currency") == spec.currency)
                     | (F.col("receiving_currency") == spec.currency))
    if spec.min_amount is not None:
        tests.append(F.col("amount_paid") >= spec.min_amount)
    if spec.max_amount is not None:
        tests.append(F.col("amount_paid") <= spec.max_amount)
    for test in tests:
        df = df.where(test)
    # A limit takes the rows that come first by date, time and the accounts, not whichever task is first.
    return df.orderBy(*(c for c in FIRST_ROWS if c in df.columns)).limit(spec.limit) if spec.limit else df


@dataclass(frozen=True)
class EvidenceFilter:
    """Predicates of the evidence browser."""

    account_id: str | None = None
    direction: str = "both"
    payment_format: str | None = None
    min_amount: float | None = None
    max_amount: float | None = None
    start: date | None = None
    end: date | None = None
    positives_only: bool = False

    def __post_init__(self) -> None:
        if self.direction not in ("both", "in", "out"):
            raise ValueError("direction must be both, in or out")


def evidence_rows(df: DataFrame, spec: EvidenceFilter) -> DataFrame:
    if spec.account_id is not None:
        sent = F.col("from_account") == spec.account_id
        got = F.col("to_account") == spec.account_id
        df = df.where({"out": sent, "in": got, "both": sent | got}[spec.direction])
    if spec.payment_format is not None:
        df = df.where(F.lower("payment_format") == spec.payment_format.lower())
    if spec.min_amount is not None:
        df = df.where(F.col("amount_paid") >= spec.min_amount)
    if spec.max_amount is not None:
        df = df.where(F.col("amount_paid") <= spec.max_amount)
    if spec.start:
        df = df.where(F.to_date("timestamp") >= F.lit(spec.start))
    if spec.end:
        df = df.where(F.to_date("timestamp") <= F.lit(spec.end))
    if spec.positives_only:
        df = df.where(F.col("is_laundering") == 1)
    return df.withColumn("transaction_id", transaction_id())


def evidence_page(df: DataFrame, spec: EvidenceFilter, *, limit: int = 50,
                  offset: int = 0, total: str | None = None) -> DataFrame:
    """One page, newest first. ``total`` names a column for the number of rows on all pages."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1..100 and offset not negative")
    newest = [F.col("timestamp").desc_nulls_last(), F.col("transaction_id").asc_nulls_last()]
    return page(evidence_rows(df, spec), newest, limit=limit, offset=offset, total=total)


def payment_formats(df: DataFrame) -> DataFrame:
    """Distinct non-blank formats, one spelling per case-insensitive name."""
    name = F.trim("payment_format")
    return (df.where(F.col("payment_format").isNotNull() & (name != ""))
              .groupBy(F.lower(name).alias("_low")).agg(F.min(name).alias("payment_format"))
              .orderBy("_low").drop("_low"))


def in_risk_band(df: DataFrame, wanted: str | None, column: str = "max_risk",
                 policy: RowRiskPolicy = RowRiskPolicy()) -> DataFrame:
    score = F.col(column)
    tests = {
        None: F.lit(True),
        "unscored": score.isNull(),
        "high": score >= policy.high,
        "medium": (score >= policy.medium) & (score < policy.high),
        "low": score < policy.medium,
    }
    if wanted not in tests:
        raise ValueError("risk band must be unscored, high, medium or low")
    return df.where(tests[wanted])
