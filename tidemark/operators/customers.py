"""Customer activity, profiles and counterparties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.paging import page
from tidemark.functions.stored import stored
from tidemark.operators.filters import in_risk_band


def legs(df: DataFrame, search: str | None = None) -> DataFrame:
    """Each transfer once per side, from one scan of the transfers."""
    if search:
        df = _touching(df, search)

    def side(account: str, bank: str, amount: str, other: str, outbound: bool):
        return F.struct(F.col(account).alias("account_id"), F.col(bank).alias("bank"),
                        F.col(amount).alias("amount"), F.col(other).alias("counterparty"),
                        F.lit(outbound).alias("outbound"))

    both = (df.select("timestamp", F.explode(F.array(
                side("from_account", "from_bank", "amount_paid", "to_account", True),
                side("to_account", "to_bank", "amount_received", "from_account", False)))
                .alias("leg"))
              .select("timestamp", "leg.*").where(F.col("account_id").isNotNull()))
    return both.where(_named("account_id", search)) if search else both


def _named(column: str, search: str) -> Column:
    return F.contains(F.lower(column), F.lit(search.lower()))


def _touching(df: DataFrame, search: str) -> DataFrame:
    return df.where(_named("from_account", search) | _named("to_account", search))


def alert_totals(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("entity_id").agg(
        F.count("*").alias("alert_count"), F.max("risk_score").alias("max_risk"),
        F.count_if(F.col("status") != "closed").alias("open_alert_count"))


def activity(df: DataFrame, alerts: DataFrame | None = None,
             search: str | None = None) -> DataFrame:
    """One row per account: both directions, counterparties, first and last seen, alerts.

    Sums fold per (account, bank) first, by hash on the map side: a busy account reaches the
    shuffle already small, and the text minimum is taken over banks rather than rows.
    Partners come from distinct unordered pairs, each of which is one partner to either end.
    """
    per_bank = _sums(legs(df, search).groupBy("account_id", "bank"))
    sums = _merged(per_bank.groupBy("account_id"))
    paired = _touching(df, search) if search else df
    pairs = (paired.where(F.col("from_account") != F.col("to_account"))
               .select(F.least("from_account", "to_account").alias("a"),
                       F.greatest("from_account", "to_account").alias("b")).distinct())
    partners = (pairs.select(F.explode(F.array("a", "b")).alias("account_id"))
                     .groupBy("account_id").agg(F.count("*").alias("partners")))
    found = (sums.join(partners, "account_id", "left")
                 .withColumn("distinct_counterparties", F.coalesce("partners", F.lit(0)))
                 .drop("partners"))
    return _with_alerts(found, alerts)


def _sums(grouped) -> DataFrame:
    out = F.col("outbound")
    return grouped.agg(
        F.count_if(out).alias("n_out"), F.count_if(~out).alias("n_in"),
        F.sum(F.when(out, F.col("amount"))).alias("sent"),
        F.sum(F.when(~out, F.col("amount"))).alias("received"),
        F.max("amount").alias("biggest"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def _merged(grouped, *extra) -> DataFrame:
    return grouped.agg(
        F.min("bank").alias("primary_bank"),
        F.sum("n_out").alias("outbound_count"), F.sum("n_in").alias("inbound_count"),
        F.coalesce(F.sum("sent"), F.lit(0.0)).alias("total_sent"),
        F.coalesce(F.sum("received"), F.lit(0.0)).alias("total_received"),
        F.max("biggest").alias("max_transaction"),
        F.min("first").alias("first_seen"), F.max("last").alias("last_seen"), *extra)


def _with_alerts(found: DataFrame, alerts: DataFrame | None) -> DataFrame:
    if alerts is None:
        return (found.withColumn("alert_count", F.lit(0).cast("long"))
                     .withColumn("max_risk", F.lit(None).cast("double"))
                     .withColumn("open_alert_count", F.lit(0).cast("long")))
    return (found.join(alert_totals(alerts).withColumnRenamed("entity_id", "account_id"),
                       "account_id", "left")
                 .withColumn("alert_count", F.coalesce("alert_count", F.lit(0)))
                 .withColumn("open_alert_count", F.coalesce("open_alert_count", F.lit(0))))


def customer_page(df: DataFrame, alerts: DataFrame | None = None, *, search: str | None = None,
                  band: str | None = None, limit: int = 50, offset: int = 0,
                  total: str | None = None) -> DataFrame:
    """One page of customers: highest risk first, then most active.

    ``total`` names a column for the number of customers on all pages. The order only needs counts, so accounts are ranked on those and the full summary is
    taken for the page's own rows: the transfers meet at most ``limit`` broadcast accounts.
    """
    if not 1 <= limit <= 1_000 or offset < 0:
        raise ValueError("limit must be 1..1000 and offset not negative")
    ends = df.select(F.explode(F.array("from_account", "to_account")).alias("account_id")) \
             .where(F.col("account_id").isNotNull())
    if search:
        ends = ends.where(_named("account_id", search))
    counts = ends.groupBy("account_id").agg(F.count("*").alias("_busy"))
    order = (F.col("max_risk").desc_nulls_last(), F.col("_busy").desc(), F.col("account_id"))
    ranked = in_risk_band(_with_alerts(counts, alerts), band)
    if total is not None:  # read twice, and the alert table may be costly
        ranked = stored(ranked)
    shown = page(ranked, list(order), limit=limit, offset=offset, total=total)
    kept = [c for c in shown.columns if c != "account_id"]
    rows = legs(df).join(F.broadcast(shown), "account_id")
    per_partner = (_sums(rows.groupBy("account_id", *kept, "counterparty", "bank"))
                   .groupBy("account_id", *kept, "counterparty")
                   .agg(F.min("bank").alias("bank"), *[F.sum(c).alias(c) for c in (
                       "n_out", "n_in", "sent", "received")], F.max("biggest").alias("biggest"),
                        F.min("first").alias("first"), F.max("last").alias("last")))
    other = F.count_if(F.col("counterparty") != F.col("account_id"))
    return (_merged(per_partner.groupBy("account_id", *kept), other.alias("distinct_counterparties"))
            .orderBy(*order).drop("_busy"))


def payment_mix(df: DataFrame) -> DataFrame:
    """(account, format) counts over both directions; a self-transfer counts once."""
    ends = F.array_distinct(F.array("from_account", "to_account"))
    return (df.select(F.explode(ends).alias("account_id"), "payment_format")
              .where(F.col("account_id").isNotNull())
              .groupBy("account_id", "payment_format").agg(F.count("*").alias("txn_count")))


def known_positives(df: DataFrame) -> DataFrame:
    ends = F.array_distinct(F.array("from_account", "to_account"))
    return (df.where(F.col("is_laundering") == 1).select(F.explode(ends).alias("account_id"))
              .where(F.col("account_id").isNotNull())
              .groupBy("account_id").agg(F.count("*").alias("known_positives")))


def top_counterparties(df: DataFrame, k: int = 12) -> DataFrame:
    """Per account the k largest (counterparty, direction) totals, itself excluded.

    ``row_number() <= k`` is applied per map task before the shuffle as well, so no task
    ranks all partners of a busy account.
    """
    totals = (legs(df).where(F.col("counterparty") != F.col("account_id"))
              .groupBy("account_id", "counterparty",
                       F.when(F.col("outbound"), "outbound").otherwise("inbound").alias("direction"))
              # Cents, so that equal totals tie whatever order they were added in.
              .agg(F.count("*").alias("txn_count"),
                   F.round(F.sum("amount"), 2).alias("total_amount")))
    rank = Window.partitionBy("account_id").orderBy(
        F.col("total_amount").desc_nulls_last(), "counterparty", "direction")
    return totals.withColumn("position", F.row_number().over(rank)).where(F.col("position") <= k)


def account_currencies(df: DataFrame) -> DataFrame:
    """Distinct non-blank currencies an account paid or was paid in."""
    pays = df.select(F.col("from_account").alias("account_id"),
                     F.col("paying_currency").alias("currency"))
    gets = df.select(F.col("to_account").alias("account_id"),
                     F.col("receiving_currency").alias("currency"))
    return (pays.union(gets)
            .where(F.col("account_id").isNotNull() & (F.trim("currency") != "")).distinct())


def customer_profile(df: DataFrame, account_id: str,
                     alerts: DataFrame | None = None, *, newest: int = 25) -> dict[str, DataFrame]:
    """Everything about one account, each part a lazy frame over the account's rows.

    With an alert table there is a part ``alerts``, the account's ``newest`` ones in its columns.
    """
    mine = df.where((F.col("from_account") == account_id) | (F.col("to_account") == account_id))
    own_alerts = None if alerts is None else alerts.where(F.col("entity_id") == account_id)
    this = F.col("account_id") == account_id
    shown = {} if own_alerts is None else {
        "alerts": page(own_alerts, [F.desc("created_at"), F.col("alert_id")], limit=newest)}
    return shown | {
        "summary": activity(mine, own_alerts).where(this),
        "payment_formats": payment_mix(mine).where(this)
                           .orderBy(F.desc("txn_count"), "payment_format"),
        "currencies": account_currencies(mine).where(this).orderBy("currency"),
        "known_positives": known_positives(mine).where(this),
        "counterparties": top_counterparties(mine).where(this).orderBy("position"),
    }
