"""The registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import policy as P
from tidemark.functions import columns as C
from tidemark.operators import (aggregate, customers, drift, evidence, features, filters, forest,
                                graph, profile, retrieval, risk, rules, stats, workflow)
from tidemark.plans import oracle as O
from tidemark.plans import views
from tidemark.plans.investigate import InvestigationSpec, investigate, score_transactions, shared
from tidemark.sources import ingest, uploads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEY = "event_id"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def r(name: str, digits: int = 6) -> Column:
    return F.round(name, digits).alias(name)


def text_list(name: str) -> Column:
    return F.array_join(name, ",").alias(name)


# ---- shared frames -------------------------------------------------------------------

def txn_bounds(t: DataFrame) -> tuple[float, float]:
    return stats.iqr_bounds(t.where(F.col("is_laundering") == 0), "amount_paid")[2:]


def full_scored(spark: SparkSession, sf: str) -> DataFrame:
    """All features, all rules, statistics, risk and action."""
    t = views.txn(spark, sf)
    ruled = rules.apply_rules(features.features_for(t, None, row_key=KEY))
    return risk.recommend(risk.score_risk(stats.add_statistics(ruled, txn_bounds(t), features.canonical_input(t))))


def knowledge(spark: SparkSession, sf: str) -> DataFrame:
    t = views.txn(spark, sf)
    return t.select(
        "event_id", "timestamp", "txn_date", "from_account", "to_account",
        F.col("amount_paid").alias("amount"), F.col("paying_currency").alias("payment_currency"),
        F.col("receiving_currency").alias("received_currency"), "from_country", "to_country",
        "payment_format", F.when(F.col("payment_format") != "ACH", 1).otherwise(0)
                           .alias("is_laundering"), "laundering_type")


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    found = evidence.best_rows(full_scored(spark, sf), KEY)
    number = F.substring("entity_id", 2, 20).cast("long")
    inv = F.concat(F.lit("INV-"), (number % 7).cast("string"))
    return workflow.alerts_from_findings(
        found.withColumnRenamed("from_account", "entity_id"), inv, F.col("timestamp"))


def actions(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "events")
    i, u = F.col("event_id"), F.col("user_id")
    inv = F.concat(F.lit("INV-"), (u % 7).cast("string"))
    kind = F.when(i % 3 == 0, "assign").when(i % 3 == 1, "disposition").otherwise("note")
    choice = (F.when(i % 4 == 1, "false_positive").when(i % 4 == 2, "true_positive")
               .otherwise("escalated"))
    value = (F.when(i % 3 == 0, F.concat(F.lit("analyst_"), (i % 5).cast("string")))
              .when(i % 3 == 1, choice).otherwise(F.concat(F.lit("note "), i.cast("string"))))
    return e.select(
        workflow.alert_id(inv, F.concat(F.lit("A"), u.cast("string"))).alias("alert_id"),
        i.alias("seq"), kind.alias("action"),
        F.concat(F.lit("analyst_"), (i % 4).cast("string")).alias("actor"),
        value.alias("value"), F.col("ts").alias("at"))


def queue(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.fold_actions(alerts(spark, sf), actions(spark, sf))


AS_OF = "2024-02-01 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


# ---- filters and ids -----------------------------------------------------------------

@query("load_filtered", O.with_(views.TXN_CTE) + """SELECT event_id, from_account, to_account, amount_paid
FROM txn WHERE txn_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND from_bank = 'BANK_3'
AND payment_format = 'Wire' AND (paying_currency = 'USD' OR receiving_currency = 'USD')
AND amount_paid >= 500 AND amount_paid <= 5000 AND is_laundering = 0""")
def load_filtered(spark, sf):
    from datetime import date
    spec = filters.TransactionFilter(
        start=date(2024, 1, 5), end=date(2024, 1, 20), from_bank="BANK_3", payment_format="Wire",
        currency="USD", min_amount=500, max_amount=5000, is_laundering=0)
    return filters.load_transactions(views.txn(spark, sf), spec).select(
        "event_id", "from_account", "to_account", "amount_paid")


_TXN_ID = """'TXN-' || upper(substr(md5(concat_ws('|', strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f'),
  from_bank, from_account, to_bank, to_account, CAST(CAST(amount_paid AS DECIMAL(18,2)) AS VARCHAR),
  payment_format)), 1, 12))"""


@query("txn_browser_page", O.with_(views.TXN_CTE) + f"""SELECT {_TXN_ID} AS transaction_id, timestamp,
  from_account, to_account, amount_paid FROM txn WHERE (from_account = 'A7' OR to_account = 'A7')
  AND lower(payment_format) = 'wire' AND amount_paid >= 100 ORDER BY timestamp DESC, 1 LIMIT 50""")
def txn_browser_page(spark, sf):
    spec = filters.EvidenceFilter(account_id="A7", payment_format="WIRE", min_amount=100)
    return filters.evidence_page(views.txn(spark, sf), spec).select(
        "transaction_id", "timestamp", "from_account", "to_account", "amount_paid")


@query("txn_browser_total", O.with_(views.TXN_CTE) + f"""SELECT transaction_id, amount_paid, total FROM (
  SELECT {_TXN_ID} AS transaction_id, timestamp, amount_paid, count(*) OVER () AS total FROM txn
  WHERE to_account = 'A7') q ORDER BY timestamp DESC, 1 LIMIT 5 OFFSET 5""")
def txn_browser_total(spark, sf):
    spec = filters.EvidenceFilter(account_id="A7", direction="in")
    return filters.evidence_page(views.txn(spark, sf), spec, limit=5, offset=5, total="total").select(
        "transaction_id", "amount_paid", "total")


@query("transaction_ids", O.with_(views.TXN_CTE) + f"SELECT event_id, {_TXN_ID} AS transaction_id FROM txn")
def transaction_ids(spark, sf):
    return views.txn(spark, sf).select("event_id", C.transaction_id().alias("transaction_id"))


_ACTIVITY = """legs AS (
  SELECT from_account AS account_id, from_bank AS bank, timestamp, amount_paid AS amount,
    to_account AS counterparty, 1 AS o FROM {source}
  UNION ALL SELECT to_account, to_bank, timestamp, amount_received, from_account, 0 FROM {source}),
activity AS (
  SELECT account_id, min(bank) AS primary_bank, CAST(sum(o) AS BIGINT) AS outbound_count,
    CAST(sum(1 - o) AS BIGINT) AS inbound_count,
    round(coalesce(sum(amount) FILTER (WHERE o = 1), 0), 4) AS total_sent,
    round(coalesce(sum(amount) FILTER (WHERE o = 0), 0), 4) AS total_received,
    max(amount) AS max_transaction,
    count(DISTINCT counterparty) FILTER (WHERE counterparty <> account_id) AS distinct_counterparties,
    min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM legs GROUP BY account_id)"""


def _act() -> list:
    return ["account_id", "primary_bank", "outbound_count", "inbound_count", r("total_sent", 4),
            r("total_received", 4), "max_transaction", "distinct_counterparties", "first_seen",
            "last_seen"]


@query("account_search", O.with_(views.TXN_CTE, _ACTIVITY.format(source="txn"))
       + "SELECT * FROM activity WHERE account_id ILIKE '%a4%'")
def account_search(spark, sf):
    return customers.activity(views.txn(spark, sf), search="a4").select(*_act())


_ALERTS_BY = """al AS (SELECT entity_id AS account_id, count(*) AS alert_count,
    max(risk_score) AS max_risk, count(*) FILTER (WHERE status <> 'closed') AS open_alert_count
  FROM folded GROUP BY entity_id),
cust AS (SELECT c.*, coalesce(alert_count, 0) AS alert_count, max_risk,
    coalesce(open_alert_count, 0) AS open_alert_count
  FROM activity c LEFT JOIN al USING (account_id))"""
_CUST = [*O.QUEUE, _ACTIVITY.format(source="txn"), _ALERTS_BY]


@query("risk_band_filter", O.with_(*_CUST)
       + "SELECT account_id, alert_count, round(max_risk, 6) AS max_risk FROM cust WHERE cust.max_risk >= 0.35 AND cust.max_risk < 0.70")
def risk_band_filter(spark, sf):
    people = customers.activity(views.txn(spark, sf), queue(spark, sf))
    return filters.in_risk_band(people, "medium").select("account_id", "alert_count", r("max_risk"))


@query("customer_page", O.with_(*_CUST) + """SELECT * REPLACE (round(max_risk, 6) AS max_risk) FROM cust
  ORDER BY cust.max_risk DESC NULLS LAST, outbound_count + inbound_count DESC, account_id LIMIT 50""")
def customer_page(spark, sf):
    return customers.customer_page(views.txn(spark, sf), queue(spark, sf)).select(
        *_act(), "alert_count", r("max_risk"), "open_alert_count")


@query("customer_page_total", O.with_(*_CUST) + """SELECT account_id, alert_count, round(max_risk, 6) AS max_risk,
  outbound_count, total_sent, total FROM (SELECT *, count(*) OVER () AS total FROM cust
    WHERE account_id ILIKE '%a1%' AND max_risk >= 0.70) q
  ORDER BY q.max_risk DESC, outbound_count + inbound_count DESC, account_id LIMIT 10 OFFSET 2""")
def customer_page_total(spark, sf):
    return customers.customer_page(views.txn(spark, sf), queue(spark, sf), search="A1", band="high", limit=10,
                                   offset=2, total="total").select(
        "account_id", "alert_count", r("max_risk"), "outbound_count", r("total_sent", 4), "total")


@query("customer_profile_alerts", O.with_(*O.QUEUE) + """SELECT alert_id, risk_label, status, created_at FROM folded
  WHERE entity_id = 'A7' ORDER BY created_at DESC, alert_id LIMIT 25""")
def customer_profile_alerts(spark, sf):
    return customers.customer_profile(views.txn(spark, sf), "A7", queue(spark, sf))["alerts"].select(
        "alert_id", "risk_label", "status", "created_at")


@query("ledger_customers", O.with_(views.LEDGER_CTE, _ACTIVITY.format(source="ledger"))
       + "SELECT * FROM activity")
def ledger_customers(spark, sf):
    return customers.activity(views.ledger(spark, sf)).select(*_act())


@query("country_mask", O.with_(views.TXN_CTE)
       + f"SELECT event_id, {O.COUNTRY} AS high_risk FROM txn")
def country_mask(spark, sf):
    t = views.txn(spark, sf)
    return t.select("event_id", C.high_risk_country(t).alias("high_risk"))


@query("cross_border", O.with_(views.TXN_CTE) + """SELECT event_id, CAST(CASE WHEN
  lower(from_country) <> lower(to_country) THEN 1 ELSE 0 END AS BIGINT) AS cross_border_flag FROM txn""")
def cross_border(spark, sf):
    t = views.txn(spark, sf)
    return t.select("event_id", C.cross_border(t).alias("cross_border_flag"))


_RAW = """raw AS (SELECT CAST(event_id AS VARCHAR) AS ref, CASE WHEN event_id % 11 = 0 THEN 'n/a'
    ELSE CAST(value AS VARCHAR) END AS amount, CASE WHEN event_id % 13 = 0 THEN '  '
    ELSE ' U' || CAST(user_id AS VARCHAR) || ' ' END AS sender_id,
    'R' || CAST(event_id % 17 AS VARCHAR) AS receiver_id, ts AS "Timestamp",
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS channel FROM events)"""


def raw_upload(spark: SparkSession, sf: str) -> DataFrame:
    """Events as an upload of unknown layout, with unreadable amounts and blank senders."""
    e, i = views.table(spark, sf, "events"), F.col("event_id")
    return e.select(
        i.cast("string").alias("ref"),
        F.when(i % 11 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("amount"),
        F.when(i % 13 == 0, "  ").otherwise(
            F.concat(F.lit(" U"), F.col("user_id").cast("string"), F.lit(" "))).alias("sender_id"),
        F.concat(F.lit("R"), (i % 17).cast("string")).alias("receiver_id"),
        F.col("ts").alias("Timestamp"),
        F.when(i % 5 != 0, F.col("event_type")).alias("channel"))


@query("canonicalise_strict", O.with_(_RAW) + """SELECT "Timestamp" AS timestamp,
  trim(sender_id) AS from_account, receiver_id AS to_account, TRY_CAST(amount AS DOUBLE) AS amount_paid,
  TRY_CAST(amount AS DOUBLE) AS amount_received, 'USD' AS paying_currency, 'USD' AS receiving_currency,
  coalesce(channel, 'Unknown') AS payment_format, CAST("Timestamp" AS DATE) AS txn_date,
  (TRY_CAST(amount AS DOUBLE) IS NOT NULL AND TRY_CAST(amount AS DOUBLE) > 0 AND trim(sender_id) <> '')
    AS is_valid FROM raw""")
def canonicalise_strict(spark, sf):
    raw = raw_upload(spark, sf)
    return uploads.canonicalise(raw, uploads.detect_schema(raw.columns)[1]).select(
        "timestamp", "from_account", "to_account", "amount_paid", "amount_received",
        "paying_currency", "receiving_currency", "payment_format", "txn_date", "is_valid")


@query("canonicalise_strings", O.with_(_RAW) + """SELECT ref, coalesce(TRY_CAST(amount AS DOUBLE), 0.0)
  AS amount, coalesce(trim(sender_id), '') AS sender_id, coalesce(trim(channel), '') AS channel FROM raw""")
def canonicalise_strings(spark, sf):
    raw = raw_upload(spark, sf)
    return raw.select("ref", C.number(raw, "amount").alias("amount"),
                      C.clean("sender_id").alias("sender_id"), C.clean("channel").alias("channel"))


@query("stratified_sample", O.with_(views.TXN_CTE) + """SELECT event_id, is_laundering FROM txn
  WHERE is_laundering = 1 UNION ALL SELECT event_id, is_laundering FROM (SELECT * FROM txn
  WHERE is_laundering = 0 ORDER BY md5('42|' || CAST(event_id AS VARCHAR)) LIMIT 500) q""")
def stratified_sample(spark, sf):
    return ingest.stratified_sample(views.txn(spark, sf), [KEY], k=500).select(
        "event_id", "is_laundering")


@query("risk_labels", O.with_(*_CUST) + """SELECT account_id, CASE WHEN max_risk IS NULL THEN 'unscored'
  WHEN max_risk < 0.35 THEN 'low' WHEN max_risk < 0.70 THEN 'medium' ELSE 'high' END AS risk_label FROM cust""")
def risk_labels(spark, sf):
    people = customers.activity(views.txn(spark, sf), queue(spark, sf))
    return people.select("account_id", risk.customer_risk_label(F.col("max_risk")).alias("risk_label"))


@query("new_files_only", """SELECT min(url) AS path, fingerprint FROM (
  SELECT url, md5(html) AS fingerprint, page_id FROM pages) p WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT md5(html) AS f FROM pages WHERE url LIKE 'https:%') k WHERE k.f = p.fingerprint)
  GROUP BY fingerprint""")
def new_files_only(spark, sf):
    pages = views.table(spark, sf, "pages").select(
        F.col("url").alias("path"), F.md5(F.col("html").cast("binary")).alias("fingerprint"))
    known = pages.where(F.col("path").startswith("https:"))
    first = pages.groupBy("fingerprint").agg(F.min("path").alias("path"))
    return uploads.new_files(first, known).select("path", "fingerprint")


# ---- features ------------------------------------------------------------------------

def _feature(name: str, wanted: list[str], digits: int = 6) -> None:
    cols = ", ".join(f"round({c}, {digits}) AS {c}" if c not in P.INTEGER_FEATURES else c
                     for c in wanted)

    @query(name, O.with_(views.TXN_CTE, O.features()) + f"SELECT event_id, {cols} FROM feat")
    def run(spark, sf):
        df = features.add_features(views.txn(spark, sf), wanted, row_key=KEY)
        return df.select("event_id", *[c if c in P.INTEGER_FEATURES else r(c, digits)
                                       for c in wanted])


_feature("feat_structuring_7d", ["txn_count_7d", "rolling_sum_7d", "near_threshold_count"])
_feature("feat_velocity_1h", ["velocity_1hr"])
_feature("feat_fan_in_sum_48h", ["fan_in_sum_48h"])
_feature("feat_amount_deviation", ["amount_deviation"])
_feature("feat_fan_in_count", ["fan_in_count"])
_feature("feat_fan_out_count", ["fan_out_count"])
_feature("feat_recent_inflow_24h", ["recent_inflow_24h"])
_feature("features_all", features.DERIVED)


@query("features_split_accounts", O.with_(views.TXN_CTE, O.features()) + "SELECT event_id, "
       + ", ".join(c if c in P.INTEGER_FEATURES else f"round({c}, 6) AS {c}"
                   for c in features.DERIVED) + " FROM feat")
def features_split_accounts(spark, sf):
    """All features by name; every account is cut into blocks, as large ones are."""
    df = features.add_features(views.txn(spark, sf), features.DERIVED, row_key=KEY,
                               policy=P.FeaturePolicy(whole_rows=0))
    return df.select("event_id", *[c if c in P.INTEGER_FEATURES else r(c)
                                   for c in features.DERIVED])


# ---- detectors -----------------------------------------------------------------------

def _rule(rule: str, families: list[str]) -> None:
    @query(f"rule_{rule}", O.with_(views.TXN_CTE, O.features())
           + f"SELECT event_id, from_account, amount_paid FROM feat WHERE {O.RULE_SQL[rule]}")
    def run(spark, sf):
        df = features.add_families(views.txn(spark, sf), families, row_key=KEY)
        return df.where(rules.rule_conditions(df)[rule]).select(
            "event_id", "from_account", "amount_paid")


for _name in P.RULE_ORDER:
    _rule(_name, P.PATTERN_FAMILIES.get(_name, []))


@query("rules_all", O.with_(*O.FULL[:3])
       + "SELECT event_id, array_to_string(rule_flags, ',') AS rule_flags, rule_score FROM ruled")
def rules_all(spark, sf):
    df = rules.apply_rules(features.features_for(views.txn(spark, sf), None, row_key=KEY))
    return df.select("event_id", text_list("rule_flags"), "rule_score")


@query("stat_scores", O.with_(views.TXN_CTE, O.BOUNDS, O.statistics("txn"))
       + "SELECT event_id, round(z_score, 6) AS z_score, iqr_flag, round(stat_score, 6) AS stat_score FROM stated")
def stat_scores(spark, sf):
    t = views.txn(spark, sf)
    return stats.add_statistics(t, txn_bounds(t)).select(
        "event_id", r("z_score"), "iqr_flag", r("stat_score"))


@query("iqr_bounds", O.with_(views.TXN_CTE, O.BOUNDS) + """SELECT round(q1, 6) AS q1, round(q3, 6) AS q3,
  round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound FROM bounds""")
def iqr_bounds(spark, sf):
    t = views.txn(spark, sf)
    found = stats.iqr_bounds(t.where(F.col("is_laundering") == 0), "amount_paid")
    return spark.createDataFrame([tuple(round(v, 6) for v in found)],
                                 "q1 double, q3 double, lower_bound double, upper_bound double")


@query("risk_scores", O.with_(*O.FULL) + "SELECT event_id, round(risk_score, 6) AS risk_score, risk_label FROM scored")
def risk_scores(spark, sf):
    return full_scored(spark, sf).select("event_id", r("risk_score"), "risk_label")


@query("escalation", O.with_(*O.FULL) + "SELECT event_id, round(risk_score, 6) AS risk_score, escalation_action FROM scored")
def escalation(spark, sf):
    return full_scored(spark, sf).select("event_id", r("risk_score"), "escalation_action")


@query("flagged_entities", O.with_(*O.FULL, O.best()) + """SELECT from_account, event_id,
  round(risk_score, 6) AS risk_score, risk_label, array_to_string(rule_flags, ',') AS rule_flags FROM best""")
def flagged_entities(spark, sf):
    return evidence.best_rows(full_scored(spark, sf), KEY).select(
        "from_account", "event_id", r("risk_score"), "risk_label", text_list("rule_flags"))


@query("flag_summary", O.with_(*O.FULL) + """SELECT CAST(sum(n) AS BIGINT) AS total_analyzed,
  count(*) FILTER (WHERE top >= 0.35) AS flagged, count(*) FILTER (WHERE top >= 0.70) AS high_risk
  FROM (SELECT from_account, count(*) AS n, max(risk_score) AS top FROM scored GROUP BY 1) q""")
def flag_summary(spark, sf):
    return evidence.flag_summary(full_scored(spark, sf))


@query("entity_evidence_top5", O.with_(views.TXN_CTE) + """SELECT from_account, event_id, amount_paid,
  CAST(rn AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY from_account
  ORDER BY amount_paid DESC, event_id) AS rn FROM txn) q WHERE rn <= 5""")
def entity_evidence_top5(spark, sf):
    return evidence.top_evidence(views.txn(spark, sf), KEY).select(
        "from_account", "event_id", "amount_paid", "position")


# ---- aggregation ---------------------------------------------------------------------

@query("threshold_aggregation", O.with_(views.LEDGER_CTE) + """, f AS (SELECT * FROM ledger
  WHERE amount_paid <= 60000 AND amount_paid >= 1000),
 w AS (SELECT f.* FROM f, (SELECT max(timestamp) AS m FROM f) x WHERE f.timestamp >= m - INTERVAL 365 DAY)
SELECT from_account, count(*) AS txn_count, round(sum(amount_paid), 2) AS total_amount,
  round(avg(amount_paid), 6) AS avg_amount, min(amount_paid) AS min_amount, max(amount_paid) AS max_amount,
  count(DISTINCT to_account) AS distinct_counterparties, min(timestamp) AS first_seen, max(timestamp) AS last_seen
FROM w GROUP BY 1 HAVING count(*) >= 3 ORDER BY total_amount DESC, from_account LIMIT 100""")
def threshold_aggregation(spark, sf):
    groups = aggregate.threshold_groups(views.ledger(spark, sf), min_count=3, max_amount=60_000,
                                        min_amount=1_000, window_days=365)
    return aggregate.top_groups(groups, order_by="total_amount").select(
        "from_account", "txn_count", r("total_amount", 2), r("avg_amount"), "min_amount",
        "max_amount", "distinct_counterparties", "first_seen", "last_seen")


@query("threshold_groups_all", O.with_(views.LEDGER_CTE) + """SELECT to_account, count(*) AS txn_count,
  round(sum(amount_paid), 2) AS total_amount, count(DISTINCT to_account) AS distinct_counterparties
FROM ledger GROUP BY 1 HAVING count(*) >= 2""")
def threshold_groups_all(spark, sf):
    return aggregate.threshold_groups(views.ledger(spark, sf), "to_account", min_count=2).select(
        "to_account", "txn_count", r("total_amount", 2), "distinct_counterparties")


@query("typology_frequency", O.with_(views.TXN_CTE)
       + "SELECT laundering_type AS value, count(*) AS row_count FROM txn GROUP BY 1")
def typology_frequency(spark, sf):
    return aggregate.frequency(views.txn(spark, sf), "laundering_type")


@query("detection_spotcheck", O.with_(*O.FULL) + """SELECT count(*) AS row_count,
  count(*) FILTER (WHERE len(rule_flags) > 0) AS rule_flagged, count(*) FILTER (WHERE iqr_flag) AS iqr_flagged
  FROM scored""")
def detection_spotcheck(spark, sf):
    return aggregate.detection_spotcheck(full_scored(spark, sf))


@query("dataset_summary", O.with_(views.TXN_CTE) + """SELECT count(*) AS row_count,
  CAST(sum(is_laundering) AS BIGINT) AS positives, min(txn_date) AS date_min, max(txn_date) AS date_max,
  count(DISTINCT from_account) AS distinct_from_account, count(DISTINCT to_account) AS distinct_to_account,
  count(DISTINCT from_bank) AS distinct_from_bank, count(DISTINCT to_bank) AS distinct_to_bank,
  round(sum(is_laundering) * 100.0::DOUBLE / count(*), 4) AS positive_rate_pct FROM txn""")
def dataset_summary(spark, sf):
    return aggregate.dataset_summary(views.txn(spark, sf))


@query("knowledge_summary", O.with_(views.TXN_CTE, O.KNOWLEDGE) + """SELECT count(*) AS row_count,
  count(*) FILTER (WHERE is_laundering = 1) AS positives, count(*) FILTER (WHERE is_laundering = 0) AS normals,
  count(DISTINCT laundering_type) FILTER (WHERE is_laundering = 1) AS typologies,
  min(txn_date) AS date_min, max(txn_date) AS date_max FROM knowledge""")
def knowledge_summary(spark, sf):
    return aggregate.knowledge_summary(knowledge(spark, sf))


@query("payment_mix", O.with_(views.TXN_CTE) + """SELECT account_id, payment_format, count(*) AS txn_count
  FROM (SELECT from_account AS account_id, payment_format FROM txn UNION ALL
  SELECT to_account, payment_format FROM txn WHERE to_account <> from_account) q GROUP BY 1, 2""")
def payment_mix(spark, sf):
    return customers.payment_mix(views.txn(spark, sf))


@query("known_positive_counts", O.with_(views.TXN_CTE) + """SELECT account_id, count(*) AS known_positives
  FROM (SELECT from_account AS account_id FROM txn WHERE is_laundering = 1 UNION ALL
  SELECT to_account FROM txn WHERE to_account <> from_account AND is_laundering = 1) q GROUP BY 1""")
def known_positive_counts(spark, sf):
    return customers.known_positives(views.txn(spark, sf))


@query("counterparty_top12", O.with_(views.TXN_CTE) + """SELECT account_id, counterparty, direction, txn_count,
  total_amount, CAST(rn AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY total_amount DESC, counterparty, direction) AS rn
  FROM (SELECT account_id, counterparty, direction, count(*) AS txn_count, round(sum(amount), 2) AS total_amount
    FROM (SELECT from_account AS account_id, to_account AS counterparty, 'outbound' AS direction,
            amount_paid AS amount FROM txn UNION ALL
          SELECT to_account, from_account, 'inbound', amount_received FROM txn) l
    WHERE account_id <> counterparty GROUP BY 1, 2, 3) g) q WHERE rn <= 12""")
def counterparty_top12(spark, sf):
    return customers.top_counterparties(views.txn(spark, sf))


@query("account_currencies", O.with_(views.TXN_CTE) + """SELECT from_account AS account_id,
  paying_currency AS currency FROM txn UNION SELECT to_account, receiving_currency FROM txn""")
def account_currencies(spark, sf):
    return customers.account_currencies(views.txn(spark, sf))


@query("payment_formats", O.with_(views.TXN_CTE) + """SELECT min(trim(payment_format)) AS payment_format FROM txn
  WHERE trim(payment_format) <> '' GROUP BY lower(trim(payment_format))""")
def payment_formats(spark, sf):
    return filters.payment_formats(views.txn(spark, sf))


@query("rule_recall", O.with_(views.TXN_CTE, """pos AS (SELECT * FROM txn WHERE payment_format <> 'ACH')""",
                              O.features("pos")) + "SELECT laundering_type, rule, count(*) AS total, "
       "count(*) FILTER (WHERE hit) AS flagged, round(count(*) FILTER (WHERE hit) / count(*)::DOUBLE, 4) AS recall "
       "FROM (SELECT laundering_type, CASE laundering_type "
       + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LABEL_RULES.items()) + " END AS rule, "
       "CASE laundering_type " + " ".join(f"WHEN '{k}' THEN ({O.RULE_SQL[v]})"
                                          for k, v in P.LABEL_RULES.items())
       + " END AS hit FROM feat) q GROUP BY 1, 2")
def rule_recall(spark, sf):
    return rules.rule_recall(knowledge(spark, sf), KEY)


# ---- profiling -----------------------------------------------------------------------

@query("eda_summary", O.with_(views.TXN_CTE) + """SELECT count(*) AS row_count,
  round(sum(amount_paid), 2) AS total_amount, round(avg(amount_paid), 6) AS mean_amount,
  round(quantile_cont(amount_paid, 0.5), 6) AS median_amount, max(amount_paid) AS max_amount,
  round(quantile_cont(amount_paid, 0.9), 6) AS p90_amount, round(quantile_cont(amount_paid, 0.99), 6) AS p99_amount,
  count(DISTINCT from_account) AS distinct_from, count(DISTINCT to_account) AS distinct_to,
  min(timestamp) AS first_seen, max(timestamp) AS last_seen,
  count(*) FILTER (WHERE is_laundering = 1) AS positives,
  round(count(*) FILTER (WHERE is_laundering = 1) * 100.0::DOUBLE / count(*), 4) AS positive_rate_pct FROM txn""")
def eda_summary(spark, sf):
    return profile.eda_summary(views.txn(spark, sf)).select(
        "row_count", r("total_amount", 2), r("mean_amount"), r("median_amount"), "max_amount",
        r("p90_amount"), r("p99_amount"), "distinct_from", "distinct_to", "first_seen",
        "last_seen", "positives", "positive_rate_pct")


@query("amount_histogram", O.with_(views.TXN_CTE) + """, b AS (SELECT min(amount_paid) AS lo,
  quantile_cont(amount_paid, 0.99) AS hi FROM txn),
 c AS (SELECT CAST(least(floor((amount_paid - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS n
  FROM txn, b WHERE amount_paid <= hi GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * ((hi - lo) / 30), 6) AS low,
  round(lo + (g.bin + 1) * ((hi - lo) / 30), 6) AS high, coalesce(n, 0) AS row_count,
  (SELECT count(*) FROM txn, b WHERE amount_paid > hi) AS overflow
FROM range(30) g(bin) CROSS JOIN b LEFT JOIN c ON c.bin = g.bin""")
def amount_histogram(spark, sf):
    return profile.amount_histogram(views.txn(spark, sf)).select(
        "bin", r("low"), r("high"), "row_count", "overflow")


@query("daily_counts", O.with_(views.TXN_CTE)
       + "SELECT CAST(timestamp AS DATE) AS day, count(*) AS row_count FROM txn GROUP BY 1")
def daily_counts(spark, sf):
    return profile.daily_counts(views.txn(spark, sf))


@query("category_top12", O.with_(views.LEDGER_CTE) + """SELECT coalesce(nullif(from_country, ''), 'Unknown')
  AS category, count(*) AS row_count FROM ledger GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""")
def category_top12(spark, sf):
    return profile.category_top(views.ledger(spark, sf), "from_country")


@query("customer_volume", O.with_(views.LEDGER_CTE) + """SELECT count(*) AS accounts,
  quantile_cont(c, 0.0) AS minimum, quantile_cont(c, 0.25) AS lower_quartile, quantile_cont(c, 0.5) AS median,
  quantile_cont(c, 0.75) AS upper_quartile, quantile_cont(c, 1.0) AS maximum
  FROM (SELECT from_account, CAST(count(*) AS DOUBLE) AS c FROM ledger GROUP BY 1) q""")
def customer_volume(spark, sf):
    return profile.customer_volume(views.ledger(spark, sf))


@query("amount_percentiles", O.with_(views.LEDGER_CTE) + """SELECT p AS percentile, round(v, 6) AS amount FROM (
  SELECT 'p50' AS p, quantile_cont(amount_paid, 0.5) AS v FROM ledger
  UNION ALL SELECT 'p90', quantile_cont(amount_paid, 0.9) FROM ledger
  UNION ALL SELECT 'p95', quantile_cont(amount_paid, 0.95) FROM ledger
  UNION ALL SELECT 'p99', quantile_cont(amount_paid, 0.99) FROM ledger) q""")
def amount_percentiles(spark, sf):
    return profile.amount_percentiles(views.ledger(spark, sf)).select("percentile", r("amount"))


@query("risk_distribution", O.with_(*O.FULL)
       + "SELECT risk_label AS label, count(*) AS row_count FROM scored GROUP BY 1")
def risk_distribution(spark, sf):
    return profile.label_distribution(full_scored(spark, sf))


@query("risk_level_counts", O.with_(*O.FULL, O.best()) + """SELECT l AS label, count(from_account) AS row_count
  FROM (VALUES ('low'), ('medium'), ('high')) v(l) LEFT JOIN best ON risk_label = l GROUP BY 1""")
def risk_level_counts(spark, sf):
    return profile.risk_level_counts(evidence.best_rows(full_scored(spark, sf), KEY))


@query("weekday_hour_grid", O.with_(views.TXN_CTE) + """SELECT CAST(g // 24 AS INTEGER) AS weekday,
  CAST(g % 24 AS INTEGER) AS hour, coalesce(n, 0) AS row_count FROM range(168) r(g) LEFT JOIN (
  SELECT isodow(timestamp) - 1 AS w, hour(timestamp) AS h, count(*) AS n FROM txn GROUP BY 1, 2) c
  ON c.w = g // 24 AND c.h = g % 24""")
def weekday_hour_grid(spark, sf):
    return profile.weekday_hour_grid(views.txn(spark, sf))


@query("missing_counts", O.with_(_RAW) + """SELECT 'ref' AS column_name, count(*) - count(ref) AS missing FROM raw
  UNION ALL SELECT 'amount', count(*) - count(amount) FROM raw
  UNION ALL SELECT 'sender_id', count(*) - count(sender_id) FROM raw
  UNION ALL SELECT 'receiver_id', count(*) - count(receiver_id) FROM raw
  UNION ALL SELECT 'Timestamp', count(*) - count("Timestamp") FROM raw
  UNION ALL SELECT 'channel', count(*) - count(channel) FROM raw""")
def missing_counts(spark, sf):
    return profile.missing_counts(raw_upload(spark, sf))


# ---- graph ---------------------------------------------------------------------------

_EDGES = """edges AS (SELECT from_account AS src, to_account AS dst, count(*) AS n,
  sum(amount_paid) AS amt, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM txn GROUP BY 1, 2)"""
_G = O.with_(views.TXN_CTE, _EDGES)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.build_edges(views.txn(spark, sf))


@query("graph_edges", _G + """SELECT src, dst, n AS transaction_count, round(amt, 2) AS total_amount,
  first_ts AS first_timestamp, last_ts AS last_timestamp FROM edges""")
def graph_edges(spark, sf):
    return edges(spark, sf).withColumn("total_amount", F.round("total_amount", 2))


@query("graph_summary", _G + """SELECT (SELECT count(*) FROM txn) AS input_rows, nodes, e AS edges, self_loops,
  round(e / (nodes * (nodes - 1))::DOUBLE, 8) AS density FROM (SELECT count(*) AS e,
  count(*) FILTER (WHERE src = dst) AS self_loops FROM edges) a, (SELECT count(*) AS nodes FROM (
  SELECT src FROM edges UNION SELECT dst FROM edges) u) b""")
def graph_summary(spark, sf):
    return graph.graph_summary(views.txn(spark, sf), edges(spark, sf))


def _fan_sql(hub: str, other: str) -> str:
    return _G + f"""SELECT account, degree, transaction_count, total_amount,
  array_to_string(names[1:20], ',') AS counterparties FROM (SELECT {hub} AS account, count(*) AS degree,
  CAST(sum(n) AS BIGINT) AS transaction_count, round(sum(amt), 2) AS total_amount,
  list_sort(list({other})) AS names FROM edges GROUP BY 1 HAVING count(*) >= 3) q"""


@query("graph_fan_in", _fan_sql("dst", "src"))
def graph_fan_in(spark, sf):
    return graph.top_fans(edges(spark, sf), "in", None).withColumn(
        "counterparties", F.array_join("counterparties", ","))


@query("graph_fan_out", _fan_sql("src", "dst"))
def graph_fan_out(spark, sf):
    return graph.top_fans(edges(spark, sf), "out", None).withColumn(
        "counterparties", F.array_join("counterparties", ","))


@query("graph_bipartite", _G + """SELECT a.src AS source_a, b.src AS source_b, count(*) AS destination_count,
  2 * count(*) AS edge_count FROM edges a JOIN edges b ON a.dst = b.dst AND a.src < b.src
  GROUP BY 1, 2 HAVING count(*) >= 2""")
def graph_bipartite(spark, sf):
    return graph.bipartite_pairs(edges(spark, sf))


@query("graph_bipartite_accounts", _G + """, pairs AS (SELECT a.src AS x, b.src AS y, count(*) AS n FROM edges a
  JOIN edges b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT account, count(*) AS pair_count, CAST(sum(2 * n) AS BIGINT) AS edge_count, max(n) AS widest FROM
  (SELECT unnest([x, y]) AS account, n FROM pairs) q GROUP BY 1""")
def graph_bipartite_accounts(spark, sf):
    return graph.bipartite_accounts(edges(spark, sf))


@query("graph_bipartite_top", _G + """SELECT source_a, source_b, destination_count,
  array_to_string(t[1:20], ',') AS destinations FROM (SELECT a.src AS source_a, b.src AS source_b,
  count(*) AS destination_count, list_sort(list(a.dst)) AS t FROM edges a
  JOIN edges b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2 HAVING count(*) >= 2) q
  ORDER BY destination_count DESC, source_a, source_b LIMIT 100""")
def graph_bipartite_top(spark, sf):
    return graph.top_bipartite(edges(spark, sf)).select(
        "source_a", "source_b", "destination_count", text_list("destinations"))


@query("graph_gather_scatter", _G + """SELECT hub, source_count, destination_count,
  array_to_string(s[1:20], ',') AS sources, array_to_string(d[1:20], ',') AS destinations FROM
  (SELECT dst AS hub, count(*) AS source_count, list_sort(list(src)) AS s FROM edges GROUP BY 1) i JOIN
  (SELECT src AS hub, count(*) AS destination_count, list_sort(list(dst)) AS d FROM edges GROUP BY 1) o USING (hub)
  WHERE source_count >= 3 AND destination_count >= 3""")
def graph_gather_scatter(spark, sf):
    return graph.top_gather_scatter(edges(spark, sf), None).select(
        "hub", "source_count", "destination_count", text_list("sources"),
        text_list("destinations"))


@query("graph_scatter_gather", _G + """SELECT a.src AS source, b.dst AS destination, count(*) AS path_count
  FROM edges a JOIN edges b ON a.dst = b.src AND a.src <> b.dst GROUP BY 1, 2 HAVING count(*) >= 3""")
def graph_scatter_gather(spark, sf):
    return graph.scatter_gather_pairs(edges(spark, sf))


@query("graph_scatter_gather_accounts", _G + """, pairs AS (SELECT a.src AS s, b.dst AS d, count(*) AS n FROM edges a
  JOIN edges b ON a.dst = b.src AND a.src <> b.dst GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT account, count(*) FILTER (WHERE side = 's') AS as_source, count(*) FILTER (WHERE side = 'd') AS as_destination,
  CAST(sum(n) AS BIGINT) AS path_count, max(n) AS widest FROM (SELECT s AS account, 's' AS side, n FROM pairs
  UNION ALL SELECT d, 'd', n FROM pairs) q GROUP BY 1""")
def graph_scatter_gather_accounts(spark, sf):
    return graph.scatter_gather_accounts(edges(spark, sf))


@query("graph_scatter_gather_top", _G + """SELECT source, destination, path_count,
  array_to_string(m[1:20], ',') AS intermediaries FROM (SELECT a.src AS source, b.dst AS destination,
  count(*) AS path_count, list_sort(list(a.dst)) AS m FROM edges a JOIN edges b ON a.dst = b.src
  AND a.src <> b.dst GROUP BY 1, 2 HAVING count(*) >= 3) q
  ORDER BY path_count DESC, source, destination LIMIT 100""")
def graph_scatter_gather_top(spark, sf):
    return graph.top_scatter_gather(edges(spark, sf)).select(
        "source", "destination", "path_count", text_list("intermediaries"))


_CYCLES = """, c AS (SELECT * FROM edges WHERE src <> dst),
rings AS (
 SELECT 2 AS length, a.src || ',' || a.dst AS accounts, a.n + b.n AS n, a.amt + b.amt AS amt
 FROM c a JOIN c b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
 UNION ALL SELECT 3, a.src || ',' || b.src || ',' || d.src, a.n + b.n + d.n, a.amt + b.amt + d.amt
 FROM c a JOIN c b ON a.dst = b.src JOIN c d ON d.src = b.dst AND d.dst = a.src
 WHERE a.src < a.dst AND a.src < b.dst
 UNION ALL SELECT 4, a.src || ',' || b.src || ',' || d.src || ',' || f.src, a.n + b.n + d.n + f.n,
   a.amt + b.amt + d.amt + f.amt
 FROM c a JOIN c b ON a.dst = b.src JOIN c d ON d.src = b.dst JOIN c f ON f.src = d.dst AND f.dst = a.src
 WHERE a.src < a.dst AND a.src < b.dst AND a.src < d.dst AND a.dst <> d.dst)
"""


@query("graph_cycles", _G + _CYCLES + """SELECT accounts, length, n AS transaction_count,
  round(amt, 2) AS total_amount FROM rings""")
def graph_cycles(spark, sf):
    return graph.cycles(edges(spark, sf)).withColumn("accounts", F.array_join("accounts", ","))


@query("graph_cycle_accounts", _G + _CYCLES + """SELECT unnest(string_split(accounts, ',')) AS account, length,
  count(*) AS cycle_count, CAST(sum(n) AS BIGINT) AS transaction_count, round(sum(amt), 2) AS total_amount
  FROM rings GROUP BY 1, 2""")
def graph_cycle_accounts(spark, sf):
    """All cycles up to four accounts, counted per account they pass through."""
    return graph.cycle_accounts(edges(spark, sf))


_MEMBERS = _CYCLES + """, pairs AS (SELECT a.src AS x, b.src AS y, count(*) AS n FROM edges a
  JOIN edges b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2 HAVING count(*) >= 2),
sized AS (SELECT dst AS account, 'fan_in' AS pattern, count(*) AS size, 3 AS least FROM edges GROUP BY 1 HAVING count(*) >= 3
  UNION ALL SELECT src, 'fan_out', count(*), 3 FROM edges GROUP BY 1 HAVING count(*) >= 3
  UNION ALL SELECT account, 'bipartite', max(n), 2 FROM (SELECT unnest([x, y]) AS account, n FROM pairs) q GROUP BY 1
  UNION ALL SELECT account, 'cycle', count(*), 1 FROM (SELECT unnest(string_split(accounts, ',')) AS account FROM rings) q GROUP BY 1),
members AS (SELECT account, pattern, size, size::DOUBLE / (size + least) AS strength FROM sized)
"""


@query("graph_pattern_members", _G + _MEMBERS
       + "SELECT account, pattern, size, round(strength, 6) AS strength FROM members")
def graph_pattern_members(spark, sf):
    return graph.pattern_membership(edges(spark, sf)).withColumn("strength", r("strength"))


@query("entity_risk", O.with_(*O.FULL, _EDGES) + _MEMBERS + """, sig AS (
  SELECT from_account AS e, 0.40 AS w, max(rule_score) AS s, bool_or(""" + O.COUNTRY + """) AS c FROM scored GROUP BY 1
  UNION ALL SELECT from_account, 0.20, max(stat_score), false FROM scored GROUP BY 1
  UNION ALL SELECT account, 0.15, max(strength), false FROM members GROUP BY 1),
named AS (SELECT from_account AS e, unnest(rule_flags) AS f FROM scored UNION SELECT account, pattern FROM members),
fl AS (SELECT e, string_agg(f, ',' ORDER BY f) AS flags FROM named GROUP BY 1),
d AS (SELECT e, max(s) AS strongest_score,
  round(least(1.0, sum(s * w) / sum(w) + CASE WHEN bool_or(c) THEN 0.08 ELSE 0.0 END), 6) AS risk_score
  FROM sig GROUP BY e)
SELECT d.e AS entity_id, round(strongest_score, 6) AS strongest_score, coalesce(flags, '') AS flags, risk_score,
  CASE WHEN risk_score < 0.45 THEN 'low' WHEN risk_score < 0.75 THEN 'medium' ELSE 'high' END AS risk_label,
  CASE WHEN risk_score < 0.45 THEN 'monitor' WHEN risk_score < 0.75 THEN 'flag_for_review' ELSE 'report' END
    AS escalation_action FROM d LEFT JOIN fl USING (e)""")
def entity_risk(spark, sf):
    """Rules, statistics and graph patterns of each account in one decision."""
    scored = shared(full_scored(spark, sf))
    named = scored.withColumn("_f", F.explode_outer("rule_flags"))
    by_rule = named.groupBy(F.col("from_account").alias("entity_id")).agg(
        F.lit("rule_engine").alias("detector"), F.max("rule_score").alias("score"),
        F.collect_set("_f").alias("flags"),
        F.bool_or(C.high_risk_country(scored)).alias("high_risk_country"))
    by_stat = scored.groupBy(F.col("from_account").alias("entity_id")).agg(
        F.lit("statistical_engine").alias("detector"), F.max("stat_score").alias("score"),
        F.array().cast("array<string>").alias("flags"), F.lit(False).alias("high_risk_country"))
    by_graph = graph.graph_signals(graph.pattern_membership(edges(spark, sf)))
    merged = risk.merge_signals({"rule_engine": by_rule, "statistical_engine": by_stat, "graph_engine": by_graph})
    return risk.decide_entities(merged).select(
        "entity_id", r("strongest_score"), text_list("flags"), "risk_score", "risk_label",
        "escalation_action")


# ---- drift ---------------------------------------------------------------------------

def _psi_sql(source: str, columns: list[str], floor_psi: str) -> str:
    legs = []
    for c in columns:
        legs.append(f"""SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v,
  txn_date < DATE '2024-01-16' AS base FROM {source}""")
    return f""", long AS ({' UNION ALL '.join(legs)}),
q AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])))
  AS e FROM long WHERE base GROUP BY feature),
inner_q AS (SELECT feature, e[2:len(e) - 1] AS e FROM q),
b AS (SELECT feature, base, len(list_filter(e, lambda x: x <= v)) AS bucket, count(*) AS n
  FROM long JOIN inner_q USING (feature) GROUP BY 1, 2, 3),
g AS (SELECT feature, unnest(range(len(e) + 1)) AS bucket FROM inner_q),
t AS (SELECT feature, count(*) FILTER (WHERE base) AS eb, count(*) FILTER (WHERE NOT base) AS ab,
  round(avg(v) FILTER (WHERE base), 6) AS baseline_mean, round(avg(v) FILTER (WHERE NOT base), 6) AS current_mean
  FROM long GROUP BY feature),
p AS (SELECT feature, greatest(coalesce(x.n, 0) / eb::DOUBLE, 1e-6) AS e, greatest(coalesce(y.n, 0) / ab::DOUBLE, 1e-6) AS a
  FROM g JOIN t USING (feature) LEFT JOIN (SELECT * FROM b WHERE base) x USING (feature, bucket)
  LEFT JOIN (SELECT * FROM b WHERE NOT base) y USING (feature, bucket))
SELECT feature, psi, CASE WHEN {floor_psi} THEN 'drift' WHEN psi >= 0.1 THEN 'caution' ELSE 'stable' END AS status,
  baseline_mean, current_mean FROM (SELECT feature, round(sum((a - e) * ln(a / e)), 6) AS psi FROM p GROUP BY 1) s
  JOIN t USING (feature)"""


def halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    cut = F.lit("2024-01-16").cast("date")
    return df.where(F.col("txn_date") < cut), df.where(F.col("txn_date") >= cut)


@query("psi_feature", O.with_(views.TXN_CTE) + _psi_sql("txn", ["amount_paid"], "psi >= 0.2"))
def psi_feature(spark, sf):
    base, current = halves(views.txn(spark, sf))
    return drift.drift_report(base, current, ["amount_paid"], inclusive=True)


_MONITORED = ["amount_paid", "amount_received"]


@query("drift_monitor", O.with_(views.TXN_CTE, "p AS (" + O.with_(views.TXN_CTE) + _psi_sql("txn", _MONITORED, "psi >= 0.2") + ")")
       + """SELECT 'txn-amounts' AS model_id, feature, psi, status, (SELECT count(*) FROM txn WHERE txn_date < DATE '2024-01-16')
  AS baseline_count, (SELECT count(*) FROM txn WHERE txn_date >= DATE '2024-01-16') AS current_count,
  (SELECT max(psi) FROM p) AS overall_psi, (SELECT CASE WHEN max(psi) >= 0.2 THEN 'drift' WHEN max(psi) >= 0.1 THEN 'caution'
  ELSE 'stable' END FROM p) AS overall_status FROM p""")
def drift_monitor(spark, sf):
    base, current = (df.select(*_MONITORED) for df in halves(views.txn(spark, sf)))
    return drift.model_drift("txn-amounts", base, current).drop("note")


@query("drift_report", O.with_(views.TXN_CTE, O.features()) + _psi_sql("feat", P.MODEL_FEATURES, "psi > 0.2"))
def drift_report(spark, sf):
    t = views.txn(spark, sf)
    base, current = halves(shared(features.features_for(t, [], with_model_features=True,
                                                        row_key=KEY)))
    return drift.drift_report(base, current)


# ---- workflow ------------------------------------------------------------------------

@query("alerts_from_findings", O.with_(*O.FULL, O.best(), O.ALERTS) + """SELECT alert_id, entity_id,
  investigation_id, round(risk_score, 6) AS risk_score, risk_label, escalation_action, created_at, sla_hours,
  status, disposition FROM alerts""")
def alerts_from_findings(spark, sf):
    return alerts(spark, sf).select(
        "alert_id", "entity_id", "investigation_id", r("risk_score"), "risk_label",
        "escalation_action", "created_at", "sla_hours", "status", "disposition")


@query("queue_state", O.with_(*O.QUEUE) + """SELECT alert_id, assigned_to, status, disposition, note_count,
  last_note FROM folded""")
def queue_state(spark, sf):
    return queue(spark, sf).select("alert_id", "assigned_to", "status", "disposition",
                                   "note_count", "last_note")


@query("queue_state_governed", O.with_(*O.FULL, O.best(), O.ALERTS, O.ACTIONS) + """SELECT a.alert_id,
  l.assigned_to, coalesce(l.decided, CASE WHEN l.assigns > 0 THEN 'in_review' END, a.status) AS status,
  coalesce(l.decision, a.disposition) AS disposition FROM alerts a LEFT JOIN (SELECT alert_id,
  arg_max(value, seq) FILTER (WHERE action = 'assign') AS assigned_to,
  arg_max(value, seq) FILTER (WHERE action = 'disposition') AS decision,
  arg_max(CASE value WHEN 'true_positive' THEN 'in_review' WHEN 'false_positive' THEN 'closed'
    WHEN 'escalated' THEN 'escalated' END, seq) FILTER (WHERE action = 'disposition') AS decided,
  count(*) FILTER (WHERE action = 'assign') AS assigns FROM actions GROUP BY alert_id) l USING (alert_id)""")
def queue_state_governed(spark, sf):
    return workflow.fold_actions(alerts(spark, sf), actions(spark, sf), governed=True).select(
        "alert_id", "assigned_to", "status", "disposition")


@query("alert_notes", O.with_(O.ACTIONS) + """SELECT alert_id, seq, '[' || strftime(acted, '%Y-%m-%dT%H:%M:%S')
  || '] ' || actor || ': ' || value AS line FROM actions WHERE action = 'note'""")
def alert_notes(spark, sf):
    return workflow.alert_notes(actions(spark, sf))


@query("alert_notes_text", O.with_(O.ACTIONS) + """SELECT alert_id, string_agg('[' || strftime(acted, '%Y-%m-%dT%H:%M:%S')
  || '] ' || actor || ': ' || value, chr(10) ORDER BY seq) AS notes FROM actions WHERE action = 'note'
  AND alert_id = (SELECT min(alert_id) FROM actions WHERE action = 'note') GROUP BY alert_id""")
def alert_notes_text(spark, sf):
    log = actions(spark, sf)
    return workflow.notes_page(log, log.where("action = 'note'").agg(F.min("alert_id")).first()[0])


_AGE = f"""round(greatest(0, date_diff('second', created_at, TIMESTAMP '{AS_OF}')) / 3600.0::DOUBLE, 6)"""


@query("queue_ranked", O.with_(*O.QUEUE) + f"""SELECT alert_id, entity_id, round(risk_score, 6) AS risk_score, status,
  created_at FROM (SELECT * FROM folded ORDER BY CASE status WHEN 'escalated' THEN 0 WHEN 'new' THEN 1
  WHEN 'in_review' THEN 2 ELSE 3 END, risk_score DESC, created_at, alert_id LIMIT 100) q""")
def queue_ranked(spark, sf):
    return workflow.rank_queue(queue(spark, sf)).select(
        "alert_id", "entity_id", r("risk_score"), "status", "created_at")


@query("queue_governed_page", O.with_(*O.QUEUE) + """SELECT alert_id, risk_label, assigned_to, created_at FROM (
  SELECT * FROM folded WHERE status = 'in_review' ORDER BY CASE risk_label WHEN 'high' THEN 0 WHEN 'medium'
  THEN 1 ELSE 2 END, created_at, alert_id LIMIT 20 OFFSET 5) q""")
def queue_governed_page(spark, sf):
    return workflow.governed_queue(queue(spark, sf), status="in_review", limit=20, offset=5).select(
        "alert_id", "risk_label", "assigned_to", "created_at")


@query("queue_ages", O.with_(*O.QUEUE) + f"""SELECT alert_id, {_AGE} AS governed_hours,
  round(greatest(0, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 3600000000.0::DOUBLE, 6) AS age_hours,
  (greatest(0, date_diff('second', created_at, TIMESTAMP '{AS_OF}')) / 3600.0::DOUBLE > sla_hours
   AND status <> 'closed') AS sla_breached FROM folded""")
def queue_ages(spark, sf):
    exact = workflow.queue_view(queue(spark, sf), as_of(), digits=6)
    governed = workflow.queue_view(exact.withColumnRenamed("age_hours", "exact_hours"), as_of(),
                                   digits=6, governed=True)
    return governed.select("alert_id", F.col("age_hours").alias("governed_hours"),
                           F.col("exact_hours").alias("age_hours"), "sla_breached")


@query("queue_summary", O.with_(*O.QUEUE) + """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'new') AS new,
  count(*) FILTER (WHERE status = 'in_review') AS in_review, count(*) FILTER (WHERE status = 'escalated') AS escalated,
  count(*) FILTER (WHERE status = 'closed') AS closed FROM folded""")
def queue_summary(spark, sf):
    return workflow.queue_summary(queue(spark, sf))


_ROLLUP = """rolled AS (SELECT investigation_id, alert_count, status, CASE WHEN status = 'escalated' THEN 'escalated'
  WHEN status = 'closed' AND tp THEN 'true_positive' WHEN status = 'closed' AND decided THEN 'false_positive'
  ELSE 'pending' END AS disposition FROM (SELECT investigation_id, count(*) AS alert_count,
  CASE WHEN bool_or(status = 'escalated') THEN 'escalated' WHEN bool_or(status IN ('new', 'in_review'))
  THEN 'in_review' ELSE 'closed' END AS status, bool_or(disposition = 'true_positive') AS tp,
  bool_or(disposition <> 'pending') AS decided FROM folded GROUP BY 1) q)"""


@query("investigation_rollup", O.with_(*O.QUEUE, _ROLLUP) + "SELECT * FROM rolled")
def investigation_rollup(spark, sf):
    return workflow.investigation_rollup(queue(spark, sf))


def investigations(spark: SparkSession, sf: str, queued: DataFrame) -> DataFrame:
    """Investigations with a JSON payload, one per group of accounts."""
    rolled = workflow.investigation_rollup(queued).select("investigation_id", "status")
    t = views.txn(spark, sf)
    number = F.substring("from_account", 2, 20).cast("long")
    first = (t.groupBy(F.concat(F.lit("INV-"), (number % 7).cast("string"))
                        .alias("investigation_id"))
              .agg(F.min("timestamp").alias("created_at")))
    odd = F.substring("investigation_id", 5, 9).cast("long") % 2 == 1
    payload = F.to_json(F.struct(
        F.when(odd, "ds_odd").otherwise("ds_even").alias("dataset_id"),
        F.when(odd, "Odd set").otherwise("Even set").alias("dataset_name"),
        F.struct(F.when(odd, "Structuring").otherwise("smurfing").alias("pattern_type"))
         .alias("intent")))
    return first.join(rolled, "investigation_id").withColumn("payload", payload)


@query("investigation_list", O.with_(*O.QUEUE, _ROLLUP) + """SELECT investigation_id, created_at, status,
  'ds_odd' AS dataset_id, 'Odd set' AS dataset_name, 'Structuring' AS pattern_type, alert_count FROM rolled
  JOIN (SELECT 'INV-' || CAST(CAST(substr(from_account, 2) AS BIGINT) % 7 AS VARCHAR) AS investigation_id,
    min(timestamp) AS created_at FROM txn GROUP BY 1) f USING (investigation_id)
  WHERE CAST(substr(investigation_id, 5) AS BIGINT) % 2 = 1 ORDER BY created_at DESC, investigation_id LIMIT 50""")
def investigation_list(spark, sf):
    queued = shared(queue(spark, sf).select("investigation_id", "status", "disposition"))
    # Shared, as the payload's filters would else be pushed down to every transfer.
    return workflow.investigation_list(
        shared(investigations(spark, sf, queued)), queued, dataset_id="ds_odd",
        pattern="structuring").drop("payload")


@query("investigation_detail", O.with_(*O.QUEUE, _ROLLUP) + """SELECT investigation_id, created_at, status, disposition,
  'ds_odd' AS dataset_id, 'Odd set' AS dataset_name, 'Structuring' AS pattern_type, alert_count,
  alert_count AS flagged_count, high_risk_count, open_alert_count FROM rolled
  JOIN (SELECT 'INV-' || CAST(CAST(substr(from_account, 2) AS BIGINT) % 7 AS VARCHAR) AS investigation_id,
    min(timestamp) AS created_at FROM txn GROUP BY 1) f USING (investigation_id)
  JOIN (SELECT investigation_id, count(*) FILTER (WHERE risk_label = 'high') AS high_risk_count,
    count(*) FILTER (WHERE status <> 'closed') AS open_alert_count FROM folded GROUP BY 1) h USING (investigation_id)
  WHERE investigation_id = 'INV-3'""")
def investigation_detail(spark, sf):
    queued = shared(queue(spark, sf))
    return workflow.investigation_detail(investigations(spark, sf, queued), queued, "INV-3").drop("payload")


@query("investigation_status", O.with_(*O.QUEUE, _ROLLUP) + """SELECT count(*) AS total,
  count(*) FILTER (WHERE status = 'in_review') AS in_review, count(*) FILTER (WHERE status = 'escalated') AS escalated,
  count(*) FILTER (WHERE status = 'closed') AS closed,
  (SELECT count(*) FROM folded WHERE risk_label = 'high') AS high_risk_entities,
  (SELECT count(*) FROM folded) AS alerts FROM rolled""")
def investigation_status(spark, sf):
    queued = shared(queue(spark, sf))
    return workflow.status_summary(investigations(spark, sf, queued), queued)


@query("audit_page", O.with_(*O.FULL, O.best(), O.ALERTS, O.ACTIONS) + """SELECT c.alert_id, a.actor,
  'alert_assigned' AS event_type, a.acted AS created_at, '{"assigned_to":"' || a.value || '"}' AS payload,
  c.investigation_id FROM actions a JOIN alerts c USING (alert_id) WHERE a.action = 'assign'
  ORDER BY a.acted DESC LIMIT 50""")
def audit_page(spark, sf):
    events = workflow.audit_events(alerts(spark, sf), actions(spark, sf),
                                   policy_version=P.EntityRiskPolicy().version)
    return workflow.audit_page(events, event_type="alert_assigned").select(
        "alert_id", "actor", "event_type", "created_at", "payload", "investigation_id")


@query("audit_event_counts", O.with_(*O.FULL, O.best(), O.ALERTS, O.ACTIONS) + """SELECT event_type, count(*) AS event_count
  FROM (SELECT 'alert_created' AS event_type FROM alerts UNION ALL
  SELECT 'investigation_completed' FROM (SELECT DISTINCT investigation_id FROM alerts) i UNION ALL
  SELECT CASE action WHEN 'assign' THEN 'alert_assigned' WHEN 'disposition' THEN 'alert_dispositioned'
    ELSE 'analyst_note_added' END FROM actions JOIN alerts USING (alert_id)) q GROUP BY 1""")
def audit_event_counts(spark, sf):
    events = workflow.audit_events(shared(alerts(spark, sf)), actions(spark, sf),
                                   policy_version=P.EntityRiskPolicy().version)
    return events.groupBy("event_type").agg(F.count("*").alias("event_count"))


@query("entity_alerts", O.with_(*O.QUEUE) + """SELECT entity_id, alert_id, created_at, CAST(rn AS INTEGER) AS position
  FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, alert_id) AS rn FROM folded) q
  WHERE rn <= 25""")
def entity_alerts(spark, sf):
    return workflow.entity_alerts(queue(spark, sf)).select(
        "entity_id", "alert_id", "created_at", "position")


@query("workload_summary", O.with_(*O.QUEUE, O.KNOWLEDGE) + """SELECT CAST(1 AS BIGINT) AS primary_sets,
  CAST(1 AS BIGINT) AS knowledge_sets, CAST(0 AS BIGINT) AS kyc_sets,
  (SELECT count(*) FROM txn) + (SELECT count(*) FROM knowledge) AS governed_rows,
  CAST((SELECT sum(is_laundering) FROM txn) + (SELECT sum(is_laundering) FROM knowledge) AS BIGINT) AS positives,
  (SELECT count(*) FROM folded) AS total, (SELECT count(*) FROM folded WHERE status = 'new') AS new,
  (SELECT count(*) FROM folded WHERE status = 'in_review') AS in_review,
  (SELECT count(*) FROM folded WHERE status = 'escalated') AS escalated,
  (SELECT count(*) FROM folded WHERE status = 'closed') AS closed""")
def workload_summary(spark, sf):
    registry = None
    for name, kind, df in (("transactions", "primary", views.txn(spark, sf)),
                           ("calibration", "knowledge", knowledge(spark, sf))):
        registry = uploads.register(registry, uploads.profile_dataset(
            df, name=name, dataset_type=kind, digest=uploads.table_digest(df), size_bytes=1))
    return workflow.workload(registry, queue(spark, sf))


# ---- text ----------------------------------------------------------------------------

_TOK = """d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark)"""


def docs_queries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = views.table(spark, sf, "documents").select(
        "doc_id", "text", F.array("lang").alias("typologies"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), "source")
    queries = views.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), "text",
        F.when(F.col("item_id") % 2 == 0, "fr").alias("typology"))
    return docs, queries


@query("bm25_topk", O.with_(_TOK) + """, n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
tf AS (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM d) x
  GROUP BY doc_id, dl, token),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
raw AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS w FROM df, n),
idf AS (SELECT token, CASE WHEN w < 0 THEN 0.25 * (SELECT avg(w) FROM raw) ELSE w END AS w FROM raw),
qq AS (SELECT query_id, token, count(*) AS qtf FROM qt GROUP BY 1, 2),
s AS (SELECT query_id, doc_id, round(sum(qtf * w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score
  FROM tf JOIN qq USING (token) JOIN idf USING (token), n GROUP BY 1, 2)
SELECT query_id, doc_id, score, CAST(rn AS INTEGER) AS position FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM s WHERE score > 0) z WHERE rn <= 3""")
def bm25_topk(spark, sf):
    docs, queries = docs_queries(spark, sf)
    return retrieval.bm25_search(docs, queries.drop("typology"))


_IDF = """, ds AS (SELECT doc_id, lang, list_distinct(list_concat(t, [lang, 'document', CAST(doc_id AS VARCHAR)])) AS t FROM d JOIN documents USING (doc_id)),
q1 AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'fr' END AS ty,
  list_distinct(regexp_extract_all(lower(concat_ws(' ', text, CASE WHEN item_id % 2 = 0 THEN 'fr' END)), '[a-z0-9]+'))
  AS t FROM benchmark),
df AS (SELECT token, count(*) AS df FROM (SELECT doc_id, unnest(t) AS token FROM ds) x GROUP BY token),
hit AS (SELECT query_id, doc_id, sum(ln(((SELECT count(*) FROM ds) + 1) / (df + 1)::DOUBLE) + 1) AS w
  FROM (SELECT query_id, unnest(t) AS token FROM q1) a JOIN (SELECT doc_id, unnest(t) AS token FROM ds) b USING (token)
  JOIN df USING (token) GROUP BY 1, 2),
ty AS (SELECT query_id, doc_id, 2.5 AS w FROM q1 JOIN ds ON ty = lang),
sc AS (SELECT query_id, doc_id, round(least(1.0, sum(w) / (len(any_value(t)) + 2.5)), 6) AS score FROM (
  SELECT * FROM hit UNION ALL SELECT * FROM ty) u JOIN q1 USING (query_id) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM sc WHERE score > 0)
"""


@query("idf_retriever_topk", O.with_(_TOK) + _IDF
       + "SELECT query_id, doc_id, score, CAST(rn AS INTEGER) AS position FROM ranked WHERE rn <= 2")
def idf_retriever_topk(spark, sf):
    docs, queries = docs_queries(spark, sf)
    return retrieval.idf_search(docs, queries)


@query("grounding_context", O.with_(_TOK) + _IDF + """SELECT q1.query_id, count(doc_id) > 0 AS supported,
  CASE WHEN count(doc_id) > 0 THEN 'Retrieved context for ' || coalesce(any_value(ty), 'the detected activity') ||
  ' from ' || string_agg('Document ' || doc_id, '; ' ORDER BY rn) || '. The alert remains an indicator requiring ' ||
  'analyst review, not a conclusion of money laundering.' ELSE 'No matching AML guidance was found in the governed ' ||
  'knowledge corpus; a regulatory conclusion is not supported.' END AS summary,
  coalesce(string_agg(source, ',' ORDER BY rn), '') AS citations
FROM q1 LEFT JOIN (SELECT * FROM ranked JOIN documents USING (doc_id) WHERE rn <= 2) k USING (query_id) GROUP BY 1""")
def grounding_context(spark, sf):
    docs, queries = docs_queries(spark, sf)
    return retrieval.grounding_context(docs, queries).withColumn(
        "citations", F.array_join("citations", ","))


@query("paragraph_split", """SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, p[i] AS paragraph FROM (
  SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(
  string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p
  FROM documents) a) b""")
def paragraph_split(spark, sf):
    return retrieval.split_paragraphs(views.table(spark, sf, "documents"))


_RESOLVED = f"""keyed AS (SELECT *, coalesce({O.FLAG_CASE}, CASE WHEN iqr_flag THEN 'behavioural_change_2'
  WHEN stat_score > 0 THEN 'behavioural_change_1' END, '') AS typology FROM {{source}}),
resolved AS (SELECT k.*, coalesce(t.typology_name, 'Unclassified AML anomaly') AS typology_name,
  coalesce(t.typology_label, '') AS typology_label, coalesce(t.reg_ref, '{P.DEFAULT_CITATION}') AS reg_ref
  FROM keyed k LEFT JOIN typologies t USING (typology))"""


@query("typology_resolve", O.with_(*O.FULL, O.TYPOLOGY_VALUES, _RESOLVED.format(source="scored"))
       + "SELECT event_id, typology, typology_name, typology_label, reg_ref FROM resolved")
def typology_resolve(spark, sf):
    return evidence.resolve_typology(full_scored(spark, sf)).select(
        "event_id", "typology", "typology_name", "typology_label", "reg_ref")


_TOP20 = "top20 AS (SELECT * FROM best ORDER BY risk_score DESC, event_id LIMIT 20)"
_TEXTS = f"""texts AS (SELECT *, CASE WHEN typology_label = '' THEN '{P.UNCLASSIFIED_LABEL}' ELSE typology_label END AS lbl,
  format('{{:.4f}}', risk_score) AS rs FROM resolved)"""


@query("explained_entities", O.with_(*O.FULL, O.best(), _TOP20, O.TYPOLOGY_VALUES,
                                     _RESOLVED.format(source="top20"), _TEXTS) + """SELECT from_account, event_id, typology_label,
  'Entity ' || from_account || ' received a composite risk score of ' || rs || ' from the detectors that ran. '
  || 'Observed rule signals were ' || CASE WHEN len(rule_flags) > 0 THEN array_to_string(rule_flags, ', ') ELSE 'none' END
  || '; the closest grounded SAML-D typology is ' || lbl || '.' AS explanation,
  'Review entity ' || from_account || ' for activity consistent with ' || lbl
  || '; the observed composite risk score is ' || rs || '.' AS sar_draft, reg_ref AS citation FROM texts""")
def explained_entities(spark, sf):
    return evidence.explained_entities(full_scored(spark, sf), KEY).select(
        "from_account", "event_id", "typology_label", "explanation", "sar_draft", "citation")


def flagged_records(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.flagged_entities(shared(full_scored(spark, sf)), KEY, limit=None)


_ENTITY = """tot AS (SELECT from_account, count(*) AS txn_count, sum(amount_paid) AS total_amount, min(timestamp) AS s,
  max(timestamp) AS e, count(DISTINCT to_account) AS distinct_counterparties FROM txn GROUP BY 1),
ev AS (SELECT from_account, string_agg(event_id || ':' || to_account, ',' ORDER BY rn) AS evidence FROM (SELECT *,
  row_number() OVER (PARTITION BY from_account ORDER BY amount_paid DESC, event_id) AS rn FROM txn) q WHERE rn <= 5 GROUP BY 1)"""
_ENTITIES = [*O.FULL, O.best(), O.TYPOLOGY_VALUES, _RESOLVED.format(source="best"), _ENTITY]


@query("flagged_entity_structs", O.with_(*_ENTITIES) + """SELECT from_account AS entity_id, round(risk_score, 6) AS risk_score,
  risk_label, txn_count, round(total_amount, 2) AS total_amount, s AS window_start, e AS window_end,
  distinct_counterparties, evidence FROM resolved JOIN tot USING (from_account) JOIN ev USING (from_account)""")
def flagged_entity_structs(spark, sf):
    listed = F.transform("top_transactions",
                         lambda x: F.concat(x["txn_id"], F.lit(":"), x["to_account"]))
    return flagged_records(spark, sf).select(
        "entity_id", r("risk_score"), "risk_label", "txn_count", r("total_amount", 2),
        F.col("observation_window.start").alias("window_start"),
        F.col("observation_window.end").alias("window_end"), "distinct_counterparties",
        F.array_join(listed, ",").alias("evidence"))


_ADVICE = "CASE escalation_action " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in P.ACTION_TEXT.items()) + " END"


@query("evidence_narrative", O.with_(*_ENTITIES) + f"""SELECT from_account AS entity_id,
  'Entity ' || from_account || ' is classified ' || risk_label || ' risk (' || format('{{:.0f}}', risk_score * 100)
  || '%) for potential ' || replace(CASE WHEN typology_label = '' THEN 'suspicious activity' ELSE typology_label END, '_', ' ')
  || '. Observed ' || format('{{:,}}', txn_count) || ' transactions totalling $' || format('{{:,.2f}}', total_amount)
  || '. Activity occurred from ' || strftime(s, '%Y-%m-%dT%H:%M:%S') || ' through ' || strftime(e, '%Y-%m-%dT%H:%M:%S')
  || '. Activity involved ' || format('{{:,}}', distinct_counterparties) || ' distinct counterparties.'
  || CASE WHEN len(rule_flags) > 0 THEN ' Triggered evidence signals: ' || replace(array_to_string(rule_flags[1:4], ', '), '_', ' ')
     || '.' ELSE '' END || ' {P.INDICATOR_TEXT}' AS explanation, {_ADVICE} AS recommendation
  FROM resolved JOIN tot USING (from_account)""")
def evidence_narrative(spark, sf):
    return evidence.narrate(flagged_records(spark, sf)).select(
        "entity_id", "explanation", "recommendation")


@query("investigation_package", O.with_(*_ENTITIES) + """SELECT 'findings' AS part, count(*) AS entries FROM resolved
  UNION ALL SELECT 'sar_drafts', count(*) FROM resolved WHERE risk_label = 'high' AND escalation_action = 'report'
  UNION ALL SELECT 'citations', count(DISTINCT reg_ref) FROM resolved UNION ALL SELECT 'warnings', CAST(0 AS BIGINT)
  UNION ALL SELECT 'checksum', CAST(1 AS BIGINT)""")
def investigation_package(spark, sf):
    parts = evidence.package_findings(shared(flagged_records(spark, sf)), "INV-2024")
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("part"), F.count("*").alias("entries"))
        out = row if out is None else out.unionByName(row)
    return out


#: Numbers between token borders; the texts hold no other signs next to digits than these.
_NUMBERS_SQL = r"""list_transform(list_filter(list_transform(string_split_regex(t, '[^\w$,.\-]+'),
  lambda x: regexp_extract(x, '^(\$?-?[0-9][0-9,]*(?:\.[0-9]+)?)[.,\-]*$', 1)), lambda x: x <> ''),
  lambda x: CAST(replace(replace(x, '$', ''), ',', '') AS DOUBLE))"""


@query("numeric_grounding_audit", O.with_(*_ENTITIES) + f""", own AS (SELECT from_account AS entity_id,
  [risk_score, txn_count::DOUBLE, total_amount, distinct_counterparties::DOUBLE] AS allowed, 'Entity ' || from_account
  || ' received a composite risk score of ' || format('{{:.4f}}', risk_score) || ' from the detectors that ran.' AS explanation,
  'the observed composite risk score is ' || format('{{:.4f}}', risk_score) || '.' AS sar_draft,
  'Observed ' || format('{{:,}}', txn_count) || ' transactions totalling $' || format('{{:,.2f}}', total_amount) || '.' AS activity,
  'Observed ' || format('{{:,}}', txn_count + 1) || ' transactions totalling $' || format('{{:,.2f}}', total_amount * 1.01) || '.' AS altered
  FROM resolved JOIN tot USING (from_account)),
parts AS (SELECT entity_id, allowed, 'explanation' AS part, explanation AS t FROM own UNION ALL
  SELECT entity_id, allowed, 'sar_draft', sar_draft FROM own UNION ALL SELECT entity_id, allowed, 'activity', activity FROM own
  UNION ALL SELECT entity_id, allowed, 'altered', altered FROM own),
counted AS (SELECT entity_id, part, len(n) AS number_count, len(list_filter(n, lambda x: len(list_filter(allowed,
  lambda v: abs(x - v) <= greatest(0.001, abs(v) * 0.0001))) = 0)) AS unknown_count
  FROM (SELECT *, {_NUMBERS_SQL} AS n FROM parts) q)
SELECT entity_id, part, CAST(number_count AS INTEGER) AS number_count, CAST(unknown_count AS INTEGER) AS unknown_count,
  unknown_count = 0 AS grounded FROM counted""")
def numeric_grounding_audit(spark, sf):
    """Written texts against the numbers of their records; the altered ones must fail."""
    found = shared(flagged_records(spark, sf))
    told = evidence.narrate(found).select("entity_id", F.element_at("evidence_points", 1).alias("activity"))
    altered = F.concat(F.lit("Observed "), F.format_number(F.col("txn_count") + 1, 0), F.lit(" transactions totalling $"),
                       F.format_number(F.col("total_amount") * 1.01, 2), F.lit("."))
    values = F.array("risk_score", F.col("txn_count").cast("double"), "total_amount",
                     F.col("distinct_counterparties").cast("double"))
    return evidence.audit_numbers(found.join(told, "entity_id").withColumn("altered", altered), "entity_id",
                                  ["explanation", "sar_draft", "activity", "altered"], values)


# ---- model ---------------------------------------------------------------------------

def model_rows(spark: SparkSession, sf: str) -> DataFrame:
    return shared(features.features_for(views.txn(spark, sf), [], with_model_features=True,
                                        row_key=KEY))


@query("forest_train_nodes")
def forest_train_nodes(spark, sf):
    base = model_rows(spark, sf).where(F.col("is_laundering") == 0)
    return forest.train_nodes(base, row_key=KEY)


@query("forest_scores")
def forest_scores(spark, sf):
    rows = model_rows(spark, sf)
    fitted = forest.fit_forest(rows.where(F.col("is_laundering") == 0), row_key=KEY)
    return forest.score_forest(rows, fitted).select("event_id", "ml_score", "anomaly_label")


# ---- investigations ------------------------------------------------------------------

_STRUCT = [views.TXN_CTE, O.features(), O.flags(["structuring", "high_risk_country"], "feat"),
           O.BOUNDS, O.statistics("ruled"), O.risk("stated"), O.best()]


@query("investigate_structuring", O.with_(*_STRUCT) + """SELECT from_account AS entity_id, round(risk_score, 6) AS risk_score,
  risk_label, escalation_action, array_to_string(rule_flags, ',') AS rule_flags FROM best
  ORDER BY risk_score DESC, event_id LIMIT 20""")
def investigate_structuring(spark, sf):
    t = views.txn(spark, sf)
    spec = InvestigationSpec("pattern_search", "structuring", row_key=KEY, iqr=txn_bounds(t))
    return investigate(t, spec)["entities"].select(
        "entity_id", r("risk_score"), "risk_label", "escalation_action", text_list("rule_flags"))


@query("investigate_entity", O.with_(views.TXN_CTE, "mine AS (SELECT * FROM txn WHERE from_account = 'A7' OR to_account = 'A7')",
                                     O.features("mine"), O.flags(O.ALL_RULES, "feat"), O.BOUNDS,
                                     O.statistics("ruled"), O.risk("stated"))
       + """SELECT event_id, array_to_string(rule_flags, ',') AS rule_flags, round(risk_score, 6) AS risk_score,
  risk_label, escalation_action FROM scored""")
def investigate_entity(spark, sf):
    t = views.txn(spark, sf)
    spec = InvestigationSpec("entity_lookup", row_key=KEY, iqr=txn_bounds(t),
                             filters=filters.TransactionFilter(entity_id="A7"))
    return score_transactions(t, spec).select(
        "event_id", text_list("rule_flags"), r("risk_score"), "risk_label", "escalation_action")


@query("investigate_broad", O.with_(views.TXN_CTE, O.features(), O.BOUNDS, O.statistics("feat"),
                                    O.risk("stated", rules_ran=False), O.best()) + """SELECT from_account AS entity_id,
  event_id, round(risk_score, 6) AS risk_score, risk_label, escalation_action FROM best""")
def investigate_broad(spark, sf):
    t = views.txn(spark, sf)
    spec = InvestigationSpec("broad_eda", row_key=KEY, iqr=txn_bounds(t))
    return evidence.best_rows(score_transactions(t, spec), KEY).select(
        F.col("from_account").alias("entity_id"), "event_id", r("risk_score"), "risk_label",
        "escalation_action")
