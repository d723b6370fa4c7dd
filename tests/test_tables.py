from datetime import date, datetime, timedelta

import numpy as np
import pytest
from conftest import by_id
from pyspark.sql import functions as F

from tidemark.operators import aggregate, customers, drift, filters, profile


@pytest.fixture(scope="module")
def groups_df(spark):
    t = datetime(2024, 1, 1)
    rows = [("A", "X", 9000.0, t), ("A", "Y", 9500.0, t + timedelta(days=1)),
            ("A", "X", 12000.0, t + timedelta(days=2)), ("B", "Z", 1000.0, t + timedelta(days=3)),
            ("B", "Z", 2000.0, t + timedelta(days=4))]
    return spark.createDataFrame(rows, "from_account string, to_account string, amount_paid double, timestamp timestamp")


def test_threshold_groups(groups_df):
    rows = aggregate.top_groups(aggregate.threshold_groups(
        groups_df, min_count=2, max_amount=10_000), order_by="total_amount").collect()
    assert [r.from_account for r in rows] == ["A", "B"]
    assert (rows[0].txn_count, rows[0].total_amount, rows[0].distinct_counterparties) == (2, 18_500.0, 2)
    assert aggregate.threshold_groups(groups_df, min_count=10).count() == 0
    recent = aggregate.threshold_groups(groups_df, window_days=1).collect()
    assert [(r.from_account, r.txn_count) for r in recent] == [("B", 2)]
    # The window ends at the newest row that passes the amount filter.
    big = aggregate.threshold_groups(groups_df, window_days=1, min_amount=9_000).collect()
    assert [(r.from_account, r.txn_count) for r in big] == [("A", 2)]
    with pytest.raises(ValueError):
        aggregate.threshold_groups(groups_df, min_count=0)
    with pytest.raises(ValueError):
        aggregate.top_groups(groups_df, order_by="nope")


@pytest.fixture(scope="module")
def loader(spark):
    start = datetime(2022, 9, 1)
    rows = []
    for i in range(100):
        ts = start + timedelta(days=i % 30, hours=i % 24)
        rows.append((ts, f"B{i % 5}", f"ACC{i % 10}", f"B{(i + 1) % 5}", f"ACC{(i + 3) % 10}",
                     100.0 + i * 10, "US Dollar", 100.0 + i * 10, "Euro" if i % 4 == 0 else "US Dollar",
                     "Wire" if i % 2 else "ACH", int(i < 5), ts.date(), 100.0 + i * 10))
    from tidemark.schema import TRANSACTION_SCHEMA
    return spark.createDataFrame(rows, TRANSACTION_SCHEMA)


def test_filters(loader):
    def n(**kw):
        return filters.load_transactions(loader, filters.TransactionFilter(**kw)).count()

    assert n() == 100 and n(is_laundering=1) == 5 and n(limit=10) == 10
    first = loader.orderBy(*filters.FIRST_ROWS).limit(10).collect()
    assert filters.load_transactions(loader.repartition(7), filters.TransactionFilter(limit=10)).collect() == first
    assert n(start=date(2022, 9, 1), end=date(2022, 9, 1)) == 4
    assert n(entity_id="ACC1") == 20 and n(from_bank="B2") == 20 and n(to_bank="B2") == 20
    assert n(payment_format="Wire") == 50 and n(currency="Euro") == 25
    assert n(min_amount=1_000) == 10 and n(max_amount=190) == 10


@pytest.mark.parametrize("bad", [
    dict(start=date(2024, 1, 2), end=date(2024, 1, 1)), dict(min_amount=-1),
    dict(min_amount=5, max_amount=1), dict(is_laundering=2), dict(limit=0)])
def test_bad_filters(bad):
    with pytest.raises(ValueError):
        filters.TransactionFilter(**bad)


def test_filters_reach_the_scan(spark, loader, tmp_path):
    path = str(tmp_path / "t")
    loader.write.partitionBy("txn_date").parquet(path)
    df = filters.load_transactions(spark.read.parquet(path), filters.TransactionFilter(
        start=date(2022, 9, 3), end=date(2022, 9, 4), min_amount=500)).select("from_account")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(txn_date" in plan
    assert "GreaterThanOrEqual(amount_paid,500.0)" in plan
    assert "ReadSchema: struct<from_account:string,amount_paid:double>" in plan


@pytest.fixture(scope="module")
def small_bank(spark):
    t = datetime(2024, 5, 1, 10)
    return spark.createDataFrame(
        [(t, "B1", "ACC-001", "B2", "ACC-002", 9400.0, "USD", 9500.0, "USD", "Wire", 1),
         (t + timedelta(hours=1), "B3", "ACC-003", "B1", "ACC-001", 2000.0, "EUR", 2000.0, "EUR", "ACH", 0)],
        "timestamp timestamp, from_bank string, from_account string, to_bank string, to_account string, "
        "amount_received double, receiving_currency string, amount_paid double, paying_currency string, "
        "payment_format string, is_laundering int")


def test_customers(spark, small_bank):
    alerts = spark.createDataFrame([("ACC-001", .82, "new")], "entity_id string, risk_score double, status string")
    people = customers.activity(small_bank, alerts)
    assert [r.account_id for r in customers.customer_page(small_bank, alerts, band="high").collect()] == ["ACC-001"]
    row = by_id(people, "account_id")["ACC-001"]
    assert (row.outbound_count, row.inbound_count, row.total_sent, row.total_received) == (1, 1, 9500.0, 2000.0)
    assert row.distinct_counterparties == 2 and row.open_alert_count == 1 and row.primary_bank == "B1"
    assert customers.customer_page(small_bank, band="unscored").count() == 3
    page = customers.customer_page(small_bank, alerts)
    assert [r.account_id for r in page.collect()][0] == "ACC-001"
    assert sorted(map(str, page.select(people.columns).collect())) == sorted(map(str, people.collect()))
    assert [r.account_id for r in customers.customer_page(small_bank, alerts, offset=2).collect()] == ["ACC-003"]
    assert [r.account_id for r in customers.activity(small_bank, search="c-002").collect()] == ["ACC-002"]
    with pytest.raises(ValueError):
        customers.customer_page(small_bank, band="odd")


def test_customer_profile(small_bank):
    parts = customers.customer_profile(small_bank, "ACC-001")
    assert {r.payment_format: r.txn_count for r in parts["payment_formats"].collect()} == {"Wire": 1, "ACH": 1}
    assert [r.currency for r in parts["currencies"].collect()] == ["EUR", "USD"]
    assert parts["known_positives"].first().known_positives == 1
    assert {r.counterparty for r in parts["counterparties"].collect()} == {"ACC-002", "ACC-003"}
    assert "alerts" not in parts


def test_profile_alerts_and_totals(spark, small_bank):
    alerts = spark.createDataFrame(
        [(f"AL{i}", "ACC-001" if i < 4 else "ACC-002", .5, "new", datetime(2024, 5, 1 + i % 3)) for i in range(6)],
        "alert_id string, entity_id string, risk_score double, status string, created_at timestamp")
    parts = customers.customer_profile(small_bank, "ACC-001", alerts, newest=3)
    assert [a.alert_id for a in parts["alerts"].collect()] == ["AL2", "AL1", "AL0"]
    assert customers.customer_profile(small_bank, "nobody", alerts)["alerts"].isEmpty()
    rows = customers.customer_page(small_bank, alerts, limit=1, offset=1, total="of").collect()
    assert len(rows) == 1 and rows[0].of == customers.customer_page(small_bank, alerts).count()
    told, seen = spark.sparkContext.accumulator(0), F.udf(lambda risk: told.add(1) or risk, "double")
    watched = alerts.withColumn("risk_score", seen("risk_score"))
    rows = customers.customer_page(small_bank, watched, band="medium", limit=1, total="of").collect()
    assert [r.of for r in rows] == [2] and told.value == 6  # the alerts are read once
    found = filters.evidence_page(small_bank, filters.EvidenceFilter(account_id="ACC-001"), limit=1, total="of")
    assert [r.of for r in found.collect()] == [2]
    with pytest.raises(ValueError, match="timestamp"):
        filters.evidence_page(small_bank, filters.EvidenceFilter(), total="timestamp")


def test_evidence_browser(small_bank):
    def ids(**kw):
        return [r.transaction_id for r in filters.evidence_page(small_bank, filters.EvidenceFilter(**kw)).collect()]

    both = ids(account_id="ACC-001")
    assert len(both) == 2 and all(i.startswith("TXN-") and len(i) == 16 for i in both)
    assert ids(account_id="ACC-001", direction="in") == both[:1]
    assert ids(account_id="ACC-001", direction="out") == both[1:]
    assert ids(payment_format="wire") == both[1:] and ids(positives_only=True) == both[1:]
    assert ids(start=date(2024, 5, 2)) == [] and ids(min_amount=3000) == both[1:]
    with pytest.raises(ValueError):
        filters.EvidenceFilter(direction="up")
    with pytest.raises(ValueError):
        filters.evidence_page(small_bank, filters.EvidenceFilter(), limit=101)


def test_formats_fold_case(spark):
    df = spark.createDataFrame([("Wire",), ("WIRE",), (" ach ",), ("",), (None,)], "payment_format string")
    assert [r.payment_format for r in filters.payment_formats(df).collect()] == ["ach", "WIRE"]


def test_profile(loader):
    row = profile.eda_summary(loader).first()
    assert row.row_count == 100 and row.median_amount == 595.0 and row.positive_rate_pct == 5.0
    bins = profile.amount_histogram(loader).collect()
    assert len(bins) == 30 and sum(r.row_count for r in bins) + bins[0].overflow == 100
    assert sum(r.row_count for r in profile.weekday_hour_grid(loader).collect()) == 100
    assert profile.weekday_hour_grid(loader).count() == 168
    assert sum(r.row_count for r in profile.daily_counts(loader).collect()) == 100
    box = profile.customer_volume(loader).first()
    assert (box.accounts, box.minimum, box.maximum) == (10, 10, 10)
    labels = {r.label: r.row_count for r in profile.label_distribution(loader).collect()}
    assert labels == {"Labelled positive": 5, "Not labelled": 95}
    assert profile.label_distribution(loader.select("timestamp")).count() == 0
    levels = profile.risk_level_counts(loader.limit(3).withColumn("risk_label", F.lit("HIGH")))
    assert [(r.label, r.row_count) for r in levels.collect()] == [("low", 0), ("medium", 0), ("high", 3)]


def test_histogram_of_equal_amounts_and_blank_categories(spark):
    df = spark.createDataFrame([(5.0, "x"), (5.0, ""), (5.0, None)], "amount_paid double, c string")
    bins = profile.amount_histogram(df).orderBy("bin").collect()
    assert bins[0].row_count == 3 and bins[-1].high == pytest.approx(6.0)
    assert [(r.category, r.row_count) for r in profile.category_top(df, "c").collect()] == [
        ("Unknown", 2), ("x", 1)]
    missing = {r.column_name: r.missing for r in profile.missing_counts(df).collect()}
    assert missing == {"c": 1, "amount_paid": 0}


def psi(e, a, buckets=10):
    edges = np.unique(np.quantile(e, np.linspace(0, 1, buckets + 1)))
    if len(edges) < 2:
        return 0.0
    edges[0], edges[-1] = -np.inf, np.inf
    pe = np.maximum(np.histogram(e, edges)[0] / len(e), 1e-6)
    pa = np.maximum(np.histogram(a, edges)[0] / len(a), 1e-6)
    return float(np.sum((pa - pe) * np.log(pa / pe)))


def column(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


@pytest.mark.parametrize("e,a", [
    (np.arange(100), np.arange(100)), (np.linspace(0, 1, 50), np.linspace(5, 6, 50)),
    (np.array([1.0] * 20), np.array([1.0, 2.0])),
    (np.random.default_rng(1).poisson(2, 400), np.random.default_rng(2).poisson(3, 300))])
def test_psi(spark, e, a):
    row = drift.drift_report(column(spark, e), column(spark, a), ["x"]).first()
    assert row.psi == pytest.approx(psi(e.astype(float), a.astype(float)), abs=2e-6)
    assert row.status == ("drift" if row.psi > .2 else "caution" if row.psi >= .1 else "stable")


def test_drift_of_nothing_and_monitor(spark):
    empty = column(spark, [])
    assert drift.drift_report(column(spark, [1, 2]), empty, ["x"]).first().psi == 0.0
    with pytest.raises(ValueError):
        drift.monitor_drift(column(spark, [1, 2]), column(spark, [1]))
    assert drift.monitor_drift(column(spark, [1, 2]), spark.range(3)) is None
    report = drift.monitor_drift(column(spark, range(20)), column(spark, range(10, 30)))
    assert drift.overall_drift(report, inclusive=True).first().status == "drift"
    with pytest.raises(ValueError):
        drift.inner_edges(column(spark, [1, 2]), ["x"], 1)


def test_model_drift_says_what_it_did_not_evaluate(spark):
    one = spark.createDataFrame([(float(i), 1.0) for i in range(30)], "x double, y double")
    row, = drift.model_drift("m", one, spark.range(3)).collect()
    assert (row.model_id, row.feature, row.status, row.overall_status) == ("m", None, "not_evaluated", "not_evaluated")
    moved = one.withColumn("x", one.x + 100)
    rows = {r.feature: r for r in drift.model_drift("m", one, moved).collect()}
    assert rows["x"].status == "drift" and rows["y"].status == "stable" and rows["x"].baseline_count == 30
    assert all(r.overall_status == "drift" and r.overall_psi == rows["x"].psi for r in rows.values())
    with pytest.raises(ValueError):
        drift.model_drift("m", one, one.limit(1))
