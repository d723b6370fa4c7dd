import random
from datetime import datetime, timedelta

import pytest
from conftest import LEDGER_COLUMNS, by_id

from tidemark.operators import features

HOURS = timedelta(hours=1)


def test_sample_counts(sample):
    rows = by_id(features.features_for(sample, None, row_key="txn_id"))
    assert rows[2].near_threshold_count == 3
    assert rows[5].fan_in_count == 3
    assert rows[2].velocity_1hr == 3
    assert rows[5].cross_border_flag == 1


def test_ledger_values(ledger9):
    rows = by_id(features.add_features(ledger9, features.DERIVED, row_key="txn_id"))
    r = rows[2]
    assert (r.txn_count_7d, r.near_threshold_count, r.rolling_sum_7d) == (3, 3, 27_300.0)
    assert r.fan_out_count == 3
    assert (rows[5].fan_in_count, rows[5].fan_in_sum_48h) == (3, 12_000.0)
    assert rows[7].recent_inflow_24h >= 5_000
    assert rows[8].cross_border_flag == 1
    assert rows[0].amount_deviation == 0.0
    assert rows[1].amount_deviation == pytest.approx(100 / 9000)


def expected(rows):
    """Straight definition of every feature, row against row."""
    out = {}
    for i, r in enumerate(rows):
        key, ts, src, dst, amt = r[0], r[1], r[2], r[3], r[4]

        def within(h, span):
            return ts is not None and h[1] is not None and ts - span <= h[1] <= ts

        week = [h for h in rows if h[2] == src and (
            within(h, 168 * HOURS) or (ts is None and h[1] is None))]
        hour = [h for h in rows if h[2] == src and (
            within(h, HOURS) or (ts is None and h[1] is None))]
        into = [h for h in rows if h[3] == dst and (
            within(h, 48 * HOURS) or (ts is None and h[1] is None))]
        far = datetime.max
        before = [h[4] or 0.0 for h in rows if h[2] == src
                  and (h[1] or far, h[0]) < (ts or far, key)]
        mean = sum(before) / len(before) if before else None
        out[key] = dict(
            txn_count_7d=len(week), rolling_sum_7d=sum(h[4] or 0 for h in week),
            near_threshold_count=sum(8000 <= (h[4] or 0) < 10000 for h in week),
            velocity_1hr=len(hour), fan_in_sum_48h=sum(h[4] or 0 for h in into),
            fan_in_count=len({h[2] for h in rows if h[3] == dst and within(h, 48 * HOURS)}),
            fan_out_count=len({h[3] for h in rows if h[2] == src and within(h, 48 * HOURS)}),
            recent_inflow_24h=sum(h[4] or 0 for h in rows
                                  if h[3] == src and within(h, 24 * HOURS)),
            amount_deviation=abs((amt or 0) - mean) / abs(mean) if mean else 0.0)
    return out


def random_rows(seed, n=220):
    """Ties, exact span distances, a hot account, missing times and amounts."""
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        step = rng.choice([timedelta(hours=rng.randrange(0, 400)),
                           timedelta(minutes=rng.randrange(0, 24_000)),
                           timedelta(days=rng.choice([0, 1, 2, 7, 9]))])
        ts = None if rng.random() < 0.04 else start + step
        src = "HOT" if rng.random() < 0.35 else f"a{rng.randrange(6)}"
        dst = "HOT" if rng.random() < 0.3 else f"a{rng.randrange(6)}"
        amt = None if rng.random() < 0.03 else float(rng.choice([10, 8000, 9000, 9999.5, 12000]))
        rows.append((i, ts, src, dst, amt))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_features_equal_their_definition(spark, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, "txn_id int, timestamp timestamp, from_account string, "
                                     "to_account string, amount_paid double")
    got = by_id(features.add_features(df, features.DERIVED, row_key="txn_id"))
    for key, want in expected(rows).items():
        for name, value in want.items():
            assert got[key][name] == pytest.approx(value, abs=1e-6), (key, name)


def test_empty_input_keeps_typed_columns(spark):
    df = spark.createDataFrame([], "txn_id int, " + LEDGER_COLUMNS)
    out = features.features_for(df, None, row_key="txn_id")
    assert set(features.DERIVED) <= set(out.columns)
    assert dict(out.dtypes)["txn_count_7d"] == "bigint"
    assert dict(out.dtypes)["rolling_sum_7d"] == "double"
    assert out.count() == 0


def test_family_selection():
    assert features.selected_families(["structuring"]) == ["structuring_features"]
    assert features.selected_families(["smurfing"]) == ["structuring_features", "velocity_features"]
    assert features.selected_families(["single_large"]) == []
    assert features.selected_families(["gather_scatter"]) == ["behavioral_features"]
    assert len(features.selected_families(None)) == 6
    assert "behavioral_features" in features.selected_families(
        ["structuring"], with_model_features=True)


def test_bad_requests(sample):
    with pytest.raises(ValueError, match="unknown feature families"):
        features.add_families(sample, ["nope"])
    with pytest.raises(ValueError, match="amount_paid"):
        features.features_for(sample.drop("amount_paid"), None)


def test_amount_alias_and_stale_columns(sample):
    from pyspark.sql import functions as F
    df = sample.withColumnRenamed("amount_paid", "amount").withColumn("txn_count_7d", F.lit(99))
    rows = by_id(features.features_for(df, ["structuring"]))
    assert rows[2].near_threshold_count == 3 and rows[0].txn_count_7d == 1


@pytest.mark.parametrize("name", features.DERIVED)
def test_single_features_equal_all(spark, name):
    df = spark.createDataFrame(random_rows(3), "txn_id int, timestamp timestamp, from_account string, "
                                               "to_account string, amount_paid double")
    one = by_id(features.add_features(df, [name], row_key="txn_id"))
    every = by_id(features.add_features(df, features.DERIVED, row_key="txn_id"))
    for key, row in every.items():
        assert one[key][name] == pytest.approx(row[name], abs=1e-6), (key, name)


def test_scores_read_features_once_and_share_exchanges(spark, tmp_path):
    """Account statistics come from the input, not from a second run of the features; points and pairs are shuffled once."""
    from datetime import datetime, timedelta
    from tidemark.plans import catalogue
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=7 * i), i % 5, "click", 10.0 + i, '{"k": %d}' % (i % 3)) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
         .write.parquet(str(tmp_path / "events.parquet"))
    df = catalogue.full_scored(spark, str(tmp_path)).select("event_id", "risk_score")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 3
    assert len(df.collect()) == 60
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ReusedExchange") >= 3


@pytest.mark.parametrize("name", ["every account cut", "busy accounts cut", "none cut"])
def test_accounts_of_few_rows_need_no_blocks(spark, name):
    """Same values whichever accounts are cut into blocks; whole ones ask for one exchange, not for several rows per point."""
    from tidemark.policy import FeaturePolicy
    policy = {"every account cut": FeaturePolicy(whole_rows=0), "busy accounts cut": FeaturePolicy(whole_rows=60, whole_share=1.0),
              "none cut": FeaturePolicy(whole_rows=10_000, whole_share=1.0)}[name]
    rows = random_rows(4)
    df = spark.createDataFrame(rows, "txn_id int, timestamp timestamp, from_account string, "
                                     "to_account string, amount_paid double")
    out = features.add_features(df, features.DERIVED, row_key="txn_id", policy=policy)
    got = by_id(out)
    for key, want in expected(rows).items():
        for feature, value in want.items():
            assert got[key][feature] == pytest.approx(value, abs=1e-6), (key, feature)
    if name == "none cut":
        assert "_tail_" not in out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_a_side_reads_only_its_own_ends(spark):
    """Rows are doubled only where a payer's incoming amounts are asked for; payers' rows are no work for the payees' side."""
    rows = random_rows(5, 120)
    df = spark.createDataFrame(rows, "txn_id int, timestamp timestamp, from_account string, "
                                     "to_account string, amount_paid double")

    def doubled(wanted):
        out = features.add_features(df, wanted, row_key="txn_id")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        return out, sum("Generate" in line and "_pays" in line and "true" in line for line in plan.splitlines())

    out, n = doubled(["txn_count_7d", "fan_in_sum_48h", "fan_in_count"])
    assert n == 0
    want = expected(rows)
    for row in out.collect():
        for name in ("txn_count_7d", "fan_in_sum_48h", "fan_in_count"):
            assert row[name] == pytest.approx(want[row.txn_id][name], abs=1e-6), (row.txn_id, name)
    assert doubled(["recent_inflow_24h", "fan_in_sum_48h"])[1] > 0
