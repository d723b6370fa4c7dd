import pytest
from conftest import by_id
from pyspark.sql import functions as F

from tidemark.operators import features, risk, rules, stats
from tidemark.policy import EntityRiskPolicy


def featured(df):
    return features.features_for(df, None, row_key="txn_id")


def test_structuring_score_counts_the_country_rule(sample):
    rows = by_id(rules.apply_rules(featured(sample), ["structuring"]))
    assert rows[2].rule_flags == ["structuring"] and rows[2].rule_score == 0.5


def test_smurfing_and_country(sample):
    flags = by_id(rules.apply_rules(featured(sample)))[5].rule_flags
    assert "smurfing" in flags and "high_risk_country" in flags
    assert flags == sorted(flags, key=["structuring", "smurfing", "rapid_cashout", "single_large",
                                       "deposit_send", "fan_in", "fan_out",
                                       "high_risk_country"].index)


def test_rapid_cashout(ledger9):
    assert "rapid_cashout" in by_id(rules.apply_rules(featured(ledger9)))[7].rule_flags


def test_rules_without_features_or_countries_are_neutral(spark):
    df = spark.createDataFrame([(1, "A", 12_000.0)], "txn_id int, from_account string, amount_paid double")
    row = rules.apply_rules(df).first()
    assert row.rule_flags == ["single_large"] and row.rule_score == pytest.approx(1 / 7)


def test_rule_selection():
    assert rules.selected_rules(["cash_withdrawal"], False) == ["rapid_cashout"]
    assert len(rules.selected_rules(None, False)) == 7
    assert rules.selected_rules(["cycle"], False) == []
    assert rules.selected_rules(["cycle"], True) == ["high_risk_country"]


def test_recall_looks_at_positives_only(ledger9):
    df = (ledger9.withColumn("is_laundering", F.lit(1))
                 .withColumn("laundering_type", F.lit("Structuring"))
                 .withColumnRenamed("amount_paid", "amount"))
    rows = {r.laundering_type: r for r in rules.rule_recall(df, "txn_id").collect()}
    assert len(rows) == 7
    assert (rows["Structuring"].total, rows["Structuring"].flagged) == (9, 1)
    assert rows["Structuring"].recall == 0.1111
    assert rows["Fan_In"].total == 0 and rows["Fan_In"].recall == 0.0


def amounts(spark, values):
    return spark.createDataFrame([(i, "A", float(v)) for i, v in enumerate(values)],
                                 "txn_id int, from_account string, amount_paid double")


def test_outlier_saturates(spark):
    rows = by_id(stats.add_statistics(amounts(spark, [0] * 19 + [100]), (-1e9, 1e9)))
    assert abs(rows[19].z_score) > 3 and rows[19].stat_score == 1.0


def test_ordinary_values_stay_below_one(spark):
    rows = stats.add_statistics(amounts(spark, [9, 10, 11]), (-1e9, 1e9)).collect()
    assert all(0 <= r.stat_score < 1 for r in rows)


def test_constant_account_and_bounds(spark):
    row = stats.add_statistics(amounts(spark, [101]), (0, 100)).first()
    assert row.z_score == 0.0 and row.iqr_flag and row.stat_score == 1.0


def test_bounds_need_values(spark):
    with pytest.raises(ValueError):
        stats.iqr_bounds(amounts(spark, []), "amount_paid")
    q1, q3, low, high = stats.iqr_bounds(amounts(spark, [1, 2, 3, 4]), "amount_paid")
    assert (q1, q3, low, high) == (1.75, 3.25, -0.5, 5.5)


def scores(spark, rows):
    return spark.createDataFrame(
        rows, "id int, rule_score double, stat_score double, ml_score double, from_country string")


def test_bands_and_boost(spark):
    df = spark.createDataFrame([(1, .34, "UK"), (2, .35, "UK"), (3, .69, "UK"), (4, .70, "UK"),
                                (5, .30, " nigeria ")], "id int, rule_score double, from_country string")
    rows = by_id(risk.score_risk(df), "id")
    assert [rows[i].risk_label for i in (1, 2, 3, 4)] == ["low", "medium", "medium", "high"]
    assert rows[5].risk_score == 0.4 and rows[5].country_risk_boost == 0.10


def test_only_detectors_that_ran_count(spark):
    df = scores(spark, [(1, .8, .5, .1, "UK")])
    assert risk.score_risk(df, ["rule_engine"]).first().risk_score == 0.8
    row = risk.score_risk(df, ["rule_engine", "statistical"]).first()
    assert row.risk_score == pytest.approx(.8 * .40 / .65 + .5 * .25 / .65)
    c = row.risk_contribution
    assert c.formula == "0.40/0.65*rule_score + 0.25/0.65*stat_score + country_boost"
    assert c.ml_score == 0.0 and c.active_detector_count == 2 and len(c) == 13
    none = risk.score_risk(df, []).first()
    assert none.risk_score == 0.0 and none.risk_contribution.formula == "no detectors + country_boost"


def test_escalation_boundaries(spark):
    df = spark.createDataFrame(
        [(1, .39, []), (2, .40, []), (3, .69, []), (4, .70, []), (5, .1, ["pep"]), (6, None, [])],
        "id int, risk_score double, rule_flags array<string>")
    got = {k: v.escalation_action for k, v in by_id(risk.recommend(df), "id").items()}
    assert got == {1: "monitor", 2: "flag_for_review", 3: "flag_for_review", 4: "report",
                   5: "report", 6: "monitor"}


SIGNAL = "entity_id string, detector string, score double, flags array<string>, high_risk_country boolean"


def test_signals_merge_and_decide(spark):
    rule = spark.createDataFrame([("C-1", "rule_engine", .8, ["structuring", "fan_in"], False),
                                  ("C-2", "rule_engine", .9, ["smurfing"], True)], SIGNAL)
    stat = spark.createDataFrame([("C-1", "statistical_engine", .5, ["fan_in"], False)], SIGNAL)
    merged = risk.merge_signals({"rule_engine": rule, "statistical_engine": stat})
    ordered = [r.entity_id for r in merged.orderBy(F.desc("strongest_score"), "entity_id").collect()]
    assert ordered == ["C-2", "C-1"]
    rows = by_id(risk.decide_entities(merged), "entity_id")
    assert rows["C-1"].flags == ["fan_in", "structuring"]
    assert rows["C-1"].risk_score == .7 and rows["C-1"].risk_label == "medium"
    assert rows["C-1"].rationale == ("Risk is medium (0.70) based on selected detector evidence: "
                                     "fan_in, structuring.")
    assert rows["C-2"].risk_score == .98 and rows["C-2"].escalation_action == "report"
    assert rows["C-2"].rationale.endswith("A 0.08 jurisdiction boost was applied.")


def test_mislabelled_signals_fail(spark):
    bad = spark.createDataFrame([("C-1", "other", .8, ["x"], False)], SIGNAL)
    with pytest.raises(Exception, match="returned a signal labelled other"):
        risk.merge_signals({"rule_engine": bad}).collect()


def test_policy_is_checked():
    with pytest.raises(ValueError):
        EntityRiskPolicy(medium=.8, high=.7)
    with pytest.raises(ValueError):
        EntityRiskPolicy(weights={})


def test_custom_scores_are_checked(spark):
    good = spark.createDataFrame([(0.0,), (1.0,)], "s double")
    assert risk.require_scores(good, "s").count() == 2
    for bad in (1.1, -0.1, float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="between 0 and 1"):
            risk.require_scores(spark.createDataFrame([(bad,)], "s double"), "s").collect()
