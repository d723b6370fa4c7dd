import numpy as np
import pytest

from tidemark.operators import forest
from tidemark.policy import MODEL_FEATURES

COLUMNS = "txn_id long, " + ", ".join(f"{c} double" for c in MODEL_FEATURES)


def rows(spark, values, start=0):
    return spark.createDataFrame([(start + i, *map(float, v)) for i, v in enumerate(values)], COLUMNS)


@pytest.fixture(scope="module")
def normal(spark):
    return rows(spark, np.random.default_rng(0).normal(5, 1, (400, 6))).persist()


@pytest.fixture(scope="module")
def fitted(normal):
    return forest.fit_forest(normal, trees=60, row_key="txn_id", contamination=0.01)


def test_outlier_scores_higher(spark, fitted):
    got = forest.score_forest(rows(spark, [[5] * 6, [60] * 6]), fitted).orderBy("txn_id").collect()
    assert all(0 <= r.ml_score <= 1 and r.iso_score == r.ml_score for r in got)
    assert got[1].ml_score > got[0].ml_score
    assert (got[0].anomaly_label, got[1].anomaly_label) == (0, 1)


def test_share_of_flagged_training_rows(normal, fitted):
    flagged = forest.score_forest(normal, fitted).where("anomaly_label = 1").count()
    assert 1 <= flagged <= 8


def test_same_seed_same_trees(normal):
    one = forest.train_nodes(normal, trees=5, row_key="txn_id").orderBy("tree", "node").collect()
    two = forest.train_nodes(normal.repartition(7), trees=5, row_key="txn_id").orderBy("tree", "node")
    assert {(r.tree, r.node): r.feature for r in one}.keys() and len(one) == two.count()
    assert {r.tree for r in one} == set(range(5))


def test_samples_do_not_overlap_while_rows_last(spark):
    many = rows(spark, np.random.default_rng(1).normal(size=(3000, 6)))
    nodes = forest.train_nodes(many, trees=10, sample=256, row_key="txn_id")
    assert nodes.select("tree").distinct().count() == 10


def test_degenerate_training(spark):
    same = rows(spark, [[1] * 6] * 10)
    f = forest.fit_forest(same, trees=3, row_key="txn_id")
    assert forest.score_forest(same, f).first().ml_score == 0.0
    with pytest.raises(ValueError):
        forest.fit_forest(rows(spark, [[1] * 6]), trees=3)
    with pytest.raises(ValueError):
        forest.fit_forest(same, contamination=0)


def test_missing_and_infinite_features_count_as_zero(spark, fitted):
    odd = spark.createDataFrame([(1, float("nan"), float("inf"), None)],
                                "txn_id long, txn_count_7d double, rolling_sum_7d double, velocity_1hr double")
    zero = rows(spark, [[0] * 6])
    a, b = (forest.score_forest(d, fitted).first().ml_score for d in (odd, zero))
    assert a == b


def test_baseline_is_scored_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(forest, "stored", lambda df: kept.append(df.columns) or df)
    rows = spark.range(300).selectExpr("id", *(f"cast(id % {n + 2} as double) as {c}" for n, c in enumerate(forest.MODEL_FEATURES)))
    forest.fit_forest(rows, trees=3, sample=32, row_key="id")
    assert kept == [["_raw"]]
