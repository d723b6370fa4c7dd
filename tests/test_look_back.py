import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features
from tidemark.streaming import look_back as lb

COLUMNS = "txn_id long, timestamp timestamp, from_account string, to_account string, amount_paid double, batch string"
START = datetime(2024, 3, 1)


def made(seed, days, per_day):
    """Rows in order of arrival; some tied, some up to 20 hours late, a third of all from one account."""
    rng, rows = random.Random(seed), []
    for day in range(days):
        for _ in range(per_day):
            at = START + timedelta(days=day, hours=rng.randrange(24), minutes=rng.choice([0, 0, 30]))
            if rng.random() < .2:
                at -= timedelta(hours=rng.randrange(20))
            src = "hub" if rng.random() < .34 else rng.choice("abcde")
            rows.append((len(rows), at, src, rng.choice("abcdef"), rng.choice([9000.0, 120.5, None, 8500.0]), "user's"))
    return rows


def values(df):
    return {r.txn_id: [round(float(r[f]), 6) for f in lb.EXACT] for r in df.collect()}


def feed(spark, box, target, check, rows, **options):
    if rows is not None:
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(box)
    stream = spark.readStream.schema(COLUMNS).parquet(box)
    lb.look_back(stream, target, check, row_key="txn_id", **options).awaitTermination()


def test_stream_equals_batch(spark, tmp_path):
    box, target, check = (str(tmp_path / n) for n in ("box", "out", "check"))
    rows = made(5, 14, 12)
    for part in (rows[:80], rows[80:90], rows[90:]):
        feed(spark, box, target, check, part, lateness=timedelta(days=5))
    whole = features.add_features(spark.createDataFrame(rows, COLUMNS), lb.EXACT, row_key="txn_id")
    got = lb.current(spark, target, "txn_id")
    assert got.columns == ["txn_id", "timestamp", "from_account", "to_account", "amount_paid", *lb.EXACT]
    assert values(got) == values(whole)
    assert spark.read.parquet(target + "_unplaced").isEmpty()
    again = spark.read.parquet(target).groupBy("txn_id").count().where("count > 1")
    assert not again.isEmpty()
    feed(spark, box, target, check, None)
    assert values(lb.current(spark, target, "txn_id")) == values(whole)


def test_state_expires_and_late_rows_are_kept_apart(spark, tmp_path):
    box, target, check = (str(tmp_path / n) for n in ("box", "out", "check"))

    def row(i, day, src="a"):
        return (i, None if day is None else START + timedelta(days=day), src, "b", 9000.0, None)

    feed(spark, box, target, check, [row(0, 0), row(1, 1), row(2, None)])
    feed(spark, box, target, check, [row(3, 30), row(4, -1, None)])
    feed(spark, box, target, check, [row(5, 31), row(6, 28), row(7, 29.5)])
    late = spark.read.parquet(target + "_unplaced")
    assert {(r.txn_id, r.batch) for r in late.collect()} == {(2, 0), (4, 1), (6, 2)}
    assert {r.txn_id for r in spark.read.parquet(target + "_state/0").where("seen != 'late'").collect()} == {3, 5, 7}
    got = {r.txn_id: r.txn_count_7d for r in lb.current(spark, target, "txn_id").collect()}
    assert got == {0: 1, 1: 2, 3: 2, 5: 3, 7: 1}


def test_a_batch_run_again_changes_nothing(spark, tmp_path, monkeypatch):
    """The second batch fails after its state was written and is run again."""
    box, target, check = (str(tmp_path / n) for n in ("box", "out", "check"))
    rows = made(8, 6, 8)
    feed(spark, box, target, check, rows[:30], lateness=timedelta(days=9))
    real = lb.add_features

    def broken(*args, **kwargs):
        raise RuntimeError("lost")

    monkeypatch.setattr(lb, "add_features", broken)
    with pytest.raises(Exception, match="lost"):
        feed(spark, box, target, check, rows[30:], lateness=timedelta(days=9))
    monkeypatch.setattr(lb, "add_features", real)
    feed(spark, box, target, check, None, lateness=timedelta(days=9))
    whole = features.add_features(spark.createDataFrame(rows, COLUMNS), lb.EXACT, row_key="txn_id")
    assert values(lb.current(spark, target, "txn_id")) == values(whole)
    assert spark.read.parquet(target + "_state/1").where(F.col("seen") != "late").count() == len(rows)


def test_what_cannot_be_asked(spark, tmp_path):
    stream = spark.readStream.schema(COLUMNS).parquet(str(tmp_path))
    for options in ({"wanted": ("amount_deviation",)}, {"wanted": ()}):
        with pytest.raises(ValueError, match="look-back"):
            lb.look_back(stream, "t", "c", row_key="txn_id", **options)
    with pytest.raises(ValueError, match="row key"):
        lb.look_back(stream, "t", "c", row_key="timestamp")
