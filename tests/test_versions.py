import pytest
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.sources import ingest, versions
from test_sources_and_streams import HEADER, ROWS, write_csv


def failing(spark):
    """Rows of which some are written before one raises an error."""
    return spark.range(0, 1000, 1, 8).select(F.when(F.col("id") == 990, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))


def test_readers_see_old_rows_until_a_version_is_whole(spark):
    assert versions.publish(spark.range(10), "pub") == 10
    before = spark.table("pub")
    first = versions.current_version(spark, "pub")
    for bad, error in ((failing(spark), Exception), (spark.range(0), ValueError)):
        with pytest.raises(error):
            versions.publish(bad, "pub")
        assert spark.table("pub").count() == 10 and versions.current_version(spark, "pub") == first
        assert versions.versions(spark, "pub") == [first]
    assert versions.publish(spark.range(25), "pub") == 25
    # who read before stays with what was there
    assert (before.count(), before.where("id > 3").count(), spark.table("pub").count()) == (10, 6, 25)
    assert versions.drop_versions(spark, "pub") == []
    versions.publish(spark.range(30), "pub")
    assert versions.drop_versions(spark, "pub", keep=1) == [first]
    assert len(versions.versions(spark, "pub")) == 2 and spark.table("pub").count() == 30
    with pytest.raises(ValueError):
        versions.drop_versions(spark, "pub", keep=-1)


def test_a_version_may_change_its_columns(spark):
    versions.publish(spark.range(3), "pub_columns")
    versions.publish(spark.range(3).select(F.lit("x").alias("name"), "id"), "pub_columns", partition_by="name")
    assert spark.table("pub_columns").columns == ["name", "id"]
    versions.append(spark.createDataFrame([(7, "y")], "id long, name string"), "pub_columns")
    assert sorted(map(tuple, spark.table("pub_columns").collect())) == [("x", 0), ("x", 1), ("x", 2), ("y", 7)]


def test_a_plain_table_becomes_the_first_version(spark):
    spark.range(4).write.saveAsTable("pub_plain")
    assert versions.current_version(spark, "pub_plain") is None
    versions.append(spark.range(1), "pub_plain")
    assert ingest.publish_table(spark.range(9), "pub_plain") == 5  # left alone
    assert ingest.publish_table(spark.range(9), "pub_plain", force=True) == 9
    old, new = versions.versions(spark, "pub_plain")
    assert (spark.table(old).count(), new) == (5, versions.current_version(spark, "pub_plain"))


def test_transactions_are_partitioned_by_day(spark, tmp_path):
    path = write_csv(tmp_path / "t.csv", HEADER, ROWS)
    assert ingest.ingest_transactions(spark, path, "pub_days") == 3
    df = spark.table("pub_days")
    assert df.columns == S.TRANSACTION_COLUMNS and df.where("txn_date is null").count() == 1
    day = df.where("txn_date = date'2022-09-01'")
    assert day.count() == 1
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(txn_date" in plan
    ingest.append_rows(day, "pub_days")
    assert spark.table("pub_days").where("txn_date = date'2022-09-01'").count() == 2
