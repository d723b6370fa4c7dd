import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    home = tmp_path_factory.mktemp("spark")
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false",
        "spark.sql.warehouse.dir": str(home / "warehouse"),
        "spark.checkpoint.dir": str(home / "checkpoints")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


LEDGER_COLUMNS = ("timestamp string, from_account string, to_account string, amount_paid double, "
                  "payment_format string, from_country string, to_country string")


@pytest.fixture(scope="session")
def sample(spark):
    """Three near-threshold wires of A, then three senders into H."""
    rows = [("2022-09-01 09:00:00", "A", "X", 8500.0, "Wire", "UK", "UK"),
            ("2022-09-01 09:20:00", "A", "Y", 9000.0, "Wire", "UK", "UK"),
            ("2022-09-01 09:40:00", "A", "Z", 9500.0, "Wire", "UK", "UK"),
            ("2022-09-01 10:00:00", "B", "H", 4000.0, "ACH", "UK", "UK"),
            ("2022-09-01 10:20:00", "C", "H", 4000.0, "ACH", "UK", "UK"),
            ("2022-09-01 11:00:00", "D", "H", 4000.0, "ACH", "NIGERIA", "UK")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "txn_id int, " + LEDGER_COLUMNS)
    return df.withColumn("timestamp", df.timestamp.cast("timestamp"))


@pytest.fixture(scope="session")
def ledger9(spark):
    rows = [("2022-09-01 09:00:00", "A", "X", 9000.0, "Wire", "UK", "UK"),
            ("2022-09-02 09:00:00", "A", "Y", 9100.0, "Wire", "UK", "UK"),
            ("2022-09-03 09:00:00", "A", "W", 9200.0, "Wire", "UK", "UK"),
            ("2022-09-01 10:00:00", "B", "Z", 4000.0, "ACH", "UK", "UK"),
            ("2022-09-01 11:00:00", "C", "Z", 4000.0, "ACH", "UK", "UK"),
            ("2022-09-01 12:00:00", "D", "Z", 4000.0, "ACH", "UK", "UK"),
            ("2022-09-05 08:00:00", "P", "CASHER", 5000.0, "Wire", "UK", "UK"),
            ("2022-09-05 09:00:00", "CASHER", "Q", 4900.0, "Cash Withdrawal", "UK", "UK"),
            ("2022-09-06 09:00:00", "RISKY", "Q2", 100.0, "Wire", "Turkey", "UK")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "txn_id int, " + LEDGER_COLUMNS)
    return df.withColumn("timestamp", df.timestamp.cast("timestamp"))


def by_id(df, key="txn_id"):
    return {row[key]: row for row in df.collect()}
