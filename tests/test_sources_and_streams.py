import csv
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.operators import workflow
from tidemark.sources import ingest, sinks, uploads
from tidemark.streaming import jobs

HEADER = ["Timestamp", "From Bank", "Account", "To Bank", "Account", "Amount Received",
          "Receiving Currency", "Amount Paid", "Payment Currency", "Payment Format", "Is Laundering"]
ROWS = [["2022/09/01 00:20", "010", "0001", "020", " 0002 ", "10.5", "US Dollar", "11", "Euro", "Wire", "1"],
        ["2022-09-02 10:00:05", "010", "0003", "", "0004", "x", "US Dollar", "", "Euro", "ACH", ""],
        ["never", "010", "0005", "020", "0006", "1", "", "2", "", "", "0"]]


def write_csv(path, header, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)
    return str(path)


def test_transaction_file(spark, tmp_path):
    raw = ingest.read_raw_csv(spark, write_csv(tmp_path / "t.csv", HEADER, ROWS), S.RAW_TRANSACTION_HEADERS)
    df = ingest.canonical_transactions(raw)
    assert df.schema.fieldNames() == S.TRANSACTION_COLUMNS
    a, b, c = sorted(df.collect(), key=lambda r: r.from_account)
    assert (a.timestamp, a.from_account, a.to_account) == (datetime(2022, 9, 1, 0, 20), "0001", "0002")
    assert (a.amount_paid, a.amount_usd, a.is_laundering, a.txn_date) == (11.0, 11.0, 1, date(2022, 9, 1))
    assert b.timestamp == datetime(2022, 9, 2, 10, 0, 5)
    assert (b.amount_received, b.amount_paid, b.is_laundering) == (None, None, 0)
    assert c.timestamp is None and c.payment_format == ""
    with pytest.raises(ValueError, match="Amount Paid"):
        ingest.canonical_transactions(raw.drop("Amount Paid"))


def test_repeated_headers_and_odd_numbers(spark, tmp_path):
    rows = [["2022/09/01 00:20", "1", "\t7 ", "2", "8", "nan", "USD", "inf", "USD", "Wire", "nan"]]
    raw = ingest.read_raw_csv(spark, write_csv(tmp_path / "r.csv", HEADER, rows))
    assert raw.columns == S.RAW_TRANSACTION_HEADERS
    assert uploads.inspect(raw).schema_name == "ibm_aml"
    row = ingest.canonical_transactions(raw).first()
    assert (row.from_account, row.amount_received, row.amount_paid, row.is_laundering) == (
        "7", None, float("inf"), 0)
    with pytest.raises(ValueError, match="no header"):
        ingest.read_raw_csv(spark, write_csv(tmp_path / "e.csv", [], []))


def test_knowledge_file_sample_and_publish(spark, tmp_path):
    rows = [["10:35:19", "2022-10-07", str(i), str(i + 1), "5.5", "UK pounds", "UK pounds", "UK", "UAE",
             "Cash", "1" if i < 3 else "0", "Smurfing" if i < 3 else "Normal_Group"] for i in range(40)]
    path = write_csv(tmp_path / "k.csv", S.RAW_KNOWLEDGE_HEADERS, rows)
    df = ingest.canonical_knowledge(ingest.read_raw_csv(spark, path))
    assert df.schema.fieldNames() == S.KNOWLEDGE_COLUMNS
    assert df.first().timestamp == datetime(2022, 10, 7, 10, 35, 19)
    picked = ingest.stratified_sample(df, k=10)
    assert picked.where("is_laundering = 1").count() == 3 and picked.count() == 13
    assert picked.exceptAll(ingest.stratified_sample(df.repartition(5), k=10)).count() == 0
    with pytest.raises(ValueError):
        ingest.stratified_sample(df, k=-1)
    rows = ingest.ingest_knowledge(spark, path, "calibration")
    assert rows == spark.table("calibration").count() == ingest.read_raw_csv(spark, path).count()
    assert ingest.ingest_knowledge(spark, path, "calibration", force=True) == rows
    with pytest.raises(ValueError):
        ingest.publish_table(df.limit(0), "calibration", force=True)
    assert spark.table("calibration").count() == 40
    ingest.append_rows(df.limit(2), "calibration")
    assert spark.table("calibration").count() == 42
    kyc = write_csv(tmp_path / "kyc.csv", ["id", "name"], [["007", "Bo"]])
    assert ingest.ingest_kyc(spark, kyc, "kyc") == 1 and spark.table("kyc").first().id == "007"


def generic(spark, n=100, **change):
    rows = [(f"2024-01-{1 + i % 28:02d} 10:00:00", f"S{i}", f"R{i}", str(10 + i), "", "wire", "1" if i == 0 else "0")
            for i in range(n)]
    df = spark.createDataFrame(rows, "Timestamp string, sender_id string, receiver_id string, amount string, "
                                     "currency string, payment_type string, is_laundering string")
    return df.withColumns(change)


def test_detect_layouts():
    name, m = uploads.detect_schema(["timestamp", "Sender_ID", "receiver_id", "amount", "currency"])
    assert name == "generic_transactions" and m["from_account"] == "Sender_ID" and m["amount_paid"] == "amount"
    assert uploads.detect_schema(S.RAW_TRANSACTION_HEADERS)[0] == "ibm_aml"
    assert uploads.detect_schema(S.RAW_KNOWLEDGE_HEADERS)[0] == "saml_d"
    assert uploads.detect_schema(["a", "b"]) == ("unmapped", {})


def test_inspect_and_strict_load(spark):
    raw = generic(spark)
    found = uploads.inspect(raw)
    assert found.schema_name == "generic_transactions" and found.warnings == [] and found.preview.count() == 5
    df = uploads.require_valid(uploads.canonicalise(raw, found.column_map))
    assert df.schema.fieldNames() == S.TRANSACTION_COLUMNS and df.count() == 100
    row = df.first()
    assert (row.paying_currency, row.receiving_currency, row.payment_format) == ("USD", "USD", "wire")
    assert row.amount_received == row.amount_paid
    bad = uploads.canonicalise(generic(spark, amount=F.when(F.col("sender_id") == "S3", "-1").otherwise("5"),
                                       receiver_id=F.when(F.col("sender_id") == "S4", " ").otherwise("R")),
                               found.column_map)
    with pytest.raises(ValueError, match="^2 rows"):
        uploads.require_valid(bad)
    good, quarantined = uploads.split_valid(bad)
    assert (good.count(), quarantined.count()) == (98, 2)
    warned = uploads.inspect(raw.drop("amount", "is_laundering")).warnings
    assert warned[0] == "Missing required mappings: amount_paid" and len(warned) == 2
    with pytest.raises(ValueError):
        uploads.canonicalise(raw, {"timestamp": "Timestamp"})


def test_profile_and_registry(spark):
    raw = generic(spark)
    df = uploads.require_valid(uploads.canonicalise(raw, uploads.detect_schema(raw.columns)[1]))
    first = uploads.profile_dataset(df, name="January", dataset_type="primary", digest="ab" * 16, size_bytes=10)
    row = first.first()
    assert (row.dataset_id, row.row_count, row.positives, row.date_min) == ("ds_" + "ab" * 6, 100, 1, date(2024, 1, 1))
    with pytest.raises(ValueError, match="already registered"):
        uploads.profile_dataset(df, name="Again", dataset_type="primary", digest="ab" * 16, size_bytes=10, registry=first)
    second = uploads.profile_dataset(df, name="February", dataset_type="primary", digest="cd" * 16, size_bytes=10)
    both = {r.display_name: r.is_active for r in uploads.register(first, second).collect()}
    assert both == {"January": False, "February": True}
    for wrong in (dict(name="x"), dict(dataset_type="odd"), dict(digest="zz"), dict(size_bytes=0)):
        with pytest.raises(ValueError):
            uploads.profile_dataset(df, **{**dict(name="Name", dataset_type="primary", digest="ab" * 16,
                                                  size_bytes=1), **wrong})
    with pytest.raises(ValueError, match="100 rows"):
        uploads.profile_dataset(df.limit(99), name="Few", dataset_type="primary", digest="ef" * 16, size_bytes=1)


def test_fingerprints(spark, tmp_path):
    import hashlib
    data = b"x" * 70_000
    (tmp_path / "f.bin").write_bytes(data)
    whole = uploads.file_fingerprints(spark, str(tmp_path)).first()
    assert whole.fingerprint == hashlib.md5(data).hexdigest()
    head = uploads.file_fingerprints(spark, str(tmp_path), head_only=True).first()
    assert head.fingerprint == hashlib.md5(data[:65_536]).hexdigest()
    df = spark.range(50)
    assert uploads.table_digest(df) == uploads.table_digest(df.repartition(7))
    assert uploads.table_digest(df) != uploads.table_digest(spark.range(51))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", ["a", "b"], 1), ("ok", [], 2), ("-x", None, 3)],
                               "name string, flags array<string>, n int").withColumn("s", F.struct("n"))
    sinks.export_csv(df, str(tmp_path / "c"))
    back = {r.n: r for r in spark.read.csv(str(tmp_path / "c"), header=True, escape='"').collect()}
    assert back["1"]["name"] == "'=1+1" and back["3"]["name"] == "'-x" and back["2"]["name"] == "ok"
    assert back["1"]["flags"] == "a|b" and back["1"]["s"] == '{"n":1}'
    sinks.export_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    events = spark.createDataFrame([("e1", datetime(2024, 1, 1, 5)), ("e2", datetime(2024, 1, 9))],
                                   "event_id string, created_at timestamp")
    events = events.withColumns({c: F.lit("x") for c in sinks.AUDIT_FIELDS if c not in events.columns})
    sinks.export_audit(events, str(tmp_path / "a"), date(2024, 1, 1), date(2024, 1, 2))
    assert [r.event_id for r in spark.read.csv(str(tmp_path / "a"), header=True).collect()] == ["e1"]


def test_entity_export(spark):
    df = spark.createDataFrame(
        [("E1", .9, "high", "report", "Fan_In", 2, 5.0, "text", "cite", ["a", "b"],
          (datetime(2024, 1, 1), datetime(2024, 1, 2)))],
        "entity_id string, risk_score double, risk_label string, escalation_action string, "
        "typology_label string, txn_count long, total_amount double, explanation string, citation string, "
        "rule_flags array<string>, observation_window struct<start: timestamp, end: timestamp>")
    assert sinks.entity_export(df).columns == sinks.ENTITY_FIELDS
    row = sinks.entity_export(df, full=True).first()
    assert row.rule_flags == "a|b"
    assert row.observation_window == "2024-01-01T00:00:00|2024-01-02T00:00:00"
    assert sinks.entity_export(df.limit(0)).columns == sinks.ENTITY_FIELDS


def test_arriving_files_load_once(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    target, check, seen = str(tmp_path / "out"), str(tmp_path / "check"), []

    def run():
        jobs.ingest_arrivals(spark, str(box), target, check,
                             then=lambda df, i: seen.append(df.count())).awaitTermination()
        return spark.read.parquet(target).count()

    write_csv(box / "a.csv", HEADER, ROWS)
    assert run() == 3 and run() == 3
    write_csv(box / "b.csv", HEADER, ROWS[:1])
    (box / "skip.txt").write_text("not a transaction file")
    assert run() == 4 and seen == [3, 1]
    receipts = spark.read.parquet(target + "_receipts")
    assert receipts.count() == 2 and receipts.select("receipt_id").distinct().count() == 2


def test_live_state_equals_batch(spark, tmp_path):
    acts = spark.createDataFrame(
        [("a", 1, "assign", "x", "kim", datetime(2024, 1, 1)), ("a", 2, "disposition", "x", "sar_filed", datetime(2024, 1, 1)),
         ("b", 3, "note", "x", "hm", datetime(2024, 1, 1)), ("a", 4, "note", "x", "done", datetime(2024, 1, 2))],
        S.ACTION_SCHEMA)
    path = str(tmp_path / "acts")
    acts.write.parquet(path)
    stream = spark.readStream.schema(S.ACTION_SCHEMA).parquet(path)
    jobs.live_alert_state(stream).writeStream.outputMode("complete").format("memory") \
        .queryName("live_state").trigger(availableNow=True).start().awaitTermination()
    live = {r.alert_id: r for r in spark.table("live_state").collect()}
    alerts = spark.createDataFrame([("a",), ("b",)], "alert_id string").select(
        "*", F.lit(None).cast("string").alias("assigned_to"), F.lit("new").alias("status"),
        F.lit("pending").alias("disposition"))
    for r in workflow.fold_actions(alerts, acts).collect():
        x = live[r.alert_id]
        assert (x.assigned_to, x.status, x.disposition, x.note_count, x.last_note) == (
            r.assigned_to, r.status, r.disposition, r.note_count, r.last_note)


def test_velocity_stream(spark, tmp_path):
    rows = [(datetime(2024, 1, 1 + i), "A", 9000.0) for i in range(5)] + [(datetime(2024, 3, 1), "B", 1.0)]
    df = spark.createDataFrame(rows, "timestamp timestamp, from_account string, amount_paid double")
    path = str(tmp_path / "v")
    df.write.parquet(path)
    jobs.account_velocity(spark.readStream.schema(df.schema).parquet(path)).writeStream.outputMode("append") \
        .format("memory").queryName("velocity").trigger(availableNow=True).start().awaitTermination()
    got = {(r.from_account, r.window_start): r for r in spark.table("velocity").collect()}
    row = got["A", datetime(2024, 1, 1)]
    assert (row.txn_count, row.near_threshold_count, row.total_amount) == (5, 5, 45_000.0)
    assert ("B", datetime(2024, 3, 1)) not in got
