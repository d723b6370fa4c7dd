"""Streams: files as they arrive, alert actions, account velocity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import schema as S
from tidemark.operators.workflow import QUEUE_DISPOSITIONS, _pick, note_line
from tidemark.sources.ingest import canonical_transactions


def ingest_arrivals(spark: SparkSession, folder: str, target: str, checkpoint: str, *,
                    pattern: str = "*.csv",
                    then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Load every new transaction file once.

    The checkpoint lists the files already taken. A batch writes its own ``batch``
    partition with overwrite, so a batch that is run again after a failure replaces its
    rows instead of doubling them. ``then`` may start an investigation on the batch.
    File names must not read as globs; ``arrivals.ingest_files`` takes those too, and other layouts.
    """
    raw = (spark.readStream.schema(S.raw_string_schema(S.RAW_TRANSACTION_HEADERS))
                .option("header", True).option("pathGlobFilter", pattern).csv(folder)
                .select("*", F.col("_metadata.file_path").alias("file"),
                        F.col("_metadata.file_size").alias("file_size")))

    def load(batch: DataFrame, batch_id: int) -> None:
        rows = canonical_transactions(batch.select(*[f"`{h}`" for h in S.RAW_TRANSACTION_HEADERS]))
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        receipts = batch.groupBy("file", "file_size").agg(F.count("*").alias("row_count"))
        (receipts.withColumn("receipt_id", F.sha2(F.concat_ws(":", "file", "file_size")
                                                   .cast("binary"), 256))
                 .write.mode("overwrite").parquet(f"{target}_receipts/batch={batch_id}"))
        if then is not None:
            then(batch.sparkSession.read.parquet(f"{target}/batch={batch_id}"), batch_id)

    return (raw.writeStream.option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).foreachBatch(load).start())


def live_alert_state(actions: DataFrame) -> DataFrame:
    """Latest assignee, status and note per alert from a stream of actions (update mode)."""
    assign, decide = F.col("action") == "assign", F.col("action") == "disposition"
    moved = (F.when(assign, "in_review")
              .when(decide, _pick("value", QUEUE_DISPOSITIONS, "closed")))
    return actions.groupBy("alert_id").agg(
        F.max_by("value", F.when(assign, F.col("seq"))).alias("assigned_to"),
        F.coalesce(F.max_by(moved, F.when(assign | decide, F.col("seq"))), F.lit("new"))
         .alias("status"),
        F.coalesce(F.max_by("value", F.when(decide, F.col("seq"))), F.lit("pending"))
         .alias("disposition"),
        F.count_if(F.col("action") == "note").alias("note_count"),
        F.max_by(note_line(), F.when(F.col("action") == "note", F.col("seq"))).alias("last_note"))


def account_velocity(transactions: DataFrame, *, lateness: str = "1 day", span: str = "7 days",
                     slide: str = "1 day", near_low: float = 8_000.0,
                     near_high: float = 10_000.0) -> DataFrame:
    """Counts and sums per account over sliding windows of arriving transactions.

    Windows start on slide boundaries, so this watches accounts; the exact look-back per
    transaction is the batch feature.
    """
    near = (F.col("amount_paid") >= near_low) & (F.col("amount_paid") < near_high)
    return (transactions.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
            .withWatermark("timestamp", lateness)
            .groupBy(F.window("timestamp", span, slide).alias("w"), "from_account")
            .agg(F.count("*").alias("txn_count"), F.sum("amount_paid").alias("total_amount"),
                 F.count_if(near).alias("near_threshold_count"))
            .select("from_account", F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), "txn_count", "total_amount",
                    "near_threshold_count"))
