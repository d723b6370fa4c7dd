"""Exact look-back features of arriving transactions.

Every micro-batch writes its state, the rows that later ones can still look back to, and gets
its features from there by the batch operators (``operators.features``). So a streamed row has the values
of the batch, and one account is spread over (account, block) tasks here too.

* A row may be late by ``lateness`` against the newest row of the batches before. It counts for all rows after it:
  those are written again, and ``current`` has the last values of each.
* Rows that are later than that, or have no time, cannot be placed; they go to ``<target>_unplaced``.
* State is two folders written in turn: batch n reads what n - 1 wrote and replaces what n - 2 wrote. A batch that is run
  again finds its input unchanged. Rows leave once no row that is still accepted can look back to them.

A batch costs one pass over the rows of the longest span plus ``lateness``, so triggers should be
far enough apart to bring a share of that.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.features import add_features, canonical_input
from tidemark.policy import FeaturePolicy
from tidemark.schema import require_columns

# ``amount_deviation`` looks back to all rows ever and is left to the batch.
EXACT = ("txn_count_7d", "rolling_sum_7d", "near_threshold_count", "velocity_1hr",
         "recent_inflow_24h", "fan_in_sum_48h", "fan_in_count", "fan_out_count")
_USED = ["timestamp", "from_account", "to_account", "amount_paid"]


def look_back(transactions: DataFrame, target: str, checkpoint: str, *, row_key: str,
              wanted: tuple[str, ...] = EXACT, lateness: timedelta = timedelta(days=1),
              policy: FeaturePolicy = FeaturePolicy()) -> StreamingQuery:
    """Write features of a stream to ``target``, one ``batch`` partition for each micro-batch.

    ``row_key`` must be unique. Its rows carry key, time, accounts, amount and the wanted features;
    other columns, whatever their names, stay behind and are met by the key. Empty batches write empty results.
    A target belongs to one checkpoint: a new one needs a new target.
    """
    unknown = sorted(set(wanted) - set(EXACT))
    if unknown or not wanted:
        raise ValueError(f"no exact look-back in streams: {', '.join(unknown) or 'nothing wanted'}")
    if row_key in _USED:
        raise ValueError(f"{row_key} cannot be the row key")
    require_columns(transactions.columns, [row_key, *_USED], "a stream of transactions")
    span = max(policy.week_s, policy.hour_s, policy.inflow_s, policy.fan_s) * 1_000_000
    late_by = lateness // timedelta(microseconds=1)

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        time = F.unix_micros("timestamp")
        rows = canonical_input(batch.select(row_key, *_USED))
        rows = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        state = rows.withColumn("seen", F.lit("new"))
        if batch_id:
            before = (spark.read.parquet(f"{target}_state/{(batch_id - 1) % 2}")
                           .where(F.col("seen") != "late"))
            newest = before.agg(F.max(time)).first()[0]
            floor = -(1 << 63) if newest is None else newest - late_by
            state = state.withColumn("seen", F.when(time >= floor, "new").otherwise("late"))
            oldest = max(floor - span, -(1 << 63))
            state = before.where(time >= oldest).withColumn("seen", F.lit("old")).unionByName(state)
        state = state.withColumn("seen", F.when(F.col("timestamp").isNull(), "late").otherwise(F.col("seen")))
        slot = f"{target}_state/{batch_id % 2}"
        state.write.mode("overwrite").parquet(slot)
        held = spark.read.parquet(slot)
        (held.where(F.col("seen") == "late").drop("seen")
             .write.mode("overwrite").parquet(f"{target}_unplaced/batch={batch_id}"))
        placed = held.where(F.col("seen") != "late")
        changed(placed).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    def changed(placed: DataFrame) -> DataFrame:
        """Features of the rows at or after a new row of one of their accounts."""
        ends = F.array("from_account", "to_account")
        first = (placed.where(F.col("seen") == "new").select("timestamp", F.explode(ends).alias("account"))
                       .groupBy("account").agg(F.min("timestamp").alias("since")))
        found = add_features(placed.drop("seen"), wanted, row_key=row_key, policy=policy)
        for end in ("from_account", "to_account"):
            found = found.join(first.select(F.col("account").alias(end), F.col("since").alias(f"_{end}")),
                               end, "left")
        after = F.coalesce(F.col("timestamp") >= F.least("_from_account", "_to_account"), F.lit(False))
        return found.where(after).select(row_key, *_USED, *wanted)

    return (transactions.writeStream.option("checkpointLocation", checkpoint)
                        .trigger(availableNow=True).foreachBatch(load).start())


def current(spark: SparkSession, target: str, row_key: str) -> DataFrame:
    """The last values of every row."""
    rows = spark.read.parquet(target)
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in (row_key, "batch")]), "batch")
    return rows.groupBy(row_key).agg(last.alias("_last")).select(row_key, "_last.*")
