"""Two-pass external shuffle: a uniform random order of any amount of records, in shards.

Pass one scatters records into buckets by a seeded hash of their contents; there are so many
buckets that one fits in memory. Pass two puts each bucket in a fixed order, draws a
Fisher-Yates permutation seeded by the bucket's number, and gives the records their places
in the whole order: the buckets one after another. Record p of that order goes to shard
p mod ``shards``, slot p div ``shards``, so shards differ by one record at most.

The records move once. Only bucket sizes (one number for each 32 MB of input) are gathered in
between. Equal records get different hashes by their number within a task, so that a record
that fills a third of the input is spread too; as equal records are interchangeable, a task
that runs again after a lost executor scatters the same. Null and empty texts are records
of size 1, and null ids are ids like others.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

SHARDS = 8
SEED = 17
BUCKET_BYTES = 32 << 20
LEAST_BUCKETS = 64


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def buckets_for(documents: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    total = documents.agg(F.sum(size_of())).first()[0] or 0
    return max(LEAST_BUCKETS, -(-total // bucket_bytes))


def scatter(documents: DataFrame, buckets: int, seed: int = SEED) -> DataFrame:
    """Pass one: documents with the columns __bucket and __order.

    __order is a hash of the row, salted with its number among equal rows of its task.
    """
    marked = documents.withColumn(
        "__order", F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in documents.columns)))

    def spread(batches):
        met: Counter[int] = Counter()
        for batch in batches:
            at = batch.schema.get_field_index("__order")
            order = batch.column(at).to_numpy(zero_copy_only=False).copy()
            first = np.zeros(len(order), bool)
            first[np.unique(order, return_index=True)[1]] = True
            known = np.isin(order, np.fromiter(met, np.int64, len(met))) if met else ~first
            for i in np.flatnonzero(~first | known).tolist():
                own = int(order[i])
                met[own] += 1
                order[i] = np.int64((own * 0x2545F4914F6CDD1D + met[own] * 0x9E3779B9) % (1 << 63))
            bucket = (order.view(np.uint64) >> np.uint64(11)) % np.uint64(buckets)
            yield batch.set_column(at, "__order", pa.array(order)).append_column(
                "__bucket", pa.array(bucket.astype(np.int64)))

    return marked.mapInArrow(spread, StructType([*marked.schema, StructField("__bucket", LongType())]))


def shuffle(documents: DataFrame, shards: int = SHARDS, seed: int = SEED,
            bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Pass two: documents with __shard and __slot, which replace columns of these names, in the order of the shuffle."""
    n = buckets_for(documents, bucket_bytes)
    # inside, columns go by number, so that their names can't clash
    own = {c: f"own_{i}" for i, c in enumerate(documents.columns)}
    scattered = scatter(documents.toDF(*own.values()), n, seed)
    order = Window.orderBy("__bucket")
    # one row for each bucket, so its size is bounded by bytes / bucket_bytes
    starts = (scattered.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "__bucket", (F.sum("n").over(order) - F.col("n")).alias("__start")))

    def permuted(table: pa.Table) -> pa.Table:
        table = table.sort_by("__order")
        rng = np.random.default_rng([seed, table.column("__bucket")[0].as_py()])
        place = np.arange(table.num_rows)
        for i in range(len(place) - 1, 0, -1):
            j = int(rng.integers(i + 1))
            place[i], place[j] = place[j], place[i]
        return table.take(pa.array(place)).append_column("__place", pa.array(np.arange(table.num_rows)))

    placed = StructType([*scattered.schema, StructField("__place", LongType())])
    whole = (scattered.groupBy("__bucket").applyInArrow(permuted, placed)
             .join(F.broadcast(starts), "__bucket"))
    position = F.col("__start") + F.col("__place")
    return whole.select(*(F.col(i).alias(c) for c, i in own.items() if c not in ("__shard", "__slot")),
                        (position % shards).cast("int").alias("__shard"),
                        F.expr(f"(__start + __place) div {int(shards)}").alias("__slot"))


def write(shuffled: DataFrame, path: str) -> None:
    """One folder per shard; records keep their slot as a column."""
    shuffled.withColumnsRenamed({"__shard": "shard", "__slot": "slot"}).write.partitionBy("shard").parquet(path)


def report(documents: DataFrame) -> DataFrame:
    out = shuffle(documents.select("doc_id", "text"))
    return out.select("doc_id", size_of().alias("size"),
                      F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"),
                      F.col("__shard").alias("shard"), F.col("__slot").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))
