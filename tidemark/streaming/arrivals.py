"""Arriving files of any known layout, each with a receipt that tells what became of it.

The stream itself only lists files; their bytes are read as tables. A file loads into a folder of its own,
named by its receipt (path, size and time of change), so loading it again replaces its rows. A receipt
is one of

* ``loaded``: its rows count. Rows without time, accounts or a positive amount are kept apart (``quarantined``).
* ``copy``: the same rows were loaded under another name (``same_as``); they are not counted twice.
* ``invalid``: no known layout, too large, too few good rows, or bad ones where ``strict``; ``reason`` says which.
* ``superseded``: the file changed while it was loaded, or a newer version of the path was loaded later.

Receipts are written after the rows, as one partition of the ledger for each stream and batch. A batch that fails is run again as a whole
and ends in the same rows and receipts. Errors other than those of a file's content stop the
stream, so that the next run takes its files again.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import Future

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import schema as S
from tidemark.sources import uploads
from tidemark.sources.ingest import read_raw_csv

RECEIPT_SCHEMA = ("receipt_id string, path string, bytes long, modified timestamp, status string, reason string, "
                  "layout string, digest string, same_as string, row_count long, bad_rows long, stream string, batch long")
_CHANGES = 3


def ingest_files(spark: SparkSession, folder: str, target: str, checkpoint: str, *,
                 pattern: str = "*.csv", strict: bool = False, min_rows: int = uploads.MIN_PRIMARY_ROWS,
                 max_bytes: int | None = None, max_files: int = 200,
                 then: Callable[[DataFrame, str], None] | None = None) -> StreamingQuery:
    """Load every new file of a folder; a batch lists at most ``max_files``, the others follow in the next.
    Files of no bytes are not listed and get no receipt.

    ``then`` gets the good rows of each loaded file and its receipt id, after the receipts are stored. A batch
    that is run again calls it again, so it should write under that id.
    """
    spark.createDataFrame([], RECEIPT_SCHEMA).drop("stream", "batch").write.mode("append").parquet(
        f"{target}_receipts/stream=none/batch=-1")
    found = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
                  .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).load(folder)
                  .select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")))

    # Numbers of batches begin anew with a new checkpoint, and so does the stream's id.
    stream: Future[str] = Future()

    def load(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        own = (F.col("stream") == stream.result(timeout=600)) & (F.col("batch") == batch_id)
        earlier = _ledger(session, target).where(~own)
        # Spark lists files twice if the name of one of them reads as a glob.
        arrived = batch.dropDuplicates(["path"]).withColumn("receipt_id", _receipt_id())
        settled = earlier.where(F.col("status") != "superseded").select("receipt_id")
        written: list[dict] = []
        for file in arrived.join(settled, "receipt_id", "left_anti").orderBy("modified", "path").collect():
            version = file.asDict()
            for _ in range(_CHANGES):
                receipt = _load_file(session, version, target, strict=strict, min_rows=min_rows, max_bytes=max_bytes)
                now = _version(session, version["path"])
                if now is not None and now["receipt_id"] == receipt["receipt_id"]:
                    break
                written.append(receipt | {"status": "superseded", "reason": "the file changed while it was loaded"})
                if now is None:
                    receipt = None
                    break
                version = now
            else:
                raise RuntimeError(f"{version['path']} keeps changing")
            if receipt is not None:
                written.append(_marked_copy(receipt, earlier, written))
        (session.createDataFrame(written, RECEIPT_SCHEMA).drop("stream", "batch").coalesce(1).write.mode("overwrite")
                .parquet(f"{target}_receipts/stream={stream.result()}/batch={batch_id}"))
        if then is not None:
            for receipt in written:
                if receipt["status"] == "loaded":
                    then(_rows_of(session, target, receipt["receipt_id"]).where("is_valid").drop("is_valid"),
                         receipt["receipt_id"])

    query = (found.writeStream.option("checkpointLocation", checkpoint)
                  .trigger(availableNow=True).foreachBatch(load).start())
    stream.set_result(str(query.id))
    return query


def _receipt_id():
    return F.sha2(F.concat_ws(":", "path", "bytes", F.unix_micros("modified")).cast("binary"), 256)


def _literal(path: str) -> str:
    """A path whose characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _version(spark: SparkSession, path: str) -> dict | None:
    """What the path holds now; None where it is gone."""
    listed = (spark.read.format("binaryFile").option("ignoreMissingFiles", True)
                   .option("pathGlobFilter", _literal(path.rpartition("/")[2])).load(path.rpartition("/")[0])
                   .where(F.col("path") == path)
                   .select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")))
    row = listed.withColumn("receipt_id", _receipt_id()).first()
    return row.asDict() if row else None


def _load_file(spark: SparkSession, version: dict, target: str, *, strict: bool, min_rows: int,
               max_bytes: int | None) -> dict:
    """Write the rows of one file and return its receipt."""
    receipt = version | dict.fromkeys(("reason", "layout", "digest", "same_as")) | {
        "status": "invalid", "row_count": 0, "bad_rows": 0}
    if max_bytes is not None and version["bytes"] > max_bytes:
        return receipt | {"reason": f"more than {max_bytes} bytes"}
    try:
        raw = read_raw_csv(spark, _literal(version["path"]))
        receipt["layout"], mapping = uploads.detect_schema(raw.columns)
        rows = uploads.canonicalise(raw, mapping)
    except ValueError as problem:
        return receipt | {"reason": str(problem).replace(version["path"], "the file")}
    rows.write.mode("overwrite").partitionBy("is_valid").parquet(f"{target}/receipt_id={version['receipt_id']}")
    stored = _rows_of(spark, target, version["receipt_id"])
    hashed = F.xxhash64(*S.TRANSACTION_COLUMNS).cast("decimal(38,0)")
    good, bad, total = stored.agg(F.count_if("is_valid"), F.count_if(~F.col("is_valid")),
                                  F.sum(F.when(F.col("is_valid"), hashed))).first()
    receipt |= {"row_count": good, "bad_rows": bad, "digest": f"{good}:{total}"}
    if strict and bad:
        return receipt | {"reason": f"{bad} rows fail required timestamp, account, or positive-amount validation"}
    if good < min_rows:
        return receipt | {"reason": f"{good} good rows, at least {min_rows} are needed"}
    return receipt | {"status": "loaded"}


def _marked_copy(receipt: dict, earlier: DataFrame, written: list[dict]) -> dict:
    """The receipt, as a copy if other paths have loaded the same rows before."""
    if receipt["status"] != "loaded":
        return receipt

    def first(receipts) -> str | None:
        return min((r["receipt_id"] for r in receipts), default=None)

    same = (F.col("status") == "loaded") & (F.col("digest") == receipt["digest"]) & (F.col("path") != receipt["path"])
    twin = first(w for w in written if w["status"] == "loaded" and w["digest"] == receipt["digest"]
                 and w["path"] != receipt["path"])
    twin = twin or earlier.where(same).agg(F.min("receipt_id")).first()[0]
    return receipt | {"status": "copy", "same_as": twin} if twin else receipt


def _ledger(spark: SparkSession, target: str) -> DataFrame:
    """Receipts as they were written, less the versions that a later one of their path has replaced."""
    stored = spark.read.schema(RECEIPT_SCHEMA).parquet(f"{target}_receipts")
    taken = F.col("status").isin("loaded", "copy")
    later = Window.partitionBy("path").orderBy("modified", "batch").rowsBetween(1, Window.unboundedFollowing)
    replaced = taken & (F.count_if(taken).over(later) > 0)
    return stored.withColumns({
        "status": F.when(replaced, "superseded").otherwise(F.col("status")),
        "reason": F.when(replaced, "a newer version was loaded").otherwise(F.col("reason"))})


def receipts(spark: SparkSession, target: str) -> DataFrame:
    """One row for each version of each file."""
    return _ledger(spark, target)


def _rows_of(spark: SparkSession, target: str, receipt_id: str) -> DataFrame:
    return _table(spark, f"{target}/receipt_id={receipt_id}", "is_valid boolean")


def _table(spark: SparkSession, path: str, partitions: str) -> DataFrame:
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.TRANSACTION_SCHEMA)
    return spark.read.schema(f"{columns}, {partitions}").parquet(path)


def _counted(spark: SparkSession, target: str) -> DataFrame:
    """All stored rows of files that were loaded. Where a copy's original was superseded, the copy stands in."""
    ledger = _ledger(spark, target)
    copies = ledger.where(F.col("status") == "copy").select("receipt_id", "digest")
    loaded = ledger.where(F.col("status") == "loaded").select("receipt_id", "digest")
    orphans = (copies.join(loaded.select("digest"), "digest", "left_anti")
                     .groupBy("digest").agg(F.min("receipt_id").alias("receipt_id")))
    counted = loaded.select("receipt_id").union(orphans.select("receipt_id"))
    rows = _table(spark, target, "receipt_id string, is_valid boolean")
    return rows.join(counted, "receipt_id", "left_semi")


def accepted(spark: SparkSession, target: str) -> DataFrame:
    """The good rows of all files that count, with their ``receipt_id``."""
    return _counted(spark, target).where("is_valid").drop("is_valid")


def quarantined(spark: SparkSession, target: str) -> DataFrame:
    """The bad rows of all files that count, with their ``receipt_id``."""
    return _counted(spark, target).where(~F.col("is_valid")).drop("is_valid")
