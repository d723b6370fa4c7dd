"""Reading raw transaction and calibration files into the canonical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions.columns import clean, readable_number, trimmed
from tidemark.functions.sampling import bottom_k, hash_key
from tidemark.sources import versions


def read_raw_csv(spark: SparkSession, path: str, headers: list[str] | None = None) -> DataFrame:
    """All columns as text, named by position.

    Names come from the first line unless given. A repeated one gets a number, the second
    Account becoming ``Account.1``.
    """
    if headers is None:
        first = spark.read.csv(path).first()
        if first is None:
            raise ValueError(f"no header line in {path}")
        headers = []
        for i, name in enumerate(first):
            name = name or f"Unnamed: {i}"
            copies = sum(h == name or h.rpartition(".")[0] == name for h in headers)
            headers.append(f"{name}.{copies}" if copies else name)
    return spark.read.option("header", True).schema(S.raw_string_schema(headers)).csv(path)


def parse_timestamp(text: Column) -> Column:
    """ISO first, then the slash formats of the public files; null where none fits."""
    tries = [F.try_to_timestamp(text)]
    tries += [F.try_to_timestamp(text, F.lit(f)) for f in S.TIMESTAMP_FORMATS]
    return F.coalesce(*tries)


def _ordered(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def canonical_transactions(raw: DataFrame) -> DataFrame:
    """Lenient: what cannot be read becomes null, labels default to 0, text is trimmed."""
    paying = "Payment Currency" if "Payment Currency" in raw.columns else "Paying Currency"
    S.require_columns(raw.columns,
                      [h for h in S.RAW_TRANSACTION_HEADERS if h != "Payment Currency"] + [paying],
                      "a transaction file")

    def text(name: str) -> Column:
        return F.coalesce(trimmed(F.col(f"`{name}`")), F.lit(""))

    def amount(name: str) -> Column:
        return readable_number(F.col(f"`{name}`"))

    stamp = parse_timestamp(trimmed(F.col("Timestamp")))
    return _ordered(raw.select(
        stamp.alias("timestamp"), text("From Bank").alias("from_bank"),
        text("Account").alias("from_account"), text("To Bank").alias("to_bank"),
        text("Account.1").alias("to_account"), amount("Amount Received").alias("amount_received"),
        text("Receiving Currency").alias("receiving_currency"),
        amount("Amount Paid").alias("amount_paid"), text(paying).alias("paying_currency"),
        text("Payment Format").alias("payment_format"),
        F.coalesce(amount("Is Laundering").try_cast("int"), F.lit(0)).alias("is_laundering"),
        F.to_date(stamp).alias("txn_date"), amount("Amount Paid").alias("amount_usd"),
    ), S.TRANSACTION_SCHEMA)


def canonical_knowledge(raw: DataFrame) -> DataFrame:
    S.require_columns(raw.columns, S.RAW_KNOWLEDGE_HEADERS, "a calibration file")
    stamp = parse_timestamp(F.concat_ws(" ", trimmed(F.col("Date")), trimmed(F.col("Time"))))
    return _ordered(raw.select(
        stamp.alias("timestamp"), F.to_date(stamp).alias("txn_date"),
        clean("Sender_account").alias("from_account"), clean("Receiver_account").alias("to_account"),
        readable_number(F.col("Amount")).alias("amount"),
        clean("Payment_currency").alias("payment_currency"),
        clean("Received_currency").alias("received_currency"),
        clean("Sender_bank_location").alias("from_country"),
        clean("Receiver_bank_location").alias("to_country"),
        clean("Payment_type").alias("payment_format"),
        F.coalesce(readable_number(F.col("Is_laundering")).try_cast("int"), F.lit(0))
         .alias("is_laundering"),
        clean("Laundering_type").alias("laundering_type")), S.KNOWLEDGE_SCHEMA)


def stratified_sample(df: DataFrame, key_columns: list[str] | None = None, *,
                      k: int = 50_000, seed: int = 42) -> DataFrame:
    """All positives and a uniform, repeatable sample of k normals."""
    if k < 0:
        raise ValueError("the sample size cannot be negative")
    key = hash_key(seed, [F.col(c).cast("string") for c in key_columns or df.columns])
    normals = bottom_k(df.where(F.col("is_laundering") == 0).withColumn("_key", key), "_key", k)
    return df.where(F.col("is_laundering") == 1).unionByName(normals.drop("_key"))


def publish_table(df: DataFrame, table: str, *, force: bool = False,
                  partition_by: str | None = None) -> int:
    """Publish a version of the table (see ``versions``); returns the row count.

    An existing table is left alone unless ``force``; an empty or failed load is an error and
    readers go on with the old rows.
    """
    spark = df.sparkSession
    if spark.catalog.tableExists(table) and not force:
        return spark.table(table).count()
    return versions.publish(df, table, partition_by=partition_by)


def append_rows(df: DataFrame, table: str) -> None:
    """Append by column name, in the table's own order."""
    S.require_columns(df.columns, df.sparkSession.table(table).columns, f"an append to {table}")
    versions.append(df, table)


def ingest_transactions(spark: SparkSession, path: str, table: str, *,
                        force: bool = False) -> int:
    """Partitioned by day, which filters on ``txn_date`` prune."""
    raw = read_raw_csv(spark, path, S.RAW_TRANSACTION_HEADERS)
    return publish_table(canonical_transactions(raw), table, force=force, partition_by="txn_date")


def ingest_knowledge(spark: SparkSession, path: str, table: str, *,
                     force: bool = False) -> int:
    """The whole calibration table; what fits a forest is bounded where it is fitted."""
    raw = read_raw_csv(spark, path)
    return publish_table(canonical_knowledge(raw), table, force=force)


def ingest_kyc(spark: SparkSession, path: str, table: str, *, force: bool = False) -> int:
    """Customer records as they are, every column text."""
    return publish_table(read_raw_csv(spark, path), table, force=force)
