"""Canonical tables and the header names they can be read from."""

from __future__ import annotations

from pyspark.sql import types as T

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("from_bank", T.StringType()),
    T.StructField("from_account", T.StringType()),
    T.StructField("to_bank", T.StringType()),
    T.StructField("to_account", T.StringType()),
    T.StructField("amount_received", T.DoubleType()),
    T.StructField("receiving_currency", T.StringType()),
    T.StructField("amount_paid", T.DoubleType()),
    T.StructField("paying_currency", T.StringType()),
    T.StructField("payment_format", T.StringType()),
    T.StructField("is_laundering", T.IntegerType()),
    T.StructField("txn_date", T.DateType()),
    T.StructField("amount_usd", T.DoubleType()),
])
TRANSACTION_COLUMNS = TRANSACTION_SCHEMA.fieldNames()

KNOWLEDGE_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("txn_date", T.DateType()),
    T.StructField("from_account", T.StringType()),
    T.StructField("to_account", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("payment_currency", T.StringType()),
    T.StructField("received_currency", T.StringType()),
    T.StructField("from_country", T.StringType()),
    T.StructField("to_country", T.StringType()),
    T.StructField("payment_format", T.StringType()),
    T.StructField("is_laundering", T.IntegerType()),
    T.StructField("laundering_type", T.StringType()),
])
KNOWLEDGE_COLUMNS = KNOWLEDGE_SCHEMA.fieldNames()

ACTION_SCHEMA = T.StructType([
    T.StructField("alert_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("actor", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("at", T.TimestampType()),
])

# --- fixed values: source headers and their order in the public data sets -------------
RAW_TRANSACTION_HEADERS = [
    "Timestamp", "From Bank", "Account", "To Bank", "Account.1", "Amount Received",
    "Receiving Currency", "Amount Paid", "Payment Currency", "Payment Format",
    "Is Laundering",
]
RAW_KNOWLEDGE_HEADERS = [
    "Time", "Date", "Sender_account", "Receiver_account", "Amount", "Payment_currency",
    "Received_currency", "Sender_bank_location", "Receiver_bank_location",
    "Payment_type", "Is_laundering", "Laundering_type",
]
# Header spellings accepted for each canonical column, best match first.
HEADER_ALIASES = {
    "timestamp": ["timestamp", "date", "txn_date", "transaction_date", "time"],
    "from_bank": ["from_bank", "sender_bank", "ordering_institution"],
    "from_account": ["from_account", "sender_id", "sender_account", "account",
                     "account_from", "ordering_customer"],
    "to_bank": ["to_bank", "receiver_bank", "beneficiary_institution"],
    "to_account": ["to_account", "receiver_id", "receiver_account", "account.1",
                   "account_to", "beneficiary_customer"],
    "amount_paid": ["amount_paid", "amount", "payment_amount", "value"],
    "amount_received": ["amount_received", "received_amount"],
    "paying_currency": ["paying_currency", "payment_currency", "currency", "currency_code"],
    "receiving_currency": ["receiving_currency", "received_currency"],
    "payment_format": ["payment_format", "payment_type", "transaction_type", "channel"],
    "is_laundering": ["is_laundering", "laundering_flag", "suspicious_label"],
}
REQUIRED_MAPPINGS = ["timestamp", "from_account", "to_account", "amount_paid"]
# Timestamp spellings in the public files, tried in order after ISO.
TIMESTAMP_FORMATS = ["yyyy/MM/dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm"]
# --- end of fixed values --------------------------------------------------------------


def raw_string_schema(headers: list[str]) -> T.StructType:
    """All-string schema, so that identifiers keep their leading zeroes."""
    return T.StructType([T.StructField(h, T.StringType()) for h in headers])


def require_columns(columns: list[str], needed: list[str], what: str) -> None:
    missing = sorted(set(needed) - set(columns))
    if missing:
        raise ValueError(f"{what} needs columns: {', '.join(missing)}")
