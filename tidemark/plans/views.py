"""Transaction-shaped views over the star-schema tables, in Spark and as SQL text.

The tables hold no transfers, so ``events`` and ``lineitem`` are read as ledgers. The SQL
text is the same statement for an independent engine; only the JSON access differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_COUNTRY = ("CASE {x} % 8 WHEN 0 THEN 'USA' WHEN 1 THEN 'UK' WHEN 2 THEN 'Turkey' "
            "WHEN 3 THEN 'Nigeria' WHEN 4 THEN 'India' WHEN 5 THEN 'Germany' "
            "WHEN 6 THEN 'UAE' ELSE 'France' END")
_CURRENCY = "CASE {x} % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END"
_FORMAT = ("CASE event_type WHEN 'purchase' THEN 'Cash Deposit' WHEN 'error' THEN "
           "'Cash Withdrawal' WHEN 'click' THEN 'Wire' WHEN 'view' THEN 'ACH' ELSE 'Cheque' END")
_TYPE = ("CASE event_id % 7 WHEN 0 THEN 'Structuring' WHEN 1 THEN 'Smurfing' WHEN 2 THEN "
         "'Cash_Withdrawal' WHEN 3 THEN 'Single_large' WHEN 4 THEN 'Deposit-Send' "
         "WHEN 5 THEN 'Fan_In' ELSE 'Fan_Out' END")


def _txn_sql(json_get: str) -> str:
    return f"""
  SELECT event_id, ts AS timestamp,
    concat('BANK_', CAST(user_id % 7 AS VARCHAR(20))) AS from_bank,
    concat('A', CAST(user_id AS VARCHAR(20))) AS from_account,
    concat('BANK_', CAST(k % 7 AS VARCHAR(20))) AS to_bank,
    concat('A', CAST(k AS VARCHAR(20))) AS to_account,
    value * 40 AS amount_received, {_CURRENCY.format(x='k')} AS receiving_currency,
    value * 40 AS amount_paid, {_CURRENCY.format(x='user_id')} AS paying_currency,
    {_FORMAT} AS payment_format,
    CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS is_laundering,
    CAST(ts AS DATE) AS txn_date, value * 40 AS amount_usd,
    {_COUNTRY.format(x='user_id')} AS from_country,
    {_COUNTRY.format(x='k')} AS to_country, {_TYPE} AS laundering_type
  FROM (SELECT *, CAST({json_get} AS BIGINT) AS k FROM events) e"""


_LEDGER = f"""
  SELECT l.l_shipdate AS timestamp,
    concat('BANK_', CAST(c.c_nationkey AS VARCHAR(20))) AS from_bank,
    concat('C', CAST(o.o_custkey AS VARCHAR(20))) AS from_account,
    concat('BANK_', CAST(s.s_nationkey AS VARCHAR(20))) AS to_bank,
    concat('S', CAST(l.l_suppkey AS VARCHAR(20))) AS to_account,
    l.l_extendedprice * (1 - l.l_discount) AS amount_received,
    l.l_extendedprice AS amount_paid, l.l_returnflag AS payment_format,
    cn.n_name AS from_country, sn.n_name AS to_country,
    CAST(l.l_shipdate AS DATE) AS txn_date
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  JOIN nation sn ON s.s_nationkey = sn.n_nationkey"""

TXN_CTE = f"txn AS ({_txn_sql('''json_extract_string(props, '$.k')''')})"
LEDGER_CTE = f"ledger AS ({_LEDGER})"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _from(spark: SparkSession, sf: str, sql: str, names: list[str]) -> DataFrame:
    frames = {n: table(spark, sf, n) for n in names}
    for n in names:
        sql = sql.replace(f"FROM {n})", f"FROM {{{n}}})")
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {n} ", f"{word} {{{n}}} ")
    return spark.sql(sql, **frames)


def txn(spark: SparkSession, sf: str) -> DataFrame:
    return _from(spark, sf, _txn_sql("get_json_object(props, '$.k')"), ["events"])


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    return _from(spark, sf, _LEDGER,
                 ["lineitem", "orders", "customer", "supplier", "nation"])
