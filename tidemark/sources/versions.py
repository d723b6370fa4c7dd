"""Tables that are published whole: every load is a version, and a view points to the one that counts.

A version is written under a name of its own and checked there. Readers see it from the moment
the view is replaced, which is one step of the catalog; up to then, and if a load fails at any time, the view
still shows the rows of before. A frame that was read keeps the version it was planned with, so replaced versions stay until
``drop_versions`` removes them.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_PROPERTY = "tidemark.version"
_MARK = "__v"


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def current_version(spark: SparkSession, table: str) -> str | None:
    """The table that the pointer names; None where ``table`` is no pointer."""
    if not spark.catalog.tableExists(table) or spark.catalog.getTable(table).tableType != "VIEW":
        return None
    found = [r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {_quoted(table)}").collect() if r["key"] == _PROPERTY]
    return found[0] if found else None


def versions(spark: SparkSession, table: str) -> list[str]:
    """All versions that are stored, oldest first; also those of loads that failed or are still running."""
    where, _, name = table.rpartition(".")
    rows = spark.sql(f"SHOW TABLES {f'IN {_quoted(where)} ' if where else ''}LIKE '{name.lower()}{_MARK}*'").collect()
    return [f"{where}.{n}" if where else n for n in sorted(r["tableName"] for r in rows)]


def publish(df: DataFrame, table: str, *, partition_by: str | None = None) -> int:
    """Write a version, check that it has rows, and point ``table`` to it; returns the row count.

    With ``partition_by`` rows are brought together by it first, in parts of even size, so that a partition has few files
    and a day with a third of all rows has several writers. A plain table of that name becomes
    the first version, in two steps; that happens once.
    """
    spark = df.sparkSession
    version = f"{table}{_MARK}{time.time_ns():020d}_{uuid.uuid4().hex[:8]}"
    writer = (df.hint("rebalance", partition_by) if partition_by else df).write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    try:
        writer.saveAsTable(version)
        rows = spark.table(version).count()
        if not rows:
            raise ValueError(f"nothing to load into {table}")
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(version)}")
        raise
    if spark.catalog.tableExists(table) and current_version(spark, table) is None:
        spark.sql(f"ALTER TABLE {_quoted(table)} RENAME TO {_quoted(f'{table}{_MARK}{0:020d}')}")
    columns = ", ".join(f"`{c}`" for c in df.columns)
    spark.sql(f"CREATE OR REPLACE VIEW {_quoted(table)} TBLPROPERTIES ('{_PROPERTY}' = '{version}') "
              f"AS SELECT {columns} FROM {_quoted(version)}")
    return rows


def append(df: DataFrame, table: str) -> None:
    """Add rows, which have the stored columns' names, to the version that counts, or to a plain table."""
    target = current_version(df.sparkSession, table) or table
    df.select(*df.sparkSession.table(target).columns).write.insertInto(target)


def drop_versions(spark: SparkSession, table: str, *, keep: int = 1) -> list[str]:
    """Remove what was published before the current version and the ``keep`` before it; returns what went.

    Versions after the current one may be loads that are still running and stay.
    """
    if keep < 0:
        raise ValueError("the number of versions to keep cannot be negative")
    current = current_version(spark, table)
    older = [v for v in versions(spark, table) if current and v.lower() < current.lower()]
    gone = older[:max(0, len(older) - keep)]
    for version in gone:
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(version)}")
    return gone
