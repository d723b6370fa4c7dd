"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one is set only where none is and the session is local (tests)."""
    folder = spark.conf.get(_SETTING, None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError(f"{_SETTING} must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder as Parquet and read it back.

    It cuts lineage, survives lost executors, is computed once, and Spark knows its size
    when it plans the joins that follow.
    """
    path = f"{shared_folder(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, for a column of an operator's own."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow(kind: str):
    """Make a function of Arrow arrays a function of columns; ``kind`` is what it returns."""
    def wrap(f):
        @functools.wraps(f)
        def of(*columns):
            return F.arrow_udf(f, kind)(*columns)
        return of
    return wrap
