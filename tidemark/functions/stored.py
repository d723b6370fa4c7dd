"""Frames that several results read, computed once."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tidemark.session import checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """A reliable checkpoint where the session names a shared folder, else executor storage.

    The checkpoint cuts lineage and survives lost executors. Storage is recomputed where it is lost.
    """
    if checkpoint_dir(df.sparkSession):
        return df.checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK)
