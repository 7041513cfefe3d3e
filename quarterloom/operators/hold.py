"""Tables that a plan reads several times."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def hold(df: DataFrame) -> DataFrame:
    """``df``, evaluated once.

    Where the session names a checkpoint folder the table is written there, which also
    cuts its lineage and outlives executors. Elsewhere it is cached and recomputed if lost.
    """
    if df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir"):
        return df.checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK)
