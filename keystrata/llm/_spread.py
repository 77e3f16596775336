"""Spreading few input partitions over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """The frame in at least as many partitions as there are cores.

    A large table has more splits than that and comes back as it is; a table in a few splits, which would keep most
    cores idle during per-row Python work, is dealt out once. A frame that comes out of a shuffle has the session's
    partitions and is left alone.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
