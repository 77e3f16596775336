"""Puts and deletes as new versions, and the in-memory table they would go through: rotation, order, flush."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keystrata._util import P
from keystrata.operators.compaction import entry_bytes, sst_metadata, split_by_size
from keystrata.operators.ordered import ordered

#: What a table entry takes beside key and value, and the share kept for its links.
ENTRY_OVERHEAD = 8 + 4 * 20 + 8


def put(versions: DataFrame, rows: DataFrame, sequence: int) -> DataFrame:
    """The versions with ``rows (user_key, value)`` put under one new sequence; of repeated keys the greatest value.

    Raises if the sequence isn't above all present ones, or if a key or value is NULL. An empty value is a value.
    """
    if rows.where(F.col("user_key").isNull() | F.col("value").isNull()).limit(1).count():
        raise ValueError("a put needs a key and a value")
    _after(versions, sequence)
    new = rows.groupBy("user_key").agg(F.max("value").alias("value"))
    return versions.unionByName(new.select("user_key", F.lit(sequence).cast("bigint").alias("sequence"), F.lit("PUT").alias("op"), "value"))


def delete(versions: DataFrame, keys: DataFrame, sequence: int) -> DataFrame:
    """The versions with a tombstone for each of ``keys (user_key)`` under one new sequence, present or not."""
    _after(versions, sequence)
    gone = keys.where(F.col("user_key").isNotNull()).select("user_key").distinct()
    return versions.unionByName(gone.select("user_key", F.lit(sequence).cast("bigint").alias("sequence"), F.lit("DELETE").alias("op"), F.lit(None).cast("string").alias("value")))


def _after(versions: DataFrame, sequence: int) -> None:
    last = versions.agg(F.max("sequence")).first()[0]
    if last is not None and sequence <= last:
        raise ValueError(f"sequence {sequence} doesn't follow {last}")


def rotate(rows: DataFrame, order: list[Column], capacity: int) -> DataFrame:
    """Adds ``table``: the memory table a row goes to when, in ``order``, tables are cut each ``capacity`` bytes."""
    size = (entry_bytes() + ENTRY_OVERHEAD).cast("bigint")
    got = ordered(rows, [], order, sums={f"{P}upto": size})
    return got.withColumn("table", F.call_function("div", F.col(f"{P}upto") - 1, F.lit(capacity))).drop(f"{P}upto")


def oldest_immutable(tables: DataFrame) -> DataFrame:
    """The rows of the table to be flushed next: the lowest of ``rotate`` that isn't the one still written to, if there is any."""
    ends = tables.agg(F.min("table").alias(f"{P}lo"), F.max("table").alias(f"{P}hi"))
    at = F.broadcast(ends)  # one row
    return tables.join(at, (F.col("table") == F.col(f"{P}lo")) & (F.col(f"{P}lo") < F.col(f"{P}hi"))).select(*tables.columns)


def out_of_order(rows: DataFrame, group: list[str], order: list[Column], value: str) -> DataFrame:
    """Rows whose ``value`` isn't greater than that of the row before: writes that break a group's order."""
    got = ordered(rows, group, order, lags={"previous": F.col(value)})
    return got.where(F.col(value) <= F.col("previous"))


def flush(versions: DataFrame, capacity: int, first_id: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the level-0 run they are flushed to, and the runs' metadata, ids counting from ``first_id``.

    Runs are cut by size in full-key order; versions of one key may lie in two runs.
    """
    cut = split_by_size(versions, capacity).withColumn("sst_id", F.col("chunk") + first_id).withColumn("level", F.lit(0)).drop("chunk")
    return cut, sst_metadata(cut)
