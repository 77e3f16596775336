"""Merging sorted runs, level-wise reads, and rows of one key and sequence that contradict each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from keystrata._util import P

def merge(runs: list[DataFrame], backward: bool = False) -> DataFrame:
    """All rows of the runs in full-key order (key, newest first) or its reverse; duplicates stay."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)
    k, s = F.col("user_key"), F.col("sequence")
    return every.orderBy(*((k.desc(), s.asc()) if backward else (k.asc(), s.desc())))


def concat(runs: list[DataFrame]) -> DataFrame:
    """Rows of ordered runs that don't overlap, run after run: partitions follow each other, nothing is sorted again."""
    return reduce(lambda a, b: a.unionByName(b), runs)


def level_first(versions: DataFrame, snapshot: int) -> DataFrame:
    """Per key the newest visible version of the lowest level that has one, even if it is a tombstone."""
    v = versions.where(F.col("sequence") <= snapshot)
    best = v.groupBy("user_key").agg(F.max(F.struct((-F.col("level")).alias("up"), "sequence", "op", "value")).alias(f"{P}b"))
    return best.select("user_key", (-F.col(f"{P}b.up")).cast("int").alias("level"), f"{P}b.sequence", f"{P}b.op", f"{P}b.value")


def first_writer(rows: DataFrame, order: str) -> DataFrame:
    """Of rows with the same key and sequence, the first written; later ones were rejected or are copies."""
    same = rows.groupBy("user_key", "sequence").agg(F.min(F.struct(order, "op", "value")).alias(f"{P}f"))
    return same.select("user_key", "sequence", f"{P}f.*")


def write_conflicts(rows: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """``(keys..., contents)`` where one key and version was written with more than one content."""
    many = rows.groupBy(*keys).agg(F.min(content).alias(f"{P}a"), F.max(content).alias(f"{P}b"), F.count(F.lit(1)).alias("writes"))
    return many.where(F.col(f"{P}a") != F.col(f"{P}b")).select(*keys, "writes")


def stats(rows: DataFrame) -> DataFrame:
    """One row ``(entries, keys_from, keys_to)``: length and ends of a run; an empty run has 0 and NULLs."""
    return rows.agg(F.count(F.lit(1)).alias("entries"), F.min("user_key").alias("keys_from"), F.max("user_key").alias("keys_to"))
