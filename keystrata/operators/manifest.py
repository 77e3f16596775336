"""Manifest algebra: folding version diffs, picking runs by key range, checking that levels don't overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keystrata._util import P, checked_broadcast
from keystrata.operators.compaction import overlaps
from keystrata.operators.ordered import ordered


def fold(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., data_size)`` of the runs present after all diffs: inserted more often than deleted.

    Takes distinct diffs. The size is that of the last insert. Deletes of runs that were never inserted leave nothing.
    """
    sign = F.when(F.col("op") == "INSERT", 1).when(F.col("op") == "DELETE", -1).otherwise(0)
    size = F.max(F.when(F.col("op") == "INSERT", F.struct("version_id", "op_idx", "data_size")))["data_size"]
    return diffs.groupBy(*keys).agg(F.sum(sign).alias(f"{P}n"), size.alias("data_size")).where(F.col(f"{P}n") > 0).drop(f"{P}n")


def unknown_deletes(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that were deleted more often than inserted: an invalid diff."""
    sign = F.when(F.col("op") == "INSERT", 1).when(F.col("op") == "DELETE", -1).otherwise(0)
    return diffs.groupBy(*keys).agg(F.sum(sign).alias(f"{P}n")).where(F.col(f"{P}n") < 0).select(*keys)


def gaps(diffs: DataFrame, stream: list[str]) -> DataFrame:
    """``(stream..., version_id, previous)`` of versions whose predecessor is missing."""
    ids = diffs.select(*stream, "version_id").distinct()
    with_prev = ordered(ids, stream, [F.col("version_id")], lags={"previous": F.col("version_id")})
    return with_prev.where(F.col("version_id") != F.col("previous") + 1)


def diffs_from(diffs: DataFrame, start: int, n: int) -> DataFrame:
    """The diffs of at most ``n`` versions from ``start`` on, in order; raises if ``start`` has been squashed away."""
    oldest = diffs.agg(F.min("version_id")).first()[0]
    if oldest is None or start < oldest:
        raise ValueError(f"version {start} has expired")
    chosen = diffs.where(F.col("version_id") >= start).select("version_id").distinct().orderBy("version_id").limit(n)
    return diffs.join(F.broadcast(chosen) if n <= 100_000 else chosen, "version_id", "left_semi").orderBy("version_id", "op_idx")


def diffs_from_each(diffs: DataFrame, start: int, n: int, stream: list[str]) -> DataFrame:
    """The diffs of at most ``n`` versions from ``start`` on of every stream. A stream squashed beyond ``start`` goes on where it begins."""
    ids = diffs.where(F.col("version_id") >= start).select(*stream, "version_id").distinct()
    chosen = ordered(ids, stream, [F.col("version_id")], sums={f"{P}no": F.lit(1).cast("bigint")}).where(F.col(f"{P}no") <= n)
    return diffs.join(chosen.select(*stream, "version_id"), [*stream, "version_id"], "left_semi")


def squash(diffs: DataFrame, version: int) -> DataFrame:
    """The diffs that are left when those below a version have been folded away."""
    return diffs.where(F.col("version_id") >= version)


def latest_version(diffs: DataFrame, stream: list[str]) -> DataFrame:
    return diffs.groupBy(*stream).agg(F.coalesce(F.max("version_id"), F.lit(0)).alias("version_id"))


def level_sizes(ssts: DataFrame, keys: list[str]) -> DataFrame:
    return ssts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("data_size"), F.lit(0)).alias("data_size"))


def next_diff(new: DataFrame, diffs: DataFrame, version: int | None = None) -> DataFrame:
    """``new`` rows with the id of the next version; with ``version`` it must be exactly that (sync mode)."""
    latest = diffs.agg(F.coalesce(F.max("version_id"), F.lit(0))).first()[0]
    if version is not None and latest and version != latest + 1:
        raise ValueError(f"version {version} doesn't follow {latest}")
    return new.withColumn("version_id", F.lit(latest + 1 if version is None else version))


def insert_l0(new: DataFrame, diffs: DataFrame, next_wanted: int, stream: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The manifest after new level-0 runs (``stream..., sst_id, data_size``), and all diffs from ``next_wanted`` on.

    The runs make the next version of their stream, 1 where the stream has none yet.
    """
    numbered = ordered(new.select(*stream, "sst_id", "data_size"), list(stream), [F.col("sst_id")], sums={f"{P}no": F.lit(1)})
    rows = numbered.select(*stream, (F.col(f"{P}no").cast("int") - 1).alias("op_idx"), "sst_id", "data_size")
    if stream:
        latest = latest_version(diffs, list(stream)).withColumnRenamed("version_id", f"{P}v")
        rows = rows.join(latest, list(stream), "left").withColumn("version_id", F.coalesce(f"{P}v", F.lit(0)) + 1)
    else:
        rows = next_diff(rows, diffs)
    added = rows.select(*stream, "version_id", "op_idx", "sst_id", F.lit(0).alias("level"), F.lit("INSERT").alias("op"), "data_size")
    after = diffs.select(*stream, "version_id", "op_idx", "sst_id", "level", "op", "data_size").unionByName(added)
    return after, after.where(F.col("version_id") >= next_wanted)


def pick_by_range(ssts: DataFrame, lo, hi) -> DataFrame:
    """``(level, sst_id)`` of runs that overlap ``[lo, hi]``, both inclusive."""
    return ssts.where(overlaps(F.col("first_key"), F.col("last_key"), F.lit(lo), F.lit(hi))).select("level", "sst_id")


def pick_by_key(ssts: DataFrame, key) -> DataFrame:
    """As ``pick_by_range`` for one key."""
    return pick_by_range(ssts, key, key)


def pick_by_ids(ssts: DataFrame, ids: list[int]) -> DataFrame:
    """Runs that overlap the hull of the named runs; none without ids, or for unknown ones."""
    lo, hi = ssts.where(F.col("sst_id").isin(*ids) if ids else F.lit(False)).agg(F.min("first_key"), F.max("last_key")).first()
    return pick_by_range(ssts if lo is not None else ssts.limit(0), lo or "", hi or "")


def listed(picked: DataFrame, levels: int) -> DataFrame:
    """``(level, picked)`` for every level: the picked ids as one sorted list. For picks known to be few."""
    lists = picked.groupBy("level").agg(F.sort_array(F.collect_list("sst_id")).alias("picked"))
    every = picked.sparkSession.range(levels).select(F.col("id").cast("int").alias("level"))
    return every.join(lists, "level", "left").select("level", F.coalesce("picked", F.array().cast("array<bigint>")).alias("picked"))


def overlap_counts(ssts: DataFrame) -> DataFrame:
    """``(sst_id, n)``: how many other runs overlap each, inclusive.

    Two runs don't overlap if one ends before the other begins. Both numbers are running counts over the sorted ends
    and beginnings, so the work is a sort, not a join of all pairs.
    """
    total = ssts.count()
    begins = ssts.select(F.col("first_key").alias("k"), F.lit(1).alias("o"), "sst_id", F.lit(1).alias("b"), F.lit(0).alias("e"))
    ends = ssts.select(F.col("last_key").alias("k"), F.lit(2).alias("o"), "sst_id", F.lit(0).alias("b"), F.lit(1).alias("e"))
    run = ordered(begins.unionByName(ends), [], [F.col("k"), F.col("o"), F.col("sst_id")], sums={"begun": F.col("b"), "ended": F.col("e")})
    before = F.max(F.when(F.col("o") == 1, F.col("ended")))
    after = F.lit(total) - F.max(F.when(F.col("o") == 2, F.col("begun")))
    return run.groupBy("sst_id").agg((F.lit(total) - 1 - before - after).alias("n"))


def non_overlap(ssts: DataFrame) -> DataFrame:
    """``(level, ok)``: whether a level's runs are disjoint, each beginning after all before it have ended."""
    prev = ordered(ssts.select("level", "first_key", "last_key", "sst_id"), ["level"], [F.col("first_key"), F.col("sst_id")], lags={"before": F.col("last_key")})
    fine = F.col("before").isNull() | (F.col("first_key") > F.col("before"))
    return prev.groupBy("level").agg(F.min(fine).alias("ok"))


def overlap_violations(ssts: DataFrame) -> DataFrame:
    """``(level, sst_id)`` of runs of a level that begin at or before the end of the run before them."""
    prev = ordered(ssts.select("level", "first_key", "last_key", "sst_id"), ["level"], [F.col("first_key"), F.col("sst_id")], lags={"before": F.col("last_key")})
    return prev.where(F.col("first_key") <= F.col("before")).select("level", "sst_id")


def diffs_for(wanted: DataFrame, diffs: DataFrame, stream: list[str], most: int = 10) -> DataFrame:
    """``(stream..., member..., version_id)``: the next ``most`` recorded versions for each member of ``wanted``.

    ``wanted`` has the stream's columns, further member columns and ``next_version_id``. Versions are numbered per
    stream in order, so "the next few" is a range of numbers and a version meets only members it is for.
    """
    ids = diffs.select(*stream, "version_id").distinct()
    numbered = ordered(ids, stream, [F.col("version_id")], sums={f"{P}no": F.lit(1).cast("bigint")})
    member = [c for c in wanted.columns if c not in (*stream, "next_version_id")]
    merged = numbered.unionByName(
        wanted.select(*stream, *member, F.col("next_version_id").alias("version_id"), F.lit(0).cast("bigint").alias(f"{P}no")).where("version_id IS NOT NULL"), allowMissingColumns=True
    )
    # a member stands before the version it wants; the next number at or after it is where its range begins
    at = ordered(merged, stream, [F.col("version_id"), F.col(f"{P}no")], next_mins={f"{P}from": F.when(F.col(f"{P}no") > 0, F.col(f"{P}no"))})
    asks = at.where(F.col(f"{P}no") == 0).where(F.col(f"{P}from").isNotNull())
    each = asks.select(*stream, *member, F.explode(F.sequence(F.col(f"{P}from"), F.col(f"{P}from") + (most - 1))).alias(f"{P}no"))
    return each.join(numbered, [*stream, f"{P}no"]).select(*stream, *member, "version_id")


def watermark(reports: DataFrame, node: list[str]) -> DataFrame:
    """One row ``(watermark)``: the least of the nodes' highest reported watermarks; below it no node reads any more."""
    per = reports.where(F.col("watermark").isNotNull()).groupBy(*node).agg(F.max("watermark").alias("w"))
    return per.agg(F.min("w").alias("watermark"))


def advance_watermark(current: int, new: int) -> int:
    if new < current:
        raise ValueError(f"watermark {new} lies before {current}")
    return new


def with_level_options(ssts: DataFrame, options: DataFrame) -> DataFrame:
    """Adds each run's level options; raises if a level is unknown."""
    side = checked_broadcast(options)
    if ssts.select("level").distinct().join(side, "level", "left_anti").limit(1).count():
        raise ValueError("a level doesn't exist")
    return ssts.join(side, "level")


