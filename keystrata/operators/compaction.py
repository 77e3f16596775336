"""Flush, compaction, garbage collection of versions, and the choice of what to compact."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from keystrata._util import P, cut_lineage
from keystrata.operators.intervals import overlap_pairs, seeded
from keystrata.operators.ordered import ordered


@dataclass(frozen=True)
class LsmOptions:
    """Capacities in bytes. Level 0 may overlap; the levels above it don't."""

    l1_capacity: int = 1 << 20
    multiplier: int = 10
    l0_trigger: int = 4
    sst_capacity: int = 64 << 10
    pin_ttl_s: int = 15
    levels: int = 7
    compression: dict[int, str] = field(default_factory=lambda: {0: "none", 1: "none"})
    overlapping: tuple[int, ...] = (0,)

    def codec(self, level: int) -> str:
        if not 0 <= level < self.levels:
            raise ValueError(f"level {level} doesn't exist")
        return self.compression.get(level, "lz4_raw")


#: Bytes of an entry beside key and value (sequence and tag).
ENTRY_BYTES = 9


def entry_bytes() -> Column:
    return F.octet_length("user_key") + F.lit(ENTRY_BYTES) + F.coalesce(F.octet_length("value"), F.lit(0))


def collect_garbage(versions: DataFrame, watermark: int, mode: str = "safe", last_level: bool = False) -> DataFrame:
    """Versions that survive compaction at a watermark.

    ``safe`` keeps what any snapshot at or above the watermark can still read: all versions above it and, per key, the
    newest at or below it. ``compat`` keeps versions at or above the watermark and the newest of each key, which loses
    versions that snapshots between them need. Both are a filter and one aggregate with map-side combine. With
    ``last_level`` (safe only) tombstones at or below the watermark go too: nothing older is left for them to hide.
    """
    s = F.col("sequence")
    if mode == "safe":
        old = versions.where(s <= watermark).groupBy("user_key").agg(F.max(F.struct("sequence", "op", "value")).alias(f"{P}l"))
        kept = old.select("user_key", f"{P}l.*")
        if last_level:
            kept = kept.where("op != 'DELETE'")
        return versions.where(s > watermark).select("user_key", "sequence", "op", "value").unionByName(kept)
    if mode != "compat" or last_level:
        raise ValueError("mode is safe or compat; tombstones are dropped in safe mode only")
    newest = versions.groupBy("user_key").agg(F.max(F.struct("sequence", "op", "value")).alias(f"{P}l")).select("user_key", f"{P}l.*")
    return versions.where(s >= watermark).select("user_key", "sequence", "op", "value").unionByName(newest.where(s < watermark))


def partition_of(key: Column, points: list) -> Column:
    """Number of partition points at or below the key: compaction output is cut where it changes."""
    if not points:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(p) for p in sorted(points)]), lambda p: p <= key))


def split_by_size(versions: DataFrame, capacity: int, whole_keys: bool = False) -> DataFrame:
    """Adds ``chunk``: the run a version goes to when the sorted rows are cut each ``capacity`` bytes.

    With ``whole_keys`` sizes are summed per key first and all versions of a key share the chunk in which it begins.
    """
    size = entry_bytes().cast("bigint")
    if not whole_keys:
        cut = ordered(versions, [], [F.col("user_key"), -F.col("sequence")], sums={f"{P}upto": size})
        return cut.withColumn("chunk", F.call_function("div", F.col(f"{P}upto") - 1, F.lit(capacity))).drop(f"{P}upto")
    per = versions.groupBy("user_key").agg(F.sum(size).alias(f"{P}size"))
    upto = ordered(per, [], [F.col("user_key")], sums={f"{P}upto": F.col(f"{P}size")})
    first = upto.select("user_key", F.call_function("div", F.col(f"{P}upto") - F.col(f"{P}size"), F.lit(capacity)).alias("chunk"))
    return versions.join(first, "user_key")


def compact(
    runs: list[DataFrame], watermark: int, capacity: int, points: list | None = None, mode: str = "safe", last_level: bool = False,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Merge, filter, split again: ``(user_key, sequence, op, value, part, chunk)``, no key in two chunks.

    ``keep`` is a further filter, a function from frame to frame.
    """
    from keystrata.operators.merge import concat

    rows = collect_garbage(concat([r.select("user_key", "sequence", "op", "value") for r in runs]), watermark, mode, last_level)
    if keep is not None:
        rows = rows.transform(keep)
    return split_by_size(rows.withColumn("part", partition_of(F.col("user_key"), points or [])), capacity, whole_keys=True)


def sst_metadata(versions: DataFrame) -> DataFrame:
    """``(sst_id, level, first_key, last_key, n, data_size)`` of rows that carry ``sst_id`` and ``level``."""
    return versions.groupBy("sst_id", "level").agg(
        F.min("user_key").alias("first_key"), F.max("user_key").alias("last_key"), F.count(F.lit(1)).alias("n"), F.sum(entry_bytes().cast("bigint")).alias("data_size")
    )


def overstepped_levels(sizes: DataFrame, options: LsmOptions) -> DataFrame:
    """``(level, data_size, capacity, over)`` of all levels: over if larger than its capacity. Level 0 and the last never are."""
    level = F.col("level")
    capacity = F.when((level > 0) & (level < options.levels - 1), F.lit(options.l1_capacity) * F.pow(F.lit(options.multiplier), level - 1)).cast("bigint")
    return sizes.select("level", "data_size", capacity.alias("capacity"), F.coalesce(F.col("data_size") > capacity, F.lit(False)).alias("over"))


def overlaps(first: Column, last: Column, lo: Column, hi: Column) -> Column:
    """Inclusive overlap; a NULL ``hi`` is no upper end."""
    return ~((F.coalesce(first > hi, F.lit(False))) | (last < lo))


def _met(ranges: DataFrame, ssts: DataFrame) -> DataFrame:
    """``(range columns..., sst_id, first_key, last_key)`` of every run that overlaps a range, ends included."""
    lo, hi = ("start_key", "end_key") if "start_key" in ranges.columns else ("first_key", "last_key")
    runs = ssts.select("sst_id", "first_key", "last_key").where("first_key IS NOT NULL")
    return overlap_pairs(ranges.where(F.col(lo).isNotNull()), runs, (lo, hi), ("first_key", "last_key")).select(*[F.col(f"a.{c}").alias(c) for c in ranges.columns if c not in runs.columns], "b.*")


def l0_candidates(ssts: DataFrame, ranges: DataFrame, trigger: int, pinned: DataFrame | None = None) -> DataFrame:
    """``(grp, n)``: groups whose range overlaps at least ``trigger`` level-0 runs; groups that touch a pinned run are left out."""
    hit = _met(ranges.select("grp", "start_key", "end_key"), ssts.where("level = 0"))
    if pinned is None:
        held = F.lit(False)
    else:
        hit = hit.join(pinned.select("sst_id", F.lit(True).alias(f"{P}pin")).distinct(), "sst_id", "left")
        held = F.coalesce(F.col(f"{P}pin"), F.lit(False))
    return hit.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max(held).alias(f"{P}held")).where((F.col("n") >= trigger) & ~F.col(f"{P}held")).select("grp", "n")


def pick_runs(ssts: DataFrame, ranges: DataFrame, level: int, options: LsmOptions, seed: int, pinned: DataFrame | None = None) -> DataFrame:
    """``(grp, level, sst_id)``: what each group compacts from ``level`` and takes along from the next; the same for the same seed.

    Of level 0 a group takes all runs that its ranges overlap, if they are at least as many as the trigger. Of a level
    that doesn't overlap it takes, per range, a contiguous tenth of the runs the range overlaps, at least one, from a
    seeded place on. Of a level that overlaps it takes, per range, a seeded hundredth, at least one, and every run of the
    level that these overlap. Runs of the next level that lie in the hull of the picked ones come along if that level
    doesn't overlap. A group of which any run is pinned is left out.
    """
    at = ssts.where(F.col("level") == level)
    met = cut_lineage(_met(ranges.select("grp", "start_key", "end_key").where("grp IS NOT NULL"), at))
    if level == 0:
        enough = met.groupBy("grp").agg(F.count_distinct("sst_id").alias("n")).where(F.col("n") >= options.l0_trigger)
        base = met.join(enough, "grp", "left_semi")
    else:
        spread = level in options.overlapping
        place = seeded(seed, F.col("sst_id")) if spread else F.col("first_key")
        ranked = ordered(met, ["grp", "start_key"], [place, F.col("sst_id")], sums={f"{P}no": F.lit(1).cast("bigint")})
        n = F.col(f"{P}n")
        sized = ranked.join(met.groupBy("grp", "start_key").agg(F.count(F.lit(1)).alias(f"{P}n")), ["grp", "start_key"])
        take = F.greatest(F.call_function("div", n, F.lit(100 if spread else 10)), F.lit(1))
        first = F.lit(0) if spread else F.pmod(seeded(seed, F.col("grp"), F.col("start_key")), n - take + 1)
        base = sized.where((F.col(f"{P}no") > first) & (F.col(f"{P}no") <= first + take))
        if spread:
            base = base.select("grp", "sst_id", "first_key", "last_key").distinct()
            beside = overlap_pairs(base.withColumnsRenamed({"first_key": "lo", "last_key": "hi", "sst_id": "of"}), at.select("sst_id", "first_key", "last_key"), ("lo", "hi"), ("first_key", "last_key"))
            base = base.unionByName(beside.select("a.grp", "b.*"))
    base = cut_lineage(base.select("grp", "sst_id", "first_key", "last_key").distinct())
    picked = base.select("grp", F.lit(level).alias("level"), "sst_id")
    if level + 1 < options.levels and level + 1 not in options.overlapping:
        picked = picked.unionByName(next_level_inputs(base, ssts, level).select("grp", F.lit(level + 1).alias("level"), "sst_id"))
    if pinned is not None:
        picked = cut_lineage(picked)
        picked = picked.join(picked.join(pinned.select("sst_id").distinct(), "sst_id", "left_semi").select("grp").distinct(), "grp", "left_anti")
    return picked


def next_level_inputs(picked: DataFrame, ssts: DataFrame, level: int) -> DataFrame:
    """Runs of ``level + 1`` that the hull of each group's picked runs overlaps: ``(grp, sst_id)``.

    ``picked`` has ``grp, first_key, last_key``. Hulls are one row per group.
    """
    hulls = picked.groupBy("grp").agg(F.min("first_key").alias("start_key"), F.max("last_key").alias("end_key"))
    return _met(hulls, ssts.where(F.col("level") == level + 1)).select("grp", "sst_id")


def target_level(level: int, options: LsmOptions) -> tuple[int, str]:
    """The level a compaction of ``level`` writes to, and its compression."""
    to = min(level + 1, options.levels - 1)
    return to, options.codec(to)


def plans(picked: DataFrame, options: LsmOptions) -> DataFrame:
    """``(grp, level, target, codec, last_level, n)``: for the picks of ``pick_runs`` from a level, what the compaction writes, and from how many runs."""
    per = picked.groupBy("grp").agg(F.min("level").alias("level"), F.count(F.lit(1)).alias("n"))
    targets = [F.struct(F.lit(at).alias("level"), F.lit(to).alias("target"), F.lit(codec).alias("codec")) for at in range(options.levels) for to, codec in [target_level(at, options)]]
    known = per.sparkSession.range(1).select(F.inline(F.array(*targets)))
    return per.join(F.broadcast(known), "level").select("grp", "level", "target", "codec", (F.col("target") == options.levels - 1).alias("last_level"), "n")  # a row a level


def compaction_diff(first: DataFrame, level: int, second: DataFrame, made: DataFrame, target: int) -> DataFrame:
    """``(sst_id, level, op, data_size)``: deletes of both inputs and inserts of the outputs."""
    gone = [x.select("sst_id", F.lit(at).alias("level"), F.lit("DELETE").alias("op"), F.lit(0).cast("bigint").alias("data_size")) for x, at in ((first, level), (second, level + 1))]
    new = made.select("sst_id", F.lit(target).alias("level"), F.lit("INSERT").alias("op"), F.col("data_size").cast("bigint"))
    return gone[0].unionByName(gone[1]).unionByName(new)


def has_duplicates(ssts: DataFrame) -> DataFrame:
    """One row ``(duplicates)``: how many rows repeat an id."""
    per = ssts.groupBy("sst_id").agg((F.count(F.lit(1)) - 1).alias("more"))
    return per.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("duplicates"))


def pinned(pins: DataFrame, now: Column, ttl_s: int) -> DataFrame:
    """``(sst_id)``: pinned and not yet expired. Unpinning is a row's removal."""
    return pins.where(F.col("pinned_at") + F.expr(f"INTERVAL {int(ttl_s)} SECONDS") > now).select("sst_id").distinct()


def pin(ids: DataFrame, pins: DataFrame, now: Column, ttl_s: int) -> DataFrame:
    """Pins for all ids, or none at all if any of them is pinned."""
    held = pinned(pins, now, ttl_s)
    free = ids.join(held, "sst_id", "left_semi").limit(1).count() == 0
    return ids.select("sst_id", now.alias("pinned_at")) if free else ids.select("sst_id", now.alias("pinned_at")).limit(0)
