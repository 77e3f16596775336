"""Multi-version reads: visibility at a snapshot, point and range reads, ordered iteration.

A versions frame has ``user_key, sequence, op (PUT or DELETE), value``; a DELETE is a tombstone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keystrata._util import P
from keystrata.operators.ordered import ordered

LATEST = 2**63 - 1
#: Versions of the first page of a seek.
SEEK_ROWS = 1024


def visible(versions: DataFrame, snapshot: int = LATEST) -> DataFrame:
    """The newest version of each key with ``sequence <= snapshot``, tombstones included.

    An aggregate, not a window: versions of a hot key are combined on the map side.
    """
    v = versions.where((F.col("sequence") <= snapshot) & F.col("user_key").isNotNull())
    last = v.groupBy("user_key").agg(F.max(F.struct("sequence", "op", "value")).alias(f"{P}l"))
    return last.select("user_key", f"{P}l.*")


def live(versions: DataFrame, snapshot: int = LATEST) -> DataFrame:
    """Keys alive at a snapshot with their value; a tombstone hides everything older."""
    return visible(versions, snapshot).where("op = 'PUT'").drop("op")


def scan(versions: DataFrame, snapshot: int = LATEST, lo=None, hi=None, backward: bool = False) -> DataFrame:
    """Live keys of ``[lo, hi)`` in key order or its reverse. The bounds are applied before versions are resolved."""
    v = versions
    if lo is not None:
        v = v.where(F.col("user_key") >= F.lit(lo))
    if hi is not None:
        v = v.where(F.col("user_key") < F.lit(hi))
    return live(v, snapshot).orderBy(F.desc("user_key") if backward else F.asc("user_key"))


def get(versions: DataFrame, keys: DataFrame, snapshot: int = LATEST) -> DataFrame:
    """``(user_key, value, found)`` for each distinct asked key; a key that is absent or deleted has NULL and false.

    An empty value is a value: it differs from a missing one by ``found``.
    """
    asked = keys.select("user_key").where(F.col("user_key").isNotNull()).distinct()
    near = live(versions.join(asked, "user_key", "left_semi"), snapshot)
    return asked.join(near.withColumn("found", F.lit(True)), "user_key", "left").select("user_key", "value", F.coalesce("found", F.lit(False)).alias("found"))


def get_as_of(versions: DataFrame, reads: DataFrame, read_id: list[str]) -> DataFrame:
    """``(read_id..., user_key, at, value)`` for reads at their own snapshot ``at`` (0 or NULL: latest).

    An as-of lookup: reads and versions of a key are merged in order of sequence and each read takes the last version
    before it, by the ordered operator, so a hot key is spread over tasks.
    """
    r = reads.where(F.col("user_key").isNotNull()).select(
        *read_id, "user_key", F.col("at"), F.when(F.col("at") > 0, F.col("at")).otherwise(F.lit(LATEST)).alias(f"{P}s"), F.lit(1).alias(f"{P}k")
    )
    v = versions.select("user_key", F.col("sequence").alias(f"{P}s"), F.lit(0).alias(f"{P}k"), F.struct("op", "value").alias(f"{P}ver"))
    both = v.unionByName(r, allowMissingColumns=True)
    got = ordered(both, ["user_key"], [F.col(f"{P}s"), F.col(f"{P}k")], lasts={f"{P}last": F.col(f"{P}ver")})
    value = F.when(F.col(f"{P}last.op") == "PUT", F.col(f"{P}last.value"))
    return got.where(F.col(f"{P}k") == 1).select(*read_id, "user_key", "at", value.alias("value"))


def seek(versions: DataFrame, key=None, snapshot: int = LATEST, backward: bool = False, strict: bool = False) -> DataFrame:
    """The first live key at or after ``key`` (at or before it, backward), or the first or last of all without one.

    At most one row ``(user_key, sequence, value, found)``. ``found`` says whether a version of exactly ``key`` is
    visible, alive or deleted, and doesn't depend on where the seek lands. ``strict`` leaves out the key itself.

    The search goes by pages: the nearest ``SEEK_ROWS`` versions fix a range of keys (a top-n, no shuffle), only that
    range is resolved, and only if all of it is dead does a larger page follow.
    """
    k, found = F.col("user_key"), False
    v = versions.where((F.col("sequence") <= snapshot) & k.isNotNull())
    if key is not None:
        found = v.where(k == F.lit(key)).limit(1).count() > 0
        at = F.lit(key)
        v = v.where((k < at if strict else k <= at) if backward else (k > at if strict else k >= at))
    order, rows = (F.desc if backward else F.asc)("user_key"), SEEK_ROWS
    while True:
        page = v.select("user_key").orderBy(order).limit(rows)
        n, edge = page.agg(F.count(F.lit(1)), F.min("user_key") if backward else F.max("user_key")).first()
        near = v.where(F.lit(False)) if edge is None else v.where(k >= F.lit(edge) if backward else k <= F.lit(edge))
        first = live(near).orderBy(order).limit(1).withColumn("found", F.lit(found))
        if n < rows or first.count():
            return first
        v, rows = v.where(k < F.lit(edge) if backward else k > F.lit(edge)), rows * 16


def seek_found(versions: DataFrame, key, snapshot: int = LATEST) -> DataFrame:
    """One row ``(found)``: a version of exactly the key is visible, alive or deleted."""
    hit = versions.where((F.col("user_key") == F.lit(key)) & (F.col("sequence") <= snapshot))
    return hit.agg((F.count(F.lit(1)) > 0).alias("found"))


def neighbours(live_keys: DataFrame) -> DataFrame:
    """``(user_key, prev_key, next_key)`` among live keys."""
    k = live_keys.select("user_key")
    return ordered(k, [], [F.col("user_key")], lags={"prev_key": F.col("user_key")}, leads={"next_key": F.col("user_key")})


def intervals(versions: DataFrame) -> DataFrame:
    """``(user_key, sequence, op, next_sequence)``: a version is visible for snapshots in [sequence, next_sequence)."""
    return ordered(versions.select("user_key", "sequence", "op"), ["user_key"], [F.col("sequence")], leads={"next_sequence": F.col("sequence")})


def snapshot(versions: DataFrame) -> DataFrame:
    """One row ``(sequence)``: a handle on the present state, 0 for an empty store."""
    return versions.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("sequence"))
