"""Key-range metadata, routing and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keystrata._util import P, checked_broadcast
from keystrata.operators.intervals import overlap_pairs, seeded
from keystrata.operators.ordered import ordered

#: Ranges up to which containment is compiled into a search tree of comparisons; beyond it keys and starts are sorted together.
TREE_RANGES = 128


def _tree(key: Column, ranges: list[tuple], lo: int, hi: int) -> Column:
    """Binary search over disjoint ranges sorted by start, as nested CASE expressions (whole-stage codegen)."""
    if hi - lo == 1:
        start, end, grp = ranges[lo]
        inside = F.lit(True)
        if start is not None:
            inside = key >= F.lit(start)
        if end is not None:
            inside = inside & (key < F.lit(end))
        return F.when(inside, F.lit(grp).cast("bigint"))
    mid = (lo + hi) // 2
    return F.when(key < F.lit(ranges[mid][0]), _tree(key, ranges, lo, mid)).otherwise(_tree(key, ranges, mid, hi))


def route(keys: DataFrame, key: str, ranges: DataFrame, out: str = "grp") -> DataFrame:
    """Adds the group whose ``[start_key, end_key)`` holds the key, NULL if none does or the key is NULL.

    A NULL ``end_key`` means no upper end; a NULL ``start_key`` no lower one. The ranges must be disjoint. Up to
    ``TREE_RANGES`` of them become a balanced tree of comparisons, about log2(n) per row and no join at all; with more,
    keys and range starts are sorted together and each key takes the last start before it.
    """
    few = ranges.select("start_key", "end_key", "grp").where(F.col("grp").isNotNull()).limit(TREE_RANGES + 1).collect()
    if not few:
        return keys.withColumn(out, F.lit(None).cast("bigint"))
    if len(few) <= TREE_RANGES:
        sorted_ = sorted(((r[0], r[1], r[2]) for r in few), key=lambda r: (r[0] or "").encode())
        return keys.withColumn(out, _tree(F.col(key), sorted_, 0, len(sorted_)))
    range_ = F.struct(F.col("end_key").alias("end"), F.col("grp").alias("grp")).alias(f"{P}r")
    starts = ranges.where(F.col("grp").isNotNull()).select(F.coalesce("start_key", F.lit("")).alias(f"{P}k"), F.lit(0).alias(f"{P}o"), range_)
    rows = keys.withColumn(f"{P}k", F.col(key)).withColumn(f"{P}o", F.lit(1))
    merged = ordered(rows.unionByName(starts, allowMissingColumns=True), [], [F.col(f"{P}k"), F.col(f"{P}o")], lasts={f"{P}last": F.col(f"{P}r")})
    inside = F.col(key).isNotNull() & (F.col(f"{P}last.end").isNull() | (F.col(key) < F.col(f"{P}last.end")))
    got = merged.where(F.col(f"{P}o") == 1).withColumn(out, F.when(inside, F.col(f"{P}last.grp")))
    return got.drop(f"{P}k", f"{P}o", f"{P}r", f"{P}last")


def leaders(ranges: DataFrame) -> DataFrame:
    """``(grp, leader, leader_node)``: a leader of 0 or NULL, or one outside ``raft_nodes``, is unknown (NULL)."""
    known = F.when(F.col("leader") != 0, F.col("leader"))
    node = F.try_element_at(F.col("raft_nodes"), known)
    return ranges.select("grp", F.when(node.isNotNull(), known).alias("leader"), node.alias("leader_node"))


def route_to_leader(keys: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """Adds ``grp, leader, leader_node``; where the group has no known leader the request must wait (NULL leader)."""
    return route(keys, key, ranges).join(checked_broadcast(leaders(ranges)), "grp", "left")


def refresh(ranges: DataFrame, updates: DataFrame) -> DataFrame:
    """The key ranges after updates, which carry a ``version``: the newest of each group counts, what the router had if there is none.

    Updates of a group that tie in version are taken to be the same.
    """
    both = ranges.withColumn("version", F.lit(None).cast("bigint")).unionByName(updates.select(*ranges.columns, F.col("version").cast("bigint")))
    newest = F.max_by(F.struct(*[c for c in ranges.columns if c != "grp"]), F.coalesce("version", F.lit(-(2**63))))
    return both.where("grp IS NOT NULL").groupBy("grp").agg(newest.alias(f"{P}r")).select("grp", f"{P}r.*").select(*ranges.columns)


def key_range_conflicts(ranges: DataFrame, inclusive: bool = True) -> DataFrame:
    """``(a, b)``: pairs of groups, a < b, whose ranges overlap.

    ``inclusive`` treats the end as part of the range, so adjacent ranges conflict; otherwise they don't. A NULL end is no
    upper end, a NULL start no lower one.
    """
    r = ranges.select("grp", "start_key", "end_key")
    pairs = overlap_pairs(r, r, ("start_key", "end_key"), ("start_key", "end_key"), inclusive)
    return pairs.where("a.grp < b.grp").select(F.col("a.grp").alias("a"), F.col("b.grp").alias("b")).distinct()


def key_range_violations(new: DataFrame, present: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(grp, problem)`` of key ranges to be added: GROUP_EXISTS, RANGE_OVERLAPS, RAFT_NODE_EXISTS, NODE_UNKNOWN.

    The overlap test is inclusive. ``nodes`` lists the known nodes in ``node_id``.
    """
    had = present.select("grp").distinct()
    exists = new.join(had, "grp", "left_semi").select("grp", F.lit("GROUP_EXISTS").alias("problem"))
    both = present.select("grp", "start_key", "end_key").unionByName(new.join(had, "grp", "left_anti").select("grp", "start_key", "end_key"))
    pairs = key_range_conflicts(both)
    fresh = new.select("grp").distinct()
    hit = pairs.select(F.explode(F.array("a", "b")).alias("grp")).distinct().join(fresh, "grp", "left_semi")
    overlaps = hit.select("grp", F.lit("RANGE_OVERLAPS").alias("problem"))
    wants = new.select("grp", F.explode("raft_nodes").alias("raft_node", "node_id"))
    taken = present.select(F.explode("raft_nodes").alias("raft_node", f"{P}n")).select("raft_node").distinct()
    again = wants.join(taken, "raft_node", "left_semi").select("grp", F.lit("RAFT_NODE_EXISTS").alias("problem"))
    lost = wants.join(nodes.select("node_id").distinct(), "node_id", "left_anti").select("grp", F.lit("NODE_UNKNOWN").alias("problem"))
    return exists.unionByName(overlaps).unionByName(again).unionByName(lost).distinct()


def raft_states(reports: DataFrame) -> DataFrame:
    """``(raft_node, at, is_leader)``: the last report of each raft node stands."""
    last = reports.where(F.col("raft_node").isNotNull()).groupBy("raft_node").agg(F.max(F.struct("at", "is_leader")).alias("last"))
    return last.select("raft_node", "last.at", "last.is_leader")


def live_leaders(ranges: DataFrame, reports: DataFrame, now: Column, ttl_s: int = 10) -> DataFrame:
    """``(grp, leader)``: the raft node of the group with the newest report of leading, at most ``ttl_s`` old, else 0.

    ``reports`` has ``raft_node, is_leader, at``. The last report of a raft node stands. Where several claim to lead,
    the newest report, then the larger raft node, wins.
    """
    fresh = raft_states(reports).where(F.col("is_leader") & (F.col("at") >= now - F.expr(f"INTERVAL {int(ttl_s)} SECONDS")))
    of = ranges.select("grp", F.explode_outer(F.map_keys("raft_nodes")).alias("raft_node"))
    best = of.join(fresh, "raft_node", "left").groupBy("grp").agg(F.max(F.when(F.col("at").isNotNull(), F.struct("at", "raft_node"))).alias("b"))
    return best.select("grp", F.coalesce("b.raft_node", F.lit(0)).cast("bigint").alias("leader"))


def live_nodes(reports: DataFrame, node: str, now: Column, ttl_s: int) -> DataFrame:
    """Nodes whose newest heartbeat is at most ``ttl_s`` old; a pick among them is up to the caller."""
    last = reports.where(F.col(node).isNotNull()).groupBy(node).agg(F.max("at").alias("at"))
    return last.where(F.col("at") >= now - F.expr(f"INTERVAL {int(ttl_s)} SECONDS"))


def pick_live_node(reports: DataFrame, node: str, now: Column, ttl_s: int, seed: int) -> DataFrame:
    """One live node, chosen by a seeded hash of its name (the same for the same seed)."""
    return live_nodes(reports, node, now, ttl_s).orderBy(seeded(seed, F.col(node)), node).limit(1)


def add_nodes(present: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The membership after adding, and the rejected rows (already present). Repeated new rows count once."""
    fresh = new.dropDuplicates(["node_id"]).join(present.select("node_id"), "node_id", "left_anti")
    return present.unionByName(fresh), new.join(present.select("node_id"), "node_id", "left_semi")


def ranges_per_group(ranges: DataFrame) -> DataFrame:
    """``(grp, no, start_key, end_key)``: each group's ranges numbered from 1 in order of their starts."""
    return ordered(ranges.select("grp", "start_key", "end_key"), ["grp"], [F.col("start_key"), F.col("end_key")], sums={"no": F.lit(1).cast("bigint")})


def all_in_range(keys: DataFrame, key: str, ranges: DataFrame, request: str) -> DataFrame:
    """``(request, one_range)``: whether all keys of a request lie in one and the same range."""
    routed = route(keys.where(F.col(key).isNotNull()), key, ranges)
    g = F.col("grp")
    one = (F.min(g) == F.max(g)) & (F.count(g) == F.count(F.lit(1)))
    return routed.groupBy(request).agg(F.coalesce(one, F.lit(False)).alias("one_range"))
