"""Requests: evaluation of their ops, classification, sequence numbers, redirects, batching of commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keystrata._util import P, checked_broadcast, spelled
from keystrata.operators.ordered import ordered
from keystrata.operators.reads import get_as_of

WRITES = ("PUT", "DELETE")


def distinct_ops(ops: DataFrame) -> DataFrame:
    """One row per ``(request_id, op_idx)``: copies delivered again fall together, with the first arrival; op names as spelled."""
    rows = ops.where(F.col("request_id").isNotNull() & F.col("op_idx").isNotNull())
    one = rows.groupBy("request_id", "op_idx").agg(
        F.min(F.struct("arrived_at", "op_type", "user_key", "op_value", "sequence", "target")).alias(f"{P}o")
    )
    o = one.select("request_id", "op_idx", f"{P}o.*")
    return o.withColumn("op_type", spelled(F.col("op_type")))


def classify(ops: DataFrame) -> DataFrame:
    """``(request_id, kind, read_only, n_ops, target, arrived_at)`` of each request.

    ``kind`` is NONE, or the one op type beside NONE, or TXN for several; a request is read-only if it has no PUT or DELETE.
    """
    types = F.array_remove(F.collect_set("op_type"), "NONE")
    kind = F.when(F.size(types) == 0, "NONE").when(F.size(types) == 1, types[0]).otherwise("TXN")
    read_only = F.max(F.when(F.col("op_type").isin(*WRITES), 1).otherwise(0)) == 0
    return ops.groupBy("request_id").agg(kind.alias("kind"), read_only.alias("read_only"), F.count(F.lit(1)).alias("n_ops"), F.max("target").alias("target"), F.min("arrived_at").alias("arrived_at"))


def assign_sequences(requests: DataFrame, node: str, arrival: list[str], base: int = 0) -> DataFrame:
    """Adds ``assigned``: per node in order of arrival a write takes the next number, a read the present one."""
    w = F.when(F.col("read_only"), F.lit(0)).otherwise(F.lit(1)).cast("bigint")
    got = ordered(requests, [node], [F.col(c) for c in arrival], sums={"assigned": w})
    return got.withColumn("assigned", F.col("assigned") + F.lit(base))


def timestamps(calls: DataFrame, arrival: list[str]) -> DataFrame:
    """Adds ``tso``: 2, 3, ... in order of arrival, without gaps."""
    got = ordered(calls, [], [F.col(c) for c in arrival], sums={"tso": F.lit(1).cast("bigint")})
    return got.withColumn("tso", F.col("tso") + 1)


def redirects(requests: DataFrame, target: str, ranges: DataFrame) -> DataFrame:
    """Adds ``status``: OK if the target is the leader of its group, else REDIRECT (unknown or other node, no leader)."""
    lead = checked_broadcast(ranges.where(F.col("leader") != 0).select(F.col("leader").alias(f"{P}l")).distinct())
    got = requests.join(lead, F.col(target) == F.col(f"{P}l"), "left")
    return got.withColumn("status", F.when(F.col(f"{P}l").isNull(), "REDIRECT").otherwise("OK")).drop(f"{P}l")


def evaluate(ops: DataFrame, versions: DataFrame) -> DataFrame:
    """``(request_id, op_idx, op_type, result)``: each op's answer against the versions.

    A GET reads at its own positive ``sequence``, else the latest; a SNAPSHOT answers its sequence as text; a PUT echoes
    its value; NONE and DELETE answer NULL.
    """
    reads = ops.where("op_type = 'GET'").select("request_id", "op_idx", "user_key", F.col("sequence").alias("at"))
    got = get_as_of(versions, reads, ["request_id", "op_idx"]).select("request_id", "op_idx", F.lit("GET").alias("op_type"), F.col("value").alias("result"))
    keyless = ops.where("op_type = 'GET' AND user_key IS NULL").select("request_id", "op_idx", "op_type", F.lit(None).cast("string").alias("result"))
    result = F.when(F.col("op_type") == "PUT", F.col("op_value")).when(F.col("op_type") == "SNAPSHOT", F.col("sequence").cast("string"))
    rest = ops.where("op_type != 'GET'").select("request_id", "op_idx", "op_type", result.alias("result"))
    return got.unionByName(keyless).unionByName(rest)


def apply_in_order(ops: DataFrame, order: list[Column]) -> DataFrame:
    """``(request_id, op_idx, user_key, value)``: what each GET reads if ops are applied one after the other in ``order``.

    A read sees the last write of its key that was applied before it, not what the write's sequence says; NULL if there is
    none or it was a DELETE. Reads and writes of a key are merged by the ordered operator, so a hot key is spread.
    """
    keyed = ops.where(F.col("user_key").isNotNull() & F.col("op_type").isin("GET", *WRITES))
    wrote = F.when(F.col("op_type").isin(*WRITES), F.struct("op_type", "op_value"))
    got = ordered(keyed.select("request_id", "op_idx", "op_type", "user_key", "op_value", "arrived_at"), ["user_key"], order, lasts={f"{P}w": wrote})
    value = F.when(F.col(f"{P}w.op_type") == "PUT", F.col(f"{P}w.op_value"))
    return got.where("op_type = 'GET'").select("request_id", "op_idx", "user_key", value.alias("value"))


def islands(rows: DataFrame, group: list[str], order: list[Column], same: Column, extra: dict[str, Column]) -> DataFrame:
    """``(group..., island, extra...)``: aggregates of maximal runs of consecutive rows for which ``same`` has one value."""
    numbered = ordered(rows, group, order, breaks={"island": (same, lambda before, now: ~before.eqNullSafe(now))})
    return numbered.groupBy(*group, "island").agg(*[e.alias(c) for c, e in extra.items()])


def proposal_batches(requests: DataFrame, node: str, arrival: list[str]) -> DataFrame:
    """Maximal runs of read-only or of writing requests of a node: ``(node, island, read_only, first_request, n)``."""
    first = F.min_by("request_id", F.struct(*arrival))
    return islands(
        requests, [node], [F.col(c) for c in arrival], F.col("read_only"),
        {"read_only": F.min("read_only"), "first_request": first, "n": F.count(F.lit(1))},
    )


def release_reads(reads: DataFrame, applied: DataFrame, group: str, index: str, read_id: str) -> DataFrame:
    """``(read_id, released_at)``: the lowest applied index at or above the read's; reads nothing releases are left out."""
    r = reads.select(group, F.col(index).alias(f"{P}i"), F.lit(0).alias(f"{P}k"), F.col(read_id).alias(f"{P}id"))
    a = applied.select(group, F.col(index).alias(f"{P}i"), F.lit(1).alias(f"{P}k"), F.lit(None).cast("bigint").alias(f"{P}id"))
    nxt = ordered(r.unionByName(a), [group], [F.col(f"{P}i"), F.col(f"{P}k"), F.col(f"{P}id")], next_mins={"released_at": F.when(F.col(f"{P}k") == 1, F.col(f"{P}i"))})
    return nxt.where((F.col(f"{P}k") == 0) & F.col("released_at").isNotNull()).select(F.col(f"{P}id").alias(read_id), "released_at")


def completions(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their first response; unanswered ones have NULL."""
    first = responses.groupBy("request_id").agg(F.min("answered_at").alias("answered_at"))
    return requests.join(first, "request_id", "left")


def command_id(request_id: Column, index: Column, sequence: Column) -> Column:
    """The request's id, or a hash of index and sequence where there is none."""
    return F.coalesce(request_id, F.xxhash64(index, sequence))
