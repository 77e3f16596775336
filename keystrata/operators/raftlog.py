"""Replicated log: what a replay leaves, bounds, terms, the small key-value store in the log, batches and gaps.

A log frame has ``pos, kind, grp, term, idx`` and, for the key-value kinds, ``rec_key, rec_value``. Order is that of ``pos``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keystrata._util import P
from keystrata.operators.ordered import ordered
from keystrata.operators.requests import islands


def compacted_to(log: DataFrame) -> DataFrame:
    """``(grp, compacted)``: the first index each group still has to hold."""
    return log.where("kind = 'COMPACT' AND grp IS NOT NULL").groupBy("grp").agg(F.max("idx").alias("compacted"))


def survivors(log: DataFrame) -> DataFrame:
    """``(grp, idx, term, pos)`` of the entries that a replay of the log leaves.

    An entry is gone if a later TRUNCATE of its group names its index or a lower one, if a COMPACT of its group names a
    higher one, or if another entry of its index has a higher term, or the same term and was written later. The
    smallest truncation behind each entry is a suffix minimum over the group's log order, found without a join; the
    rest are aggregates. Entries that lack part of their identifier are not replayed.
    """
    rows = log.where("kind IN ('ENTRY', 'TRUNCATE') AND grp IS NOT NULL AND idx IS NOT NULL").select("grp", "idx", "term", "pos", "kind")
    cut = ordered(rows, ["grp"], [F.col("pos")], next_mins={f"{P}cut": F.when(F.col("kind") == "TRUNCATE", F.col("idx"))})
    held = cut.where("kind = 'ENTRY' AND term IS NOT NULL").where(F.col(f"{P}cut").isNull() | (F.col(f"{P}cut") > F.col("idx")))
    best = held.groupBy("grp", "idx").agg(F.max(F.struct("term", "pos")).alias(f"{P}b")).select("grp", "idx", f"{P}b.*")
    done = best.join(compacted_to(log), "grp", "left")
    return done.where(F.col("compacted").isNull() | (F.col("idx") >= F.col("compacted"))).drop("compacted")


def bounds(entries: DataFrame) -> DataFrame:
    """``(grp, first_index, last_index, n, gap)`` of surviving entries; gap if the indexes aren't contiguous."""
    per = entries.groupBy("grp").agg(F.min("idx").alias("first_index"), F.max("idx").alias("last_index"), F.count(F.lit(1)).alias("n"))
    return per.withColumn("gap", F.col("last_index") - F.col("first_index") + 1 != F.col("n"))


def range_gaps(log_entries: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(grp, lo, hi, missing)``: how many indexes of ``[lo, hi)`` a group's surviving entries lack.

    ``ranges`` has ``grp, lo, hi``. Entries and ends of ranges are counted in one ordered pass, so ranges may overlap and a
    group may have any number of them.
    """
    asks = ranges.where("grp IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL").distinct()
    ends = asks.select("grp", "lo", "hi", F.explode(F.array("lo", "hi")).alias("idx"), F.lit(0).alias(f"{P}k"))
    had = log_entries.select("grp", "idx").distinct().withColumn(f"{P}k", F.lit(1))
    upto = ordered(ends.unionByName(had, allowMissingColumns=True), ["grp"], [F.col("idx"), F.col(f"{P}k"), F.col("lo"), F.col("hi")], sums={f"{P}n": F.col(f"{P}k").cast("bigint")})
    per = upto.where(F.col(f"{P}k") == 0).groupBy("grp", "lo", "hi").agg((F.max(f"{P}n") - F.min(f"{P}n")).alias(f"{P}had"))
    return per.select("grp", "lo", "hi", (F.greatest(F.col("hi") - F.col("lo"), F.lit(0)) - F.col(f"{P}had")).alias("missing"))


def phantom_terms(log: DataFrame) -> DataFrame:
    """``(grp, idx, term)`` of the last entry that compaction removed: still asked for to check the first one kept."""
    gone = log.where("kind = 'ENTRY' AND term IS NOT NULL AND idx IS NOT NULL AND grp IS NOT NULL").join(compacted_to(log), "grp").where(F.col("idx") < F.col("compacted"))
    return gone.groupBy("grp").agg(F.max(F.struct("idx", "term", "pos")).alias(f"{P}p")).select("grp", f"{P}p.idx", f"{P}p.term")


def term_of(asked: DataFrame, log_entries: DataFrame, phantoms: DataFrame) -> DataFrame:
    """Adds ``term`` to ``asked (grp, idx)``: that of the entry, of the phantom at its index, or of the phantom for any
    index of a group whose log is empty; else NULL."""
    known = log_entries.select("grp", "idx", "term").unionByName(phantoms.select("grp", "idx", "term")).groupBy("grp", "idx").agg(F.max("term").alias(f"{P}t"))
    empty = phantoms.join(log_entries.select("grp").distinct(), "grp", "left_anti").select("grp", F.col("term").alias(f"{P}e"))
    got = asked.join(known, ["grp", "idx"], "left").join(empty, "grp", "left")
    return got.withColumn("term", F.coalesce(f"{P}t", f"{P}e")).drop(f"{P}t", f"{P}e")


def entries(log_entries: DataFrame, grp: int, index: int, n: int, mask: int = 0, strict: bool = True) -> DataFrame:
    """Up to ``n`` surviving entries of a group from ``index`` on, hidden ones below ``mask`` left out.

    ``strict`` raises outside the group's range; otherwise the start is clamped and the result may be empty.
    """
    mine = log_entries.where(F.col("grp") == grp)
    if strict:
        lo, hi = mine.agg(F.min("idx"), F.max("idx")).first()
        if lo is None or not lo <= index <= hi:
            raise ValueError(f"index {index} lies outside the log of group {grp}")
    return mine.where(F.col("idx") >= max(index, mask)).orderBy("idx").limit(n)


def entries_each(log_entries: DataFrame, index: int, n: int, mask: int = 0) -> DataFrame:
    """As ``entries`` without ``strict``, for every group."""
    at = log_entries.where(F.col("idx") >= max(index, mask))
    numbered = ordered(at, ["grp"], [F.col("idx")], sums={f"{P}no": F.lit(1).cast("bigint")})
    return numbered.where(F.col(f"{P}no") <= n).drop(f"{P}no")


def log_kv(log: DataFrame) -> DataFrame:
    """``(grp, rec_key, rec_value)``: the last PUT of each key of a group that no later DELETE removed."""
    rows = log.where("kind IN ('PUT', 'DELETE') AND rec_key IS NOT NULL")
    last = rows.groupBy("grp", "rec_key").agg(F.max_by(F.struct("kind", "rec_value"), "pos").alias(f"{P}l"))
    return last.where(F.col(f"{P}l.kind") == "PUT").select("grp", "rec_key", f"{P}l.rec_value")


def batches(log_entries: DataFrame) -> DataFrame:
    """``(grp, island, term, first_index, n)``: a new batch wherever term changes or the index doesn't follow the last one."""
    starts = lambda before, now: (now["term"] != before["term"]) | (now["idx"] != before["idx"] + 1)
    numbered = ordered(log_entries.select("grp", "term", "idx", "pos"), ["grp"], [F.col("pos")], breaks={"island": (F.struct("term", "idx"), starts)})
    return numbered.groupBy("grp", "island").agg(F.min("term").alias("term"), F.min("idx").alias("first_index"), F.count(F.lit(1)).alias("n"))


def file_gaps(files: DataFrame) -> DataFrame:
    """``(file_id, previous)`` of log files whose predecessor is missing."""
    ids = files.select("file_id").where("file_id IS NOT NULL").distinct()
    return ordered(ids, [], [F.col("file_id")], lags={"previous": F.col("file_id")}).where(F.col("file_id") != F.col("previous") + 1)


def group_terms(log_entries: DataFrame) -> DataFrame:
    """``(grp, island, term, first_index, last_index)``: runs of one term along the indexes of a group."""
    return islands(
        log_entries, ["grp"], [F.col("idx")], F.col("term"),
        {"term": F.min("term"), "first_index": F.min("idx"), "last_index": F.max("idx")},
    )


def remove_groups(log: DataFrame, removed: DataFrame) -> DataFrame:
    """The log without any record of the removed groups."""
    return log.join(removed.select("grp").distinct(), "grp", "left_anti")
