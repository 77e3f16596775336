"""Most frequent items among billions: iceberg filtering over several hashes."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, functions as F

from keystrata._util import checked_broadcast, cut_lineage

P = "__ks_"
HASHES, BUCKETS, MOST_BUCKETS = 3, 8192, 1 << 22
#: Heavy buckets of a hash up to which they become part of the filter itself.
LISTED = 1000


def buckets_for(share: Fraction) -> int:
    """Buckets of a hash: some 16 for each value that could reach the share, so that few others survive."""
    return min(MOST_BUCKETS, max(BUCKETS, 1 << (16 * share.denominator // share.numerator).bit_length()))


def frequent(rows: DataFrame, column: str, share: Fraction, hashes: int = HASHES, buckets: int | None = None) -> DataFrame:
    """``(<column>, n)``: every non-NULL value in at least ``share`` of all rows, with its exact count.

    Pass 1 counts, exactly, the rows of each of ``buckets`` buckets under each hash. A value of n rows makes every one
    of its buckets at least n, so none is missed; at most 1/share buckets of a hash reach the threshold. Pass 2 keeps the
    values whose every bucket reaches it (a value below the threshold survives with a chance of about
    (1 / (share * buckets)) ** hashes) and counts the survivors. Memory is bounded by hashes * buckets counters a task,
    however many distinct values there are; ``buckets`` follows from the share, up to ``MOST_BUCKETS``. Up to ``LISTED``
    heavy buckets of a hash are written into the filter, more are joined. Rows with NULL count in the total. An empty
    table gives no rows.
    """
    if column == "n":
        raise ValueError("the count comes out as n; rename the column of that name")
    buckets = buckets or buckets_for(share)
    v = F.col(column)
    bucket = [F.pmod(F.xxhash64(F.lit(i), v), F.lit(buckets)).cast("int") for i in range(hashes)]
    whole = F.array(F.lit(-1))  # the bucket of all rows
    placed = rows.select(F.when(v.isNull(), whole).otherwise(F.array(F.lit(-1), *[b + F.lit(i * buckets) for i, b in enumerate(bucket)])).alias("b"))
    counted = cut_lineage(placed.select(F.explode("b").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")))
    total = counted.where("b = -1").agg(F.max("n")).first()[0] or 0
    reaches = F.col("n") * share.denominator >= F.lit(total) * share.numerator
    heavy = counted.where((F.col("b") >= 0) & reaches).select("b")
    kept = rows.select(v).where(v.isNotNull())
    few = [r[0] for r in heavy.limit(hashes * LISTED + 1).collect()]
    for i, b in enumerate(bucket):
        if len(few) <= hashes * LISTED:
            kept = kept.where(b.isin(*[x - i * buckets for x in few if x // buckets == i]))
        else:
            mine = heavy.where(F.call_function("div", F.col("b"), F.lit(buckets)) == i).select((F.col("b") - i * buckets).alias(f"{P}b"))
            kept = kept.join(checked_broadcast(mine), b == F.col(f"{P}b"), "left_semi")
    return kept.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(reaches)
