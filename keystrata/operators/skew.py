"""Per-key results when a few keys hold most rows: exact quantiles by distributed selection."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from keystrata._util import P, checked_broadcast, cut_lineage, require

BINS = 4096


def _rank(p: float, n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * n)).cast("bigint")


def _bins(lo: Column, hi: Column, bins: int) -> Column:
    """The bin of ``v`` when the span from lo to hi is cut in at most ``bins`` equal parts, in whole numbers."""
    step = F.call_function("div", hi - lo, F.lit(bins)) + 1
    return F.call_function("div", F.col(f"{P}v") - lo, step)



def _histogram(rows: DataFrame, by: list[str], bin_: Column) -> DataFrame:
    """Rows, least and greatest value of each bin: sums that are combined on the map side, so only counts move."""
    v = F.col(f"{P}v")
    return rows.groupBy(*by, bin_.alias(f"{P}bin")).agg(F.count(F.lit(1)).alias(f"{P}c"), F.min(v).alias(f"{P}lo"), F.max(v).alias(f"{P}hi"))


def exact_quantiles(df: DataFrame, keys: list[str], value: Column, probs: dict[str, float], min_share: Fraction | None = None, bins: int = BINS) -> DataFrame:
    """``(keys..., n, <name of each prob>...)``: rows per key and exact quantiles of an integer value.

    The quantile p is the value of rank ``max(1, ceil(p * m))`` among the key's m non-NULL values, NULL if it has none;
    ``n`` counts all rows of the key. Keys with a NULL part come out of no group but count in the total. With
    ``min_share`` only keys with at least that share of all rows come out, of which there are at most 1/min_share. Values
    must lie within +-2^62.

    Every key is resolved the same way, whatever its size. A first round cuts the span of all values in ``bins`` parts
    and counts rows by key and part. The counts of a key, at most ``bins`` and one rows, give the part that holds each
    rank; it is solved if its least and greatest value agree. Further rounds cut the parts that are still open, each for
    itself, until all are one value. A round moves a row per map task, key and part at most, and none of the values.
    """
    require(df, *keys)
    rows = df.select(*keys, value.cast("bigint").alias(f"{P}v"))
    named = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    ends = rows
    if min_share is not None:
        v = F.col(f"{P}v")
        counts = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias(f"{P}lo"), F.max(v).alias(f"{P}hi")))
        total = counts.agg(F.sum("n")).first()[0] or 0
        wanted = counts.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).where(F.col("n") * min_share.denominator >= F.lit(total) * min_share.numerator)
        named = named.join(F.broadcast(wanted.select(*keys)), keys, "left_semi")  # at most 1 / min_share keys
        ends = wanted.select(F.explode(F.array(f"{P}lo", f"{P}hi")).alias(f"{P}v"))
    least, greatest = ends.agg(F.min(f"{P}v"), F.max(f"{P}v")).first()
    whole = _bins(F.lit(least or 0).cast("bigint"), F.lit(greatest or 0).cast("bigint"), bins)
    hist = _histogram(named, keys, whole)
    by = W.partitionBy(*keys)
    c = F.col(f"{P}c")
    upto = F.sum(F.when(F.col(f"{P}bin").isNotNull(), c)).over(by.orderBy(F.col(f"{P}bin").asc_nulls_last()))
    placed = hist.select("*", upto.alias(f"{P}upto"), F.sum(c).over(by).alias("n"), F.coalesce(F.sum(F.when(F.col(f"{P}bin").isNotNull(), c)).over(by), F.lit(0)).alias(f"{P}m"))
    names = list(probs)
    inside = lambda r: (F.col(f"{P}upto") >= r) & (F.col(f"{P}upto") - c < r)
    ranks = [_rank(probs[q], F.col(f"{P}m")) for q in names]
    asked = F.array_compact(F.array(*[F.when(F.col(f"{P}bin").isNotNull() & inside(r), F.struct(F.lit(i).alias("q"), (r - F.col(f"{P}upto") + c).alias("rank"))) for i, r in enumerate(ranks)]))
    none = F.array(F.struct(F.lit(-1).alias("q"), F.lit(0).cast("bigint").alias("rank")))  # a key without values
    each = F.explode(F.when(F.col(f"{P}m") == 0, none).otherwise(asked)).alias(f"{P}t")
    open_ = placed.select(*keys, "n", f"{P}lo", f"{P}hi", each).select(*keys, "n", F.col(f"{P}t.q").alias(f"{P}q"), F.col(f"{P}t.rank").alias(f"{P}rank"), f"{P}lo", f"{P}hi")
    found = _solved(named, keys, cut_lineage(open_), bins)
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col(f"{P}q") == i, F.col(f"{P}lo"))).alias(q) for i, q in enumerate(names)])


def _solved(rows: DataFrame, keys: list[str], bounds: DataFrame, bins: int) -> DataFrame:
    """Narrow every ``[lo, hi]`` to the part that holds its rank, until each is one value; the columns are those of ``bounds``.

    Intervals that several ranks of a key share are counted once. The rows of open intervals are found by a join with
    them, broadcast only where they are measured to be small.
    """
    lo, hi, rank = (F.col(f"{P}{c}") for c in ("lo", "hi", "rank"))
    one = lo.eqNullSafe(hi)
    done = bounds.where(one)
    while True:
        bounds = bounds.where(~one)
        if not bounds.limit(1).count():
            return done
        spans = bounds.select(*[F.col(k).alias(f"{P}k{i}") for i, k in enumerate(keys)], lo.alias(f"{P}a"), hi.alias(f"{P}b")).distinct()
        a, b, v = F.col(f"{P}a"), F.col(f"{P}b"), F.col(f"{P}v")
        same = [F.col(k) == F.col(f"{P}k{i}") for i, k in enumerate(keys)]
        within = rows.join(checked_broadcast(spans), [*same, v >= a, v <= b])
        hist = _histogram(within, [*[f"{P}k{i}" for i in range(len(keys))], f"{P}a", f"{P}b"], _bins(a, b, bins))
        upto = F.sum(f"{P}c").over(W.partitionBy(*[f"{P}k{i}" for i in range(len(keys))], f"{P}a", f"{P}b").orderBy(f"{P}bin"))
        parts = hist.select("*", upto.alias(f"{P}upto")).withColumnsRenamed({f"{P}lo": f"{P}least", f"{P}hi": f"{P}most"})
        again = [F.col(k) == F.col(f"{P}k{i}") for i, k in enumerate(keys)]
        hit = bounds.join(parts, [*again, lo == F.col(f"{P}a"), hi == F.col(f"{P}b"), F.col(f"{P}upto") >= rank, F.col(f"{P}upto") - F.col(f"{P}c") < rank])
        rest = (rank - F.col(f"{P}upto") + F.col(f"{P}c")).alias(f"{P}rank")
        bounds = cut_lineage(hit.select(*keys, "n", f"{P}q", rest, F.col(f"{P}least").alias(f"{P}lo"), F.col(f"{P}most").alias(f"{P}hi")))
        done = done.unionByName(bounds.where(one))
