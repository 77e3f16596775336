"""Ordered analytics without one-task windows: range partitions, local windows, and a carry per partition edge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from keystrata._util import P, cut_lineage

PID = f"{P}pid"


def ordered(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    sums: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    leads: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    next_mins: dict[str, Column] | None = None,
    prior_maxes: dict[str, Column] | None = None,
    breaks: dict[str, tuple[Column, Callable[[Column, Column], Column]]] | None = None,
) -> DataFrame:
    """Adds window results over each group's rows in ascending order.

    ``sums``: running sum up to and with the row; ``lags``/``leads``: value of the row before/after, NULL at the ends;
    ``lasts``: last non-NULL value up to and with the row; ``next_mins``: smallest value of the rows after it;
    ``prior_maxes``: largest value of the rows before it; ``breaks``: number, from 1, of the run of rows that the row lies
    in, where a value and a function of the value before and the present one say whether a new run begins.

    A plain window gives a whole group to one task, and without a group the whole table. Here rows are range-partitioned
    by group and order, each partition is windowed by itself, and what crosses an edge is added from a table that has a
    row for every partition in which a group goes on, hence at most as many rows as partitions. ``order`` should be
    total; rows that tie stay in one partition and fall in any order. NULLs are a group of their own and sort first.
    """
    sums, lags, leads, lasts, next_mins, prior_maxes, breaks = sums or {}, lags or {}, leads or {}, lasts or {}, next_mins or {}, prior_maxes or {}, breaks or {}
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ocols = [f"{P}o{i}" for i in range(len(order))]
    exprs = [*sums.items(), *lags.items(), *leads.items(), *lasts.items(), *next_mins.items(), *prior_maxes.items()]
    exprs += [(c, e) for c, (e, _) in breaks.items()]
    held = df.select("*", *[o.alias(c) for o, c in zip(order, ocols, strict=True)], *[e.alias(f"{P}v_{name}") for name, e in exprs])
    held = cut_lineage(held.repartitionByRange(n, *group, *ocols).withColumn(PID, F.spark_partition_id()))
    w = W.partitionBy(PID, *group).orderBy(*ocols)
    upto, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    # what follows a row is what comes before it in reverse: a frame that ends with the group is filled anew for every row
    after = W.partitionBy(PID, *group).orderBy(*[F.desc(c) for c in ocols]).rowsBetween(W.unboundedPreceding, -1)
    v = lambda name: F.col(f"{P}v_{name}")
    local = [
        *[F.sum(v(c)).over(upto).alias(f"{P}w_{c}") for c in sums],
        *[F.lag(F.struct(v(c))).over(w).alias(f"{P}w_{c}") for c in lags],
        *[F.lead(F.struct(v(c))).over(w).alias(f"{P}w_{c}") for c in leads],
        *[F.last(v(c), ignorenulls=True).over(upto).alias(f"{P}w_{c}") for c in lasts],
        *[F.min(v(c)).over(after).alias(f"{P}w_{c}") for c in next_mins],
        *[F.max(v(c)).over(ahead).alias(f"{P}w_{c}") for c in prior_maxes],
    ]
    new = lambda c, before, now: F.when(F.coalesce(breaks[c][1](before[c], now[c]), F.lit(True)), 1).otherwise(0).cast("bigint")
    held_before = {c: F.lag(F.struct(v(c).alias(c))).over(w) for c in breaks}
    if breaks:  # a partition's first row of a group is judged by the carry
        held = held.select("*", *[F.when(b.isNull(), F.lit(0).cast("bigint")).otherwise(new(c, b, F.struct(v(c).alias(c)))).alias(f"{P}b_{c}") for c, b in held_before.items()])
        local += [F.sum(f"{P}b_{c}").over(upto).alias(f"{P}w_{c}") for c in breaks]
    inside = held.select("*", *local)
    at = F.struct(*ocols)
    per = held.groupBy(PID, *group).agg(
        F.count(F.lit(1)).alias(f"{P}n"),
        *[F.sum(v(c)).alias(f"{P}e_{c}") for c in sums],
        *[F.max_by(F.struct(v(c)), at).alias(f"{P}e_{c}") for c in lags],
        *[F.min_by(F.struct(v(c)), at).alias(f"{P}e_{c}") for c in leads],
        *[F.max_by(v(c), F.when(v(c).isNotNull(), at)).alias(f"{P}e_{c}") for c in lasts],
        *[F.min(v(c)).alias(f"{P}e_{c}") for c in next_mins],
        *[F.max(v(c)).alias(f"{P}e_{c}") for c in prior_maxes],
        *[F.sum(f"{P}b_{c}").alias(f"{P}e_{c}") for c in breaks],
        *[F.min_by(F.struct(v(c).alias(c)), at).alias(f"{P}f_{c}") for c in breaks],
        *[F.max_by(F.struct(v(c).alias(c)), at).alias(f"{P}l_{c}") for c in breaks],
    )
    we = W.partitionBy(*group).orderBy(PID) if group else W.partitionBy(F.lit(0)).orderBy(PID)
    before = we.rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy(*group if group else [F.lit(0)]).orderBy(F.desc(PID)).rowsBetween(W.unboundedPreceding, -1)
    e = lambda name: F.col(f"{P}e_{name}")
    through = we.rowsBetween(W.unboundedPreceding, 0)
    for c in breaks:  # whether a partition's first row begins a run: it does if there is none before
        last = F.lag(f"{P}l_{c}").over(we)
        per = per.withColumn(f"{P}g_{c}", F.when(last.isNull(), F.lit(1).cast("bigint")).otherwise(new(c, last, F.col(f"{P}f_{c}"))))
    carry = per.select(
        F.col(PID).alias(f"{P}cp"),
        *[F.col(g).alias(f"{P}cg{i}") for i, g in enumerate(group)],
        F.count(F.lit(1)).over(W.partitionBy(*group) if group else W.partitionBy(F.lit(0))).alias(f"{P}pieces"),
        *[F.sum(e(c)).over(before).alias(f"{P}c_{c}") for c in sums],
        *[F.lag(e(c)).over(we).alias(f"{P}c_{c}") for c in lags],
        *[F.lead(e(c)).over(we).alias(f"{P}c_{c}") for c in leads],
        *[F.last(e(c), ignorenulls=True).over(before).alias(f"{P}c_{c}") for c in lasts],
        *[F.min(e(c)).over(behind).alias(f"{P}c_{c}") for c in next_mins],
        *[F.max(e(c)).over(before).alias(f"{P}c_{c}") for c in prior_maxes],
        *[(F.coalesce(F.sum(e(c)).over(before), F.lit(0)) + F.sum(f"{P}g_{c}").over(through)).alias(f"{P}c_{c}") for c in breaks],
    ).where(F.col(f"{P}pieces") > 1)
    on = [F.col(PID) == F.col(f"{P}cp"), *[F.col(g).eqNullSafe(F.col(f"{P}cg{i}")) for i, g in enumerate(group)]]
    both = inside.join(F.broadcast(carry), on, "left")  # at most two rows a partition
    mine, theirs = (lambda c: F.col(f"{P}w_{c}")), (lambda c: F.col(f"{P}c_{c}"))
    out = [
        *[(F.coalesce(mine(c), F.lit(0)) + F.coalesce(theirs(c), F.lit(0))).alias(c) for c in sums],
        *[F.coalesce(mine(c), theirs(c))[f"{P}v_{c}"].alias(c) for c in [*lags, *leads]],
        *[F.coalesce(mine(c), theirs(c)).alias(c) for c in lasts],
        *[F.least(mine(c), theirs(c)).alias(c) for c in next_mins],
        *[F.greatest(mine(c), theirs(c)).alias(c) for c in prior_maxes],
        *[(mine(c) + F.coalesce(theirs(c), F.lit(1))).alias(c) for c in breaks],
    ]
    return both.select(*df.columns, *out)


def numbered(df: DataFrame, out: str = "position") -> DataFrame:
    """Adds each row's number, from 1, in the order in which the frame delivers its rows.

    The order is taken as it is, not made again: partitions follow each other, rows count within theirs. Only the number
    of rows of each partition comes together.
    """
    held = cut_lineage(df).select("*", F.monotonically_increasing_id().alias(f"{P}id"))
    part, row = F.shiftright(F.col(f"{P}id"), 33), F.col(f"{P}id").bitwiseAND((1 << 33) - 1)
    sizes = held.groupBy(part.alias(PID)).agg(F.count(F.lit(1)).alias(f"{P}n"))
    before = W.partitionBy(F.lit(0)).orderBy(PID).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col(PID), F.coalesce(F.sum(f"{P}n").over(before), F.lit(0)).alias(f"{P}from"))
    at = held.withColumn(PID, part).join(F.broadcast(starts), PID)  # a row a partition
    return at.select(*df.columns, (row + F.col(f"{P}from") + 1).alias(out))
