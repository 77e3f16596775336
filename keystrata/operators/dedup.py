"""Messages delivered more than once: exactly one copy of each comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keystrata._util import P, cut_lineage, require


def _complete(ids: list[str]) -> Column:
    whole = F.lit(True)
    for c in ids:
        whole = whole & F.col(c).isNotNull()
    return whole


def _repeated(rows: DataFrame, ids: list[str], order: str) -> DataFrame:
    """Repeated identifiers with the least ``order`` of their rows, as ``(ids..., first)`` with prefixed names.

    Frequencies are counted with map-side partial sums, so an identifier that fills a third of the table arrives
    at the counting task as one row per map task.
    """
    counted = rows.select(*ids, order).where(_complete(ids)).groupBy(*ids).agg(F.count(F.lit(1)).alias(f"{P}n"), F.min(order).alias(f"{P}first"))
    return counted.where(F.col(f"{P}n") > 1).select(*[F.col(c).alias(f"{P}{c}") for c in ids], f"{P}first")


def repeats(rows: DataFrame, ids: list[str], order: str) -> DataFrame:
    """The rows to drop: those of a repeated identifier that rank behind the first by ``order``.

    Rows that lack part of their identifier are no copies of anything. Rows that tie with the first in ``order``
    rank with it and are not reported here; ``one_copy_each`` still keeps a single one of them. The side of the join has
    one row per identifier, so rows of a hot one can be split by AQE.
    """
    require(rows, *ids, order)
    ranked = rows.join(_repeated(rows, ids, order), [*[F.col(c) == F.col(f"{P}{c}") for c in ids], F.col(order) > F.col(f"{P}first")])
    return ranked.select(*rows.columns)


def one_copy_each(stored: DataFrame, ids: list[str], order: str, new: DataFrame | None = None) -> DataFrame:
    """One row of each message among stored and new rows: the first by ``order``.

    Singletons pass directly; only repeated groups are ranked (against the group's mergeable minimum, never in one
    task), and the two results are united. Identifiers with a NULL part have no message and come back unchanged.
    Ties in ``order`` leave one of the tied rows; a group whose ``order`` is NULL throughout leaves one row.
    Extra columns stay; columns that only one input has are NULL in the other's rows.

    The count reads identifiers and order once and is kept for both branches. Singletons are what an anti join with it
    leaves, rows without identifier among them. A repeated group's first is found by joining on the order as well, so
    the copies of a hot message go to as many tasks as there are values of ``order``, and tied ones fall together by an
    aggregate with map-side combine.
    """
    require(stored, *ids, order)
    rows = stored if new is None else stored.unionByName(new, allowMissingColumns=True)
    repeated = cut_lineage(_repeated(rows, ids, order))
    same = [F.col(c) == F.col(f"{P}{c}") for c in ids]
    singles = rows.join(repeated, same, "left_anti")
    first = rows.join(repeated, [*same, F.col(order).eqNullSafe(F.col(f"{P}first"))], "left_semi").dropDuplicates(ids)
    return singles.unionByName(first)
