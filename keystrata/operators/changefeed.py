"""Applying a stream of inserts, updates and deletes, in any order of arrival."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from keystrata._util import P, require

STATE = f"{P}last"
#: Bits of an integral order column, and most bits of what is packed below the first one.
BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
LOW_BITS = 62


class _Packing:
    """Order columns and the kind of change as one decimal that compares like their struct, NULL lowest behind the first.

    A decimal can be updated in a hash table, a struct can't: with it each map task hashes its rows where it would sort them.
    """

    def __init__(self, rows: DataFrame, order: list[str], kinds: tuple[str, ...]):
        types = [rows.schema[c].dataType for c in order]
        self.order, self.kinds, self.types = order, sorted(kinds), types
        self.bits = [BITS.get(type(t), 99) + 1 for t in types[1:]] + [len(kinds).bit_length()]
        self.fits = type(types[0]) in BITS and sum(self.bits) <= LOW_BITS

    def pack(self) -> Column:
        low = F.lit(0).cast("bigint")
        for c, n in zip(self.order[1:], self.bits, strict=False):
            low = low * F.lit(1 << n) + F.coalesce(F.col(c).cast("bigint") + F.lit((1 << (n - 2)) + 1), F.lit(0))
        kind = reduce(lambda x, i: x.when(F.col("op") == self.kinds[i], i + 1), range(1, len(self.kinds)), F.when(F.col("op") == self.kinds[0], 1)).otherwise(0)
        low = low * F.lit(1 << self.bits[-1]) + kind
        top = F.col(self.order[0]).cast("decimal(19,0)") * F.lit(1 << sum(self.bits)).cast("decimal(19,0)")
        return (top + low.cast("decimal(19,0)")).cast("decimal(38,0)")

    def unpack(self, packed: Column) -> list[Column]:
        width = F.lit(1 << sum(self.bits)).cast("decimal(38,0)")
        low, out = F.pmod(packed, width).cast("bigint"), []
        top = ((packed - F.pmod(packed, width)) / width).cast(self.types[0])
        kind = low.bitwiseAND((1 << self.bits[-1]) - 1)
        names = reduce(lambda x, i: x.when(kind == i + 1, self.kinds[i]), range(1, len(self.kinds)), F.when(kind == 1, self.kinds[0]))
        low = F.shiftright(low, self.bits[-1])
        for c, n, t in reversed(list(zip(self.order[1:], self.bits, self.types[1:], strict=False))):
            part = low.bitwiseAND((1 << n) - 1)
            out.insert(0, F.when(part != 0, part - F.lit((1 << (n - 2)) + 1)).cast(t).alias(c))
            low = F.shiftright(low, n)
        return [top.alias(self.order[0]), *out, names.alias("op")]


def fold_changes(
    changes: DataFrame, keys: list[str], order: list[str], op: Column, payload: list[str] = (), base: DataFrame | None = None, kinds: tuple[str, ...] = ()
) -> DataFrame:
    """The last change of each key, as ``(keys..., order..., op, payload...)``, tombstones included.

    The fold takes the maximum of ``struct(order..., op, payload...)``: a commutative, associative and idempotent
    aggregate. Changes may therefore come repeated, late and in any order, may be folded in any number of batches,
    and a key that fills a third of the feed is combined on the map side. ``base`` is an earlier result of this
    function; its rows take part like changes, so a delete kept there outranks a late insert. Rows with a NULL key
    or a NULL first order column say nothing about any key and are left out; in later order columns NULL ranks lowest.

    Without payload, with integral order columns and ``kinds``, the names of all kinds of change that matter, the struct
    is packed into a number and the fold hashes (at most 62 bits behind the first order column, else it sorts). Of
    changes that tie in order the kind that comes last in the alphabet counts; a kind that ``kinds`` lacks ranks before
    all others and comes out as NULL.
    """
    require(changes, *keys, *order, *payload)
    if "op" in (*keys, *order, *payload):
        raise ValueError("the change's kind comes out as op; rename the column of that name")
    named = changes.where(F.col(order[0]).isNotNull())
    for k in keys:
        named = named.where(F.col(k).isNotNull())
    told = named.select(*keys, *order, op.alias("op"), *payload).where(F.col("op").isNotNull())
    if base is not None:
        told = told.unionByName(base.select(*keys, *order, "op", *payload))
    if kinds and not payload and (packing := _Packing(told, order, kinds)).fits:
        packed = told.groupBy(*keys).agg(F.max(packing.pack()).alias(STATE))
        return packed.select(*keys, *packing.unpack(F.col(STATE)))
    folded = told.groupBy(*keys).agg(F.max(F.struct(*order, "op", *payload)).alias(STATE))
    return folded.select(*keys, f"{STATE}.*")


def live(state: DataFrame, gone: str = "DELETE") -> DataFrame:
    """The rows of a folded state that are not tombstones."""
    return state.where(F.col("op") != gone)
