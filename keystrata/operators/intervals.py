"""Pairs of overlapping intervals, found by a sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keystrata._util import P
from keystrata.operators.ordered import ordered


def overlap_pairs(a: DataFrame, b: DataFrame, a_ends: tuple[str, str], b_ends: tuple[str, str], inclusive: bool = True) -> DataFrame:
    """``(a, b)``: structs of the rows of every pair whose intervals overlap.

    Intervals are named by their two end columns; a NULL beginning is no lower end, a NULL end no upper one. Both ends
    belong to an interval; with ``inclusive`` off, intervals of which one ends where the other begins don't overlap (nor
    does anything with an interval that ends where it begins, at that point).

    Two intervals overlap if one begins within the other. All ends are sorted together once, and running counts number
    the beginnings of each side. What begins within an interval is then a range of numbers, and each number is looked up
    by an equi-join on it. The work is a sort and the pairs that come out; there is no join on an inequality, and no key
    of a join has more than one row on the side that it names.
    """

    def points(df: DataFrame, ends: tuple[str, str], side: int) -> DataFrame:
        lo, hi = (F.col(c) for c in ends)
        named = df.select(F.struct(*df.columns).alias(f"{P}row"), lo.alias(f"{P}lo"), hi.alias(f"{P}hi"), F.monotonically_increasing_id().alias(f"{P}id"))
        begin = F.struct(F.lit(0).alias("open"), F.col(f"{P}lo").alias("k"), F.lit(side).alias("o"))
        end = F.struct(F.when(F.col(f"{P}hi").isNull(), 2).otherwise(0).alias("open"), F.col(f"{P}hi").alias("k"), F.lit(2 if inclusive else -1).alias("o"))
        return named.select(F.explode(F.array(begin, end)).alias(f"{P}p"), F.lit(side).alias(f"{P}side"), f"{P}id", f"{P}row")

    def swept(df: DataFrame, other: DataFrame) -> DataFrame:
        return df.withColumnRenamed(f"{P}row", f"{P}a").unionByName(other.withColumnRenamed(f"{P}row", f"{P}b"), allowMissingColumns=True)

    begins = F.col(f"{P}p.o").isin(0, 1)
    one = lambda side: F.when(begins & (F.col(f"{P}side") == side), 1).otherwise(0).cast("bigint")
    order = [F.col(f"{P}p.open"), F.col(f"{P}p.k"), F.col(f"{P}p.o"), F.col(f"{P}side"), F.col(f"{P}id")]
    run = ordered(swept(points(a, a_ends, 0), points(b, b_ends, 1)), [], order, sums={"na": one(0), "nb": one(1)})

    def numbered(side: int, row: str, own: str, other: str) -> DataFrame:
        mine = run.where(F.col(f"{P}side") == side)
        first = mine.where(begins).select(f"{P}id", F.col(f"{P}{row}").alias(row), F.col(own).alias(f"{P}no"), (F.col(other) + 1).alias(f"{P}from"))
        last = mine.where(~begins).select(f"{P}id", F.col(other).alias(f"{P}to"))
        return first.join(last, f"{P}id").drop(f"{P}id")

    left, right = numbered(0, "a", "na", "nb"), numbered(1, "b", "nb", "na")

    def met(asks: DataFrame, asked: DataFrame) -> DataFrame:
        many = asks.where(F.col(f"{P}from") <= F.col(f"{P}to"))
        each = many.select(*[c for c in ("a", "b") if c in asks.columns], F.explode(F.sequence(f"{P}from", f"{P}to")).alias(f"{P}no"))
        return each.join(asked.drop(f"{P}from", f"{P}to"), f"{P}no").select("a", "b")

    return met(left, right).unionByName(met(right, left))


def seeded(seed: int, *parts: Column) -> Column:
    """A number below 2^32 that depends on the seed and the parts alone: the first digits of an MD5 sum."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")
