"""Scalar functions: key and value encodings, varints, checksums, time and hashing helpers, configuration values."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from keystrata._util import micros

#: Fixed value: the epoch of sequence numbers, 2021-03-09 in seconds.
EPOCH_S = 1_615_248_000
#: Tags of encoded values.
DELETE_TAG, PUT_TAG = "00", "01"


def full_key(user_key: Column, sequence: Column) -> Column:
    """User key followed by the complement of the sequence, 8 bytes big-endian: a key's newest version sorts first."""
    return F.concat(user_key.cast("binary"), F.unhex(F.lpad(F.hex(F.bitwise_not(sequence)), 16, "0")))


def user_key_of(full: Column) -> Column:
    return F.substring(full, F.lit(1), F.length(full) - 8)


def sequence_of(full: Column) -> Column:
    """The sequence of a full key, for sequences below 2^63."""
    tail = F.hex(F.substring(full, F.length(full) - 7, F.lit(8)))
    return F.bitwise_not(F.conv(tail, 16, -10).cast("bigint"))


def raw_value(op: Column, value: Column) -> Column:
    return F.when(op == "DELETE", F.unhex(F.lit(DELETE_TAG))).otherwise(F.concat(F.unhex(F.lit(PUT_TAG)), F.coalesce(value.cast("binary"), F.unhex(F.lit("")))))


def value_of(raw: Column) -> Column:
    """The value of an encoded one, NULL for a tombstone."""
    return F.when(F.hex(F.substring(raw, F.lit(1), F.lit(1))) == PUT_TAG, F.substring(raw, F.lit(2), F.length(raw)))


def varint_length(n: Column) -> Column:
    """Bytes of an unsigned 32-bit number in groups of 7 bits."""
    out = F.lit(5)
    for size, bits in ((4, 28), (3, 21), (2, 14), (1, 7)):
        out = F.when(n < F.lit(1 << bits), F.lit(size)).otherwise(out)
    return out


def varint(n: Column) -> Column:
    """An unsigned 32-bit number in groups of 7 bits, lowest first; all but the last have the top bit set."""
    byte = lambda i, more: F.lpad(F.hex(F.shiftrightunsigned(n.cast("bigint"), 7 * i).bitwiseAND(127) + (128 if more else 0)), 2, "0")
    out = None
    for size in range(1, 6):
        coded = F.concat(*[byte(i, i + 1 < size) for i in range(size)])
        out = F.when(n < F.lit(1 << 7 * size), coded) if out is None else out.when(n < F.lit(1 << min(7 * size, 32)), coded)
    return F.unhex(out)


def length_prefixed(data: Column) -> Column:
    """A slice behind the varint of its length."""
    return F.concat(varint(F.length(data)), data)


def crc32(data: Column) -> Column:
    return F.crc32(data)


@F.pandas_udf(T.IntegerType())
def shared_prefix(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Length in bytes of the common prefix of two strings; NULL counts as empty."""
    from os.path import commonprefix

    for a, b in pairs:
        sides = zip(a.fillna(""), b.fillna(""), strict=True)
        yield pd.Series([len(commonprefix([x.encode(), y.encode()])) for x, y in sides], dtype="int32")


def align_up(n: Column, to: int) -> Column:
    """The least multiple of ``to`` at or above the whole number ``n``."""
    return n + F.pmod(-n, F.lit(to))


def align_down(n: Column, to: int) -> Column:
    return n - F.pmod(n, F.lit(to))


def is_pow2(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def timestamp_ms(ts: Column) -> Column:
    """Milliseconds since the store's epoch of a timestamp without zone."""
    return F.floor(micros(ts) / 1000).cast("bigint") - EPOCH_S * 1000


def shard_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n))


_UNITS = {"": 1, "b": 1, "k": 10**3, "kb": 10**3, "kib": 1 << 10, "m": 10**6, "mb": 10**6, "mib": 1 << 20, "g": 10**9, "gb": 10**9, "gib": 1 << 30}
_TIMES = {"ms": 0.001, "s": 1.0, "m": 60.0, "min": 60.0, "h": 3600.0, "d": 86400.0}


def parse_bytes(text: str) -> int:
    """``64 KiB`` and the like in bytes."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([a-zA-Z]*)\s*", text)
    if not m or m[2].lower() not in _UNITS:
        raise ValueError(f"no size: {text!r}")
    return int(float(m[1]) * _UNITS[m[2].lower()])


def parse_seconds(text: str) -> float:
    """``15 s`` and the like in seconds."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([a-z]+)\s*", text.lower())
    if not m or m[2] not in _TIMES:
        raise ValueError(f"no duration: {text!r}")
    return float(m[1]) * _TIMES[m[2]]
