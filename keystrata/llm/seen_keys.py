"""Has this key been seen before? Scalable Bloom chains, sharded by key hash.

The history is a table of layers, one row each: ``(shard, layer, m, k, inserted, error, bits)``. A shard's chain starts
with a small layer; when half of a layer's bits are set it is closed and one twice as large with half its error rate is
added. With e0 = bound * (1 - TIGHTEN) for the first layer, the rates sum to at most ``bound`` however long the chain
grows. Keys themselves are kept nowhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

P = "__ks_"
TIGHTEN, GROW, FILL = 0.5, 2, 0.5
#: Keys that a shard's first layer holds, and rows of history per shard.
FIRST_KEYS, ROWS_PER_SHARD = 8192, 4_000_000
#: Slots of the per-task filter that thins out hot keys before the shuffle.
RECENT = 1 << 18

LAYERS = "shards int, shard int, layer int, m bigint, k int, inserted bigint, error double, bits binary"


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor-shift) that makes independent hash words of one key hash."""
    with np.errstate(over="ignore"):
        x = h.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Layer:
    def __init__(self, m: int, k: int, error: float, inserted: int = 0, bits: bytes | None = None):
        self.m, self.k, self.error, self.inserted = m, k, error, inserted
        self.bits = np.zeros(m // 8, np.uint8) if bits is None else np.frombuffer(bits, np.uint8).copy()

    @classmethod
    def of(cls, keys: int, error: float) -> "Layer":
        k = max(1, math.ceil(math.log2(1 / error)))
        return cls(8 * math.ceil(keys * k / math.log(2) / 8), k, error)

    @property
    def fill(self) -> float:
        return int(np.bitwise_count(self.bits).sum(dtype=np.int64)) / self.m

    def _places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        a, b, m = _mix(h, 2 * self.k), _mix(h, 2 * self.k + 1) | np.uint64(1), np.uint64(self.m)
        for i in range(self.k):
            with np.errstate(over="ignore"):
                yield ((a + np.uint64(i) * b) >> np.uint64(3)) % m

    def contains(self, h: np.ndarray) -> np.ndarray:
        left = np.arange(len(h))
        a, b, m = _mix(h, 2 * self.k), _mix(h, 2 * self.k + 1) | np.uint64(1), np.uint64(self.m)
        for i in range(self.k):
            with np.errstate(over="ignore"):
                at = ((a[left] + np.uint64(i) * b[left]) >> np.uint64(3)) % m
            left = left[(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            if not len(left):
                break
        out = np.zeros(len(h), bool)
        out[left] = True
        return out

    def add(self, h: np.ndarray) -> None:
        for at in self._places(h):
            np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        self.inserted += len(h)


class Chain:
    def __init__(self, bound: float, first_keys: int = FIRST_KEYS):
        self.bound, self.first_keys = bound, first_keys
        self.layers: list[Layer] = []

    def contains(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for layer in reversed(self.layers):
            left = np.flatnonzero(~out)
            out[left] = layer.contains(h[left])
        return out

    def _room(self) -> int:
        """Keys that may still go into the last layer before its fill must be looked at again."""
        last = self.layers[-1]
        unset = (1 - FILL) / max(1e-9, 1 - last.fill)
        return int(last.m * -math.log(unset) / last.k) if unset < 1 else 0

    def add(self, h: np.ndarray) -> None:
        h = np.unique(h)
        h = h[~self.contains(h)]
        while len(h):
            if not self.layers or self._room() < 1:
                n = len(self.layers)
                self.layers.append(Layer.of(self.first_keys * GROW**n, self.bound * (1 - TIGHTEN) * TIGHTEN**n))
            room = max(1, self._room())
            self.layers[-1].add(h[:room])
            h = h[room:]

    def rows(self, shard: int) -> dict[str, list]:
        ls = self.layers
        return {
            "shard": [shard] * len(ls), "layer": list(range(len(ls))), "m": [x.m for x in ls], "k": [x.k for x in ls],
            "inserted": [x.inserted for x in ls], "error": [x.error for x in ls], "bits": [x.bits.tobytes() for x in ls],
        }


_ARROW = pa.schema([("shards", pa.int32()), ("shard", pa.int32()), ("layer", pa.int32()), ("m", pa.int64()), ("k", pa.int32()), ("inserted", pa.int64()), ("error", pa.float64()), ("bits", pa.binary())])


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops keys this task passed on lately (a fixed table of recent hashes), so a hot key isn't shuffled row by row."""
    recent, used = np.zeros(RECENT, np.int64), np.zeros(RECENT, bool)
    for b in batches:
        h = np.unique(b.column("h").to_numpy(zero_copy_only=False))
        slot = (_mix(h, 0) & np.uint64(RECENT - 1)).astype(np.int64)
        h, slot = (lambda new: (h[new], slot[new]))((recent[slot] != h) | ~used[slot])
        recent[slot], used[slot] = h, True
        yield pa.RecordBatch.from_arrays([pa.array(h)], names=["h"])


def _load(chain: Chain, b: pa.RecordBatch, i: int) -> None:
    chain.layers.append(Layer(b.column("m")[i].as_py(), b.column("k")[i].as_py(), b.column("error")[i].as_py(), b.column("inserted")[i].as_py(), b.column("bits")[i].as_py()))


def _run(bound: float, first_keys: int, probing: bool, shards: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains: dict[int, Chain] = {}
        for b in batches:
            shard = b.column("shard").to_numpy(zero_copy_only=False)
            stored = b.column("kind").to_numpy(zero_copy_only=False) == 0
            for i in np.flatnonzero(stored):
                if (made := b.column("shards")[int(i)].as_py()) != shards:
                    raise ValueError(f"the layers were made with {made} shards, not {shards}")
                _load(chains.setdefault(int(shard[i]), Chain(bound, first_keys)), b, int(i))
            rest = np.flatnonzero(~stored)
            if not len(rest):
                continue
            h = b.column("h").take(pa.array(rest)).to_numpy(zero_copy_only=False)
            seen = np.zeros(len(h), bool)
            for s in np.unique(shard[rest]):
                of = np.flatnonzero(shard[rest] == s)
                chain = chains.setdefault(int(s), Chain(bound, first_keys))
                if probing:
                    seen[of] = chain.contains(h[of])
                else:
                    chain.add(h[of])
            if probing:
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(seen)], names=["h", "maybe_seen"])
        if not probing:
            for s, chain in chains.items():
                for i in range(len(chain.layers)):
                    yield pa.RecordBatch.from_pydict({"shards": [shards]} | {k: v[i : i + 1] for k, v in chain.rows(s).items()}, schema=_ARROW)

    return go


def shards_for(rows: int) -> int:
    """Shards for a history of so many rows, a power of two; fixed once the first layers are written."""
    return max(16, 1 << math.ceil(math.log2(max(1, rows / ROWS_PER_SHARD))))


def _fed(keys: DataFrame, layers: DataFrame | None, shards: int) -> DataFrame:
    shard = F.pmod(F.col("h"), F.lit(shards)).cast("int")
    fed = keys.select(shard.alias("shard"), F.lit(1).alias("kind"), "h")
    if layers is None:
        return fed.repartitionById(shards, "shard")
    fed = fed.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in LAYERS.split(", ")) if c != "shard"])
    stored = layers.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("h"), "shards", "layer", "m", "k", "inserted", "error", "bits")
    return stored.unionByName(fed).repartitionById(shards, "shard").sortWithinPartitions("kind", "shard", "layer")


def key_hash(key: F.Column) -> F.Column:
    return F.xxhash64(key)


def remember(keys: DataFrame, shards: int, bound: float, layers: DataFrame | None = None, first_keys: int = FIRST_KEYS) -> DataFrame:
    """The layer table after adding ``keys`` (hashes in ``h``; NULL says nothing) to ``layers``.

    ``shards`` is stored with the layers; going on with another number would miss keys, so the run fails. A task holds the
    chain of its shard, about 1.44 * log2(1/error) bits a key; repeated keys take no room.
    """
    thinned = keys.select("h").where(F.col("h").isNotNull()).mapInArrow(_thin, "h bigint")
    return _fed(thinned, layers, shards).mapInArrow(_run(bound, first_keys, False, shards), LAYERS)


def ask(keys: DataFrame, layers: DataFrame, shards: int, bound: float) -> DataFrame:
    """``(h, maybe_seen)`` for every hash of ``keys``; False is certain, True is wrong at the rate of ``error_bounds``."""
    return _fed(keys.select("h").where(F.col("h").isNotNull()), layers, shards).mapInArrow(_run(bound, FIRST_KEYS, True, shards), "h bigint, maybe_seen boolean")


def error_bounds(layers: DataFrame) -> DataFrame:
    """Per shard: keys held, bits a key, and the compounded bound, the sum of the rates of the layers it has."""
    return layers.groupBy("shard").agg(
        F.count(F.lit(1)).alias("layers"), F.sum("inserted").alias("keys"), F.sum("error").alias("bound"), (F.sum("m") / F.sum("inserted")).alias("bits_per_key")
    )


def seen_before(incoming: DataFrame, key: str, order: str, layers: DataFrame, shards: int, bound: float) -> DataFrame:
    """Adds ``maybe_seen``: whether the key occurred in the history or in an incoming row of smaller ``order``.

    Only the first incoming row of each key asks the chain (found by an aggregate with map-side combine); all later
    ones have been seen for certain, so a key that fills the batch costs one probe. Rows with a NULL key get False;
    a NULL ``order`` comes before no row and after none. Rows that tie in ``order`` don't count as earlier than each other.
    """
    named = incoming.where(F.col(key).isNotNull())
    first = named.groupBy(F.col(key).alias(f"{P}key")).agg(F.min(order).alias(f"{P}first")).withColumn("h", key_hash(F.col(f"{P}key")))
    told = ask(first.select("h").distinct(), layers, shards, bound).select(F.col("h").alias(f"{P}h"), F.col("maybe_seen").alias(f"{P}m"))
    verdict = first.join(told, F.col("h") == F.col(f"{P}h")).select(f"{P}key", f"{P}first", f"{P}m")
    joined = incoming.join(verdict, F.col(key) == F.col(f"{P}key"), "left")
    seen = F.coalesce(F.col(f"{P}m") | (F.col(order) > F.col(f"{P}first")), F.col(f"{P}m"), F.lit(False))
    return joined.withColumn("maybe_seen", seen).drop(f"{P}key", f"{P}first", f"{P}m")
