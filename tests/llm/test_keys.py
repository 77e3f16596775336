"""Seen keys and frequent items."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import heavy_hitters, seen_keys


def hashes(n, seed):
    return np.random.default_rng(seed).integers(-(2**63), 2**63 - 1, n, dtype=np.int64)


def test_chain_grows_within_its_bound():
    old, new = hashes(60_000, 1), hashes(200_000, 2)
    chain = seen_keys.Chain(1e-2, first_keys=500)
    for part in np.array_split(old, 37):
        chain.add(part)
    assert chain.contains(old).all()
    assert len(chain.layers) > 5 and all(b.m > a.m and b.error < a.error for a, b in zip(chain.layers, chain.layers[1:], strict=False))
    assert sum(x.error for x in chain.layers) <= 1e-2
    assert all(x.fill <= 0.51 for x in chain.layers)
    assert chain.contains(new).mean() <= 1e-2
    before = [x.inserted for x in chain.layers]
    chain.add(old)
    assert [x.inserted for x in chain.layers] == before


def test_seen_before_against_brute_force(spark):
    rng = random.Random(4)
    history = [rng.choice(["hot", None, f"k{rng.randrange(3000)}"]) for _ in range(5000)]
    incoming = [(i, rng.choice(["hot", "new-hot", None, f"k{rng.randrange(6000)}"]), 1) for i in range(4000)]
    incoming += [(None, "never", 1), (None, "hot", 1), (9001, "tie", 1), (9001, "tie", 1)]
    rng.shuffle(incoming)
    h = spark.createDataFrame([(x,) for x in history], "key string").repartition(5)
    i = spark.createDataFrame(incoming, "id int, key string, maybe int").repartition(5)
    hist = h.where("key IS NOT NULL").select(seen_keys.key_hash(F.col("key")).alias("h"))
    layers = seen_keys.remember(hist, 4, 1e-6, first_keys=64)
    got = Counter((r["id"], r["key"], r["maybe_seen"]) for r in seen_keys.seen_before(i, "key", "id", layers, 4, 1e-6).collect())
    known, first = set(history) - {None}, {}
    for x, k, _ in incoming:
        if k is not None and x is not None:
            first[k] = min(first.get(k, x), x)
    want = Counter((x, k, k is not None and (k in known or (x is not None and x > first.get(k, 10**9)))) for x, k, _ in incoming)
    assert got == want


def test_layers_go_on_from_a_stored_state(spark, tmp_path):
    a, b = hashes(3000, 5), hashes(3000, 6)
    frame = lambda x: spark.createDataFrame([(int(v),) for v in x], "h bigint").repartition(3)
    seen_keys.remember(frame(a), 4, 1e-4, first_keys=100).write.parquet(str(tmp_path / "1"))
    stored = spark.read.parquet(str(tmp_path / "1"))
    seen_keys.remember(frame(np.concatenate([b, a[:500]])), 4, 1e-4, stored).write.parquet(str(tmp_path / "2"))
    after = spark.read.parquet(str(tmp_path / "2"))
    assert after.agg(F.sum("inserted")).first()[0] == 6000
    told = {r["h"]: r["maybe_seen"] for r in seen_keys.ask(frame(np.concatenate([a, b, hashes(2000, 7)])), after, 4, 1e-4).collect()}
    assert all(told[int(x)] for x in np.concatenate([a, b])) and sum(told.values()) <= 6003
    for number in (2, 8):
        with pytest.raises(Exception, match="made with 4 shards"):
            seen_keys.ask(frame(a), after, number, 1e-4).collect()
        with pytest.raises(Exception, match="made with 4 shards"):
            seen_keys.remember(frame(a), number, 1e-4, after).collect()
    assert all(r["bound"] <= 1e-4 for r in seen_keys.error_bounds(after).collect())


def test_every_hash_is_kept(spark):
    """Zero and the ends among them; a task's table of recent hashes starts empty."""
    odd = spark.createDataFrame([(0,), (-1,), (2**63 - 1,), (-(2**63),), (0,), (None,)], "h bigint")
    layers = seen_keys.remember(odd, 16, 1e-6)
    assert layers.agg(F.sum("inserted")).first()[0] == 4
    assert all(r["maybe_seen"] for r in seen_keys.ask(odd, layers, 16, 1e-6).collect())


def test_empty_history_and_batch(spark):
    none = spark.createDataFrame([], "h bigint")
    layers = seen_keys.remember(none, 4, 1e-3)
    one = spark.createDataFrame([(1, "a"), (2, "a")], "id int, key string")
    assert {r["id"]: r["maybe_seen"] for r in seen_keys.seen_before(one, "key", "id", layers, 4, 1e-3).collect()} == {1: False, 2: True}
    assert seen_keys.seen_before(one.limit(0), "key", "id", layers, 4, 1e-3).count() == 0


@pytest.mark.parametrize("buckets", [4, 8192])
def test_frequent_against_brute_force(spark, monkeypatch, buckets):
    rng = random.Random(8)
    data = ["hot"] * 900 + [None] * 500 + ["", "é"] * 40 + [f"k{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    df = spark.createDataFrame([(x, 1, 2) for x in data], "key string, n int, b int").repartition(6)
    for share in (Fraction(1, 100), Fraction(1, 7), Fraction(1, 1)):
        n = Counter(data)
        want = {k: v for k, v in n.items() if k is not None and v * share.denominator >= len(data) * share.numerator}
        assert {r["key"]: r["n"] for r in heavy_hitters.frequent(df, "key", share, buckets=buckets).collect()} == want
    monkeypatch.setattr(heavy_hitters, "LISTED", 0)
    assert {r["key"]: r["n"] for r in heavy_hitters.frequent(df, "key", Fraction(1, 100), buckets=buckets).collect()} == {k: v for k, v in n.items() if k is not None and v * 100 >= len(data)}
    assert heavy_hitters.buckets_for(Fraction(1, 200)) == 8192 < heavy_hitters.buckets_for(Fraction(1, 10**4)) <= heavy_hitters.MOST_BUCKETS == heavy_hitters.buckets_for(Fraction(1, 10**9))
    assert heavy_hitters.frequent(df.limit(0), "key", Fraction(1, 2)).count() == 0
    assert heavy_hitters.frequent(df.where("key IS NULL"), "key", Fraction(1, 2)).count() == 0
