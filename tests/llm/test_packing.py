import base64

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from keystrata.llm import packing


def slow_pack(sizes, capacity, width):
    """Sum of squares by its definition."""
    bins, out = [], []
    for s in sizes:
        best = None
        for b, used in [*enumerate(bins), (len(bins), 0)]:
            gap = capacity - used
            if s > gap or (b < len(bins) and gap == 0):
                continue
            after = [capacity - u for i, u in enumerate(bins) if i != b] + [gap - s]
            n = np.bincount([g // width for g in after if g >= width], minlength=1)
            key = (int((n**2).sum()), b == len(bins), gap)
            if best is None or key < best[0]:
                best = (key, b)
        b = best[1]
        if b == len(bins):
            bins.append(0)
        bins[b] += s
        out.append(b)
    return bins


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=40))), st.integers(1, 5))
def test_pack_follows_the_rule(case, width):
    capacity, sizes = case
    where = packing.pack(np.array(sizes, np.int64), capacity, width)
    used = np.bincount(where, weights=sizes).astype(int).tolist() if sizes else []
    assert all(u <= capacity for u in used)
    assert sorted(used) == sorted(slow_pack(sizes, capacity, width))


@pytest.fixture
def ranks(tmp_path):
    """A rank file of the single bytes and one pair."""
    lines = [base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)] + [base64.b64encode(b"ab") + b" 256"]
    (tmp_path / "r.tiktoken").write_bytes(b"\n".join(lines))
    return str(tmp_path / "r.tiktoken")


def test_documents_go_whole_into_containers(spark, ranks):
    texts = [(i, "ab" * (i % 13)) for i in range(60)] + [(100, "xyz " * 30), (101, None), (102, ""), (103, "é"), (103, "é")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("shard", F.lit("x"))
    counts = packing.token_counts(docs, ranks=ranks)
    assert {r["doc_id"]: r["n_tokens"] for r in counts.collect()} == {**{i: i % 13 for i in range(60)}, 100: 120, 101: 0, 102: 0, 103: 2}
    targets = spark.createDataFrame([(1, "a", 16), (2, "b", 50), (3, "c", 0), (4, "d", None)], "target_id bigint, label string, capacity_tokens bigint")
    got = packing.containers(counts, targets, docs_per_shard=20).collect()
    for t, cap in ((1, 16), (2, 50)):
        mine = [r for r in got if r["target_id"] == t]
        for r in mine:
            whole = dict((d, len(x or "")) for d, x in texts)
            assert (r["container"] is None) == (r["n_tokens"] == 0)
            assert r["piece"] == 0 or r["doc_id"] == 100, whole
        total = {}
        for r in mine:
            if r["container"] is not None:
                total.setdefault((r["shard"], r["container"]), []).append(r["n_tokens"])
        assert all(sum(v) <= cap for v in total.values())
        long = sorted((r["first_token"], r["n_tokens"]) for r in mine if r["doc_id"] == 100)
        assert long[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(long, long[1:], strict=False)) and sum(n for _, n in long) == 120
        assert all(n == cap for _, n in long[:-1])
        assert len([r for r in mine if r["doc_id"] == 103]) == 2
        assert {r["doc_id"] for r in mine} == {d for d, _ in texts}
    assert {r["target_id"] for r in got} == {1, 2}
    fill = {r["target_id"]: r for r in packing.fill(packing.containers(counts, targets), targets).collect()}
    assert all(r["containers"] >= r["at_least"] and 0.8 < r["used"] <= 1 for r in fill.values())
    assert packing.containers(counts.limit(0), targets).count() == 0
    assert packing.containers(counts, targets.limit(0)).count() == 0


def test_faults_are_found(spark, rows):
    counts = spark.createDataFrame([(1, 4), (2, 9), (3, 25), (4, 0), (None, 3), (5, 4), (5, 4)], "doc_id bigint, n_tokens bigint")
    targets = spark.createDataFrame([(7, 10), (8, 30), (9, None)], "target_id bigint, capacity_tokens bigint")
    good = packing.containers(counts, targets)
    assert rows(packing.faults(good, counts, targets)) == [(7, 0, 0, 0, 7), (8, 0, 0, 0, 7)]
    worse = good.where("NOT (target_id = 8 AND doc_id = 2)").withColumn("container", F.when(F.col("container").isNotNull(), F.when(F.col("target_id") == 7, 0).otherwise(F.col("container"))))
    worse = worse.unionByName(worse.where("target_id = 8 AND doc_id = 1").withColumn("piece", F.lit(1)))
    bad = {r["target_id"]: r for r in packing.faults(worse, counts, targets).collect()}
    assert bad[7]["overfull"] == 1 and bad[8]["split"] == 1 and bad[8]["tokens_off"] == 4 and bad[8]["documents"] == 5
