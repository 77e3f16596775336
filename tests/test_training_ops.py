"""Incremental work, deduplication, change feeds and skew-proof quantiles: odd inputs and brute force."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from keystrata.operators import changefeed, dedup, incremental, intervals, ordered, skew


@pytest.fixture
def clock():
    now = [0]
    return now


def test_ledger_survives_failures(spark, tmp_path, clock):
    led = incremental.WorkLedger(spark, str(tmp_path / "ledger"), ttl=10)
    led.register(spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "item string"), 0)
    led.register(spark.createDataFrame([("c",), ("d",)], "item string"), 0)

    def work(leased, ledger):
        for r in leased.collect():
            spark.createDataFrame([(r["item"], r["token"])], "item string, token bigint").write.mode("overwrite").parquet(ledger.output_path(r["item"]))

    def crash(leased, ledger):
        work(leased.limit(1), ledger)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        led.run("w1", 2, lambda: clock[0], crash)
    assert Counter(r["state"] for r in led.state(1).collect()) == {"leased": 2, "pending": 2}
    assert Counter(r["state"] for r in led.state(11).collect()) == {"pending": 4}
    clock[0] = 20
    while led.run("w2", 3, lambda: clock[0], work).count():
        pass
    assert Counter(r["state"] for r in led.state(21).collect()) == {"done": 4}
    out = spark.read.parquet(f"{tmp_path}/ledger/out").select("item").collect()
    assert sorted(r[0] for r in out) == ["a", "b", "c", "d"]


def test_ledger_rejects_stale_writers(spark, tmp_path):
    led = incremental.WorkLedger(spark, str(tmp_path / "ledger"), ttl=10)
    led.register(spark.createDataFrame([("a",)], "item string"), 0)
    slow = led.lease("slow", 1, 0)
    fast = led.lease("fast", 1, 50)
    assert [r["token"] for r in fast.collect()] == [2]
    assert led.complete(slow, "slow", 51).count() == 0
    assert led.complete(fast, "fast", 52).count() == 1
    assert led.complete(fast, "fast", 53).count() == 0
    assert led.lease("x", 9, 99).count() == 0
    # the fold itself, whatever the coordinator checked
    told = [("i", "LEASED", 1, "", 0, 9), ("i", "LEASED", 2, "", 5, 19), ("i", "DONE", 1, "", 6, None), ("j", "DONE", 3, "", 6, None), (None, "DONE", 1, "", 0, 0)]
    told += [("k", "LEASED", 1, "", 0, 9), ("k", "DONE", 1, "", 4, None), ("k", "LEASED", 2, "", 4, 99)]  # done before it was leased again: stands
    events = spark.createDataFrame([(*e, None) for e in told], incremental.LEDGER)
    assert {r["item"]: r["state"] for r in incremental.ledger_state(events, 10).collect()} == {"i": "leased", "j": "pending", "k": "done"}
    assert {r["item"]: r["state"] for r in incremental.ledger_state(events, 20).collect()}["i"] == "pending"


def test_leases_that_interleave(spark, tmp_path, monkeypatch):
    one, two = (incremental.WorkLedger(spark, str(tmp_path / "ledger"), ttl=10) for _ in range(2))
    one.register(spark.createDataFrame([(x,) for x in "abcd"], "item string"), 0)
    plain, between = incremental.cut_lineage, []

    def cut(df):
        got = plain(df)
        if not between:  # the second worker's whole lease falls between the first one's reading and writing
            between.append(None)
            between[0] = two.lease("two", 2, 0).collect()
        return got

    monkeypatch.setattr(incremental, "cut_lineage", cut)
    mine = one.lease("one", 2, 0).collect()
    assert [r["item"] for r in between[0]] == ["a", "b"] and [r["item"] for r in mine] == ["c", "d"]
    leases = one.events().where("event = 'LEASED'").groupBy("item", "token").count().collect()
    assert len(leases) == 4 and all(r["count"] == 1 for r in leases)
    # a completion that is overtaken by the next lease of its items is stale
    between.clear()
    monkeypatch.setattr(incremental, "cut_lineage", lambda df: (plain(df), between or between.append(1) or two.lease("two", 9, 50))[0])
    assert one.complete(spark.createDataFrame(mine), "one", 50).count() == 0


def test_writes_of_batches_at_once(spark, tmp_path):
    import time
    from concurrent.futures import ThreadPoolExecutor

    one, two = (incremental.WorkLedger(spark, str(tmp_path / "ledger"), ttl=10) for _ in range(2))

    @F.udf("string")
    def slow(x):
        time.sleep(4)
        return x

    late = spark.createDataFrame([("slow",)], "item string").coalesce(1).select(slow("item").alias("item"))
    with ThreadPoolExecutor(2) as pool:
        first = pool.submit(one.register, late, 0)
        while not first.done() and not list((tmp_path / "ledger").rglob("_temporary")):
            time.sleep(0.05)
        two.register(spark.createDataFrame([("quick",)], "item string"), 0)
        first.result()
    assert sorted(r["item"] for r in one.state(0).collect()) == ["quick", "slow"]
    torn = tmp_path / "ledger/batches/torn"
    torn.mkdir()
    kept = sorted((tmp_path / "ledger/batches").iterdir())
    one.sweep(3_600_000)
    assert sorted((tmp_path / "ledger/batches").iterdir()) == kept
    time.sleep(0.1)
    one.sweep(0)
    assert not torn.exists() and one.state(0).count() == 2


RUNS = "file_id bigint, run bigint, begun bigint, over bigint, outcome string, read_pos bigint"


def _readers(spark, runs, now, rewinds=False):
    df = spark.createDataFrame(runs, RUNS)
    ok = F.coalesce(F.upper(F.trim("outcome")) == "OK", F.lit(False))
    events = incremental.attempts(df, ["file_id"], F.col("run"), F.col("begun"), 10, F.col("over"), ok, F.col("read_pos"))
    return df, incremental.ledger_state(events, now, ["file_id"], rewinds)


def test_readers_of_positions(spark, rows):
    runs = [
        (7, 1, 0, 5, "ok", 10), (7, 1, 0, 5, "ok", 10), (7, 2, 5, 9, "FAILED", 20), (7, 3, 9, 12, " OK", 8),  # a later failure or a lower position undoes nothing
        (8, 1, 0, 3, "FAILED", 99), (8, 2, 50, None, None, 99),  # a run that goes on
        (9, 1, 0, 30, "OK", 40), (9, 2, 20, 25, "OK", 15),  # handed on at 20, so the report at 30 is stale
        (5, 1, 0, 3, "OK", None), (None, 1, 0, 3, "OK", 4), (6, None, 0, 3, "OK", 4), (6, 1, None, 3, "OK", 4), (4, 1, 0, None, "OK", 3),
    ]
    df, at = _readers(spark, runs, 55)
    assert rows(at) == [(4, "pending", 1, 3), (5, "pending", 1, None), (7, "pending", 3, 10), (8, "leased", 2, None), (9, "pending", 2, 15)]
    assert rows(_readers(spark, runs, 60)[1])[3] == (8, "pending", 2, None)
    assert rows(_readers(spark, runs, 60, True)[1])[2] == (7, "pending", 3, 8)
    got = incremental.stretches(df.where("run IS NOT NULL").selectExpr("file_id", "run AS token", "read_pos AS position"), ["file_id"], at)
    assert rows(got.where("file_id IN (7, 8, 9)")) == [(7, 8, "done", 3), (7, 10, "done", 2), (7, 20, "pending", 1), (8, 99, "leased", 2), (9, 15, "done", 2), (9, 40, "pending", 1)]
    assert _readers(spark, [], 0)[1].count() == 0


def test_one_reader_with_most_attempts(spark, rows):
    rng = random.Random(11)
    runs, t = [], 0
    for i in range(900):
        file = 1 if rng.random() < 0.4 else rng.randrange(2, 30)
        runs.append((file, i, t, t + rng.randrange(1, 4), rng.choice(["OK", "FAILED", None]), rng.randrange(1000)))
        t += 1
    rng.shuffle(runs)
    want = {}
    for f, r, _, over, outcome, pos in runs:
        later = [b for g, q, b, *_ in runs if g == f and q > r]
        if outcome == "OK" and all(b >= over for b in later):
            want[f] = max(want.get(f, -1), pos)
    got = {r["file_id"]: r["position"] for r in _readers(spark, runs, 10**6)[1].collect() if r["position"] is not None}
    assert got == want


def test_pending_messages(spark, rows):
    e = spark.createDataFrame([(1, 1, 1, 7, 10), (1, 1, 1, 8, 5), (1, 1, 2, 7, 11), (1, 1, 3, 9, 1), (None, 1, 4, 7, 1), (1, 1, 5, None, 1), (1, 1, 6, 7, None), (1, 1, 7, 6, 1), (1, 1, 8, 6, 1), (1, 1, 8, 9, 1)], "grp bigint, term bigint, idx bigint, file_id bigint, pos bigint")
    at = spark.createDataFrame([(7, "pending", 1, 10), (8, "pending", 1, None), (6, "leased", 1, None)], "file_id bigint, state string, token bigint, position bigint")
    got = incremental.pending_messages(e, at, ["grp", "term", "idx"], "file_id", "pos")
    assert rows(got) == [(1, 1, 2), (1, 1, 3), (1, 1, 5), (1, 1, 6), (1, 1, 8)]
    assert incremental.pending_messages(e.limit(0), at, ["grp", "term", "idx"], "file_id", "pos").count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_pending_versions(spark, rows, monkeypatch, few):
    if not few:
        monkeypatch.setattr(incremental, "small", lambda df: None)
    diffs = spark.createDataFrame([(1, 1, 10), (1, 2, 90), (1, 2, 20), (1, 3, 99), (2, 1, 5), (None, 1, 1), (1, None, 1)], "r bigint, v bigint, t bigint")
    members = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (3, 5), (1, None), (2, 9)], "r bigint, n bigint")
    acks = spark.createDataFrame([(1, 5, "pending", 50, 4), (2, 9, "leased", 50, 1)], "r bigint, n bigint, state string, token bigint, position bigint")
    got = incremental.pending_versions(diffs, members, acks, "r", "n", "v", "t")
    assert rows(got) == [(1, 5, 3), (1, 6, 1), (1, 6, 2), (1, 6, 3)]


def test_dedup(spark, rows):
    data = [(1, 1, 5, "a"), (1, 1, 3, "b"), (1, 2, 9, "c"), (None, 1, 1, "d"), (None, 1, 1, "d"), (2, 2, None, "e"), (2, 2, None, "f"), (3, 3, 4, "g"), (3, 3, 4, "g")]
    df = spark.createDataFrame(data, "a int, b int, o int, n string")
    kept = rows(dedup.one_copy_each(df, ["a", "b"], "o"))
    assert [r for r in kept if r[0] == 1] == [(1, 1, 3, "b"), (1, 2, 9, "c")]
    assert len([r for r in kept if r[0] is None]) == 2 and len([r for r in kept if r[0] == 2]) == 1 and len([r for r in kept if r[0] == 3]) == 1
    assert rows(dedup.repeats(df, ["a", "b"], "o")) == [(1, 1, 5, "a")]
    new = spark.createDataFrame([(1, 1, 9, 0), (7, 7, 1, 0)], "a int, b int, o int, `__ks` int")
    both = dedup.one_copy_each(df, ["a", "b"], "o", new)
    assert both.where("a = 1 AND b = 1").count() == 1 and both.where("a = 7").count() == 1
    assert dedup.one_copy_each(df.limit(0), ["a", "b"], "o").count() == 0
    with pytest.raises(ValueError, match="missing"):
        dedup.repeats(df, ["zz"], "o")


def test_change_feed_in_any_order(spark, rows):
    rng = random.Random(3)
    feed = [(f"k{rng.randrange(9)}", s, rng.randrange(2), rng.choice(["PUT", "DELETE"]), f"v{s}") for s in range(200)]
    feed += rng.sample(feed, 60) + [(None, 1, 0, "PUT", "x"), ("k1", None, 0, "PUT", "x"), ("k1", 999, 0, None, "x")]
    want = {}
    for k, s, i, op, v in sorted((f for f in feed if None not in f), key=lambda f: f[1:3]):
        want[k] = (s, i, op, v)
    rng.shuffle(feed)
    schema = "k string, s bigint, i int, o string, v string"
    fold = lambda part, base=None: changefeed.fold_changes(spark.createDataFrame(part, schema), ["k"], ["s", "i"], F.col("o"), ["v"], base)
    assert {r[0]: tuple(r[1:]) for r in fold(feed).collect()} == want
    by_batch = fold(feed[200:], fold(feed[100:200], fold(feed[:100])))
    assert {r[0]: tuple(r[1:]) for r in by_batch.collect()} == want
    assert {r[0] for r in changefeed.live(by_batch).collect()} == {k for k, x in want.items() if x[2] == "PUT"}
    assert fold(feed[:0]).count() == 0


def test_packed_fold_is_the_plain_one(spark, rows):
    rng = random.Random(8)
    top = [-(2**63), -5, 0, 7, 2**63 - 1]
    feed = [(rng.choice("abc"), rng.choice(top), rng.choice([None, -(2**31), -1, 0, 3, 2**31 - 1]), rng.choice(["PUT", "DELETE"])) for _ in range(300)]
    for n in range(1, 300, 37):
        df = spark.createDataFrame(feed[:n], "k string, s bigint, i int, o string")
        fold = lambda kinds: changefeed.fold_changes(df, ["k"], ["s", "i"], F.col("o"), kinds=kinds)  # noqa: B023, E731
        assert rows(fold(("PUT", "DELETE"))) == rows(fold(()))
    plan = fold(("PUT", "DELETE"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") >= 2
    odd = spark.createDataFrame([("a", 1, 0, "PUT"), ("a", 2, 0, "NOPE"), ("b", 1, 0, "NOPE"), ("b", 1, 0, "DELETE")], "k string, s bigint, i int, o string")
    assert rows(changefeed.fold_changes(odd, ["k"], ["s", "i"], F.col("o"), kinds=("PUT", "DELETE"))) == [("a", 2, 0, None), ("b", 1, 0, "DELETE")]


def test_copies_are_counted_once(spark):
    """One scan for the count, which is kept, and one for each side of the split."""
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "a int, o int, n string")
    got = dedup.one_copy_each(df, ["a"], "o")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("count(1)") == 0 and plan.count("Join LeftAnti") == 1 and plan.count("Join LeftSemi") == 1


@pytest.mark.parametrize(("few", "bins"), [(True, 16), (False, 16), (True, 4096)])
def test_quantiles_against_brute_force(spark, monkeypatch, few, bins):
    if not few:
        monkeypatch.setattr(skew, "checked_broadcast", lambda df: df)
    rng = random.Random(5)
    data = [("hot", rng.randrange(-(10**12), 10**12)) for _ in range(3000)] + [("same", 7)] * 500 + [(f"k{i % 40}", rng.randrange(100)) for i in range(400)]
    data += [("null", None), ("k1", None), (None, 3)]
    df = spark.createDataFrame(data, "key string, v bigint").withColumn("n", F.lit(1)).repartition(5)
    by = defaultdict(list)
    for k, v in data:
        by[k].append(v)
    probs = {"lo": 0.0, "mid": 0.5, "hi": 0.95, "top": 1.0}

    def want(vs):
        xs = sorted(v for v in vs if v is not None)
        return tuple(xs[max(1, -int(-p * len(xs) // 1)) - 1] if xs else None for p in probs.values())

    got = {r["key"]: (r["n"], *r[2:]) for r in skew.exact_quantiles(df.select("key", "v"), ["key"], F.col("v"), probs, bins=bins).collect()}
    assert got == {k: (len(v), *want(v)) for k, v in by.items() if k is not None}
    share = skew.exact_quantiles(df, ["key"], F.col("v"), probs, Fraction(1, 10), bins)
    assert {r["key"] for r in share.collect()} == {"hot", "same"}
    assert skew.exact_quantiles(df.limit(0), ["key"], F.col("v"), probs).count() == 0


@pytest.mark.parametrize("inclusive", [True, False])
def test_overlaps_against_all_pairs(spark, inclusive):
    rng = random.Random(12)

    def some(n, base):
        out = []
        for i in range(n):
            lo = rng.randrange(40)
            out.append((base + i, None if rng.random() < 0.1 else lo, None if rng.random() < 0.1 else lo + rng.randrange(1, 9)))
        return [*out, out[0]]

    a, b = some(40, 0), some(60, 100)
    schema = "id int, lo int, hi int"
    meets = (lambda x, y: x <= y) if inclusive else (lambda x, y: x < y)
    want = sorted((p[0], q[0]) for p in a for q in b if (p[1] is None or q[2] is None or meets(p[1], q[2])) and (q[1] is None or p[2] is None or meets(q[1], p[2])))
    got = intervals.overlap_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ("lo", "hi"), ("lo", "hi"), inclusive)
    assert sorted((r["a"]["id"], r["b"]["id"]) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    none = spark.createDataFrame([], schema)
    assert intervals.overlap_pairs(none, none, ("lo", "hi"), ("lo", "hi")).count() == 0


def test_rows_are_numbered_as_they_come(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("x")).orderBy(F.desc("x"))
    got = ordered.numbered(df).collect()
    assert sorted((r["position"], r["x"]) for r in got) == [(i + 1, 999 - i) for i in range(1000)]


def test_ordered_against_plain_windows(spark, rows):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), i, rng.choice([None, rng.randrange(50)])) for i in range(900)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, o int, v int")
    for group in (["g"], []):
        got = ordered.ordered(df, group, [F.col("o")], {"s": F.col("v")}, {"l": F.col("v")}, {"n": F.col("o")}, {"z": F.col("v")}, {"m": F.col("v")}, {"x": F.col("v")}, {"b": (F.col("v"), lambda before, now: ~before.eqNullSafe(now)), "c": (F.struct("v", "o"), lambda before, now: now["v"] < before["v"])})
        want = []
        by = defaultdict(list)
        for g, o, v in sorted(data, key=lambda r: r[1]):
            by[g if group else 0].append((g, o, v))
        for rs in by.values():
            total, last, b, c = 0, None, 0, 0
            for i, (g, o, v) in enumerate(rs):
                had = rs[i - 1][2] if i else None
                b += i == 0 or v != had
                c += i == 0 or v is None or had is None or v < had
                total, last = total + (v or 0), v if v is not None else last
                later = [x[2] for x in rs[i + 1 :] if x[2] is not None]
                want.append((g, o, v, total, rs[i - 1][2] if i else None, rs[i + 1][1] if i + 1 < len(rs) else None, last, min(later, default=None), max((x[2] for x in rs[:i] if x[2] is not None), default=None), b, c))
        assert rows(got) == sorted(want, key=lambda t: tuple((x is not None, x) for x in t))
    assert ordered.ordered(df.limit(0), [], [F.col("o")], {"s": F.col("v")}).count() == 0
