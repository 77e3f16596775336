from pyspark.sql import functions as F

from keystrata.operators import requests, routing


def ranges_of(spark, data):
    return spark.createDataFrame(data, "grp bigint, start_key string, end_key string, raft_nodes map<bigint,bigint>, leader bigint")


def test_routing(spark, rows, monkeypatch):
    r = ranges_of(spark, [(1, "b", "d", {11: 1}, 11), (2, "d", "f", {21: 2}, 0), (3, "x", None, {31: 3}, 99), (4, None, "a", {41: 4}, None)])
    keys = spark.createDataFrame([("b",), ("c",), ("d",), ("f",), ("zz",), ("a",), ("A",), (None,), ("",)], "user_key string")
    want = [(None, None), ("", 4), ("A", 4), ("a", None), ("b", 1), ("c", 1), ("d", 2), ("f", None), ("zz", 3)]
    got = {k: g for k, g in rows(routing.route(keys, "user_key", r))}
    want = dict(want)
    want[None] = None
    assert {k: g for k, g in got.items() if k is not None} == {k: g for k, g in want.items() if k is not None}
    lead = {x["user_key"]: (x["leader"], x["leader_node"]) for x in routing.route_to_leader(keys.where("user_key is not null"), "user_key", r).collect()}
    assert lead["b"] == (11, 1) and lead["d"] == (None, None) and lead["zz"] == (None, None)
    monkeypatch.setattr(routing, "TREE_RANGES", 2)
    assert {k: g for k, g in rows(routing.route(keys, "user_key", r)) if k is not None} == {k: g for k, g in want.items() if k is not None}
    assert routing.route(keys, "user_key", r.limit(0)).where("grp is not null").count() == 0


def test_conflicts(spark, rows):
    r = ranges_of(spark, [(1, "a", "c", {1: 1}, 1), (2, "c", "e", {2: 1}, 1), (3, "d", None, {3: 1}, 1), (4, "zz", "zzz", {4: 1}, 1)])
    assert rows(routing.key_range_conflicts(r)) == [(1, 2), (2, 3), (3, 4)]
    assert rows(routing.key_range_conflicts(r, inclusive=False)) == [(2, 3), (3, 4)]
    assert routing.key_range_conflicts(r.limit(0)).count() == 0


def test_membership(spark, rows):
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "node_id bigint, host string")
    all_, rejected = routing.add_nodes(nodes, spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], "node_id bigint, host string"))
    assert rows(all_.select("node_id")) == [(1,), (2,), (3,)] and rows(rejected) == [(2, "x")]
    beats = spark.createDataFrame([(1, 100), (2, 10), (None, 100)], "node bigint, s int").withColumn("at", F.timestamp_seconds("s"))
    now = F.timestamp_seconds(F.lit(105))
    assert rows(routing.live_nodes(beats, "node", now, 10).select("node")) == [(1,)]
    assert routing.pick_live_node(beats, "node", now, 1000, 1).count() == 1


def test_classification(spark, rows):
    ops = spark.createDataFrame(
        [(1, 0, "t_get", "k", None, 5), (1, 0, "t_get", "k", None, 5), (1, 1, " PUT", "k", "v", 5), (2, 0, "None ", None, None, None), (3, 0, "get", "k", None, 0), (3, 1, "NONE", None, None, 0), (4, 0, "Snapshot", None, None, 8), (None, 0, "GET", "k", None, 1)],
        "request_id bigint, op_idx int, op_type string, user_key string, op_value string, sequence bigint",
    ).withColumn("target", F.lit(1).cast("bigint")).withColumn("arrived_at", F.lit(0).cast("timestamp"))
    one = requests.distinct_ops(ops)
    got = {r["request_id"]: (r["kind"], r["read_only"], r["n_ops"]) for r in requests.classify(one).collect()}
    assert got == {1: ("TXN", False, 2), 2: ("NONE", True, 1), 3: ("GET", True, 2), 4: ("SNAPSHOT", True, 1)}
    v = spark.createDataFrame([("k", 5, "PUT", "v"), ("k", 6, "PUT", "w")], "user_key string, sequence bigint, op string, value string")
    res = {(r[0], r[1]): r["result"] for r in requests.evaluate(one, v).collect()}
    assert res == {(1, 0): "v", (1, 1): "v", (2, 0): None, (3, 0): "w", (3, 1): None, (4, 0): "8"}


def test_release(spark, rows):
    reads = spark.createDataFrame([(1, 5, 100), (1, 9, 101), (1, 11, 102), (2, 1, 103)], "g int, i bigint, id bigint")
    applied = spark.createDataFrame([(1, 5), (1, 10)], "g int, i bigint")
    assert rows(requests.release_reads(reads, applied, "g", "i", "id")) == [(100, 5), (101, 10)]
