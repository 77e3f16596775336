"""Tables of expected results: snapshots, seeks, merge order, garbage collection, manifest, log, codecs."""

import pytest
from pyspark.sql import functions as F

from keystrata.functions import codec
from keystrata.operators import compaction, manifest, merge, raftlog, reads

MAX = reads.LATEST


# Versions, seeks, scans and what garbage collection keeps, as the engine's semantics define them.


@pytest.fixture(scope="module")
def mvcc(spark):
    data = []
    for k in (2, 4, 6, 8, 10, 12):
        data += [(f"k{k:02d}", 3, "DELETE", None), (f"k{k:02d}", 2, "PUT", f"v{k:02d}-02")]
    for k in (3, 7, 11):
        data += [(f"k{k:02d}", s, "PUT", f"v{k:02d}-{s:02d}") for s in (4, 3, 2)]
    for k in (5, 9):
        data += [(f"k{k:02d}", s, "PUT", f"v{k:02d}-{s:02d}") for s in (5, 4, 3, 2, 1)]
    return spark.createDataFrame(data, "user_key string, sequence bigint, op string, value string").cache()


def got(df):
    r = df.collect()
    return (r[0]["value"], r[0]["found"]) if r else None


@pytest.mark.parametrize(
    ("key", "backward", "want"),
    [
        (None, False, {MAX: "v03-04", 3: "v03-03", 2: "v02-02", 1: "v05-01", 0: None}),
        (None, True, {MAX: "v11-04", 3: "v11-03", 2: "v12-02", 1: "v09-01", 0: None}),
        ("k06", False, {MAX: ("v07-04", True), 3: ("v07-03", True), 2: ("v06-02", True), 1: ("v09-01", False), 0: None}),
        ("k08", True, {MAX: ("v07-04", True), 3: ("v07-03", True), 2: ("v08-02", True), 1: ("v05-01", False), 0: None}),
        ("k07", False, {MAX: ("v07-04", True), 4: ("v07-04", True), 3: ("v07-03", True), 2: ("v07-02", True), 1: ("v09-01", False)}),
        ("k07", True, {MAX: ("v07-04", True), 4: ("v07-04", True), 3: ("v07-03", True), 2: ("v07-02", True), 1: ("v05-01", False)}),
        ("k01", False, {MAX: ("v03-04", False)}),
        ("k01", True, {MAX: None}),
        ("k12", False, {MAX: None}),
        ("k12", True, {MAX: ("v11-04", True)}),
    ],
)
def test_seek(mvcc, key, backward, want):
    for s, expected in want.items():
        if isinstance(expected, str):
            expected = (expected, False)
        assert got(reads.seek(mvcc, key, s, backward)) == expected


def test_scans(mvcc):
    values = lambda s, **k: [r["value"] for r in reads.scan(mvcc, s, **k).collect()]
    assert values(3) == ["v03-03", "v05-03", "v07-03", "v09-03", "v11-03"]
    assert values(2) == [f"v{k:02d}-02" for k in range(2, 13)]
    assert values(1) == ["v05-01", "v09-01"]
    assert values(3, backward=True) == ["v11-03", "v09-03", "v07-03", "v05-03", "v03-03"]
    assert values(3, lo="k05", hi="k09") == ["v05-03", "v07-03"]


def test_direction_switch(mvcc):
    near = {r[0]: (r[1], r[2]) for r in reads.neighbours(reads.live(mvcc, 3)).collect()}
    assert near["k07"] == ("k05", "k09")
    assert near["k03"][0] is None and near["k11"][1] is None


def test_point_reads(spark, mvcc):
    asked = spark.createDataFrame([("k03",), ("k02",), ("zz",), (None,), ("k03",)], "user_key string")
    assert sorted(map(tuple, reads.get(mvcc, asked).collect())) == [("k02", None, False), ("k03", "v03-04", True), ("zz", None, False)]
    assert reads.snapshot(mvcc).first()[0] == 5
    assert reads.snapshot(mvcc.limit(0)).first()[0] == 0
    at = spark.createDataFrame([(1, "k05", 3), (2, "k05", 0), (3, "k05", None), (4, "k02", 2), (5, "zz", 9), (6, None, 1)], "id int, user_key string, at bigint")
    assert {r["id"]: r["value"] for r in reads.get_as_of(mvcc, at, ["id"]).collect()} == {1: "v05-03", 2: "v05-05", 3: "v05-05", 4: "v02-02", 5: None}


def test_merge_and_concat(spark):
    def run(*ns):
        return spark.createDataFrame([(f"k{n:02d}", n, "PUT", f"v{n:02d}") for n in ns], "user_key string, sequence bigint, op string, value string")

    merged = merge.merge([run(1, 5, 9), run(2, 6, 10), run(3, 7, 11)])
    assert [r["sequence"] for r in merged.collect()] == [1, 2, 3, 5, 6, 7, 9, 10, 11]
    assert [r["sequence"] for r in merge.merge([run(1, 5), run(2)], backward=True).collect()] == [5, 2, 1]
    assert [r["sequence"] for r in merge.concat([run(1, 2, 3), run(5, 6, 7), run(9)]).collect()] == [1, 2, 3, 5, 6, 7, 9]
    assert got(reads.seek(merged, "k04")) == ("v05", False)
    assert got(reads.seek(merged, "k04", backward=True)) == ("v03", False)
    assert merge.merge([run(1), run(1)]).count() == 2


def test_compaction_filter(spark, rows):
    data = [("k1", 20), ("k1", 10), ("k1", 1), ("k2", 1), ("k4", 100), ("k4", 20), ("k4", 8), ("k4", 1)]
    v = spark.createDataFrame([(k, s, "PUT", f"{k}-{s}") for k, s in data], "user_key string, sequence bigint, op string, value string")
    compat = {(r[0], r[1]) for r in compaction.collect_garbage(v, 10, "compat").collect()}
    assert compat == {("k1", 20), ("k1", 10), ("k2", 1), ("k4", 100), ("k4", 20)}
    safe = {(r[0], r[1]) for r in compaction.collect_garbage(v, 10).collect()}
    assert safe == compat | {("k4", 8)}
    with pytest.raises(ValueError, match="safe mode"):
        compaction.collect_garbage(v, 10, "compat", last_level=True)


def test_compaction_keeps_snapshots(mvcc, rows):
    for last in (False, True):
        kept = compaction.collect_garbage(mvcc, 3, last_level=last)
        for s in (3, 4, 5, MAX):
            assert rows(reads.live(kept, s)) == rows(reads.live(mvcc, s))
    assert compaction.collect_garbage(mvcc, 3).count() < mvcc.count()


def test_compact_keeps_keys_whole(mvcc):
    out = compaction.compact([mvcc.where("sequence % 2 = 0"), mvcc.where("sequence % 2 = 1")], 1, 40, ["k05", "k09"], keep=lambda df: df.where("user_key != 'k12'"))
    per = out.groupBy("user_key").agg(F.count_distinct("chunk").alias("c"), F.min("part").alias("p")).collect()
    assert all(r["c"] == 1 for r in per)
    assert {r["user_key"]: r["p"] for r in per}["k05"] == 1 and "k12" not in {r["user_key"] for r in per}
    assert out.agg(F.count_distinct("chunk")).first()[0] > 2


def test_levels_and_picks(spark, rows):
    sizes = spark.createDataFrame([(0, 10**9), (1, 100), (2, 200), (3, 10**9)], "level int, data_size bigint")
    o = compaction.LsmOptions(l1_capacity=100, multiplier=2, levels=4)
    assert [r["over"] for r in compaction.overstepped_levels(sizes, o).orderBy("level").collect()] == [False] * 4
    assert compaction.overstepped_levels(sizes.withColumn("data_size", F.col("data_size") + 1), o).where("over").count() == 2
    assert compaction.target_level(3, o) == (3, "lz4_raw")
    with pytest.raises(ValueError, match="level 9"):
        o.codec(9)
    ssts = spark.createDataFrame([(1, 0, "aaa", "fff"), (2, 0, "bbb", "ggg"), (3, 0, "xxx", "zzz"), (4, 1, "bbb", "fff"), (5, 3, "xxx", "zzz"), (6, 4, "aaa", "ddd"), (7, 4, "eee", "fff")], "sst_id bigint, level int, first_key string, last_key string")
    picked = {r[0]: r[1] for r in manifest.listed(manifest.pick_by_range(ssts, "eee", "fff"), 7).collect()}
    assert [picked[i] for i in range(7)] == [[1, 2], [4], [], [], [7], [], []]
    assert {r[0]: r[1] for r in manifest.listed(manifest.pick_by_ids(ssts, []), 7).collect()} == {i: [] for i in range(7)}
    assert {r[0]: r[1] for r in manifest.listed(manifest.pick_by_ids(ssts, [7]), 7).collect()}[0] == [1, 2]
    ranges = spark.createDataFrame([(1, "a", "h"), (2, "x", None)], "grp bigint, start_key string, end_key string")
    assert rows(compaction.l0_candidates(ssts, ranges, 2)) == [(1, 2)]
    pins = spark.createDataFrame([(2,)], "sst_id bigint")
    assert rows(compaction.l0_candidates(ssts, ranges, 1, pins)) == [(2, 1)]
    assert rows(compaction.pick_runs(ssts, ranges, 0, compaction.LsmOptions(l0_trigger=2), 7)) == [(1, 0, 1), (1, 0, 2), (1, 1, 4)]
    assert compaction.pick_runs(ssts, ranges, 0, compaction.LsmOptions(l0_trigger=2), 7, pins).count() == 0
    assert dict(manifest.overlap_counts(ssts).collect()) == {1: 4, 2: 4, 3: 1, 4: 4, 5: 1, 6: 3, 7: 3}
    assert dict(manifest.non_overlap(ssts).collect()) == {0: False, 1: True, 3: True, 4: True}
    diff = compaction.compaction_diff(ssts.where("level = 0"), 0, ssts.where("level = 1"), spark.createDataFrame([(9, 5)], "sst_id bigint, data_size bigint"), 1)
    assert diff.where("op = 'DELETE'").count() == 4 and diff.where("op = 'INSERT'").first()["sst_id"] == 9


def test_manifest(spark, rows):
    d = spark.createDataFrame(
        [(1, 0, 1, 0, "INSERT", 5), (1, 1, 2, 1, "INSERT", 6), (2, 0, 8, 1, "INSERT", 7), (3, 0, 2, 1, "DELETE", 0), (5, 0, 77, 1, "DELETE", 0)],
        "version_id bigint, op_idx int, sst_id bigint, level int, op string, data_size bigint",
    )
    assert rows(manifest.fold(d, ["sst_id", "level"])) == [(1, 0, 5), (8, 1, 7)]
    assert rows(manifest.unknown_deletes(d, ["sst_id", "level"])) == [(77, 1)]
    assert rows(manifest.gaps(d, [])) == [(5, 3)]
    assert [r["version_id"] for r in manifest.diffs_from(d, 2, 2).collect()] == [2, 3]
    with pytest.raises(ValueError, match="expired"):
        manifest.diffs_from(manifest.squash(d, 3), 1, 2)
    assert manifest.next_diff(spark.range(1), d).first()["version_id"] == 6
    with pytest.raises(ValueError, match="follow"):
        manifest.next_diff(spark.range(1), d, 9)
    after, told = manifest.insert_l0(spark.createDataFrame([(50, 1), (51, 2)], "sst_id bigint, data_size bigint"), d, 5)
    assert after.count() == 7 and rows(told.select("version_id", "op_idx", "sst_id"))[1:] == [(6, 0, 50), (6, 1, 51)]
    with pytest.raises(ValueError, match="before"):
        manifest.advance_watermark(5, 4)
    with pytest.raises(ValueError, match="level"):
        manifest.with_level_options(d, spark.createDataFrame([(0, "x")], "level int, codec string"))


def test_raft_log(spark, rows):
    log, pos = [], 0

    def add(kind, grp, idx, term=None):
        nonlocal pos
        pos += 1
        log.append((pos, kind, grp, term, idx))

    for i in range(1, 201):
        add("ENTRY", 1, i, 1)
    add("COMPACT", 1, 101)
    for i in range(251, 351):
        add("ENTRY", 2, i, 2)
    for i in range(301, 401):
        add("ENTRY", 2, i, 3)
    for i in range(301, 401):
        add("ENTRY", 2, i, 1)  # an older term changes nothing
    add("TRUNCATE", 1, 180)
    add("ENTRY", 1, 180, 2)
    df = spark.createDataFrame(log, "pos bigint, kind string, grp bigint, term bigint, idx bigint")
    left = raftlog.survivors(df)
    assert rows(raftlog.bounds(left)) == [(1, 101, 180, 80, False), (2, 251, 400, 150, False)]
    assert rows(left.where("grp = 2").groupBy("term").count()) == [(2, 50), (3, 100)]
    assert rows(raftlog.phantom_terms(df)) == [(1, 100, 1)]
    assert rows(raftlog.group_terms(left).select("grp", "term", "first_index", "last_index")) == [(1, 1, 101, 179), (1, 2, 180, 180), (2, 2, 251, 300), (2, 3, 301, 400)]
    assert [r["idx"] for r in raftlog.entries(left, 2, 399, 9).collect()] == [399, 400]
    for index in (250, 401):
        with pytest.raises(ValueError, match="outside"):
            raftlog.entries(left, 2, index, 1)
        assert raftlog.entries(left, 2, index, 1, strict=False).count() == int(index == 250)
    assert raftlog.remove_groups(df, spark.createDataFrame([(1,)], "grp bigint")).where("grp = 1").count() == 0


def test_raft_batches(spark, rows):
    data = [(i, "ENTRY", g, t, x) for i, (g, t, x) in enumerate((g, t, x) for g in (1, 2) for t in (1, 2) for x in (1, 2))]
    df = spark.createDataFrame(data, "pos bigint, kind string, grp bigint, term bigint, idx bigint")
    assert raftlog.batches(df).count() == 4


def test_log_kv(spark, rows):
    df = spark.createDataFrame([(1, "PUT", 1, b"k", b"1"), (2, "PUT", 1, b"k", b"2"), (3, "PUT", 1, b"d", b"x"), (4, "DELETE", 1, b"d", None), (5, "PUT", 1, None, b"x")], "pos bigint, kind string, grp bigint, rec_key binary, rec_value binary")
    assert [(r[0], bytes(r[1]), bytes(r[2])) for r in raftlog.log_kv(df).collect()] == [(1, b"k", b"2")]


@pytest.mark.parametrize("key", [1, 5, 10, 15, 5558, 9995, 9999])
@pytest.mark.parametrize("less", [False, True])
@pytest.mark.parametrize("equal", [False, True])
def test_floor_and_ceiling(spark, key, less, equal):
    keys = list(range(5, 10000, 10))
    v = spark.range(5, 10000, 10).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("user_key"), F.lit(1).cast("bigint").alias("sequence"), F.lit("PUT").alias("op"), F.col("id").cast("string").alias("value"))
    fits = [k for k in keys if (k < key if less else k > key) or (equal and k == key)]
    want = (max(fits) if less else min(fits)) if fits else None
    r = reads.seek(v, f"{key:05d}", backward=less, strict=not equal).collect()
    assert (int(r[0]["value"]) if r else None) == want


def test_codecs(spark):
    r = spark.range(1).select(*[codec.varint_length(F.lit(n)).alias(f"n{i}") for i, n in enumerate((2**7 - 1, 2**7, 2**14 - 1, 2**21 - 1, 2**28 - 1, 2**32 - 1))]).first()
    assert tuple(r) == (1, 2, 2, 3, 4, 5)
    df = spark.createDataFrame([("k1", 5, "PUT", "v"), ("k1", 4, "DELETE", None), ("k1", 3, "PUT", ""), ("k2", 2**62, "PUT", "x")], "k string, s bigint, op string, v string")
    f = df.select("*", codec.full_key(F.col("k"), F.col("s")).alias("f"), codec.raw_value(F.col("op"), F.col("v")).alias("r"))
    back = f.select("k", "s", codec.user_key_of(F.col("f")).cast("string").alias("k2"), codec.sequence_of(F.col("f")).alias("s2"), "v", codec.value_of(F.col("r")).cast("string").alias("v2"), "f")
    out = back.orderBy("f").collect()
    assert [(x["k"], x["s"]) for x in out] == [("k1", 5), ("k1", 4), ("k1", 3), ("k2", 2**62)]
    assert all(x["k"] == x["k2"] and x["s"] == x["s2"] and x["v"] == x["v2"] for x in out)
    assert bytes(f.where("op = 'DELETE'").first()["r"]) == b"\x00"
    assert codec.parse_bytes("64 KiB") == 65536 and codec.parse_bytes("1MB") == 10**6 and codec.parse_seconds("15 s") == 15
    for bad in ("x", "1 parsec"):
        with pytest.raises(ValueError):
            codec.parse_bytes(bad)
        with pytest.raises(ValueError):
            codec.parse_seconds(bad)
    n = [(1 << 60) + 8191, 0, -1, 4096, 2**53 + 1]
    up = spark.createDataFrame([(x,) for x in n], "n bigint").select(codec.align_up(F.col("n"), 4096), codec.align_down(F.col("n"), 4096)).collect()
    assert [tuple(r) for r in up] == [(-(-x // 4096) * 4096, x // 4096 * 4096) for x in n]
    coded = spark.createDataFrame([(x,) for x in (0, 127, 128, 300, 2**28, 2**32 - 1)], "n bigint").select(codec.varint(F.col("n"))).collect()
    assert [bytes(r[0]).hex() for r in coded] == ["00", "7f", "8001", "ac02", "8080808001", "ffffffff0f"]
    assert bytes(spark.range(1).select(codec.length_prefixed(F.lit("ab").cast("binary"))).first()[0]) == b"\x02ab"
    pairs = spark.createDataFrame([("abc", "abd"), (None, "a"), ("é", "ê"), ("", "")], "a string, b string")
    assert [r[0] for r in pairs.select(codec.shared_prefix("a", "b")).collect()] == [2, 0, 1, 0]


def test_writes(spark, rows):
    from keystrata.operators import writes

    v = spark.createDataFrame([("a", 1, "PUT", "x")], "user_key string, sequence bigint, op string, value string")
    after = writes.put(v, spark.createDataFrame([("b", ""), ("c", "1"), ("c", "2")], "user_key string, value string"), 2)
    after = writes.delete(after, spark.createDataFrame([("a",), ("zz",), (None,)], "user_key string"), 3)
    assert rows(reads.live(after)) == [("b", 2, ""), ("c", 2, "2")]
    assert rows(reads.live(after, 2)) == [("a", 1, "x"), ("b", 2, ""), ("c", 2, "2")]
    with pytest.raises(ValueError, match="follow"):
        writes.delete(after, v.select("user_key"), 3)
    with pytest.raises(ValueError, match="needs"):
        writes.put(v, spark.createDataFrame([("b", None)], "user_key string, value string"), 9)
    assert writes.out_of_order(after, [], [F.col("sequence"), F.col("user_key")], "sequence").count() == 2
    cut, meta = writes.flush(after, 10, 7)
    assert cut.count() == 5 and meta.agg(F.min("sst_id"), F.sum("n")).first() == (7, 5)


def test_term_lookup(spark, rows):
    held = spark.createDataFrame([(1, 5, 2, 9)], "grp bigint, idx bigint, term bigint, pos bigint")
    gone = spark.createDataFrame([(1, 4, 1), (2, 8, 3)], "grp bigint, idx bigint, term bigint")
    asked = spark.createDataFrame([(1, 3), (1, 4), (1, 5), (2, 1), (3, 1)], "grp bigint, idx bigint")
    assert rows(raftlog.term_of(asked, held, gone)) == [(1, 3, None), (1, 4, 1), (1, 5, 2), (2, 1, 3), (3, 1, None)]


def test_seek_goes_on_past_dead_pages(spark, monkeypatch):
    monkeypatch.setattr(reads, "SEEK_ROWS", 4)
    dead = [(f"d{i:03d}", s, op, "x" if op == "PUT" else None) for i in range(40) for s, op in ((1, "PUT"), (2, "DELETE"))]
    v = spark.createDataFrame([("a", 1, "PUT", "va"), *dead, ("z", 1, "PUT", "vz")], "user_key string, sequence bigint, op string, value string")
    assert got(reads.seek(v, "b")) == ("vz", False)
    assert got(reads.seek(v, "y", backward=True)) == ("va", False)
    assert got(reads.seek(v, "d001")) == ("vz", True)
    assert got(reads.seek(v, "b", snapshot=1)) == ("x", False)
    assert got(reads.seek(v, "zz")) is None and got(reads.seek(v.limit(0))) is None


def test_small_operators(spark, rows):
    assert spark.range(1).select(compaction.partition_of(F.lit("k"), [])).first()[0] == 0
    twice = spark.createDataFrame([("k", 1, 5, "PUT", "late"), ("k", 1, 2, "PUT", "first"), ("k", 2, 7, "DELETE", None)], "user_key string, sequence bigint, pos int, op string, value string")
    assert rows(merge.first_writer(twice, "pos").select("user_key", "sequence", "value")) == [("k", 1, "first"), ("k", 2, None)]
    assert rows(merge.write_conflicts(twice, ["user_key", "sequence"], F.col("value"))) == [("k", 1, 2)]
    pins = spark.createDataFrame([(1, 100), (2, 10)], "sst_id bigint, s int").select("sst_id", F.timestamp_seconds("s").alias("pinned_at"))
    now = F.timestamp_seconds(F.lit(105))
    assert rows(compaction.pinned(pins, now, 15)) == [(1,)]
    assert compaction.pin(spark.createDataFrame([(1,), (3,)], "sst_id bigint"), pins, now, 15).count() == 0
    assert compaction.pin(spark.createDataFrame([(2,), (3,)], "sst_id bigint"), pins, now, 15).count() == 2
    from keystrata.operators import requests

    asked = spark.createDataFrame([(1,), (2,)], "request_id bigint")
    answers = spark.createDataFrame([(1, 9), (1, 7), (5, 1)], "request_id bigint, answered_at int")
    assert rows(requests.completions(asked, answers)) == [(1, 7), (2, None)]
    ids = asked.select(requests.command_id(F.col("request_id"), F.lit(1), F.lit(2)), requests.command_id(F.lit(None).cast("bigint"), F.lit(1), F.lit(2))).collect()
    assert [r[0] for r in ids] == [1, 2] and ids[0][1] == ids[1][1] is not None
    assert 0 <= spark.range(1).select(codec.shard_of(F.lit("k"), 7)).first()[0] < 7
