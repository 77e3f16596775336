"""Queries over storage, choice of runs, metadata and small functions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from keystrata._util import cut_lineage, scratch, spelled
from keystrata.functions import codec
from keystrata.operators import compaction, manifest, merge, raftlog, reads, requests, routing, writes
from keystrata.plans.store import CAPACITY, DIFFS, HI, KV, LEVELS, LO, NEWER, NOW, OP, OPTIONS, REQ_OPS, RUNS, SIZE, SNAPSHOT, SST, STREAM, SURVIVORS, WATERMARK, _kv, _requests, _runs, _spread_runs, _sst, alive
from keystrata.sources import runs
from keystrata.sources.tables import manifest_diffs, table

Q: dict = {}
SEED = 7
#: As OPTIONS, but level 2 may overlap.
LOOSE = replace(OPTIONS, overlapping=(0, 2))


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


def seeded(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', '{SEED}', {', '.join(parts)})), 1, 8) AS BIGINT)"


# ---- runs on storage


def _written(spark: SparkSession, d: str) -> str:
    path = scratch(spark, "run")
    runs.write_run(_kv(spark, d), path, 2, OPTIONS)
    return path


@query(f"SELECT user_key, sequence, op, value FROM {KV} k")
def run_round_trip(spark, d):
    return runs.read_runs(spark, _written(spark, d))


@query(f"SELECT user_key, sequence, op, value FROM {KV} k WHERE user_key >= '{LO}' AND user_key < '{HI}'")
def run_range_read(spark, d):
    """Files and row groups outside the range are skipped by the keys in their footers."""
    return runs.read_runs(spark, _written(spark, d)).where(F.col("user_key").between(LO, HI) & (F.col("user_key") < HI))


@query(f"SELECT user_key, sequence, op, value FROM {KV} k WHERE user_key = (SELECT max(user_key) FROM {KV} k)")
def run_point_read(spark, d):
    """Row groups whose Bloom filter lacks the key are skipped."""
    kept = runs.read_runs(spark, _written(spark, d))
    return kept.where(F.col("user_key") == F.lit(kept.agg(F.max("user_key")).first()[0]))


@query(f"SELECT count(*) AS entries, true AS disjoint FROM {KV} k HAVING count(*) > 0")
def run_files_disjoint(spark, d):
    """Entries by the runs' metadata, and whether no key lies in two files."""
    meta = runs.run_metadata(spark, _written(spark, d)).withColumnRenamed("file", "sst_id").withColumn("level", F.lit(0))
    meta = cut_lineage(meta)
    fine = manifest.non_overlap(meta).select("ok")
    return meta.agg(F.sum("n").alias("entries")).join(F.broadcast(fine.withColumnRenamed("ok", "disjoint")))  # a row each


@query(f"SELECT l.level, CASE WHEN l.level < 2 THEN 'UNCOMPRESSED' ELSE 'LZ4_RAW' END AS codec, count(r.user_key) AS entries FROM (SELECT CAST(level AS INTEGER) AS level FROM range(4) l(level)) l JOIN {RUNS} r ON r.level = l.level GROUP BY ALL")
def run_codecs(spark, d):
    """A run written per level, with the codec its footer names and the rows read back."""
    kv, rows = cut_lineage(_runs(spark, d)), []
    for level in range(LEVELS):
        path = scratch(spark, "run")
        runs.write_run(kv.where(F.col("level") == level), path, level, OPTIONS)
        rows.append((level, runs.codec_of(spark, path), runs.read_runs(spark, path).count()))
    return spark.createDataFrame(rows, "level int, codec string, entries bigint").where("codec IS NOT NULL")


@query("SELECT grp, start_key AS body, substr(start_key, 2, 2) AS piece, CAST(octet_length(encode(start_key)) AS BIGINT) AS size, grp % 2 = 1 AS removed FROM key_range WHERE grp IS NOT NULL AND length(start_key) > 2")
def object_store(spark, d):
    """Put, size, whole and ranged reads and removal of an object per key range (a table of fixed size)."""
    store, out = runs.ObjectStore(spark, scratch(spark, "objects")), []
    for grp, key in table(spark, d, "key_range").where("grp IS NOT NULL AND length(start_key) > 2").select("grp", "start_key").collect():
        name = str(grp)
        store.put(name, b"to be replaced")
        store.put(name, key.encode())
        body, piece, size = store.get(name), store.get_range(name, 1, 3), store.size(name)
        if grp % 2:
            store.remove(name)
        out.append((grp, body.decode(), piece.decode(), size, store.get(name) is None))
    return spark.createDataFrame(out, "grp bigint, body string, piece string, size bigint, removed boolean")


STORES = [(None, None), ("s3://b/p", None), (None, "minio://k:s@h:9000/b"), ("s3://b/p", "minio://k:s@h:9000/b")]


@query("SELECT * FROM (VALUES (0, NULL, NULL), (1, 's3a://b/p', NULL), (2, 's3a://b', 'http://h:9000'), (3, 's3a://b/p', NULL)) v(no, root, endpoint)")
def store_choice(spark, d):
    got = [runs.store_options(*s) for s in STORES]
    return spark.createDataFrame([(i, o.get("root"), o.get("fs.s3a.endpoint")) for i, o in enumerate(got)], "no int, root string, endpoint string")


# ---- reads and writes


@query(f"""WITH l AS (SELECT user_key FROM {alive(SNAPSHOT)} l), k AS (SELECT min(user_key) AS k FROM l WHERE user_key >= '{LO}')
SELECT '<' AS kind, max(user_key) AS user_key FROM l, k WHERE user_key < k UNION ALL SELECT '<=', max(user_key) FROM l, k WHERE user_key <= k
UNION ALL SELECT '>', min(user_key) FROM l, k WHERE user_key > k UNION ALL SELECT '>=', min(user_key) FROM l, k WHERE user_key >= k""")
def search_predicates(spark, d):
    """The nearest live key below and above one that is there, with and without the key itself."""
    kv = _kv(spark, d)
    at = reads.seek(kv, LO, SNAPSHOT).first()
    key = at["user_key"] if at else LO
    kinds = {"<": (True, True), "<=": (True, False), ">": (False, True), ">=": (False, False)}
    found = {k: reads.seek(kv, key, SNAPSHOT, backward, strict).first() for k, (backward, strict) in kinds.items()}
    return spark.createDataFrame([(k, r["user_key"] if r else None) for k, r in found.items()], "kind string, user_key string")


WRITTEN = f"(SELECT user_key, sequence, {OP} AS op, CASE WHEN {OP} = 'PUT' THEN op_value END AS value, arrived_at FROM kv_ops WHERE user_key IS NOT NULL AND sequence IS NOT NULL AND {OP} IN ('PUT', 'DELETE'))"


def _written_ops(spark: SparkSession, d: str) -> DataFrame:
    op = spelled(F.col("op_type"))
    rows = table(spark, d, "kv_ops").where(F.col("user_key").isNotNull() & F.col("sequence").isNotNull() & op.isin("PUT", "DELETE"))
    return rows.select("user_key", "sequence", op.alias("op"), F.when(op == "PUT", F.col("op_value")).alias("value"), "arrived_at")


@query(f"SELECT user_key, sequence, op, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key, sequence ORDER BY arrived_at NULLS FIRST, op, value NULLS FIRST) AS rn FROM {WRITTEN} w) x WHERE rn = 1")
def first_writes(spark, d):
    return merge.first_writer(_written_ops(spark, d), "arrived_at").select("user_key", "sequence", "op", "value")


@query(f"SELECT user_key, sequence, count(*) AS writes FROM {WRITTEN} w GROUP BY user_key, sequence HAVING count(DISTINCT op || '|' || coalesce(value, '')) > 1")
def conflicting_puts(spark, d):
    content = F.concat("op", F.lit("|"), F.coalesce("value", F.lit("")))
    return merge.write_conflicts(_written_ops(spark, d), ["user_key", "sequence"], content)


@query(f"""SELECT user_key, sequence FROM (SELECT user_key, sequence, table_no, max(table_no) OVER () AS last FROM
(SELECT user_key, sequence, CAST((sum({SIZE} + 96) OVER (ORDER BY sequence, user_key ROWS UNBOUNDED PRECEDING) - 1) // 65536 AS BIGINT) AS table_no FROM {KV} k) x) y WHERE table_no = 0 AND last > 0""")
def oldest_immutable(spark, d):
    return writes.oldest_immutable(writes.rotate(_kv(spark, d), [F.col("sequence"), F.col("user_key")], 65536)).select("user_key", "sequence")


# ---- compaction


@query(f"""WITH f AS (SELECT * FROM {NEWER} t WHERE (newer IS NULL OR newer > {WATERMARK}) AND (op = 'DELETE' OR value <> ''))
SELECT f.user_key, f.sequence, 0 AS part, c.chunk FROM f JOIN (SELECT user_key, CAST((sum(size) OVER (ORDER BY user_key ROWS UNBOUNDED PRECEDING) - size) // {CAPACITY} AS BIGINT) AS chunk
  FROM (SELECT user_key, sum({SIZE}) AS size FROM f GROUP BY user_key) g) c ON c.user_key = f.user_key""")
def compact_filtered(spark, d):
    """Compaction with a further filter and without partition points."""
    keep = lambda df: df.where("op = 'DELETE' OR value != ''")
    return compaction.compact(_spread_runs(spark, d), WATERMARK, CAPACITY, keep=keep).select("user_key", "sequence", "part", "chunk")


def _met(level: int) -> str:
    return f"""s AS {SST}, m AS (SELECT r.grp, r.start_key, s.sst_id, s.first_key, s.last_key FROM s JOIN key_range r ON s.level = {level} AND (r.end_key IS NULL OR s.first_key <= r.end_key) AND s.last_key >= r.start_key)"""


def _with_next(level: int) -> str:
    return f"""SELECT grp, {level} AS level, sst_id FROM b UNION ALL SELECT h.grp, {level + 1}, s.sst_id FROM (SELECT grp, min(first_key) AS lo, max(last_key) AS hi FROM b GROUP BY grp) h JOIN s ON s.level = {level + 1} AND s.first_key <= hi AND s.last_key >= lo"""


@query(f"""WITH {_met(0)}, b AS (SELECT DISTINCT grp, sst_id, first_key, last_key FROM m WHERE grp IN (SELECT grp FROM m GROUP BY grp HAVING count(DISTINCT sst_id) >= 4)) {_with_next(0)}""")
def compaction_picks_l0(spark, d):
    return compaction.pick_runs(_sst(spark, d), table(spark, d, "key_range"), 0, OPTIONS, SEED)


@query(f"""WITH {_met(1)}, n AS (SELECT *, row_number() OVER (PARTITION BY grp, start_key ORDER BY first_key, sst_id) AS no, count(*) OVER (PARTITION BY grp, start_key) AS n FROM m),
p AS (SELECT *, greatest(n // 10, 1) AS take, {seeded("CAST(grp AS VARCHAR)", "start_key")} % (n - greatest(n // 10, 1) + 1) AS first FROM n),
b AS (SELECT DISTINCT grp, sst_id, first_key, last_key FROM p WHERE no > first AND no <= first + take),
x AS ({_with_next(1)})
SELECT * FROM x WHERE grp NOT IN (SELECT grp FROM x WHERE sst_id % 13 = 5)""")
def compaction_picks_l1(spark, d):
    """A level that doesn't overlap; some runs are pinned."""
    sst = _sst(spark, d)
    return compaction.pick_runs(sst, table(spark, d, "key_range"), 1, OPTIONS, SEED, sst.where("sst_id % 13 = 5"))


@query(f"""WITH {_met(2)}, n AS (SELECT *, row_number() OVER (PARTITION BY grp, start_key ORDER BY {seeded("CAST(sst_id AS VARCHAR)")}, sst_id) AS no, count(*) OVER (PARTITION BY grp, start_key) AS n FROM m),
c AS (SELECT DISTINCT grp, sst_id, first_key, last_key FROM n WHERE no <= greatest(n // 100, 1)),
b AS (SELECT * FROM c UNION SELECT c.grp, s.sst_id, s.first_key, s.last_key FROM c JOIN s ON s.level = 2 AND s.first_key <= c.last_key AND s.last_key >= c.first_key) {_with_next(2)}""")
def compaction_picks_l2(spark, d):
    """A level that overlaps."""
    return compaction.pick_runs(_sst(spark, d), table(spark, d, "key_range"), 2, LOOSE, SEED)


@query(f"""WITH {_met(0)}, b AS (SELECT DISTINCT grp, sst_id, first_key, last_key FROM m WHERE grp IN (SELECT grp FROM m GROUP BY grp HAVING count(DISTINCT sst_id) >= 4)), x AS ({_with_next(0)})
SELECT grp, 0 AS level, 1 AS target, 'none' AS codec, false AS last_level, count(*) AS n FROM x GROUP BY grp""")
def compaction_plans(spark, d):
    return compaction.plans(compaction_picks_l0(spark, d), OPTIONS)


MADE = f"(SELECT 5000000 + CAST((sum({SIZE}) OVER (ORDER BY user_key, sequence DESC ROWS UNBOUNDED PRECEDING) - 1) // {CAPACITY} AS BIGINT) AS sst_id, {SIZE} AS size FROM {RUNS} r WHERE level < 2)"


@query(f"""SELECT sst_id, level, 'DELETE' AS op, 0 AS data_size FROM {SST} s WHERE level < 2 UNION ALL SELECT sst_id, 1, 'INSERT', CAST(sum(size) AS BIGINT) FROM {MADE} m GROUP BY sst_id""")
def compaction_result(spark, d):
    """The diff of compacting all of level 0 into level 1."""
    held = cut_lineage(_runs(spark, d).where("level < 2"))
    sst = compaction.sst_metadata(held)
    made = writes.flush(held.drop("sst_id", "level"), CAPACITY, 5_000_000)[1]
    return compaction.compaction_diff(sst.where("level = 0"), 0, sst.where("level = 1"), made, 1)


# ---- manifest


@query(f"SELECT rudder_id, version_id, op_idx, sst_id, op FROM {DIFFS} d WHERE version_id >= 20")
def manifest_squash(spark, d):
    return manifest.squash(manifest_diffs(table(spark, d, "manifest")), 20).select("rudder_id", "version_id", "op_idx", "sst_id", "op")


@query(f"SELECT rudder_id, version_id, op_idx, sst_id, op FROM (SELECT *, dense_rank() OVER (PARTITION BY rudder_id ORDER BY version_id) AS no FROM {DIFFS} d WHERE version_id >= 20) x WHERE no <= 10")
def diffs_from_each(spark, d):
    """The next ten versions from 20 on of every control node."""
    return manifest.diffs_from_each(manifest_diffs(table(spark, d, "manifest")), 20, 10, STREAM).select("rudder_id", "version_id", "op_idx", "sst_id", "op")


@query(f"SELECT s.*, v.strategy, v.codec FROM {SST} s JOIN (VALUES (0, 'overlap', 'none'), (1, 'apart', 'none'), (2, 'apart', 'lz4_raw'), (3, 'apart', 'lz4_raw')) v(l, strategy, codec) ON v.l = s.level")
def sst_level_options(spark, d):
    rows = [(i, "overlap" if i in OPTIONS.overlapping else "apart", OPTIONS.codec(i)) for i in range(LEVELS)]
    return manifest.with_level_options(_sst(spark, d), spark.createDataFrame(rows, "level int, strategy string, codec string"))


@query(f"""SELECT rudder_id, version_id, op_idx, sst_id FROM {DIFFS} d WHERE version_id >= 20
UNION ALL SELECT r.rudder_id, r.v + 1, CAST(row_number() OVER (PARTITION BY r.rudder_id ORDER BY s.sst_id) - 1 AS INTEGER), s.sst_id FROM (SELECT rudder_id, max(version_id) AS v FROM {DIFFS} d GROUP BY rudder_id HAVING max(version_id) >= 19) r
JOIN {SST} s ON s.level = 0 AND s.sst_id % 3 + 1 = r.rudder_id""")
def manifest_insert_l0(spark, d):
    """New level-0 runs dealt to the control nodes, and all diffs from version 20 on."""
    diffs = manifest_diffs(table(spark, d, "manifest")).withColumnRenamed("sst_level", "level")
    known = diffs.select("rudder_id").distinct()
    new = _sst(spark, d).where("level = 0").select((F.pmod("sst_id", F.lit(3)) + 1).alias("rudder_id"), "sst_id", "data_size").join(known, "rudder_id", "left_semi")
    return manifest.insert_l0(new, diffs, 20, ("rudder_id",))[1].select("rudder_id", "version_id", "op_idx", "sst_id")


# ---- routing and membership


@query("""WITH n AS (SELECT DISTINCT node_id FROM heartbeat WHERE node_id IS NOT NULL)
SELECT node_id, 'member' AS status FROM n UNION ALL SELECT node_id, 'rejected' FROM n WHERE node_id BETWEEN 10 AND 12""")
def membership_add(spark, d):
    """Nodes from 10 on added to those up to 12: members afterwards, and the ones rejected as present."""
    nodes = table(spark, d, "heartbeat").select("node_id").where("node_id IS NOT NULL")
    after, rejected = routing.add_nodes(nodes.where("node_id <= 12").distinct(), nodes.where("node_id >= 10"))
    return after.select("node_id", F.lit("member").alias("status")).unionByName(rejected.distinct().select("node_id", F.lit("rejected").alias("status")))


@query(f"SELECT node_id FROM (SELECT node_id, max(sent_at) AS seen FROM heartbeat WHERE node_id IS NOT NULL GROUP BY node_id) n WHERE seen >= {NOW} - INTERVAL 7200 SECOND ORDER BY {seeded('CAST(node_id AS VARCHAR)')}, node_id LIMIT 1")
def live_node_pick(spark, d):
    beats = table(spark, d, "heartbeat").withColumn("at", F.col("sent_at"))
    now = F.lit(beats.agg(F.max("at")).first()[0]).cast("timestamp_ntz")
    return routing.pick_live_node(beats, "node_id", now, 7200, SEED).select("node_id")


@query("SELECT grp, start_key, end_key, CASE WHEN grp % 2 = 0 THEN 0 ELSE leader END AS leader FROM key_range WHERE grp IS NOT NULL")
def router_refresh(spark, d):
    """Updates of every other group, delivered twice and out of order: the newest takes the leader away."""
    ranges = table(spark, d, "key_range")
    even = ranges.where("grp % 2 = 0")
    newer, older = even.withColumn("leader", F.lit(0).cast("bigint")).withColumn("version", F.lit(3)), even.withColumn("version", F.lit(2))
    return routing.refresh(ranges, newer.unionByName(older).unionByName(newer)).select("grp", "start_key", "end_key", "leader")


# ---- requests and log


@query(f"SELECT r.request_id, a.answered_at FROM (SELECT DISTINCT request_id FROM {REQ_OPS} o) r LEFT JOIN (SELECT request_id, min(arrived_at) AS answered_at FROM kv_ops WHERE {OP} = 'GET' GROUP BY request_id) a ON a.request_id = r.request_id")
def request_completions(spark, d):
    """Requests with the first of their answers, of which a GET that was delivered is one."""
    answers = table(spark, d, "kv_ops").where(spelled(F.col("op_type")) == "GET").select("request_id", F.col("arrived_at").alias("answered_at"))
    return requests.completions(_requests(spark, d).select("request_id"), answers)


@query(f"SELECT request_id, op_idx, CASE WHEN op_idx = 0 THEN request_id END AS known, op_idx <> 0 AS hashed FROM {REQ_OPS} o")
def command_ids(spark, d):
    """The first op of a request carries its id; the others get one by index and sequence."""
    ops = requests.distinct_ops(table(spark, d, "kv_ops"))
    carried = F.when(F.col("op_idx") == 0, F.col("request_id"))
    index, seq = F.col("op_idx").cast("bigint"), F.coalesce("sequence", F.lit(0))
    got = ops.withColumn("id", requests.command_id(carried, index, seq))
    return got.select("request_id", "op_idx", F.when(F.col("op_idx") == 0, F.col("id")).alias("known"), (carried.isNull() & (F.col("id") == F.xxhash64(index, seq))).alias("hashed"))


@query(f"""SELECT request_id, op_idx, user_key, CASE WHEN w.op_type = 'PUT' THEN w.op_value END AS value FROM (SELECT *,
  last_value(CASE WHEN op_type <> 'GET' THEN struct_pack(op_type := op_type, op_value := op_value) END IGNORE NULLS) OVER (PARTITION BY user_key ORDER BY arrived_at NULLS FIRST, request_id, op_idx ROWS UNBOUNDED PRECEDING) AS w
  FROM {REQ_OPS} o WHERE user_key IS NOT NULL AND op_type IN ('GET', 'PUT', 'DELETE')) x WHERE op_type = 'GET'""")
def apply_in_order(spark, d):
    """Reads and writes applied one after the other as they arrived."""
    ops = requests.distinct_ops(table(spark, d, "kv_ops"))
    return requests.apply_in_order(ops, [F.col("arrived_at"), F.col("request_id"), F.col("op_idx")])


@query(f"""SELECT r.pos, a.idx AS released_at FROM (SELECT DISTINCT grp, idx, pos FROM raft_log WHERE kind = 'TRUNCATE' AND grp IS NOT NULL AND idx IS NOT NULL) r ASOF JOIN {SURVIVORS} a ON r.grp = a.grp AND r.idx <= a.idx""")
def log_read_release(spark, d):
    """Reads that wait for the index of a truncation, released by the first surviving entry at or above it."""
    log = table(spark, d, "raft_log")
    waits = log.where("kind = 'TRUNCATE' AND grp IS NOT NULL AND idx IS NOT NULL").select("grp", "idx", "pos").distinct()
    return requests.release_reads(waits, raftlog.survivors(log), "grp", "idx", "pos")


@query(f"""SELECT r.grp, r.lo, r.hi, 100 - (SELECT count(*) FROM {SURVIVORS} s WHERE s.grp = r.grp AND s.idx >= r.lo AND s.idx < r.hi) AS missing
FROM (SELECT DISTINCT grp, idx AS lo, idx + 100 AS hi FROM raft_log WHERE kind = 'COMPACT' AND grp IS NOT NULL AND idx IS NOT NULL) r""")
def raft_range_gaps(spark, d):
    """What the hundred indexes behind each compaction lack."""
    log = table(spark, d, "raft_log")
    asks = log.where("kind = 'COMPACT'").select("grp", F.col("idx").alias("lo"), (F.col("idx") + 100).alias("hi"))
    return raftlog.range_gaps(raftlog.survivors(log), asks)


@query(f"SELECT grp, idx, term, pos FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY idx) AS no FROM {SURVIVORS} s WHERE idx >= 10) x WHERE no <= 20")
def raft_entries_each(spark, d):
    """The next twenty entries from index 10 on of every group."""
    return raftlog.entries_each(raftlog.survivors(table(spark, d, "raft_log")), 5, 20, mask=10)


@query("SELECT grp, count(*) AS n FROM raft_log WHERE grp IS NULL OR grp NOT IN (SELECT grp FROM key_range WHERE grp <= 10) GROUP BY grp")
def log_without_groups(spark, d):
    removed = table(spark, d, "key_range").where("grp <= 10")
    return raftlog.remove_groups(table(spark, d, "raft_log"), removed).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


# ---- functions


@query(f"SELECT user_key, sequence, CASE WHEN n < 128 THEN lpad(to_hex(n), 2, '0') ELSE lpad(to_hex(n % 128 + 128), 2, '0') || lpad(to_hex(n // 128), 2, '0') END || b AS slice FROM (SELECT user_key, sequence, octet_length(encode(user_key || coalesce(value, ''))) AS n, hex(encode(user_key || coalesce(value, ''))) AS b FROM {KV} k) x")
def length_prefixed(spark, d):
    data = F.concat("user_key", F.coalesce("value", F.lit(""))).cast("binary")
    return _kv(spark, d).select("user_key", "sequence", F.hex(codec.length_prefixed(data)).alias("slice"))


@query("SELECT DISTINCT user_key, CAST(1 AS BIGINT) AS shards, true AS inside FROM kv_ops WHERE user_key IS NOT NULL")
def hash_shards(spark, d):
    """Every key falls into one shard of 64."""
    s = codec.shard_of(F.col("user_key"), 64)
    keys = table(spark, d, "kv_ops").where("user_key IS NOT NULL").groupBy("user_key")
    return keys.agg(F.count_distinct(s).alias("shards"), ((F.min(s) >= 0) & (F.max(s) < 64)).alias("inside"))


@query("""SELECT text, CAST(number AS DOUBLE) AS number FROM (VALUES ('64 KiB', 65536.0), ('1MB', 1000000.0), ('3', 3.0), ('1.5 GiB', 1610612736.0), ('15 s', 15.0), ('200ms', 0.2), ('2 h', 7200.0)) v(text, number)""")
def config_values(spark, d):
    sizes, times = ("64 KiB", "1MB", "3", "1.5 GiB"), ("15 s", "200ms", "2 h")
    rows = [(t, float(codec.parse_bytes(t))) for t in sizes] + [(t, codec.parse_seconds(t)) for t in times]
    return spark.createDataFrame(rows, "text string, number double")


CATALOGUE = Q
