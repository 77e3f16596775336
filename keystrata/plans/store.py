"""Queries over the store: multi-version reads, merging, compaction, manifest, routing, requests and log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keystrata._util import cut_lineage, spelled
from keystrata.functions import codec
from keystrata.operators import compaction, manifest, merge, raftlog, reads, requests, routing, writes
from keystrata.operators.intervals import overlap_pairs
from keystrata.operators.ordered import numbered
from keystrata.sources.tables import kv_versions, log_entries, manifest_diffs, table, with_runs

#: Snapshot, watermark, keys and bounds of the queries. All lie inside the data at any scale.
SNAPSHOT, WATERMARK = 99001003000, 99001002000
LO, HI, KEY = "k40", "k80", "k7a00_T0"
POINTS = ["k40", "k80", "kc0"]
CAPACITY = 16384
LEVELS = 4
OPTIONS = compaction.LsmOptions(l1_capacity=20_000, multiplier=2, levels=LEVELS)

OP = "regexp_replace(upper(trim(op_type)), '^T_', '')"
KV = f"""(SELECT user_key, sequence, op, value FROM (SELECT user_key, sequence, {OP} AS op, CASE WHEN {OP} = 'PUT' THEN op_value END AS value,
  row_number() OVER (PARTITION BY user_key, sequence ORDER BY op_idx DESC) AS rn FROM kv_ops
  WHERE user_key IS NOT NULL AND sequence IS NOT NULL AND {OP} IN ('PUT', 'DELETE')) w WHERE rn = 1)"""


def vis(s: int) -> str:
    return f"(SELECT user_key, sequence, op, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY sequence DESC) AS rn FROM {KV} k WHERE sequence <= {s}) t WHERE rn = 1)"


def alive(s: int) -> str:
    return f"(SELECT user_key, sequence, value FROM {vis(s)} v WHERE op = 'PUT')"


RUNS = f"(SELECT *, sequence // 500 AS sst_id, CAST((sequence // 500) % 4 AS INTEGER) AS level FROM {KV} k)"
SIZE = "octet_length(encode(user_key)) + 9 + coalesce(octet_length(encode(value)), 0)"
SST = f"(SELECT sst_id, level, min(user_key) AS first_key, max(user_key) AS last_key, count(*) AS n, CAST(sum({SIZE}) AS BIGINT) AS data_size FROM {RUNS} r GROUP BY sst_id, level)"
REQ_OPS = f"""(SELECT request_id, op_idx, {OP} AS op_type, user_key, op_value, sequence, target, arrived_at FROM (SELECT *, row_number() OVER (PARTITION BY request_id, op_idx
  ORDER BY arrived_at, op_type NULLS FIRST, user_key NULLS FIRST, op_value NULLS FIRST, sequence NULLS FIRST, target NULLS FIRST) AS rn FROM kv_ops WHERE request_id IS NOT NULL AND op_idx IS NOT NULL) o WHERE rn = 1)"""
REQUESTS = f"""(SELECT request_id, CASE WHEN count(DISTINCT op_type) FILTER (op_type <> 'NONE') = 0 THEN 'NONE' WHEN count(DISTINCT op_type) FILTER (op_type <> 'NONE') = 1
  THEN max(op_type) FILTER (op_type <> 'NONE') ELSE 'TXN' END AS kind, max(CASE WHEN op_type IN ('PUT', 'DELETE') THEN 1 ELSE 0 END) = 0 AS read_only, count(*) AS n_ops, max(target) AS target, min(arrived_at) AS arrived_at
  FROM {REQ_OPS} o GROUP BY request_id)"""
DIFFS = """(SELECT rudder_id, version_id, op_idx, sst_id, sst_level, op, max(data_size) AS data_size, min(recorded_at) AS recorded_at FROM manifest
  WHERE rudder_id IS NOT NULL AND version_id IS NOT NULL GROUP BY ALL)"""
ENTRIES = "(SELECT * FROM raft_log WHERE kind = 'ENTRY' AND grp IS NOT NULL AND term IS NOT NULL AND idx IS NOT NULL)"
SURVIVORS = """(SELECT grp, idx, term, pos FROM (SELECT e.*, row_number() OVER (PARTITION BY e.grp, e.idx ORDER BY term DESC, pos DESC) AS rn FROM
  (SELECT * FROM (SELECT grp, idx, term, pos, kind, min(CASE WHEN kind = 'TRUNCATE' THEN idx END) OVER (PARTITION BY grp ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS cut
     FROM raft_log WHERE kind IN ('ENTRY', 'TRUNCATE') AND grp IS NOT NULL AND idx IS NOT NULL) x WHERE kind = 'ENTRY' AND term IS NOT NULL AND (cut IS NULL OR cut > idx)) e) y
  LEFT JOIN (SELECT grp AS g, max(idx) AS c FROM raft_log WHERE kind = 'COMPACT' GROUP BY grp) z ON z.g = y.grp WHERE rn = 1 AND (c IS NULL OR idx >= c))"""

Q: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


def _kv(spark: SparkSession, d: str) -> DataFrame:
    return kv_versions(table(spark, d, "kv_ops"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return with_runs(_kv(spark, d))


def _sst(spark: SparkSession, d: str) -> DataFrame:
    return compaction.sst_metadata(_runs(spark, d))


# ---- reads


@query(f"SELECT *, row_number() OVER (ORDER BY user_key) AS position FROM {alive(SNAPSHOT)} l")
def mvcc_snapshot_scan(spark, d):
    return numbered(reads.scan(_kv(spark, d), SNAPSHOT))


@query(f"SELECT *, row_number() OVER (ORDER BY user_key DESC) AS position FROM {alive(SNAPSHOT)} l")
def mvcc_snapshot_scan_backward(spark, d):
    return numbered(reads.scan(_kv(spark, d), SNAPSHOT, backward=True))


@query(f"""SELECT q.user_key, l.value, l.user_key IS NOT NULL AS found FROM (SELECT DISTINCT user_key FROM incoming_ops WHERE user_key IS NOT NULL AND {OP} = 'GET') q
LEFT JOIN {alive(2**63 - 1)} l ON q.user_key = l.user_key""")
def mvcc_point_get(spark, d):
    asked = table(spark, d, "incoming_ops").where(spelled(F.col("op_type")) == "GET")
    return reads.get(_kv(spark, d), asked)


@query(f"""SELECT r.request_id, r.op_idx, r.user_key, r.sequence AS at, CASE WHEN v.op = 'PUT' THEN v.value END AS value
FROM (SELECT *, CASE WHEN sequence > 0 THEN sequence ELSE 9223372036854775807 END AS s FROM {REQ_OPS} o WHERE op_type = 'GET' AND user_key IS NOT NULL) r
ASOF LEFT JOIN {KV} v ON r.user_key = v.user_key AND r.s >= v.sequence""")
def mvcc_sget(spark, d):
    ops = requests.distinct_ops(table(spark, d, "kv_ops")).where("op_type = 'GET'")
    return reads.get_as_of(_kv(spark, d), ops.withColumn("at", F.col("sequence")), ["request_id", "op_idx"])


@query(f"SELECT * FROM {alive(SNAPSHOT)} l WHERE user_key >= '{LO}' AND user_key < '{HI}'")
def mvcc_range_scan(spark, d):
    return reads.scan(_kv(spark, d), SNAPSHOT, LO, HI)


@query(f"SELECT l.*, EXISTS (SELECT 1 FROM {vis(SNAPSHOT)} v WHERE user_key = '{KEY}') AS found FROM {alive(SNAPSHOT)} l WHERE user_key >= '{KEY}' ORDER BY user_key LIMIT 1")
def seek_forward(spark, d):
    return reads.seek(_kv(spark, d), KEY, SNAPSHOT)


@query(f"SELECT l.*, EXISTS (SELECT 1 FROM {vis(SNAPSHOT)} v WHERE user_key = '{KEY}') AS found FROM {alive(SNAPSHOT)} l WHERE user_key <= '{KEY}' ORDER BY user_key DESC LIMIT 1")
def seek_backward(spark, d):
    return reads.seek(_kv(spark, d), KEY, SNAPSHOT, backward=True)


@query(f"SELECT l.*, false AS found FROM {alive(SNAPSHOT)} l ORDER BY user_key LIMIT 1")
def seek_first(spark, d):
    return reads.seek(_kv(spark, d), None, SNAPSHOT)


@query(f"SELECT l.*, false AS found FROM {alive(SNAPSHOT)} l ORDER BY user_key DESC LIMIT 1")
def seek_last(spark, d):
    return reads.seek(_kv(spark, d), None, SNAPSHOT, backward=True)


@query(f"SELECT count(*) > 0 AS found FROM {vis(SNAPSHOT)} v WHERE user_key = '{KEY}'")
def seek_found_flag(spark, d):
    return reads.seek_found(_kv(spark, d), KEY, SNAPSHOT)


@query(f"SELECT user_key, lag(user_key) OVER (ORDER BY user_key) AS prev_key, lead(user_key) OVER (ORDER BY user_key) AS next_key FROM {alive(SNAPSHOT)} l")
def iter_next_prev(spark, d):
    return reads.neighbours(reads.live(_kv(spark, d), SNAPSHOT))


@query(f"SELECT user_key, sequence, op, lead(sequence) OVER (PARTITION BY user_key ORDER BY sequence) AS next_sequence FROM {KV} k")
def version_intervals(spark, d):
    return reads.intervals(_kv(spark, d))


@query(f"SELECT coalesce(max(sequence), 0) AS sequence FROM {KV} k")
def snapshot_handle(spark, d):
    return reads.snapshot(_kv(spark, d))


# ---- merge


IN_ORDER = f"SELECT user_key, sequence, op, value, row_number() OVER (ORDER BY user_key, sequence DESC) AS position FROM {KV} k"


def _spread_runs(spark: SparkSession, d: str) -> list[DataFrame]:
    """Runs that overlap, dealt out of the versions, which are resolved once."""
    kv = cut_lineage(_kv(spark, d))
    return [kv.where(F.pmod("sequence", F.lit(LEVELS)) == i) for i in range(LEVELS)]


@query(IN_ORDER)
def merge_runs(spark, d):
    return numbered(merge.merge(_spread_runs(spark, d)))


@query(IN_ORDER)
def concat_disjoint_runs(spark, d):
    kv, cuts = cut_lineage(_kv(spark, d)), [None, *POINTS, None]
    k = F.col("user_key")
    runs = [kv.where((k >= a if a else F.lit(True)) & (k < b if b else F.lit(True))) for a, b in zip(cuts, cuts[1:], strict=False)]
    return numbered(merge.concat([merge.merge([r]) for r in runs]))


@query(f"""SELECT user_key, level, sequence, op, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY level, sequence DESC) AS rn FROM {RUNS} r WHERE sequence <= {SNAPSHOT}) t WHERE rn = 1""")
def level_first_read(spark, d):
    return merge.level_first(_runs(spark, d), SNAPSHOT)


@query("SELECT request_id, op_idx, count(*) AS writes FROM kv_ops GROUP BY request_id, op_idx HAVING count(DISTINCT coalesce(target, -1)) > 1")
def write_conflicts(spark, d):
    return merge.write_conflicts(table(spark, d, "kv_ops"), ["request_id", "op_idx"], F.coalesce("target", F.lit(-1)))


@query(f"SELECT count(*) AS entries, min(user_key) AS keys_from, max(user_key) AS keys_to FROM {KV} k")
def run_stats(spark, d):
    return merge.stats(_kv(spark, d))


# ---- compaction

NEWER = f"(SELECT *, lag(sequence) OVER (PARTITION BY user_key ORDER BY sequence DESC) AS newer FROM {KV} k)"


@query(f"SELECT user_key, sequence, op, value FROM {NEWER} t WHERE NOT (newer IS NOT NULL AND sequence < {WATERMARK})")
def compaction_filter_compat(spark, d):
    return compaction.collect_garbage(_kv(spark, d), WATERMARK, "compat")


@query(f"SELECT user_key, sequence, op, value FROM {NEWER} t WHERE newer IS NULL OR newer > {WATERMARK}")
def compaction_filter_safe(spark, d):
    return compaction.collect_garbage(_kv(spark, d), WATERMARK)


@query(f"SELECT user_key, sequence, op, value FROM {NEWER} t WHERE (newer IS NULL OR newer > {WATERMARK}) AND NOT (op = 'DELETE' AND sequence <= {WATERMARK})")
def tombstone_gc(spark, d):
    return compaction.collect_garbage(_kv(spark, d), WATERMARK, last_level=True)


@query(f"SELECT user_key, sequence, CAST((user_key >= '{POINTS[0]}') AS INTEGER) + CAST((user_key >= '{POINTS[1]}') AS INTEGER) + CAST((user_key >= '{POINTS[2]}') AS INTEGER) AS part FROM {KV} k")
def partition_points(spark, d):
    return _kv(spark, d).select("user_key", "sequence", compaction.partition_of(F.col("user_key"), POINTS).alias("part"))


@query(f"SELECT user_key, sequence, CAST((sum({SIZE}) OVER (ORDER BY user_key, sequence DESC ROWS UNBOUNDED PRECEDING) - 1) // {CAPACITY} AS BIGINT) AS chunk FROM {KV} k")
def sst_split_by_size(spark, d):
    return compaction.split_by_size(_kv(spark, d), CAPACITY).select("user_key", "sequence", "chunk")


@query(f"""WITH g AS (SELECT user_key, sum({SIZE}) AS size FROM {KV} k GROUP BY user_key), c AS (SELECT user_key, CAST((sum(size) OVER (ORDER BY user_key ROWS UNBOUNDED PRECEDING) - size) // {CAPACITY} AS BIGINT) AS chunk FROM g)
SELECT t.user_key, t.sequence, t.op, CAST((t.user_key >= '{POINTS[0]}') AS INTEGER) + CAST((t.user_key >= '{POINTS[1]}') AS INTEGER) + CAST((t.user_key >= '{POINTS[2]}') AS INTEGER) AS part, c.chunk
FROM {NEWER} t JOIN (SELECT user_key, CAST((sum(size) OVER (ORDER BY user_key ROWS UNBOUNDED PRECEDING) - size) // {CAPACITY} AS BIGINT) AS chunk
  FROM (SELECT user_key, sum({SIZE}) AS size FROM {NEWER} t WHERE newer IS NULL OR newer > {WATERMARK} GROUP BY user_key) g) c ON t.user_key = c.user_key WHERE t.newer IS NULL OR t.newer > {WATERMARK}""")
def compact_runs(spark, d):
    return compaction.compact(_spread_runs(spark, d), WATERMARK, CAPACITY, POINTS).select("user_key", "sequence", "op", "part", "chunk")


@query(f"SELECT * FROM {SST} s")
def sst_metadata(spark, d):
    return _sst(spark, d)


LEVEL_SIZES = f"(SELECT level, count(*) AS n, CAST(sum(data_size) AS BIGINT) AS data_size FROM {SST} s GROUP BY level)"


@query(f"SELECT level, data_size, CAST(CASE WHEN level BETWEEN 1 AND 2 THEN 20000 * pow(2, level - 1) END AS BIGINT) AS capacity, coalesce(data_size > CASE WHEN level BETWEEN 1 AND 2 THEN 20000 * pow(2, level - 1) END, false) AS over FROM {LEVEL_SIZES} l")
def level_size_overstep(spark, d):
    return compaction.overstepped_levels(manifest.level_sizes(_sst(spark, d), ["level"]), OPTIONS)


@query(f"""SELECT r.grp, count(*) AS n FROM {SST} a JOIN key_range r ON a.level = 0 AND NOT (coalesce(a.first_key > r.end_key, false) OR a.last_key < r.start_key) GROUP BY r.grp HAVING count(*) >= 4""")
def l0_pick(spark, d):
    return compaction.l0_candidates(_sst(spark, d), table(spark, d, "key_range"), 4)


@query("""SELECT sst_id FROM (SELECT sst_id, max(recorded_at) AS pinned_at FROM manifest GROUP BY sst_id) p, (SELECT max(recorded_at) AS now FROM manifest) n
WHERE pinned_at + INTERVAL 86400 SECOND > now""")
def pinned_ssts(spark, d):
    rows = table(spark, d, "manifest")
    now = rows.agg(F.max("recorded_at")).first()[0]
    pins = rows.groupBy("sst_id").agg(F.max("recorded_at").alias("pinned_at"))
    return compaction.pinned(pins, F.lit(now).cast("timestamp_ntz"), 86400)


@query("SELECT coalesce(CAST(sum(more) AS BIGINT), 0) AS duplicates FROM (SELECT count(*) - 1 AS more FROM manifest GROUP BY sst_id) x")
def sst_duplicates(spark, d):
    return compaction.has_duplicates(table(spark, d, "manifest"))


@query(f"""SELECT user_key, sequence, CAST((sum({SIZE} + 96) OVER (ORDER BY sequence, user_key ROWS UNBOUNDED PRECEDING) - 1) // 65536 AS BIGINT) AS table_no FROM {KV} k""")
def memtable_rotation(spark, d):
    return writes.rotate(_kv(spark, d), [F.col("sequence"), F.col("user_key")], 65536).select("user_key", "sequence", F.col("table").alias("table_no"))


@query(f"""SELECT request_id, sequence, previous FROM (SELECT request_id, sequence, lag(sequence) OVER (ORDER BY arrived_at, request_id) AS previous FROM
(SELECT request_id, max(sequence) AS sequence, min(arrived_at) AS arrived_at FROM {REQ_OPS} o WHERE op_type IN ('PUT', 'DELETE') GROUP BY request_id) w) x WHERE sequence <= previous""")
def writes_out_of_order(spark, d):
    ops = requests.distinct_ops(table(spark, d, "kv_ops")).where(F.col("op_type").isin(*requests.WRITES))
    per = ops.groupBy("request_id").agg(F.max("sequence").alias("sequence"), F.min("arrived_at").alias("arrived_at"))
    return writes.out_of_order(per, [], [F.col("arrived_at"), F.col("request_id")], "sequence").select("request_id", "sequence", "previous")


@query(f"""SELECT sst_id, 0 AS level, min(user_key) AS first_key, max(user_key) AS last_key, count(*) AS n, CAST(sum(size) AS BIGINT) AS data_size FROM
(SELECT user_key, {SIZE} AS size, 1000 + CAST((sum({SIZE}) OVER (ORDER BY user_key, sequence DESC ROWS UNBOUNDED PRECEDING) - 1) // {CAPACITY} AS BIGINT) AS sst_id FROM {KV} k) x GROUP BY sst_id""")
def flush_runs(spark, d):
    return writes.flush(_kv(spark, d), CAPACITY, 1000)[1]


@query(f"""WITH s AS {SST}, h AS (SELECT r.grp, min(first_key) AS lo, max(last_key) AS hi FROM s JOIN key_range r ON s.level = 0 AND NOT (coalesce(s.first_key > r.end_key, false) OR s.last_key < r.start_key) GROUP BY r.grp)
SELECT h.grp, s.sst_id FROM s JOIN h ON s.level = 1 AND NOT (s.first_key > h.hi OR s.last_key < h.lo)""")
def compaction_inputs(spark, d):
    sst = _sst(spark, d)
    ranges = table(spark, d, "key_range").select("grp", "start_key", "end_key")
    met = overlap_pairs(sst.where("level = 0").select("first_key", "last_key"), ranges, ("first_key", "last_key"), ("start_key", "end_key"))
    return compaction.next_level_inputs(met.select("b.grp", "a.*"), sst, 0)


@query(f"""SELECT user_key, sequence, value FROM (SELECT user_key, sequence, value FROM {alive(2**63 - 1)} l WHERE user_key NOT IN (SELECT user_key FROM incoming_ops WHERE user_key IS NOT NULL AND {OP} IN ('PUT', 'DELETE'))) a
UNION ALL SELECT DISTINCT user_key, 99900000000, 'new' FROM incoming_ops WHERE user_key IS NOT NULL AND {OP} = 'PUT' AND user_key NOT IN (SELECT user_key FROM incoming_ops WHERE user_key IS NOT NULL AND {OP} = 'DELETE')""")
def put_and_delete(spark, d):
    new = table(spark, d, "incoming_ops").where(F.col("user_key").isNotNull()).withColumn("op_type", spelled(F.col("op_type")))
    after = writes.put(_kv(spark, d), new.where("op_type = 'PUT'").select("user_key", F.lit("new").alias("value")), 99900000000)
    return reads.live(writes.delete(after, new.where("op_type = 'DELETE'"), 99900000001))


# ---- manifest

STREAM = ["rudder_id"]


@query(f"""SELECT rudder_id, sst_id, sst_level, arg_max(data_size, struct_pack(a := version_id, b := op_idx)) FILTER (op = 'INSERT') AS data_size FROM
(SELECT * REPLACE (coalesce(data_size, -1) AS data_size) FROM {DIFFS} d) d GROUP BY ALL HAVING sum(CASE op WHEN 'INSERT' THEN 1 WHEN 'DELETE' THEN -1 ELSE 0 END) > 0""")
def manifest_fold(spark, d):
    diffs = manifest_diffs(table(spark, d, "manifest")).withColumn("data_size", F.coalesce("data_size", F.lit(-1)))
    return manifest.fold(diffs, ["rudder_id", "sst_id", "sst_level"])


@query(f"SELECT rudder_id, sst_id, sst_level FROM {DIFFS} d GROUP BY ALL HAVING sum(CASE op WHEN 'INSERT' THEN 1 WHEN 'DELETE' THEN -1 ELSE 0 END) < 0")
def manifest_unknown_deletes(spark, d):
    return manifest.unknown_deletes(manifest_diffs(table(spark, d, "manifest")), ["rudder_id", "sst_id", "sst_level"])


@query(f"SELECT * FROM (SELECT rudder_id, version_id, lag(version_id) OVER (PARTITION BY rudder_id ORDER BY version_id) AS previous FROM (SELECT DISTINCT rudder_id, version_id FROM {DIFFS} d) v) x WHERE version_id <> previous + 1")
def manifest_gap_check(spark, d):
    return manifest.gaps(manifest_diffs(table(spark, d, "manifest")), STREAM)


@query(f"SELECT version_id, op_idx, sst_id, op FROM {DIFFS} d WHERE rudder_id = 1 AND version_id IN (SELECT DISTINCT version_id FROM {DIFFS} d WHERE rudder_id = 1 AND version_id >= 20 ORDER BY 1 LIMIT 10)")
def diffs_from(spark, d):
    mine = manifest_diffs(table(spark, d, "manifest")).where("rudder_id = 1")
    return manifest.diffs_from(mine, 20, 10).select("version_id", "op_idx", "sst_id", "op")


@query(f"SELECT rudder_id, max(version_id) AS version_id FROM {DIFFS} d GROUP BY rudder_id")
def latest_versions(spark, d):
    return manifest.latest_version(manifest_diffs(table(spark, d, "manifest")), STREAM)


@query(f"SELECT * FROM {LEVEL_SIZES} l")
def level_sizes(spark, d):
    return manifest.level_sizes(_sst(spark, d), ["level"])


@query(f"SELECT a.sst_id, (SELECT count(*) FROM {SST} b WHERE b.sst_id <> a.sst_id AND NOT (a.first_key > b.last_key OR a.last_key < b.first_key)) AS n FROM {SST} a")
def sst_overlap_counts(spark, d):
    return manifest.overlap_counts(_sst(spark, d))


def _picked(lo: str, hi: str) -> str:
    hit = f"SELECT level, string_agg(CAST(sst_id AS VARCHAR), ',' ORDER BY sst_id) AS picked FROM {SST} s WHERE NOT (first_key > {hi} OR last_key < {lo}) GROUP BY level"
    return f"SELECT CAST(l.level AS INTEGER) AS level, coalesce(picked, '') AS picked FROM range(4) l(level) LEFT JOIN ({hit}) h ON l.level = h.level"


def _listed(picked: DataFrame) -> DataFrame:
    return manifest.listed(picked, LEVELS).select("level", F.array_join(F.transform("picked", lambda x: x.cast("string")), ",").alias("picked"))


@query(_picked(f"'{LO}'", f"'{HI}'"))
def pick_by_range(spark, d):
    return _listed(manifest.pick_by_range(_sst(spark, d), LO, HI))


@query(_picked(f"'{KEY}'", f"'{KEY}'"))
def pick_by_key(spark, d):
    return _listed(manifest.pick_by_key(_sst(spark, d), KEY))


FIRST_RUN = SNAPSHOT // 500 - 4


@query(_picked(*(f"(SELECT {f} FROM {SST} s WHERE sst_id IN ({FIRST_RUN}, {FIRST_RUN + 1}))" for f in ("min(first_key)", "max(last_key)"))))
def pick_by_ids(spark, d):
    return _listed(manifest.pick_by_ids(_sst(spark, d), [FIRST_RUN, FIRST_RUN + 1]))


@query(f"SELECT level, bool_and(prev IS NULL OR first_key > prev) AS ok FROM (SELECT level, first_key, lag(last_key) OVER (PARTITION BY level ORDER BY first_key, sst_id) AS prev FROM {SST} s) t GROUP BY level")
def verify_non_overlap(spark, d):
    return manifest.non_overlap(_sst(spark, d))


@query(f"SELECT level, sst_id FROM (SELECT level, sst_id, first_key, lag(last_key) OVER (PARTITION BY level ORDER BY first_key, sst_id) AS prev FROM {SST} s) t WHERE first_key <= prev")
def sst_overlap_violations(spark, d):
    return manifest.overlap_violations(_sst(spark, d))


@query(f"""WITH w AS (SELECT rudder_id, node_id, max(next_version_id) AS v FROM heartbeat WHERE next_version_id IS NOT NULL AND rudder_id IS NOT NULL AND node_id IS NOT NULL AND upper(trim(outcome)) = 'OK' GROUP BY rudder_id, node_id),
d AS (SELECT DISTINCT rudder_id, version_id FROM {DIFFS} d)
SELECT rudder_id, node_id, version_id FROM (SELECT w.rudder_id, w.node_id, d.version_id, row_number() OVER (PARTITION BY w.rudder_id, w.node_id ORDER BY d.version_id) AS rn FROM w JOIN d ON d.rudder_id = w.rudder_id AND d.version_id >= w.v) x WHERE rn <= 10""")
def heartbeat_diffs(spark, d):
    beats = table(spark, d, "heartbeat").where((spelled(F.col("outcome")) == "OK") & F.col("rudder_id").isNotNull() & F.col("node_id").isNotNull())
    wanted = beats.groupBy("rudder_id", "node_id").agg(F.max("next_version_id").alias("next_version_id"))
    return manifest.diffs_for(wanted, manifest_diffs(table(spark, d, "manifest")), STREAM)


@query("SELECT min(w) AS watermark FROM (SELECT rudder_id, node_id, max(watermark) AS w FROM heartbeat WHERE watermark IS NOT NULL GROUP BY rudder_id, node_id) x")
def cluster_watermark(spark, d):
    return manifest.watermark(table(spark, d, "heartbeat"), ["rudder_id", "node_id"])


# ---- routing

ROUTED = "(SELECT k.*, r.grp FROM {keys} k LEFT JOIN key_range r ON k.user_key >= r.start_key AND (r.end_key IS NULL OR k.user_key < r.end_key))"


@query(f"SELECT o.op_id, o.user_key, o.grp, CASE WHEN map_contains(q.raft_nodes, q.leader) THEN q.leader END AS leader, q.raft_nodes[q.leader] AS leader_node FROM {ROUTED.format(keys='incoming_ops')} o LEFT JOIN key_range q ON q.grp = o.grp")
def route_keys(spark, d):
    ops = table(spark, d, "incoming_ops").select("op_id", "user_key")
    return routing.route_to_leader(ops, "user_key", table(spark, d, "key_range")).select("op_id", "user_key", "grp", "leader", "leader_node")


@query(f"SELECT request_id, coalesce(min(grp) = max(grp) AND count(grp) = count(*), false) AS one_range FROM {ROUTED.format(keys=REQ_OPS)} o WHERE user_key IS NOT NULL GROUP BY request_id")
def requests_in_one_range(spark, d):
    return routing.all_in_range(requests.distinct_ops(table(spark, d, "kv_ops")), "user_key", table(spark, d, "key_range"), "request_id")


@query("""SELECT a.grp AS a, b.grp AS b FROM key_range a JOIN key_range b ON a.grp < b.grp AND (a.end_key IS NULL OR a.end_key >= b.start_key) AND (b.end_key IS NULL OR b.end_key >= a.start_key)""")
def key_range_conflicts(spark, d):
    return routing.key_range_conflicts(table(spark, d, "key_range"))


@query("""WITH old AS (SELECT * FROM key_range WHERE grp <= 24), new AS (SELECT * FROM key_range WHERE grp >= 24), nodes AS (SELECT DISTINCT node_id FROM heartbeat WHERE node_id <= 20),
w AS (SELECT grp, unnest(map_keys(raft_nodes)) AS rn, unnest(map_values(raft_nodes)) AS node FROM new),
mixed AS (SELECT grp, start_key, end_key FROM old UNION ALL SELECT grp, start_key, end_key FROM new WHERE grp NOT IN (SELECT grp FROM old))
SELECT grp, 'GROUP_EXISTS' AS problem FROM new WHERE grp IN (SELECT grp FROM old)
UNION SELECT grp, 'RAFT_NODE_EXISTS' FROM w WHERE rn IN (SELECT unnest(map_keys(raft_nodes)) FROM old)
UNION SELECT grp, 'NODE_UNKNOWN' FROM w WHERE node NOT IN (SELECT node_id FROM nodes)
UNION SELECT n.grp, 'RANGE_OVERLAPS' FROM new n JOIN mixed b ON n.grp <> b.grp AND (n.end_key IS NULL OR n.end_key >= b.start_key) AND (b.end_key IS NULL OR b.end_key >= n.start_key)""")
def key_range_violations(spark, d):
    ranges = table(spark, d, "key_range")
    nodes = table(spark, d, "heartbeat").where("node_id <= 20").select("node_id")
    return routing.key_range_violations(ranges.where("grp >= 24"), ranges.where("grp <= 24"), nodes)


NOW = "(SELECT max(sent_at) FROM heartbeat)"


@query(f"""SELECT k.grp, coalesce(arg_max(l.raft_node, struct_pack(a := l.seen, b := l.raft_node)), 0) AS leader FROM (SELECT grp, unnest(map_keys(raft_nodes)) AS raft_node FROM key_range) k
LEFT JOIN (SELECT raft_node, seen FROM (SELECT raft_node, sent_at AS seen, is_leader, row_number() OVER (PARTITION BY raft_node ORDER BY sent_at DESC, is_leader DESC NULLS LAST) AS rn FROM heartbeat WHERE raft_node IS NOT NULL) h
  WHERE rn = 1 AND is_leader AND seen >= {NOW} - INTERVAL 86400 SECOND) l ON l.raft_node = k.raft_node GROUP BY k.grp""")
def live_leaders(spark, d):
    beats = table(spark, d, "heartbeat").withColumn("at", F.col("sent_at"))
    now = F.lit(beats.agg(F.max("at")).first()[0]).cast("timestamp_ntz")
    return routing.live_leaders(table(spark, d, "key_range"), beats, now, 86400)


@query("SELECT raft_node, sent_at AS at, is_leader FROM (SELECT *, row_number() OVER (PARTITION BY raft_node ORDER BY sent_at DESC, is_leader DESC NULLS LAST) AS rn FROM heartbeat WHERE raft_node IS NOT NULL) h WHERE rn = 1")
def raft_states(spark, d):
    return routing.raft_states(table(spark, d, "heartbeat").withColumn("at", F.col("sent_at")))


@query(f"SELECT node_id, max(sent_at) AS at FROM heartbeat GROUP BY node_id HAVING max(sent_at) >= {NOW} - INTERVAL 7200 SECOND")
def live_nodes(spark, d):
    beats = table(spark, d, "heartbeat").withColumn("at", F.col("sent_at"))
    now = F.lit(beats.agg(F.max("at")).first()[0]).cast("timestamp_ntz")
    return routing.live_nodes(beats, "node_id", now, 7200)


@query("SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY start_key, end_key) AS no, start_key, end_key FROM key_range")
def ranges_per_group(spark, d):
    return routing.ranges_per_group(table(spark, d, "key_range"))


# ---- requests


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return requests.classify(requests.distinct_ops(table(spark, d, "kv_ops")))


@query(f"SELECT request_id, kind, read_only, n_ops FROM {REQUESTS} r")
def request_types(spark, d):
    return _requests(spark, d).select("request_id", "kind", "read_only", "n_ops")


@query(f"""SELECT request_id, op_idx, op_type, CASE op_type WHEN 'PUT' THEN op_value WHEN 'SNAPSHOT' THEN CAST(sequence AS VARCHAR) WHEN 'GET' THEN got END AS result FROM (
SELECT r.*, CASE WHEN v.op = 'PUT' THEN v.value END AS got FROM (SELECT *, CASE WHEN sequence > 0 THEN sequence ELSE 9223372036854775807 END AS s FROM {REQ_OPS} o WHERE op_type = 'GET' AND user_key IS NOT NULL) r
  ASOF LEFT JOIN {KV} v ON r.user_key = v.user_key AND r.s >= v.sequence
UNION ALL SELECT *, 0, NULL FROM {REQ_OPS} o WHERE NOT (op_type = 'GET' AND user_key IS NOT NULL)) x""")
def request_results(spark, d):
    return requests.evaluate(requests.distinct_ops(table(spark, d, "kv_ops")), _kv(spark, d))


@query(f"SELECT request_id, target, CAST(sum(CASE WHEN read_only THEN 0 ELSE 1 END) OVER (PARTITION BY target ORDER BY arrived_at, request_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS assigned FROM {REQUESTS} r")
def sequence_assignment(spark, d):
    return requests.assign_sequences(_requests(spark, d), "target", ["arrived_at", "request_id"]).select("request_id", "target", "assigned")


@query(f"SELECT request_id, row_number() OVER (ORDER BY arrived_at, request_id) + 1 AS tso FROM {REQUESTS} r")
def tso(spark, d):
    return requests.timestamps(_requests(spark, d), ["arrived_at", "request_id"]).select("request_id", "tso")


@query(f"SELECT request_id, target, CASE WHEN target IN (SELECT leader FROM key_range WHERE leader <> 0) THEN 'OK' ELSE 'REDIRECT' END AS status FROM {REQUESTS} r")
def redirects(spark, d):
    return requests.redirects(_requests(spark, d), "target", table(spark, d, "key_range")).select("request_id", "target", "status")


@query(f"""SELECT target, bool_and(read_only) AS read_only, arg_min(request_id, struct_pack(a := arrived_at, b := request_id)) AS first_request, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY arrived_at, request_id)
  - row_number() OVER (PARTITION BY target, read_only ORDER BY arrived_at, request_id) AS g FROM {REQUESTS} r) x GROUP BY target, read_only, g""")
def proposal_batches(spark, d):
    return requests.proposal_batches(_requests(spark, d), "target", ["arrived_at", "request_id"]).select("target", "read_only", "first_request", "n")


@query("""SELECT r.event_id, a.event_id AS released_at FROM (SELECT * FROM events WHERE event_type = 'view') r ASOF JOIN (SELECT * FROM events WHERE event_type = 'purchase') a ON r.user_id = a.user_id AND r.event_id <= a.event_id""")
def read_index_release(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.col("event_id").alias("index"), "event_type")
    return requests.release_reads(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", "index", "event_id")


# ---- log


@query(f"SELECT * FROM {SURVIVORS} s")
def raft_log_survivors(spark, d):
    return raftlog.survivors(table(spark, d, "raft_log"))


@query(f"SELECT grp, min(idx) AS first_index, max(idx) AS last_index, count(*) AS n, max(idx) - min(idx) + 1 <> count(*) AS gap FROM {SURVIVORS} s GROUP BY grp")
def raft_log_bounds(spark, d):
    return raftlog.bounds(raftlog.survivors(table(spark, d, "raft_log")))


@query(f"""SELECT grp, idx, term FROM (SELECT e.grp, e.idx, e.term, row_number() OVER (PARTITION BY e.grp ORDER BY e.idx DESC, e.term DESC, pos DESC) AS rn FROM {ENTRIES} e
JOIN (SELECT grp, max(idx) AS c FROM raft_log WHERE kind = 'COMPACT' AND grp IS NOT NULL GROUP BY grp) z ON z.grp = e.grp WHERE e.idx < z.c) x WHERE rn = 1""")
def raft_log_phantom_terms(spark, d):
    return raftlog.phantom_terms(table(spark, d, "raft_log"))


@query("""SELECT grp, hex(rec_key) AS rec_key, hex(rec_value) AS rec_value FROM (SELECT *, row_number() OVER (PARTITION BY grp, rec_key ORDER BY pos DESC) AS rn FROM raft_log WHERE kind IN ('PUT', 'DELETE') AND rec_key IS NOT NULL) x
WHERE rn = 1 AND kind = 'PUT'""")
def log_kv(spark, d):
    return raftlog.log_kv(table(spark, d, "raft_log")).select("grp", F.hex("rec_key").alias("rec_key"), F.hex("rec_value").alias("rec_value"))


@query(f"""SELECT grp, term, first_index, n FROM (SELECT grp, island, min(term) AS term, min(idx) AS first_index, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY grp ORDER BY pos) AS island FROM
(SELECT grp, term, idx, pos, CASE WHEN term = lag(term) OVER w AND idx = lag(idx) OVER w + 1 THEN 0 ELSE 1 END AS new FROM {ENTRIES} e WINDOW w AS (PARTITION BY grp ORDER BY pos)) x) y GROUP BY grp, island) z""")
def raft_batches(spark, d):
    return raftlog.batches(log_entries(table(spark, d, "raft_log"))).select("grp", "term", "first_index", "n")


@query(f"""SELECT grp, term, min(idx) AS first_index, max(idx) AS last_index FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY idx) - row_number() OVER (PARTITION BY grp, term ORDER BY idx) AS g FROM {SURVIVORS} s) x GROUP BY grp, term, g""")
def raft_log_terms(spark, d):
    return raftlog.group_terms(raftlog.survivors(table(spark, d, "raft_log"))).select("grp", "term", "first_index", "last_index")


@query("SELECT * FROM (SELECT file_id, lag(file_id) OVER (ORDER BY file_id) AS previous FROM (SELECT DISTINCT file_id FROM log_runs WHERE file_id IS NOT NULL) f) x WHERE file_id <> previous + 1")
def log_file_gaps(spark, d):
    return raftlog.file_gaps(table(spark, d, "log_runs"))


@query(f"SELECT * FROM {SURVIVORS} s WHERE grp = 35 AND idx >= 10 ORDER BY idx LIMIT 20")
def raft_log_entries(spark, d):
    return raftlog.entries(raftlog.survivors(table(spark, d, "raft_log")), 35, 5, 20, mask=10, strict=False)


@query(f"""SELECT a.grp, a.idx, coalesce(s.term, p.term) AS term FROM (SELECT DISTINCT grp, idx FROM raft_log WHERE kind = 'COMPACT' UNION SELECT grp, idx - 1 FROM raft_log WHERE kind = 'COMPACT') a
LEFT JOIN {SURVIVORS} s ON s.grp = a.grp AND s.idx = a.idx LEFT JOIN (SELECT grp, idx, term FROM (SELECT e.grp, e.idx, e.term, row_number() OVER (PARTITION BY e.grp ORDER BY e.idx DESC, e.term DESC, pos DESC) AS rn FROM {ENTRIES} e
JOIN (SELECT grp, max(idx) AS c FROM raft_log WHERE kind = 'COMPACT' AND grp IS NOT NULL GROUP BY grp) z ON z.grp = e.grp WHERE e.idx < z.c) x WHERE rn = 1) p
ON p.grp = a.grp AND (p.idx = a.idx OR a.grp NOT IN (SELECT grp FROM {SURVIVORS} s))""")
def raft_log_term_lookup(spark, d):
    log = table(spark, d, "raft_log")
    cuts = log.where("kind = 'COMPACT'")
    asked = cuts.select("grp", "idx").union(cuts.select("grp", F.col("idx") - 1)).distinct()
    return raftlog.term_of(asked, raftlog.survivors(log), raftlog.phantom_terms(log))


# ---- functions


@query(f"""SELECT user_key, sequence, CAST(octet_length(encode(user_key)) + 8 AS INTEGER) AS key_bytes, hex(encode(user_key)) || lpad(upper(to_hex(-1 - sequence)), 16, '0') AS full_key,
hex(encode(user_key)) AS back_key, sequence AS back_sequence, CASE WHEN octet_length(encode(user_key)) + 8 < 128 THEN 1 ELSE 2 END AS varint FROM {KV} k""")
def codec_keys(spark, d):
    full = codec.full_key(F.col("user_key"), F.col("sequence"))
    kv = _kv(spark, d).select("user_key", "sequence", full.alias("f"))
    return kv.select(
        "user_key", "sequence", F.length("f").alias("key_bytes"), F.hex("f").alias("full_key"), F.hex(codec.user_key_of(F.col("f"))).alias("back_key"),
        codec.sequence_of(F.col("f")).alias("back_sequence"), codec.varint_length(F.length("f")).alias("varint"),
    )


@query(f"""SELECT user_key, sequence, CASE WHEN op = 'DELETE' THEN '00' ELSE '01' || coalesce(hex(encode(value)), '') END AS raw_value FROM {KV} k""")
def codec_values(spark, d):
    return _kv(spark, d).select("user_key", "sequence", F.hex(codec.raw_value(F.col("op"), F.col("value"))).alias("raw_value"))


CRC = """CAST(xor(4294967295, list_reduce(list_prepend(4294967295, flatten([[CAST(('0x' || substr(f, 2 * i - 1, 2)) AS BIGINT) * 8 + j for j in range(8)] for i in range(1, length(f) // 2 + 1)])),
  lambda c, x: CASE WHEN xor(c, CASE WHEN x % 8 = 0 THEN x // 8 ELSE 0 END) & 1 = 1 THEN xor(xor(c, CASE WHEN x % 8 = 0 THEN x // 8 ELSE 0 END) >> 1, 3988292384) ELSE xor(c, CASE WHEN x % 8 = 0 THEN x // 8 ELSE 0 END) >> 1 END)) AS BIGINT)"""


@query(f"SELECT user_key, sequence, {CRC} AS crc FROM (SELECT user_key, sequence, hex(encode(user_key)) || lpad(upper(to_hex(-1 - sequence)), 16, '0') AS f FROM {KV} k) x")
def codec_checksums(spark, d):
    return _kv(spark, d).select("user_key", "sequence", codec.crc32(codec.full_key(F.col("user_key"), F.col("sequence"))).alias("crc"))


@query(f"""SELECT user_key, CAST(CASE WHEN prev IS NULL THEN 0 ELSE (SELECT coalesce(max(n), 0) FROM range(1, 64) r(n) WHERE n <= length(user_key) AND n <= length(prev) AND left(user_key, CAST(n AS INTEGER)) = left(prev, CAST(n AS INTEGER))) END AS INTEGER) AS shared
FROM (SELECT user_key, lag(user_key) OVER (ORDER BY user_key) AS prev FROM {alive(SNAPSHOT)} l) x""")
def codec_prefix_savings(spark, d):
    near = reads.neighbours(reads.live(_kv(spark, d), SNAPSHOT))
    return near.select("user_key", codec.shared_prefix("user_key", "prev_key").alias("shared"))


@query("SELECT request_id, op_idx, epoch_us(arrived_at) // 1000 - 1615248000000 AS ms, CASE WHEN sequence >= 0 THEN CAST(((sequence + 4095) // 4096) * 4096 AS BIGINT) END AS aligned, (request_id & (request_id - 1)) = 0 AND request_id > 0 AS pow2 FROM kv_ops")
def time_and_integers(spark, d):
    return table(spark, d, "kv_ops").select(
        "request_id", "op_idx", codec.timestamp_ms(F.col("arrived_at")).alias("ms"),
        F.when(F.col("sequence") >= 0, codec.align_up(F.col("sequence"), 4096).cast("bigint")).alias("aligned"), codec.is_pow2(F.col("request_id")).alias("pow2"),
    )


# ---- streaming

#: Files that the deliveries are dealt to before they are streamed, two a micro-batch.
STREAM_FILES = 8


@query(f"SELECT user_key, sequence, op_value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY sequence DESC, op_idx DESC) AS rn FROM kv_ops WHERE user_key IS NOT NULL AND sequence IS NOT NULL AND {OP} IN ('PUT', 'DELETE')) t WHERE rn = 1 AND {OP} = 'PUT'")
def streaming_apply(spark, d):
    """The op stream applied in several micro-batches of deliveries; the result must be the state that one batch gives."""
    from keystrata._util import scratch
    from keystrata.streaming import apply

    root = scratch(spark, "apply")
    split = f"{root}/input"
    ops = table(spark, d, "kv_ops").withColumn("arrival", F.pmod(F.coalesce("batch_id", F.lit(0)), F.lit(STREAM_FILES)).cast("int"))
    ops.repartition(STREAM_FILES, "arrival").write.parquet(split)
    stream = spark.readStream.schema(spark.read.parquet(split).schema).option("maxFilesPerTrigger", 2).parquet(split)
    apply.apply_changes(stream, f"{root}/state", f"{root}/progress", ["user_key"], ["op_value"]).awaitTermination()
    return apply.StateTable(spark, f"{root}/state", ["user_key"], ["op_value"]).read().where("op = 'PUT'").select("user_key", "sequence", "op_value")


CATALOGUE = Q
