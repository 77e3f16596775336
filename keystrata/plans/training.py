"""Queries p1, p2, p5 and p6: the general training-data operations over the store's tables."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, functions as F

from keystrata._util import cut_lineage, micros, spelled
from keystrata.operators import changefeed, dedup, incremental, routing, skew
from keystrata.sources.tables import log_entries, table

MESSAGE = ["grp", "term", "idx"]
LEASE_S, BEAT_S = 3600, 15


def _ok(c: str = "outcome"):
    return F.coalesce(spelled(F.col(c)) == "OK", F.lit(False))


def _log_readers(spark: SparkSession, d: str) -> DataFrame:
    """Ledger events of the log readers: a run leases its file's unread rest, and is done at the position that it came to."""
    runs = table(spark, d, "log_runs")
    return incremental.attempts(runs, ["file_id"], F.col("run_id"), micros(F.col("started_at")), LEASE_S * 1_000_000, micros(F.col("ended_at")), _ok(), F.col("read_pos"))


def _all_over(events: DataFrame) -> int:
    """When the last lease has run out."""
    return events.agg(F.max("until")).first()[0] or 0


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """What the ledger hands out once every lease has been answered or has run out."""
    runs = _log_readers(spark, d)
    log = incremental.pending_messages(log_entries(table(spark, d, "raft_log")), incremental.ledger_state(runs, _all_over(runs), ["file_id"]), MESSAGE, "file_id", "pos")
    beats, sent = table(spark, d, "heartbeat"), micros(F.col("sent_at"))
    wheel = ["rudder_id", "node_id"]
    # a heartbeat that failed asked for nothing; one that succeeded is a lease answered at once
    acks = incremental.attempts(beats.where(_ok() & F.col("next_version_id").isNotNull()), wheel, sent, sent, BEAT_S * 1_000_000, sent, F.lit(True), F.col("next_version_id"))
    diffs = table(spark, d, "manifest").select("rudder_id", "version_id", micros(F.col("recorded_at")).alias("at"))
    readers = incremental.ledger_state(acks, _all_over(acks), wheel, rewinds=True)
    ahead = incremental.pending_versions(diffs, beats, readers, "rudder_id", "node_id", "version_id", "at")
    a = log.select(F.lit("log").alias("stream"), F.col("grp").alias("owner"), F.col("term").alias("member"), F.col("idx").alias("item"))
    b = ahead.select(F.lit("manifest").alias("stream"), F.col("rudder_id").alias("owner"), F.col("node_id").alias("member"), F.col("version_id").alias("item"))
    return a.unionByName(b)


P1_FOUND = """
WITH f AS (SELECT file_id, max(read_pos) AS p FROM log_runs WHERE upper(trim(outcome)) = 'OK' GROUP BY file_id),
m AS (SELECT grp, term, idx, bool_or(coalesce(r.pos <= f.p, false)) AS seen FROM raft_log r LEFT JOIN f ON r.file_id = f.file_id
      WHERE kind = 'ENTRY' AND grp IS NOT NULL AND term IS NOT NULL AND idx IS NOT NULL GROUP BY grp, term, idx),
w AS (SELECT DISTINCT rudder_id, node_id FROM heartbeat WHERE rudder_id IS NOT NULL AND node_id IS NOT NULL),
a AS (SELECT rudder_id, node_id, sent_at, next_version_id FROM (SELECT *, row_number() OVER (PARTITION BY rudder_id, node_id ORDER BY sent_at DESC NULLS LAST, next_version_id DESC) AS rn
      FROM heartbeat WHERE upper(trim(outcome)) = 'OK' AND next_version_id IS NOT NULL) x WHERE rn = 1),
v AS (SELECT rudder_id, version_id, min(recorded_at) AS at FROM manifest WHERE version_id IS NOT NULL GROUP BY rudder_id, version_id)
SELECT 'log' AS stream, grp AS owner, term AS member, idx AS item FROM m WHERE NOT seen
UNION ALL
SELECT 'manifest', v.rudder_id, w.node_id, v.version_id FROM v JOIN w ON v.rudder_id = w.rudder_id
LEFT JOIN a ON a.rudder_id = w.rudder_id AND a.node_id = w.node_id
WHERE NOT coalesce(a.next_version_id > v.version_id AND a.sent_at >= v.at, false)
"""


def p1_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The items that runs of the log readers name, as of the last start of any run, with leases of an hour.

    An item is a file and a position; every DONE is taken as arriving now, so that a later lease of the item fences it.
    ``p1_stretches`` has the work between positions instead, with each DONE at its own time.
    """
    runs = table(spark, d, "log_runs").where("run_id IS NOT NULL AND file_id IS NOT NULL").dropDuplicates(["run_id"])
    at = micros(F.col("started_at"))
    event = F.when(_ok(), "DONE").otherwise("LEASED")
    item = F.concat_ws("/", F.col("file_id").cast("string"), F.col("read_pos").cast("string"))
    until = F.when(F.col("ended_at").isNull() & (F.col("outcome").isNull()), at + LEASE_S * 1_000_000).otherwise(at)
    leases = runs.select(item.alias("item"), F.lit("LEASED").alias("event"), F.col("run_id").alias("token"), until.alias("until"))
    done = runs.where(_ok()).select(item.alias("item"), event.alias("event"), F.col("run_id").alias("token"), at.alias("until"))
    now = runs.agg(F.max(at)).first()[0] or 0
    events = leases.unionByName(done).select("item", "event", "token", F.lit(None).cast("string").alias("worker"), F.when(F.col("event") == "DONE", 1).otherwise(0).alias("at"), "until", F.lit(None).cast("bigint").alias("position"))
    return incremental.ledger_state(events, now).drop("position")


P1_LEDGER = """
WITH r AS (SELECT DISTINCT run_id, file_id, started_at, ended_at, upper(trim(outcome)) AS outcome, read_pos FROM log_runs WHERE run_id IS NOT NULL AND file_id IS NOT NULL),
i AS (SELECT concat_ws('/', CAST(file_id AS VARCHAR), CAST(read_pos AS VARCHAR)) AS item, * FROM r),
g AS (SELECT item, max(run_id) AS token, max(CASE WHEN outcome = 'OK' THEN run_id END) AS done FROM i GROUP BY item),
n AS (SELECT max(started_at) AS now FROM r)
SELECT g.item, CASE WHEN g.done = g.token THEN 'done'
  WHEN i.ended_at IS NULL AND i.outcome IS NULL AND i.started_at + INTERVAL 1 HOUR > n.now THEN 'leased' ELSE 'pending' END AS state, g.token
FROM g JOIN i ON i.item = g.item AND i.run_id = g.token, n
"""


def p1_stretches(spark: SparkSession, d: str) -> DataFrame:
    """The work of each log file between the positions that its runs came to: done, leased or pending as of the last start of any run."""
    runs, events = table(spark, d, "log_runs"), _log_readers(spark, d)
    now = runs.agg(F.max(micros(F.col("started_at")))).first()[0] or 0
    state = incremental.ledger_state(events, now, ["file_id"])
    came = runs.where("run_id IS NOT NULL AND started_at IS NOT NULL AND file_id IS NOT NULL").select("file_id", F.col("run_id").alias("token"), F.col("read_pos").alias("position"))
    return incremental.stretches(came, ["file_id"], state)


P1_STRETCHES = """
WITH r AS (SELECT DISTINCT run_id, file_id, started_at, ended_at, upper(trim(outcome)) AS outcome, read_pos FROM log_runs WHERE run_id IS NOT NULL AND file_id IS NOT NULL AND started_at IS NOT NULL),
g AS (SELECT file_id, max(read_pos) FILTER (outcome = 'OK') AS done, arg_max(started_at, run_id) AS last, arg_max(outcome = 'OK' AND read_pos IS NOT NULL, run_id) AS over FROM r GROUP BY file_id),
e AS (SELECT DISTINCT file_id, read_pos AS upto FROM r WHERE read_pos IS NOT NULL)
SELECT e.file_id, e.upto, CASE WHEN e.upto <= g.done THEN 'done' WHEN NOT coalesce(g.over, false) AND g.last + INTERVAL 1 HOUR > (SELECT max(started_at) FROM r) THEN 'leased' ELSE 'pending' END AS state,
  (SELECT count(*) FROM r WHERE r.file_id = e.file_id AND r.read_pos >= e.upto) AS tries
FROM e JOIN g ON g.file_id = e.file_id
"""


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.repeats(log_entries(table(spark, d, "raft_log")).select(*MESSAGE, "pos"), MESSAGE, "pos").select("pos")


P2_FOUND = """
SELECT pos FROM (SELECT pos, min(pos) OVER (PARTITION BY grp, term, idx) AS first FROM raft_log
WHERE kind = 'ENTRY' AND grp IS NOT NULL AND term IS NOT NULL AND idx IS NOT NULL) t WHERE pos > first
"""


def p2_messages(spark: SparkSession, d: str) -> DataFrame:
    entries = log_entries(table(spark, d, "raft_log")).select(*MESSAGE, "pos", F.length("entry_data").cast("bigint").alias("bytes"))
    return dedup.one_copy_each(entries, MESSAGE, "pos")


P2_MESSAGES = """
SELECT grp, term, idx, pos, CAST(octet_length(entry_data) AS BIGINT) AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY grp, term, idx ORDER BY pos) AS rn FROM raft_log
WHERE kind = 'ENTRY' AND grp IS NOT NULL AND term IS NOT NULL AND idx IS NOT NULL) t WHERE rn = 1
"""


def _kv_state(spark: SparkSession, d: str) -> DataFrame:
    op = spelled(F.col("op_type"))
    writes = table(spark, d, "kv_ops").where(op.isin("PUT", "DELETE"))
    return changefeed.fold_changes(writes, ["user_key"], ["sequence", "op_idx"], op, kinds=("PUT", "DELETE"))


def _sst_state(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.fold_changes(table(spark, d, "manifest"), ["sst_id", "sst_level"], ["version_id", "op_idx"], spelled(F.col("op")), kinds=("INSERT", "DELETE"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    kv = changefeed.live(_kv_state(spark, d)).select(F.lit("kv").alias("feed"), F.col("user_key").alias("item"), F.lit(-1).alias("sst_level"), F.col("sequence").alias("at"))
    sst = changefeed.live(_sst_state(spark, d)).select(
        F.lit("manifest").alias("feed"), F.col("sst_id").cast("string").alias("item"), F.col("sst_level"), F.col("version_id").alias("at")
    )
    return kv.unionByName(sst)


P5_FOUND = """
SELECT 'kv' AS feed, user_key AS item, -1 AS sst_level, sequence AS at FROM (SELECT user_key, sequence, regexp_replace(upper(trim(op_type)), '^T_', '') AS op,
  row_number() OVER (PARTITION BY user_key ORDER BY sequence DESC, op_idx DESC) AS rn FROM kv_ops
  WHERE user_key IS NOT NULL AND sequence IS NOT NULL AND regexp_replace(upper(trim(op_type)), '^T_', '') IN ('PUT', 'DELETE')) t WHERE rn = 1 AND op = 'PUT'
UNION ALL
SELECT 'manifest', CAST(sst_id AS VARCHAR), sst_level, version_id FROM (SELECT *, row_number() OVER (PARTITION BY sst_id, sst_level ORDER BY version_id DESC, op_idx DESC) AS rn FROM manifest
  WHERE sst_id IS NOT NULL AND sst_level IS NOT NULL AND version_id IS NOT NULL) t WHERE rn = 1 AND op = 'INSERT'
"""


def p5_tombstones(spark: SparkSession, d: str) -> DataFrame:
    """What the fold must remember beside the live state: the last delete of each dead key."""
    return _kv_state(spark, d).where("op = 'DELETE'").select("user_key", "sequence", "op_idx")


P5_TOMBSTONES = """
SELECT user_key, sequence, op_idx FROM (SELECT user_key, sequence, op_idx, regexp_replace(upper(trim(op_type)), '^T_', '') AS op,
  row_number() OVER (PARTITION BY user_key ORDER BY sequence DESC, op_idx DESC) AS rn FROM kv_ops
  WHERE user_key IS NOT NULL AND sequence IS NOT NULL AND regexp_replace(upper(trim(op_type)), '^T_', '') IN ('PUT', 'DELETE')) t WHERE rn = 1 AND op = 'DELETE'
"""


def p5_resumed(spark: SparkSession, d: str) -> DataFrame:
    """The live keys again, the odd batches folded onto the written state of the even ones."""
    op = spelled(F.col("op_type"))
    writes = table(spark, d, "kv_ops").where(op.isin("PUT", "DELETE"))
    odd = F.pmod(F.coalesce("batch_id", F.lit(0)), F.lit(2)) == 1
    how = {"keys": ["user_key"], "order": ["sequence", "op_idx"], "op": op, "kinds": ("PUT", "DELETE")}
    base = cut_lineage(changefeed.fold_changes(writes.where(~odd), **how))
    return changefeed.live(changefeed.fold_changes(writes.where(odd), base=base, **how)).select("user_key", "sequence")


P5_RESUMED = P5_FOUND.partition("UNION ALL")[0].replace("'kv' AS feed, user_key AS item, -1 AS sst_level, sequence AS at", "user_key, sequence")

KEY_SHARE, GROUP_SHARE = Fraction(1, 100), Fraction(1, 20)
QUANTILES = {"p50": 0.5, "p95": 0.95}


def _by_key(spark: SparkSession, d: str, share: Fraction | None) -> DataFrame:
    ops = table(spark, d, "kv_ops").select("user_key", "arrived_at")
    return skew.exact_quantiles(ops, ["user_key"], micros(F.col("arrived_at")), QUANTILES, share)


def _by_group(spark: SparkSession, d: str, share: Fraction | None) -> DataFrame:
    ops = routing.route(table(spark, d, "kv_ops").select("user_key", "arrived_at"), "user_key", table(spark, d, "key_range"))
    return skew.exact_quantiles(ops, ["grp"], micros(F.col("arrived_at")), QUANTILES, share)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The keys and groups of at least the asked share, out of the frames of their resolved quantiles."""
    keys = cut_lineage(_by_key(spark, d, KEY_SHARE)).select(F.lit("key").alias("kind"), F.col("user_key").alias("item"))
    groups = cut_lineage(_by_group(spark, d, GROUP_SHARE)).select(F.lit("grp").alias("kind"), F.col("grp").cast("string").alias("item"))
    return keys.unionByName(groups)


P6_FOUND = """
SELECT 'key' AS kind, user_key AS item FROM kv_ops WHERE user_key IS NOT NULL GROUP BY user_key HAVING count(*) * 100 >= (SELECT count(*) FROM kv_ops)
UNION ALL
SELECT 'grp', CAST(grp AS VARCHAR) FROM kv_ops JOIN key_range ON user_key >= start_key AND (end_key IS NULL OR user_key < end_key)
GROUP BY grp HAVING count(*) * 20 >= (SELECT count(*) FROM kv_ops)
"""


def p6_key_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Rows and arrival quantiles (microseconds) of every key."""
    return _by_key(spark, d, None)


def p6_group_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Rows and arrival quantiles (microseconds) of every group of key_range that holds a key."""
    return _by_group(spark, d, None)


_QUANTILES = """
SELECT {key}, count(*) AS n, max(CASE WHEN r = greatest(1, CAST(ceil(0.5 * m) AS BIGINT)) THEN v END) AS p50, max(CASE WHEN r = greatest(1, CAST(ceil(0.95 * m) AS BIGINT)) THEN v END) AS p95
FROM (SELECT {key}, v, CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY {key} ORDER BY v NULLS LAST) END AS r, count(v) OVER (PARTITION BY {key}) AS m FROM ({rows}) x WHERE {key} IS NOT NULL) y GROUP BY {key}
"""
P6_KEY_QUANTILES = _QUANTILES.format(key="user_key", rows="SELECT user_key, epoch_us(arrived_at) AS v FROM kv_ops")
P6_GROUP_QUANTILES = _QUANTILES.format(
    key="grp", rows="SELECT grp, epoch_us(arrived_at) AS v FROM kv_ops JOIN key_range ON user_key >= start_key AND (end_key IS NULL OR user_key < end_key)"
)

#: name -> (query, oracle or None)
CATALOGUE = {
    "p1_found": (p1_found, P1_FOUND),
    "p1_ledger": (p1_ledger, P1_LEDGER),
    "p1_stretches": (p1_stretches, P1_STRETCHES),
    "p2_found": (p2_found, P2_FOUND),
    "p2_messages": (p2_messages, P2_MESSAGES),
    "p5_found": (p5_found, P5_FOUND),
    "p5_tombstones": (p5_tombstones, P5_TOMBSTONES),
    "p5_resumed": (p5_resumed, P5_RESUMED),
    "p6_found": (p6_found, P6_FOUND),
    "p6_key_quantiles": (p6_key_quantiles, P6_KEY_QUANTILES),
    "p6_group_quantiles": (p6_group_quantiles, P6_GROUP_QUANTILES),
}
