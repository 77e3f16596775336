"""Readers of the input tables and the canonical views made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keystrata._util import spelled

#: Versions per synthetic sorted run; level of a run.
RUN_SPAN, LEVELS = 500, 4


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def kv_versions(ops: DataFrame) -> DataFrame:
    """``(user_key, sequence, op, value)``: the writes of an op stream, one per key and sequence.

    Where one request writes a key more than once, its later op wins; copies delivered again fall together. Rows
    without key, sequence or write op are left out. A DELETE is a row with a NULL value, so "deleted" and
    "absent" stay apart.
    """
    op = spelled(F.col("op_type"))
    writes = ops.where(op.isin("PUT", "DELETE") & F.col("user_key").isNotNull() & F.col("sequence").isNotNull())
    last = F.max_by(F.struct(op.alias("op"), F.when(op == "PUT", F.col("op_value")).alias("value")), F.col("op_idx"))
    folded = writes.groupBy("user_key", "sequence").agg(last.alias("last"))
    return folded.select("user_key", "sequence", "last.op", "last.value")


def with_runs(versions: DataFrame) -> DataFrame:
    """Adds the sorted run and level a version lies in: ``sst_id = sequence div 500``, ``level = sst_id mod 4``."""
    s = F.col("sequence")
    run = F.call_function("div", s - F.pmod(s, F.lit(RUN_SPAN)), F.lit(RUN_SPAN))
    return versions.withColumn("sst_id", run).withColumn("level", F.pmod(run, F.lit(LEVELS)).cast("int"))


def manifest_diffs(manifest: DataFrame) -> DataFrame:
    """The distinct diffs of a manifest; a row repeated later counts once, with its first ``recorded_at``."""
    named = manifest.where(F.col("rudder_id").isNotNull() & F.col("version_id").isNotNull())
    return named.groupBy("rudder_id", "version_id", "op_idx", "sst_id", "sst_level", "op").agg(
        F.max("data_size").alias("data_size"), F.min("recorded_at").alias("recorded_at")
    )


def log_entries(log: DataFrame) -> DataFrame:
    """ENTRY records with a complete ``(grp, term, idx)`` identifier."""
    return log.where((F.col("kind") == "ENTRY") & F.col("grp").isNotNull() & F.col("term").isNotNull() & F.col("idx").isNotNull())


NAMES = ("kv_ops", "incoming_ops", "key_range", "raft_log", "log_runs", "manifest", "heartbeat", "events", "documents", "eval_items", "pack_targets")


def register_views(spark: SparkSession, base: str) -> None:
    """Temporary views of the tables, and of ``kv_versions`` made from ``kv_ops``, for Spark SQL."""
    for name in NAMES:
        table(spark, base, name).createOrReplaceTempView(name)
    kv_versions(spark.table("kv_ops")).createOrReplaceTempView("kv_versions")
