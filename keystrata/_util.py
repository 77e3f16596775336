"""Helpers shared by the operators: lineage cuts, size-checked broadcasts, spellings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Prefix of every column an operator adds for itself, so that extra input columns can't clash.
P = "__ks_"

#: Rows and bytes up to which a side may be broadcast; beyond either the join is left to shuffle (AQE splits its skew).
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a local temporary one only where none is set (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(named or _gone_at_exit(spark, tempfile.mkdtemp(prefix="keystrata-")))
    return sc.getCheckpointDir()


def _gone_at_exit(spark: SparkSession, path: str) -> str:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared checkpoint folder, removed when the session's JVM ends."""
    return _gone_at_exit(spark, f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder: later stages neither recompute nor depend on one executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def json_bytes(df: DataFrame) -> Column:
    """Bytes of the frame's rows written as JSON, at least 16 a column: more than a hash table of them takes up in rows."""
    return F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))) + F.lit(16 * len(df.columns))), F.lit(0))


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame | None:
    """The frame, materialised once, if it holds at most ``max_rows`` rows and ``max_bytes`` bytes; else None."""
    held = cut_lineage(df.limit(max_rows + 1))
    rows, size = held.agg(F.count(F.lit(1)), json_bytes(held)).first()
    return held if rows <= max_rows and size <= max_bytes else None


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the frame is measured to be ``small``.

    Otherwise it comes back without a hint and the join shuffles both sides.
    """
    held = small(df, max_rows, max_bytes)
    return df if held is None else F.broadcast(held)


def spelled(name: Column) -> Column:
    """The name that a loosely spelt code stands for: case, blanks around it and a leading ``T_`` don't count."""
    return F.regexp_replace(F.upper(F.trim(name)), "^T_", "")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
