"""Streaming writes: a change stream applied to a state table, and a log of versions that grows by puts and deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from keystrata._util import spelled
from keystrata.operators.changefeed import fold_changes

ORDER = ["sequence", "op_idx"]
#: Deltas after which they are folded into a new base.
COMPACT_EVERY = 16


def append_versions(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the writes of a stream of ops to a versions table: a PUT adds its value, a DELETE a tombstone."""
    op = spelled(F.col("op_type"))
    rows = stream.where(op.isin("PUT", "DELETE") & F.col("user_key").isNotNull()).select(
        "user_key", "sequence", "op_idx", op.alias("op"), F.when(op == "PUT", F.col("op_value")).alias("value")
    )
    out = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()


class StateTable:
    """A folded change feed on storage: a base and the deltas since, each a folder named by its batch number.

    A batch writes only its own fold, so the cost of a batch follows the batch and not the table; every ``COMPACT_EVERY``
    deltas are folded into a new base. A folder counts once Spark has committed it. Reading folds base and deltas,
    which is the same commutative maximum again, so it doesn't matter if a delta is in the base already.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], payload: list[str]):
        self.spark, self.path, self.keys, self.payload = spark, path.rstrip("/"), keys, payload
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _numbers(self, kind: str) -> list[int]:
        root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(int(n.rpartition("-")[2]) for n in names if n.startswith(f"{kind}-") and self._fs.exists(self._at(f"{n}/_SUCCESS")))

    def _parts(self) -> list[str]:
        bases = self._numbers("base")
        since = [f"delta-{n}" for n in self._numbers("delta") if not bases or n > bases[-1]]
        return [f"base-{bases[-1]}", *since] if bases else since

    def read(self) -> DataFrame | None:
        """The last change of each key, tombstones included; None before the first batch."""
        parts = [self.spark.read.parquet(f"{self.path}/{n}") for n in self._parts()]
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else self._fold(reduce(DataFrame.unionByName, parts))

    def _fold(self, rows: DataFrame) -> DataFrame:
        return fold_changes(rows.withColumnRenamed("op", "op_type"), self.keys, ORDER, F.col("op_type"), self.payload)

    def apply(self, changes: DataFrame, number: int, op: str = "op_type") -> None:
        """Fold a batch in. Running the same number again writes the same rows to the same folder."""
        name = spelled(F.col(op))
        delta = fold_changes(changes.where(name.isin("PUT", "DELETE")), self.keys, ORDER, name, self.payload)
        delta.write.mode("overwrite").parquet(f"{self.path}/delta-{number}")
        bases = self._numbers("base")
        since = [n for n in self._numbers("delta") if not bases or n > bases[-1]]
        if len(since) >= COMPACT_EVERY:
            self.read().write.mode("overwrite").parquet(f"{self.path}/base-{since[-1]}")
            if bases:  # what a reader of the base before this one may still need stays
                for n in [*[f"delta-{n}" for n in self._numbers("delta") if n <= bases[-1]], *[f"base-{n}" for n in bases[:-1]]]:
                    self._fs.delete(self._at(n), True)


def apply_changes(stream: DataFrame, path: str, checkpoint: str, keys: list[str], payload: list[str]) -> StreamingQuery:
    """Fold a stream of changes (``op_type``, keys, sequence, op_idx, payload) into a ``StateTable``, batch by batch.

    The fold is idempotent and needs no order: copies and late changes across batches do no harm, because tombstones
    stay in the state, and a batch that runs again after a failure replaces its own delta.
    """

    def fold(batch: DataFrame, number: int) -> None:
        StateTable(batch.sparkSession, path, keys, payload).apply(batch, number)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
