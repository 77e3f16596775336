"""Keyed streaming state: the newest change of each key, emitted when it changes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keystrata._util import spelled

_SCHEMA = "sequence bigint, op_idx int, op string, value string"
_OUT = f"user_key string, {_SCHEMA}"


class _Newest(StatefulProcessor):
    """One row of state a key, tombstones included; repeated and late changes are absorbed by the maximum.

    A batch's changes of a key are reduced to one before they meet the state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _SCHEMA)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        had = self.last.get() if self.last.exists() else None
        best = None if had is None else (had[0], had[1], had[2], had[3] or "")
        kept, was = had, best
        for pdf in rows:
            at = pdf.assign(text=pdf["value"].fillna("")).sort_values(["sequence", "op_idx", "op", "text"]).iloc[-1] if len(pdf) > 1 else pdf.iloc[-1]
            value = None if pd.isna(at["value"]) else at["value"]
            rank = (int(at["sequence"]), int(at["op_idx"]), at["op"], value or "")
            if best is None or rank > best:
                best, kept = rank, (*rank[:3], value)
        if best != was:
            self.last.update(kept)
            yield pd.DataFrame([(key[0], *kept)], columns=["user_key", "sequence", "op_idx", "op", "value"])

    def close(self) -> None:
        pass


def newest_changes(ops: DataFrame) -> DataFrame:
    """A stream of ``(user_key, sequence, op_idx, op, value)``: a key's last change, each time a batch changes it.

    The state is one row per key in the state store (RocksDB), so its size follows the live and deleted keys, not
    the changes. Run it in update mode. For tables whose every batch touches few keys; the others use ``StateTable``.
    """
    op = spelled(F.col("op_type"))
    writes = ops.where(op.isin("PUT", "DELETE") & F.col("user_key").isNotNull() & F.col("sequence").isNotNull())
    rows = writes.select("user_key", "sequence", F.coalesce("op_idx", F.lit(0)).alias("op_idx"), op.alias("op"), F.when(op == "PUT", F.col("op_value")).alias("value"))
    return rows.groupBy("user_key").transformWithStateInPandas(_Newest(), outputStructType=_OUT, outputMode="Update", timeMode="None")
