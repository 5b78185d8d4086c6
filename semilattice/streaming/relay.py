"""The relay as a continuous query: ops stream in, state is kept by scope, changes go out batch by batch."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from semilattice.operators.resolve import FIELD_KEY, OUTCOMES, SKEW_MS, Scope, batches_of, frame


def running_fields(ops: DataFrame) -> DataFrame:
    """The winning write of every field over a stream of ops without base hashes: one aggregate, in the JVM.

    Folding is commutative and idempotent, so order and redelivery don't matter. Write in update or complete mode.
    """
    won = F.max_by(F.struct("value", "hlc", "txn_id", "pos"), F.struct(F.col("hlc"), -F.col("pos")))
    return ops.where("kind = 'set'").groupBy(*FIELD_KEY).agg(won.alias("w")).select(*FIELD_KEY, "w.value", "w.hlc", "w.txn_id", "w.pos")


class _ScopeProcessor(StatefulProcessor):
    """Folds one scope's pushes in order of arrival; its records live in state maps, touched ones alone are written."""

    def __init__(self, now_ms: int, skew_ms: int) -> None:
        self.now_ms, self.skew_ms = now_ms, skew_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.meta = handle.getValueState("meta", "seq long, last_seen long")
        self.fields = handle.getMapState("fields", "k string", "v string")
        self.rows = handle.getMapState("rows", "k string", "v string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows)).sort_values(["batch_id", "pos"]).astype(object).where(lambda d: d.notna(), None)
        scope = Scope(key[0])
        if self.meta.exists():
            scope.seq, scope.last_seen = map(int, self.meta.get())
        scope.fields = {tuple(json.loads(k[0])): json.loads(v[0]) for k, v in self.fields.iterator()}
        scope.rows = {tuple(json.loads(k[0])): json.loads(v[0]) for k, v in self.rows.iterator()}
        for t, r, f in scope.fields:
            scope.named.setdefault((t, r), []).append(f)
        before = {n: {k: json.dumps(v) for k, v in getattr(scope, n).items()} for n in ("fields", "rows")}
        out = [{"scope_id": key[0], "batch_id": b, **o} for b, group in batches_of(pdf.to_dict("records")) for o in scope.push(group, self.now_ms, self.skew_ms)]
        for n, state in (("fields", self.fields), ("rows", self.rows)):
            for k, v in getattr(scope, n).items():
                if before[n].get(k) != (text := json.dumps(v)):
                    state.updateValue((json.dumps(k),), (text,))
        self.meta.update((scope.seq, scope.last_seen))
        yield frame(out, OUTCOMES)

    def close(self) -> None:
        pass


def relay(ops: DataFrame, now_ms: int, skew_ms: int = SKEW_MS) -> DataFrame:
    """Outcomes of pushes over a stream of ops, certified writes and refusals included; state by scope in RocksDB.

    The session needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider.
    """
    return ops.groupBy("scope_id").transformWithStateInPandas(statefulProcessor=_ScopeProcessor(now_ms, skew_ms), outputStructType=OUTCOMES, outputMode="Update", timeMode="None")


def announce(changes: DataFrame, checkpoint: str, tell: Callable[[DataFrame, int], None], **trigger) -> StreamingQuery:
    """Calls ``tell`` once a micro-batch that holds anything; a batch told again after a failure has the same number."""

    def once(batch: DataFrame, number: int) -> None:
        if batch.take(1):
            tell(batch, number)

    return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(once).trigger(**(trigger or {"availableNow": True})).start()


def needs_resync(cursors: DataFrame, scopes: DataFrame) -> DataFrame:
    """Devices whose cursor lies below the floor or above the head, or was counted in another epoch."""
    stale = (F.col("last_server_seq") < F.col("tombstone_floor_seq")) | (F.col("last_server_seq") > F.col("server_seq")) | (F.col("d.epoch") != F.col("s.epoch"))
    return cursors.alias("d").join(scopes.alias("s"), "scope_id").where(stale).select("scope_id", "device_id", "last_server_seq")
