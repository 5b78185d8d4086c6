"""Resolving an op log into current state.

Without base hashes the state is an argmax by stamp and folds in any order, with partial aggregation on the map
side. With them, or where rejections matter, transactions are folded in order of arrival, one scope at a time.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semilattice.functions import hlc
from semilattice.functions.wire import wire_hash
from semilattice.plans.schema import BASE_FIELDS

ROW_KEY = ["scope_id", "table_name", "row_id"]
FIELD_KEY = [*ROW_KEY, "field"]
SKEW_MS = 5 * 60 * 1000
KINDS = ("create", "append", "delete", "restore", "set")


def _first_highest() -> Column:
    """Orders writes: the highest stamp wins, of equal ones the first to arrive."""
    return F.struct(F.col("hlc"), -F.col("pos"))


def latest_fields(ops: DataFrame, *values: str) -> DataFrame:
    """Each field's winning write: its ``values`` columns with hlc, txn_id and pos.

    Of equal stamps the smallest ``pos`` wins; a redelivered op changes nothing. A null value is a value. A null stamp
    loses to any other. An empty log gives an empty result.
    """
    keep = [*values, "hlc", "txn_id", "pos"]
    won = F.max_by(F.struct(*keep), _first_highest())
    return ops.where("kind = 'set'").groupBy(*FIELD_KEY).agg(won.alias("w")).select(*FIELD_KEY, *(F.col(f"w.{c}") for c in keep))


def registers(ops: DataFrame) -> DataFrame:
    """Each row's liveness: the stamp of its last delete or restore, and that stamp again if it was a delete."""
    life = ops.where(F.col("kind").isin("delete", "restore")).groupBy(*ROW_KEY)
    out = life.agg(F.max("hlc").alias("register_hlc"), F.max_by("kind", _first_highest()).alias("last"))
    return out.select(*ROW_KEY, "register_hlc", F.when(F.col("last") == "delete", F.col("register_hlc")).alias("deleted_hlc"))


def rows_of(ops: DataFrame) -> DataFrame:
    """All rows that ops name, with their registers: null where nothing was deleted or restored."""
    seen = ops.groupBy(*ROW_KEY).agg(F.min("pos").alias("first_pos"), F.max("hlc").alias("last_hlc"))
    return seen.join(registers(ops), ROW_KEY, "left")


def highest_stamps(ops: DataFrame) -> DataFrame:
    """Each scope's highest stamp; a scope whose stamps are all null has null."""
    return ops.groupBy("scope_id").agg(F.max("hlc").alias("highest"))


def acknowledged_rows(ops: DataFrame) -> DataFrame:
    """The rows that each transaction names, once each, with the place of the op that names them first."""
    return ops.groupBy("scope_id", "txn_id", "table_name", "row_id").agg(F.min("pos").alias("first_pos"))


def live_rows(ops: DataFrame) -> DataFrame:
    return rows_of(ops).where("deleted_hlc is null")


def superseded(ops: DataFrame) -> DataFrame:
    """Writes that lose on arrival, with the stamp that beats them: those not above all earlier stamps of the field."""
    before = W.partitionBy(*FIELD_KEY).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return ops.where("kind = 'set'").withColumn("winner_hlc", F.max("hlc").over(before)).where("hlc <= winner_hlc")


def with_server_seq(fields: DataFrame, base_seq: int = 0) -> DataFrame:
    """Numbers each scope's records in the order in which their writes arrived."""
    return fields.withColumn("server_seq", F.row_number().over(W.partitionBy("scope_id").orderBy("pos")) + F.lit(base_seq).cast("long"))


def with_first_seen(rows: DataFrame, now: Column) -> DataFrame:
    """``first_seen_at``: the time of arrival, above that of every earlier row of the whole relay.

    max(now, previous + 1) is a running maximum of now - n, n being a row's place. Places come from counts of
    ranges, so that no task sees all rows.
    """
    buckets = rows.withColumn("_b", F.expr("first_pos div 65536"))
    counts = buckets.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = buckets.join(before, "_b").withColumn("_i", F.col("_before") + F.row_number().over(W.partitionBy("_b").orderBy("first_pos", *ROW_KEY)) - 1)
    placed = placed.withColumn("_slack", now - F.col("_i"))
    tops = placed.groupBy("_b").agg(F.max("_slack").alias("_top"))
    carried = tops.select("_b", F.max("_top").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    inside = F.max("_slack").over(W.partitionBy("_b").orderBy("_i").rowsBetween(W.unboundedPreceding, 0))
    out = placed.join(carried, "_b").withColumn("first_seen_at", F.greatest(inside, "_carried") + F.col("_i"))
    return out.drop("_b", "_before", "_i", "_slack", "_carried")


def transactions(ops: DataFrame) -> DataFrame:
    """A scope's transactions with their place, by first appearance, and sizes."""
    return ops.groupBy("scope_id", "txn_id").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_ops"), F.count_if(F.col("kind") == "set").alias("n_sets"))


def deduplicate(ops: DataFrame) -> DataFrame:
    """Drops redelivered ops; the first to arrive stays."""
    key = [*FIELD_KEY, "kind", "hlc", "txn_id"]
    return ops.groupBy(*key).agg(F.min_by(F.struct("pos", "value"), F.col("pos")).alias("o")).select("o.pos", *key, "o.value")


def check_ops(ops: DataFrame, scope: Column, now_ms: Column) -> DataFrame:
    """Checks that need no state, in the relay's order: ``reason`` is null where an op passes."""
    base_ok = ~F.col("field").isin(*BASE_FIELDS) | F.col("field").isNull()
    reason = (
        F.when(F.col("scope_id") != scope, "scope_mismatch")
        .when(~hlc.is_stamp(F.col("hlc")) | ~F.col("kind").isin(*KINDS) | F.col("kind").isNull() | ((F.col("kind") == "set") & F.col("field").isNull()), "malformed_op")
        .when(hlc.wall(F.col("hlc")) > now_ms + SKEW_MS, "clock_skew")
        .when(~base_ok, "base_field_violation")
    )
    return ops.withColumn("reason", reason)


def opening_writes(ops: DataFrame) -> DataFrame:
    """Writes of a transaction to the rows that it creates itself."""
    made = ops.where(F.col("kind").isin("create", "append")).select(*ROW_KEY, "txn_id").distinct()
    return ops.where("kind = 'set'").join(made, [*ROW_KEY, "txn_id"], "left_semi")


@dataclass
class Scope:
    """One scope's state on the relay, folded transaction by transaction."""

    scope_id: str
    seq: int = 0
    last_seen: int = 0
    fields: dict[tuple, dict] = field(default_factory=dict)
    rows: dict[tuple, dict] = field(default_factory=dict)
    named: dict[tuple, list[str]] = field(default_factory=dict)  # each row's fields, in order of their first write

    def forget(self, key: tuple) -> None:
        """Drops a row with its fields."""
        del self.rows[key]
        for name in self.named.pop(key, ()):
            del self.fields[*key, name]

    def _next(self) -> int:
        self.seq += 1
        return self.seq

    def refuse(self, ops: list[dict], now: int, skew: int = SKEW_MS) -> tuple[str, dict, object] | None:
        """The first rule that a transaction breaks: reason, op and the relay's value."""
        opened = {(o["table_name"], o["row_id"]) for o in ops if o["kind"] in ("create", "append")}
        pending: dict[tuple, object] = {}
        for o in ops:
            key = (o["table_name"], o["row_id"])
            row = self.rows.get(key)
            if o["scope_id"] != self.scope_id:
                return "scope_mismatch", o, None
            try:
                stamp = hlc.Stamp.parse(o["hlc"])
            except (ValueError, TypeError):
                return "malformed_op", o, None
            if o["kind"] not in KINDS or (o["kind"] == "set" and not o["field"]) or o.get("base_hash") == "":
                return "malformed_op", o, None
            if stamp.wall_ms > now + skew:
                return "clock_skew", o, now
            creates = o["kind"] in ("create", "append")
            if creates and row:
                return "row_exists", o, None
            if not creates and not row and key not in opened:
                return "row_absent", o, None
            value = json.loads(o["value_json"]) if o["kind"] == "set" and o["value_json"] is not None else None
            if o["kind"] == "set" and o["field"] in BASE_FIELDS:
                identity = {"id": o["row_id"], "scope_id": self.scope_id}
                if row or value != identity.get(o["field"], value):
                    return "base_field_violation", o, None
            if row and row["class"] == "append" and key not in opened:
                return "append_class_violation", o, None
            if o["kind"] == "set":
                at = (*key, o["field"])
                if o.get("base_hash"):
                    held = pending[at] if at in pending else json.loads(self.fields[at]["value_json"] or "null") if at in self.fields else None
                    if wire_hash(held) != o["base_hash"]:
                        return "merge_required", o, held
                pending[at] = value
        return None

    def apply(self, ops: list[dict], now: int) -> list[dict]:
        """Applies a transaction: row ops first, then writes. Returns the records that beat its losing writes."""
        beaten: list[dict] = []
        for o in sorted(ops, key=lambda o: o["kind"] == "set"):
            key = (o["table_name"], o["row_id"])
            if key not in self.rows:
                self.last_seen = max(now, self.last_seen + 1)
                self.rows[key] = {"first_seen_at": self.last_seen, "first_pos": o.get("pos"), "class": "append" if o["kind"] == "append" else "row", "deleted_hlc": None, "register_hlc": None, "server_seq": self._next()}
            row = self.rows[key]
            if o["kind"] == "set":
                at = (*key, o["field"])
                held = self.fields.get(at)
                if held and o.get("base_hash") is None and o["hlc"] <= held["hlc"]:
                    beaten.append(dict(held, table_name=key[0], row_id=key[1], field=o["field"]))
                else:
                    if held is None:
                        self.named.setdefault(key, []).append(o["field"])
                    self.fields[at] = {"value_json": o["value_json"], "hlc": o["hlc"], "txn_id": o["txn_id"], "server_seq": self._next()}
            elif o["kind"] in ("delete", "restore") and o["hlc"] > (row["register_hlc"] or ""):
                row.update(register_hlc=o["hlc"], deleted_hlc=o["hlc"] if o["kind"] == "delete" else None, server_seq=self._next())
                if o["kind"] == "restore":
                    for name in self.named.get(key, ()):
                        self.fields[*key, name]["server_seq"] = self._next()
        return beaten

    def push(self, ops: list[dict], now: int, skew: int = SKEW_MS) -> list[dict]:
        """Transactions in order of first appearance, until one is refused; one outcome each."""
        groups: dict[str, list[dict]] = {}
        for o in ops:
            groups.setdefault(o["txn_id"], []).append(o)
        out = []
        for txn, group in groups.items():
            if why := self.refuse(group, now, skew):
                out.append({"txn_id": txn, "ok": False, "reason": why[0], "row_id": why[1]["row_id"], "n_beaten": 0})
                break
            out.append({"txn_id": txn, "ok": True, "reason": None, "row_id": None, "n_beaten": len(self.apply(group, now))})
        return out


STATE = "scope_id string, record string, table_name string, row_id string, field string, value_json string, hlc string, txn_id string, first_seen_at long, class string, deleted_hlc string, register_hlc string, server_seq long"
OUTCOMES = "scope_id string, batch_id long, txn_id string, ok boolean, reason string, row_id string, n_beaten long"
#: Records that one Arrow batch of a fold's result holds.
BATCH_ROWS = 4096


def frame(rows: list[dict], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)


def batches_of(rows: Iterator[dict]) -> Iterator[tuple[int, list[dict]]]:
    """Pushes of one scope, whose ops come in order."""
    for batch, group in itertools.groupby(rows, key=lambda r: r["batch_id"]):
        yield int(batch), list(group)


def _by_scope(ops: DataFrame, schema: str, one: Callable[[Scope, Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """Streams each scope's ops in order of arrival through ``one``; holds a scope's state and one push, not its log."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(T._parse_datatype_string(schema))
    columns = ["scope_id", "batch_id", "pos", "table_name", "row_id", "kind", "field", "value_json", "hlc", "txn_id", "base_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        made = (r for scope, group in itertools.groupby(rows, key=lambda r: r["scope_id"]) for r in one(Scope(scope), group))
        while part := list(itertools.islice(made, BATCH_ROWS)):
            yield pa.RecordBatch.from_pylist(part, schema=out_schema)

    # with what is equal last, so that any deal of the rows gives one order
    ordered = ops.select(*columns).repartition("scope_id").sortWithinPartitions("scope_id", "batch_id", "pos")
    return ordered.mapInArrow(run, schema)


def fold(ops: DataFrame, now_ms: int, skew_ms: int = SKEW_MS) -> DataFrame:
    """The relay's records after all pushes (``batch_id``), with certified writes and refusals.

    A scope is the unit of order, as on the relay; scopes fold in parallel, each streamed in order of (batch_id, pos).
    ``first_seen_at`` comes from one counter of the relay, in order of ``pos``. Ops of a null scope fold as one scope.
    An empty log gives an empty result. Use ``latest_fields`` where no op carries a base hash and none can be refused.
    """

    def one(scope: Scope, rows: Iterator[dict]) -> Iterator[dict]:
        for _, group in batches_of(rows):
            scope.push(group, now_ms, skew_ms)
        for (t, r, f), v in scope.fields.items():
            yield {"scope_id": scope.scope_id, "record": "field", "table_name": t, "row_id": r, "field": f, **v}
        for (t, r), v in scope.rows.items():
            yield {"scope_id": scope.scope_id, "record": "row", "table_name": t, "row_id": r, **v}

    folded = _by_scope(ops, STATE + ", first_pos long", one)
    rows = with_first_seen(folded.where("record = 'row'").drop("first_seen_at"), F.lit(now_ms).cast("long"))
    return folded.where("record = 'field'").drop("first_pos").unionByName(rows.drop("first_pos"))


def outcomes(ops: DataFrame, now_ms: int, skew_ms: int = SKEW_MS) -> DataFrame:
    """What each push answered, transaction by transaction; those after a refusal are not in it."""

    def one(scope: Scope, rows: Iterator[dict]) -> Iterator[dict]:
        for batch, group in batches_of(rows):
            for o in scope.push(group, now_ms, skew_ms):
                yield {"scope_id": scope.scope_id, "batch_id": batch, **o}

    return _by_scope(ops, OUTCOMES, one)


def emit_stamps(events: DataFrame, device: str, time_ms: str, order: str) -> DataFrame:
    """Stamps that each device's clock emits for its events in order; adds ``stamp``."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        times = iter(pdf[time_ms])
        clock = hlc.Clock(str(pdf[device].iloc[0]), lambda: int(next(times)))
        return pdf.astype(object).assign(stamp=pd.Series([clock.next() for _ in range(len(pdf))], pdf.index, dtype=object))

    return events.groupBy(device).applyInPandas(one, T.StructType([*events.schema.fields]).add("stamp", "string"))
