"""Folding, syncing and converging: invariants over random histories."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from semilattice.functions.wire import canonical, wire_hash
from semilattice.operators import resolve
from semilattice.operators.device import Device, Relay
from semilattice.plans.schema import Collection, Field, Relation, Schema, SchemaError, lint_evolution
from semilattice.sources import snapshot
from semilattice.sources.store import Store
from semilattice.streaming import relay as streaming

SCHEMA = Schema(
    (
        Collection("tasks", (Field("title"), Field("notes", merge="diff3"), Field("rank", merge="fracIndex"), Field("done", "boolean"))),
        Collection("history", (Field("task_id"), Field("status")), kind="eventLog"),
    )
)
COLUMNS = ["scope_id", "table_name", "row_id", "kind", "field", "value_json", "hlc", "txn_id", "base_hash"]


class World:
    def __init__(self, seed, devices=3):
        self.rng, self.time = random.Random(seed), 1_700_000_000_000
        self.relay = Relay(lambda: self.time)
        self.devices = [Device(f"d{i}", "s", SCHEMA, lambda i=i: self.time + i * 1000) for i in range(devices)]
        self.log = []
        push = self.relay.push
        self.relay.push = lambda scope, ops: (self.log.append([dict(o) for o in ops]), push(scope, ops))[1]

    def step(self):
        r, d = self.rng, self.rng.choice(self.devices)
        self.time += r.randint(0, 5000)
        row = f"row-{r.randint(0, 3)}"
        try:
            match r.choice(["create", "update", "update", "notes", "delete", "restore", "append", "sync", "sync"]):
                case "create":
                    d.create("tasks", row, {"title": "t", "notes": "alpha\nbravo\ncharlie", "done": False})
                case "update":
                    d.update("tasks", row, {"title": f"t{r.randint(0, 99)}"})
                case "notes":
                    lines = str(d.rows.get(("tasks", row)).fields.get("notes", "")).split("\n") if ("tasks", row) in d.rows else [""]
                    lines[r.randrange(len(lines))] = f"edit {r.randint(0, 99)}"
                    d.update("tasks", row, {"notes": "\n".join(lines)})
                case "delete":
                    if ("tasks", row) in d.rows:
                        d.delete("tasks", row)
                case "restore":
                    if ("tasks", row) in d.tombstones:
                        d.restore("tasks", row, d.tombstones["tasks", row]["fields"])
                case "append":
                    d.create("history", f"h{r.randint(0, 10**9)}", {"task_id": row, "status": "x"})
                case "sync":
                    d.sync(self.relay)
        except SchemaError:
            pass

    def settle(self):
        for _ in range(3):
            for d in self.devices:
                d.sync(self.relay)


def view(d):
    return {k: {n: v for n, v in r.fields.items()} for k, r in d.rows.items()}


@pytest.mark.parametrize("seed", range(40))
def test_devices_converge(seed):
    w = World(seed)
    for _ in range(60):
        w.step()
    w.settle()
    for d in w.devices:
        assert not d.outbox
        assert not set(d.rows) & set(d.tombstones)
    scope = w.relay.scope("s")
    live = {k for k, v in scope.rows.items() if not v["deleted_hlc"]}
    for d in w.devices:
        refused = {(o["table_name"], o["row_id"], o["field"]) for o in d.quarantined}
        made = {(t, r) for t, r, _ in refused}
        assert set(d.rows) - made == live - made
        for (t, r, f), v in scope.fields.items():
            if (t, r) in d.rows and (t, r, f) not in refused:
                assert d.rows[t, r].fields[f] == json.loads(v["value_json"]), (t, r, f)
    fresh = Device("new", "s", SCHEMA, lambda: w.time)
    fresh.sync(w.relay)
    assert set(fresh.rows) == live


def test_an_append_row_never_changes():
    w = World(1, 2)
    a, b = w.devices
    a.create("history", "h", {"task_id": "x", "status": "new"})
    a.sync(w.relay)
    with pytest.raises(SchemaError):
        a.update("history", "h", {"status": "y"})
    op = dict(w.log[0][0], kind="set", field="status", value_json='"y"', hlc=b.clock.next(), txn_id="z", base_hash=None)
    assert w.relay.push("s", [op])["reason"] == "append_class_violation"


def test_rejections_stop_a_push_and_keep_what_came_before():
    now = 1_700_000_000_000
    scope, n = resolve.Scope("s"), [0]

    def op(kind, row, txn, **kw):
        n[0] += 1
        return {"scope_id": "s", "table_name": "t", "row_id": row, "kind": kind, "field": None, "value_json": None, "hlc": f"{'0' * 8}{'1' * 7}-{n[0]:06}-d", "txn_id": txn, "base_hash": None} | kw

    got = scope.push([op("create", "a", "1"), op("set", "a", "1", field="id", value_json='"a"'), op("set", "b", "2", field="x", value_json="1"), op("create", "c", "3")], now)
    assert [(o["txn_id"], o["ok"], o["reason"]) for o in got] == [("1", True, None), ("2", False, "row_absent")]
    assert set(scope.rows) == {("t", "a")} and scope.seq == 2
    cases = [
        (op("create", "a", "4"), "row_exists"),
        (op("set", "a", "4", field="id", value_json='"a"'), "base_field_violation"),
        (op("set", "a", "4", field="x", value_json="1", base_hash=wire_hash(5)), "merge_required"),
        (op("set", "a", "4", field="x", value_json="1", base_hash=""), "malformed_op"),
        (op("set", "a", "4", field="x", value_json="1", hlc="bad"), "malformed_op"),
        (op("odd", "a", "4"), "malformed_op"),
        (op("set", "a", "4", value_json="1"), "malformed_op"),
        (op("set", "a", "4", field="x", value_json="1", scope_id="other"), "scope_mismatch"),
        (op("set", "a", "4", field="x", value_json="1", hlc="00000zzzzzzzzzz-000000-d"), "clock_skew"),
    ]
    for o, reason in cases:
        assert [x["reason"] for x in scope.push([o], now)] == [reason]
    certified = op("set", "a", "5", field="x", value_json="2", base_hash=wire_hash(None), hlc="0" * 15 + "-000000-d")
    assert scope.push([certified], now)[0]["ok"] and scope.fields["t", "a", "x"]["value_json"] == "2"
    seq = scope.seq
    scope.push([op("delete", "a", "6")], now)
    scope.push([op("restore", "a", "7")], now)
    assert scope.seq == seq + 2 + 2 and scope.fields["t", "a", "x"]["server_seq"] > scope.rows["t", "a"]["server_seq"]


def ops_frame(spark, log):
    rows = [tuple(o[c] for c in COLUMNS) + (b, i) for b, ops in enumerate(log) for i, o in enumerate(ops)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS) + ", batch_id long, pos long")


def test_the_fold_gives_the_relays_records_in_batch_and_stream(spark, tmp_path):
    w = World(7)
    for _ in range(150):
        w.step()
    w.settle()
    now = w.time + 10**6
    # the in-process relay's clock moved; refusals for skew do not occur in either
    df = ops_frame(spark, w.log)
    got = {(r.table_name, r.row_id, r.field): (r.value_json, r.hlc) for r in resolve.fold(df, now).where("record = 'field'").collect()}
    assert got == {k: (v["value_json"], v["hlc"]) for k, v in w.relay.scope("s").fields.items()}
    outcomes = [tuple(r) for r in resolve.outcomes(df, now).orderBy("batch_id").collect()]
    df.repartition(1).write.parquet(str(tmp_path / "ops"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = []
    q = streaming.announce(streaming.relay(spark.readStream.schema(df.schema).parquet(str(tmp_path / "ops")), now), str(tmp_path / "ck"), lambda b, n: out.extend(tuple(r) for r in b.collect()))
    q.awaitTermination()
    assert sorted(out, key=str) == sorted(outcomes, key=str) and len(out) > 20


def test_order_and_redelivery_do_not_matter(spark):
    rng = random.Random(2)
    rows = [("s", "t", f"r{rng.randint(0, 3)}", "set", f"f{rng.randint(0, 2)}", float(i), f"{i:015}-000000-d", f"t{i}", i) for i in range(80)]
    cols = "scope_id string, table_name string, row_id string, kind string, field string, value double, hlc string, txn_id string, pos long"
    want = sorted(resolve.latest_fields(spark.createDataFrame(rows, cols), "value").drop("pos").collect())
    mixed = rows + rng.sample(rows, 30)
    rng.shuffle(mixed)
    assert sorted(resolve.latest_fields(spark.createDataFrame([r[:-1] + (i,) for i, r in enumerate(mixed)], cols), "value").drop("pos").collect()) == want


def test_equal_stamps_keep_the_first(spark):
    cols = "scope_id string, table_name string, row_id string, kind string, field string, value double, hlc string, txn_id string, pos long"
    rows = [("s", "t", "r", "set", "f", 1.0, "h", "a", 5), ("s", "t", "r", "set", "f", 2.0, "h", "b", 3)]
    assert resolve.latest_fields(spark.createDataFrame(rows, cols), "value").first().value == 2.0


def test_prune_leaves_devices_above_the_floor_alone_and_sends_others_back():
    w = World(3, 2)
    a, b = w.devices
    a.create("tasks", "x", {"title": "1"})
    a.create("tasks", "y", {"title": "2"})
    a.sync(w.relay)
    b.sync(w.relay)
    a.delete("tasks", "x")
    a.sync(w.relay)
    w.time += 40 * 86_400_000
    before = view(a)
    assert w.relay.prune("s") == 1
    a.sync(w.relay)
    assert view(a) == before
    b.sync(w.relay)
    assert set(b.rows) == {("tasks", "y")}
    b.create("tasks", "x", {"title": "again"})
    b.sync(w.relay)
    a.tombstones.clear()
    a.sync(w.relay)
    assert a.rows["tasks", "x"].fields["title"] == "again"


def test_another_epoch_forces_a_snapshot():
    w = World(4, 1)
    d = w.devices[0]
    d.create("tasks", "x", {"title": "1"})
    d.sync(w.relay)
    w.relay.epoch = "epoch-2"
    w.relay.scopes.clear()
    d.sync(w.relay)
    assert d.epoch == "epoch-2" and not d.rows


def test_schema_versions_at_the_handshake():
    w = World(5, 1)
    d = w.devices[0]
    d.sync(w.relay)
    newer = Device("n", "s", Schema(SCHEMA.collections, 2), lambda: w.time)
    newer.sync(w.relay)
    with pytest.raises(SchemaError):
        d.sync(w.relay)


def test_snapshot_ndjson_round_trip(spark, tmp_path):
    scope = spark.createDataFrame([("s", 9, 2, None, 1, "e")], "scope_id string, server_seq long, tombstone_floor_seq long, schema_hash string, schema_version int, epoch string")
    values = [canonical(v) for v in ('a"\n\\é', 1.5, True, None, {"k": [1, "x"]})]
    fields = spark.createDataFrame([("s", "t", f"r{i}", "f", v, "h", i, "x") for i, v in enumerate(values)], "scope_id string, table_name string, row_id string, field string, value_json string, hlc string, server_seq long, txn_id string")
    rows = spark.createDataFrame([("s", "t", "r0", 5, "row", None, None, 1), ("s", "t", "r1", 5, "row", "h", "h", 2)], "scope_id string, table_name string, row_id string, first_seen_at long, class string, deleted_hlc string, register_hlc string, server_seq long")
    lines = snapshot.to_ndjson(scope, fields, rows)
    path = str(tmp_path / "snap")
    snapshot.write_ndjson(lines, path)
    assert [json.loads(r.line)["type"] for r in lines.collect()] == ["header"] + ["field"] * 5 + ["row"] * 2
    want = snapshot.digest(snapshot.body_lines(scope, fields, rows)).first().digest
    assert want == hashlib.sha256("".join(r.line + "\n" for r in lines.collect()).encode()).hexdigest()
    snapshot.verify(spark, path, want)
    s, f, r = snapshot.from_ndjson(spark, path)
    assert sorted(f.collect()) == sorted(fields.select(*f.columns).collect())
    assert sorted(r.collect(), key=str) == sorted(rows.select(*r.columns).collect(), key=str)
    assert s.first().server_seq == 9
    with pytest.raises(snapshot.SnapshotError):
        snapshot.verify(spark, path, "0" * 64)
    spark.createDataFrame([('{"type":"odd"}',)], "value string").write.text(str(tmp_path / "bad"))
    with pytest.raises(snapshot.SnapshotError):
        snapshot.from_ndjson(spark, str(tmp_path / "bad"))


def test_store_commits_whole_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    assert store.table("rows").count() == 0
    rec = lambda s, seq: (s, "t", "r", "f", "1", "h", seq, "x")
    fields = spark.createDataFrame([rec("s", 1), rec("o'x", 2)], store.table("fields").schema)
    store.commit(fields=fields)
    store.commit(fields=store.upsert("fields", spark.createDataFrame([rec("s", 7)], fields.schema), resolve.FIELD_KEY))
    assert {(r.scope_id, r.server_seq) for r in store.table("fields").collect()} == {("s", 7), ("o'x", 2)}
    assert [r.server_seq for r in store.scope("o'x")["fields"].collect()] == [2]
    with pytest.raises(Exception):  # noqa: B017
        store.commit(fields=fields.withColumn("server_seq", F.raise_error(F.lit("no")).cast("long")))
    assert store.table("fields").count() == 2
    before = store._pointer()
    store.commit_scopes(["s"], fields=spark.createDataFrame([rec("s", 8), rec("o'x", 99)], fields.schema))
    assert {(r.scope_id, r.server_seq) for r in store.table("fields").collect()} == {("s", 8), ("o'x", 2)}
    after = store._pointer()
    assert len([k for k in after if after[k] != before.get(k)]) == 1  # one bucket was written
    store.commit_scopes(["s"], fields=fields.limit(0))
    assert [r.scope_id for r in store.table("fields").collect()] == ["o'x"]


def test_schema_rules(tmp_path):
    a = Collection("a", (Field("x"), Field("k", "enum", values=("p", "q"))), relations=(Relation("b", "hasMany", "b", "id", "a_id"),))
    b = Collection("b", (Field("a_id", index=True),))
    s = Schema((a, b))
    assert s.hash == Schema((a, Collection("b", (Field("a_id"),)))).hash != Schema((a, b), 2).hash
    for bad in ([Collection("A", ()), Collection("a", ())], [Collection("_sync_x", ())], [Collection("outbox", ())], [Collection("a", (Field("ID"),))], [Collection("a", (Field("x", "enum"),))], [Collection("a", (Field("x", "number", "diff3"),))], [Collection("a", (), relations=(Relation("r", "hasOne", "zz", "id", "id"),))]):
        with pytest.raises(SchemaError):
            Schema(tuple(bad))
    newer = Schema((Collection("a", (Field("x", "number"), Field("k", "enum", values=("p",)))),), 1)
    assert lint_evolution(s, newer) == [("type_changed", "a.k"), ("type_changed", "a.x"), ("collection_removed", "b")]
    from semilattice.__main__ import main

    path = tmp_path / "s.json"
    path.write_text(json.dumps({"version": 3, "collections": [{"name": "a", "fields": [{"name": "x"}]}]}))
    assert main(["hash", str(path)]) == 0 and main(["doctor", str(path)]) == 0 and main(["ddl", str(path)]) == 0
    path.write_text(json.dumps({"collections": [{"name": "a", "fields": [{"name": "x", "odd": 1}]}]}))
    assert main(["doctor", str(path)]) == 2
