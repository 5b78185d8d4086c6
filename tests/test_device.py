"""Refused work and lives of rows, what is saved and loaded, sessions, facades and tokens."""

import base64
import hashlib
import hmac
import json
import random

import pytest

from semilattice.functions import merge, wire
from semilattice.operators import query
from semilattice.operators.device import Device, Relay
from semilattice.operators.facade import CollectionFacade
from semilattice.operators.session import Backoff, Daily, EditorBuffer, Identity, Session, TokenError, TokenVerifier
from semilattice.plans.schema import SchemaError
from semilattice.sources.store import DeviceStore
from tests.test_relay import SCHEMA, World, view

DAY = 86_400_000


def pair():
    time = [1_700_000_000_000]
    relay = Relay(lambda: time[0])
    return time, relay, *(Device(f"d{i}", "s", SCHEMA, lambda: time[0]) for i in range(2))


def refused(time, relay, a, b, new_value="mine"):
    """a's edit of a row that b has deleted: refused and set aside with the life it was made to."""
    a.create("tasks", "x", {"title": "first", "notes": "n"})
    a.sync(relay)
    b.sync(relay)
    b.delete("tasks", "x")
    b.sync(relay)
    a.update("tasks", "x", {"title": new_value}, "edit")
    a.apply_pull(relay.pull("s", a.cursor))  # it hears of the delete before it has sent the edit
    assert [(o["txn_id"], o["reason"]) for o in a.quarantined] == [("edit", "row_absent")] and ("tasks", "x") not in a.rows


def test_a_refused_write_speaks_for_one_life_of_a_row():
    time, relay, a, b = pair()
    refused(time, relay, a, b)
    life = a.quarantined[0]["row_identity"]
    time[0] += 40 * DAY
    relay.prune("s")
    b.sync(relay)
    b.tombstones.clear()
    b.create("tasks", "x", {"title": "second"})
    b.sync(relay)
    a.sync(relay)
    assert a.rows["tasks", "x"].first_seen_at != life
    assert a.rows["tasks", "x"].fields["title"] == "second"  # not the refused value of another life
    left = a.retry("edit")
    assert [o["field"] for o in left] == ["title"] and not a.outbox and len(a.quarantined) == 1
    assert a.export("edit") == a.quarantine_list()
    a.sync(relay)
    assert relay.scope("s").fields["tasks", "x", "title"]["value_json"] == '"second"'


def test_a_refused_write_stays_on_top_in_its_own_life_and_can_be_sent_again():
    time, relay, a, b = pair()
    refused(time, relay, a, b)
    b.restore("tasks", "x", {"title": "back"})
    b.sync(relay)
    a.sync(relay)
    assert a.rows["tasks", "x"].fields["title"] == "mine" and a.is_dirty("tasks", "x")
    assert a.retry("edit") == [] and not a.quarantined
    time[0] += 1000
    a.update("tasks", "x", {"title": "newer"})
    a.sync(relay)
    b.sync(relay)
    assert b.rows["tasks", "x"].fields["title"] == "newer" and not a.outbox


def test_retry_drops_what_was_written_over_and_discard_takes_made_rows():
    time, relay, a, b = pair()
    refused(time, relay, a, b)
    b.restore("tasks", "x", {"title": "back"})
    b.sync(relay)
    a.sync(relay)
    time[0] += 1000
    a.update("tasks", "x", {"title": "later"}, "later")
    assert a.retry("edit") == [] and [o["txn_id"] for o in a.outbox] == ["later"]
    a.create("tasks", "y", {"title": "t"}, "made")
    a._quarantine(lambda o: o["txn_id"] == "made", "row_exists")
    a.discard("made")
    assert ("tasks", "y") not in a.rows and a.resync and not a.quarantined
    a.discard("unknown")


def test_a_queued_restore_gives_way_to_a_delete():
    time, relay, a, b = pair()
    a.create("tasks", "x", {"title": "t"})
    a.sync(relay)
    b.sync(relay)
    a.delete("tasks", "x")
    a.sync(relay)
    b.update("tasks", "x", {"title": "u"})
    b.sync(relay)
    b.restore("tasks", "x", {"title": "again"}, "undo")
    a.restore("tasks", "x", {"title": "t"})
    a.delete("tasks", "x")
    a.sync(relay)
    b.apply_pull(relay.pull("s", b.cursor))
    assert ("tasks", "x") not in b.rows and {o["reason"] for o in b.quarantined} == {"row_absent"}


@pytest.mark.parametrize("seed", [3, 11])
def test_saved_devices_go_on_as_if_never_stopped(spark, tmp_path, seed):
    w = World(seed, 2)
    for i in range(40):
        w.step()
        if i % 13 == 12:
            for d in w.devices:
                DeviceStore(spark, f"{tmp_path}/{d.device_id}").save(d)
                assert not d.touched
    for i, d in enumerate(w.devices):
        store = DeviceStore(spark, f"{tmp_path}/{d.device_id}")
        store.save(d)
        again = Device(d.device_id, "s", SCHEMA, d.now)
        assert store.hydrate(again)
        assert view(again) == view(d) and again.outbox == d.outbox and again.quarantined == d.quarantined
        assert {k: (r.bases, r.stamps, r.first_seen_at) for k, r in again.rows.items()} == {k: (r.bases, r.stamps, r.first_seen_at) for k, r in d.rows.items()}
        assert (again.cursor, again.epoch, again.resync, again.tombstones.keys()) == (d.cursor, d.epoch, d.resync, d.tombstones.keys())
        assert again.clock.next() > d.clock.highest()
        assert store.tombstones("s").count() == len(d.tombstones)
        w.devices[i] = again
    w.settle()
    assert view(w.devices[0]).keys() == view(w.devices[1]).keys()
    assert not DeviceStore(spark, f"{tmp_path}/none").hydrate(Device("z", "s", SCHEMA, lambda: 0))


def test_facade_rules_and_moves():
    time, relay, a, _ = pair()
    tasks, history = CollectionFacade(a, "tasks"), CollectionFacade(a, "history")
    for r in "abcd":
        tasks.create(r, {"title": r, "rank": tasks.next_rank("rank"), "done": ...})
        time[0] += 10
    order = lambda: [r for _, r in sorted((v["rank"], r) for r, v in tasks.rows().items())]
    assert order() == list("abcd") and "done" not in tasks.rows()["a"]
    assert tasks.move("c", "rank", -1) and order() == list("acbd")
    assert tasks.move("a", "rank", 1) and order() == list("cabd")
    assert tasks.move("d", "rank", -1) and tasks.move("d", "rank", -1) and tasks.move("d", "rank", -1) and order() == list("dcab")
    assert not tasks.move("d", "rank", -1) and not tasks.move("zz", "rank", 1)
    history.create("h", {"status": None})
    for bad in (lambda: tasks.create("e", {"id": "q"}), lambda: history.update("h", {}), lambda: history.delete("h"), lambda: tasks.update("a", {"scope_id": "q"})):
        with pytest.raises(SchemaError):
            bad()


def test_session_debounces_polls_backs_off_and_coalesces():
    runs, fail = [], [False]

    def sync():
        runs.append(1)
        if fail[0]:
            raise OSError("down")
        if len(runs) == 3:
            session.announced(0)
            session.announced(0)

    session = Session(sync)
    assert session.tick(0) and not session.tick(2999) and session.tick(3000)
    session.wrote(4000)
    session.wrote(4100)
    assert not session.tick(4200) and session.tick(4250) and len(runs) == 4  # one more for both announcements
    fail[0] = True
    now, waits = 10_000, []
    for _ in range(9):
        assert session.tick(now)
        waits.append(session._due - now)
        now = session._due
    assert waits == [500, 1000, 2000, 4000, 8000, 16_000, 30_000, 30_000, 30_000] and isinstance(session.error, OSError)
    fail[0] = False
    session.live = True
    assert session.tick(now) and session.error is None and session._due - now == 60_000
    assert [Backoff(tries=n).next() for n in (0, 70)] == [500, 30_000]
    done = []
    daily = Daily(lambda: done.append(1), 100)
    assert [daily.tick(t) for t in (0, 99, 100, 150, 500)] == [False, False, True, False, True] and len(done) == 2
    e = EditorBuffer("a")
    e.remote("b")
    e.focus()
    e.remote("c")
    e.type("mine")
    assert e.text == "mine" and e.blur(lambda own, held: f"{own}+{held}") == "mine+c"


def token(claims, secret=b"k", alg="HS256", head=None):
    enc = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    body = enc(json.dumps(head or {"alg": alg}).encode()) + "." + enc(json.dumps(claims).encode())
    return body + "." + enc(hmac.new(secret, body.encode(), getattr(hashlib, f"sha{alg[2:]}")).digest())


def test_tokens():
    v = TokenVerifier({"t": Identity("s", "d")}, b"k", issuer="i", audience="a")
    good = {"scope_id": "s", "device_id": "d", "iss": "i", "aud": ["a", "b"], "exp": 1000, "nbf": 500}
    assert v.verify("t", 0) == v.verify(token(good), 800) == v.verify(token(good), 1059) == v.verify(token(good), 440) == Identity("s", "d")
    bad = [(token(good), 1060), (token(good), 439), (token(good, b"other"), 800), (token(good, alg="HS512"), 800), (token(good, head={"alg": "none"}), 800), ("x", 0), ("a.b.c", 0), (token(good | {"iss": "j"}), 800), (token(good | {"aud": "z"}), 800), (token(good | {"exp": "soon"}), 800), (token({**good, "device_id": ""}), 800)]
    for t, now in bad:
        with pytest.raises(TokenError):
            v.verify(t, now)
    with pytest.raises(TokenError):
        TokenVerifier().verify("t", 0)


def test_stored_values_read_back():
    for value, kind in [("x", "string"), (1.5, "number"), (3, "number"), (True, "boolean"), ({"a": [1]}, "json"), ("text", "json"), (5, "string"), ("five", "number"), ("yes", "boolean"), (None, "number"), ([1, None], "json")]:
        stored = wire.store_value(value, kind)
        assert stored is None or isinstance(stored, (str, int, float))
        if kind != "string" or isinstance(value, str):
            assert wire.read_value(stored, kind) == value
    with pytest.raises(ValueError):
        wire.store_value(float("nan"), "number")
    assert wire.present({"a": 1, "b": ..., "c": None}) == {"a": 1, "c": None}


def test_values_encode_and_decode(spark):
    df = spark.createDataFrame([("é\"\\\u001f", 1e21, True), ("", 0.000001, False), (None, None, None), ("a", -0.1, True), ("b", 1e-7, True)], "s string, n double, b boolean")
    got = df.select("s", "n", "b", *(wire.encode_value(df[c], k).alias(f"{c}_json") for c, k in (("s", "string"), ("n", "number"), ("b", "boolean"))))
    for r in got.collect():
        assert (r.s_json, r.n_json, r.b_json) == (wire.canonical(r.s), "null" if r.n is None else wire.canonical(r.n), wire.canonical(r.b))
    back = got.select("s", "n", "b", *(wire.decode_field(got[f"{c}_json"], k, True).alias(f"{c}2") for c, k in (("s", "string"), ("n", "number"), ("b", "boolean"))))
    assert all((r.s, r.n, r.b) == (r.s2, r.n2, r.b2) for r in back.collect())


def test_number_text_equals_python_for_all_magnitudes(spark):
    rng = random.Random(1)
    xs = [rng.uniform(-1, 1) * 10 ** rng.randint(-30, 30) for _ in range(2000)] + [0.0, -0.0, 1.0, 12345678.5, 0.00012, 1e21, 1e-7, 5e-324, 1.7976931348623157e308, 123456789012345680000.0]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    off = 0
    for r in df.select("x", wire.number_json(df.x).alias("t")).collect():
        want = "null" if r.x is None else wire.number_text(r.x)
        if r.t != want:  # another shortest text of the same number
            assert float(r.t) == r.x
            off += 1
    assert off < 10
    for x in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="finite"):
            spark.createDataFrame([(x,)], "x double").select(wire.number_json(df.x)).collect()


def test_scope_guard_and_order_keys(spark, tmp_path):
    spark.range(10).selectExpr("cast(id % 3 as string) as scope_id", "id", "id % 2 as k", "cast(id % 3 as string) as other_scope_id").write.parquet(f"{tmp_path}/g")
    spark.read.parquet(f"{tmp_path}/g").createOrReplaceTempView("guarded")
    for good in ("SELECT id FROM guarded WHERE scope_id = '1'", "SELECT a.id FROM guarded a JOIN guarded b ON a.scope_id = b.scope_id AND a.id = b.id WHERE a.scope_id = '1' AND a.id > 2", "SELECT 1"):
        query.assert_scoped(spark, good)
    for bad in ("SELECT id FROM guarded", "SELECT id FROM guarded WHERE scope_id IS NOT NULL", "SELECT id FROM guarded WHERE scope_id <> '1'", "SELECT id FROM guarded WHERE scope_id = '1' OR id = 2", "SELECT id FROM guarded WHERE other_scope_id = '1'", "SELECT a.id FROM guarded a JOIN guarded b ON a.id = b.id WHERE a.scope_id = '1'"):
        with pytest.raises(ValueError):
            query.assert_scoped(spark, bad)
    q = query.Scoped(spark.table("guarded"), "1").order_by("k", "desc").where("id", ">", 0).order_by("id")
    assert [r.id for r in q.select("id").collect()] == [1, 7, 4]


def test_subscriptions_run_once_and_tell_differences(spark):
    runs, version = [], [0]

    def run(key):
        runs.append(key)
        return spark.createDataFrame([(1, version[0] // 2), (2, 0)], "id long, rev long")

    heard = []
    subs = query.Subscriptions(run, keep=lambda df: spark.createDataFrame(df.collect(), df.schema))
    stop, _ = subs.watch("q"), subs.watch("q")
    subs.listen(heard.append)
    first = subs.query_snapshot("q")
    assert first.changes is None and subs.query_snapshot("q") is first and runs == ["q"]
    version[0] = 1
    subs.changed()
    second = subs.query_snapshot("q")
    assert second.same and second.rows is first.rows and heard == [1]
    version[0] = 2
    subs.changed()
    third = subs.query_snapshot("q")
    assert [tuple(r) for r in third.changes.collect()] == [(1, "changed")] and subs.snapshot("q") is third.rows and len(runs) == 3
    stop()
    assert "q" in subs._watched


def test_equal_ranks_and_ends():
    a, b = "m:x", "m:y"
    assert a < merge.rank_between(a, b, "d") < b
    with pytest.raises(ValueError):
        merge.rank_between("m:x", "m:x!", "d")  # nothing printable lies between
    low = None
    for _ in range(200):
        new = merge.rank_between(low, None, "d")
        assert low is None or new > low
        low = new
    assert len(low) < 60
