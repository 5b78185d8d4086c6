import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from semilattice.functions import hlc, merge, wire

stamps = st.builds(hlc.Stamp, st.integers(0, hlc.MAX_WALL), st.integers(0, hlc.MAX_COUNTER), st.text("abc-", min_size=1, max_size=4))


@given(stamps, stamps)
def test_stamps_sort_as_tuples(a, b):
    assert hlc.Stamp.parse(str(a)) == a
    assert (str(a) < str(b)) == (a < b)


@pytest.mark.parametrize("bad", ["", "x", "0" * 15 + "-" + "0" * 6 + "-", "0" * 14 + "-000000-d", "Z" * 15 + "-000000-d", "z" * 15 + "-000000-d"])
def test_bad_stamps(bad):
    with pytest.raises(ValueError):
        hlc.Stamp.parse(bad)


def test_columns_equal_python(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(hlc.MAX_WALL), rng.randrange(hlc.MAX_COUNTER), f"d-{i}") for i in range(50)] + [(-1, 0, "d"), (0, hlc.MAX_COUNTER + 1, "d"), (0, 0, ""), (hlc.MAX_WALL, hlc.MAX_COUNTER, "x")]
    df = spark.createDataFrame(rows, "w long, c long, d string").withColumn("s", hlc.encode(F.col("w"), F.col("c"), F.col("d")))
    for r in df.select("*", hlc.wall(F.col("s")).alias("w2"), hlc.counter(F.col("s")).alias("c2"), hlc.device(F.col("s")).alias("d2"), hlc.is_stamp(F.col("s")).alias("ok")).collect():
        if 0 <= r.w <= hlc.MAX_WALL and 0 <= r.c <= hlc.MAX_COUNTER and r.d:
            assert r.s == str(hlc.Stamp(r.w, r.c, r.d)) and (r.w2, r.c2, r.d2, r.ok) == (r.w, r.c, r.d, True)
        else:
            assert r.s is None and not r.ok


@settings(max_examples=200)
@given(st.lists(st.tuples(st.sampled_from("nao"), st.integers(0, 50)), max_size=40))
def test_clock_only_grows(steps):
    time, clock, last = 0, hlc.Clock("me", lambda: time), ""
    for kind, t in steps:
        time = t
        if kind == "n":
            new = clock.next()
            assert new > last and new > (clock.floor or "")
            last = new
        else:
            other = str(hlc.Stamp(t, 3, "other"))
            (clock.acknowledge if kind == "a" else clock.observe)(other)
            if kind == "o":
                last = str(clock.last)
        assert clock.highest() >= last
    assert clock.restamp(0) > (clock.floor or "")


def test_counter_carries():
    clock = hlc.Clock("d", lambda: 5)
    clock.last = hlc.Stamp(5, hlc.MAX_COUNTER, "d")
    assert hlc.Stamp.parse(clock.next()) == hlc.Stamp(6, 0, "d")


values = st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.floats(-(2.0**53), 2.0**53) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8)


@given(values)
def test_canonical_round_trips(v):
    text = wire.canonical(v)
    assert json.loads(text) == v and wire.canonical(json.loads(text)) == text
    assert wire.is_wire(v)


def test_canonical_order_and_refusals():
    assert wire.canonical({"b": 1, "a": [1.0, 1e21, -0.0], "\U0001f600": 1, "￿": 2}) == '{"a":[1,1e+21,0],"b":1,"\U0001f600":1,"￿":2}'
    for bad in (float("nan"), float("inf"), {1: 2}, object(), b"x"):
        assert not wire.is_wire(bad)


def test_names_and_scripts():
    assert wire.fold_name("AÉz") == "aÉz"
    assert wire.quote_name('a"b') == '"a""b"' and wire.sql_literal("it's") == "'it''s'" and wire.sql_literal(True) == "1" and wire.sql_literal(None) == "NULL"
    assert wire.split_sql("a 'x;''y'; b \"c;d\" ;; e") == ["a 'x;''y'", 'b "c;d"', "e"]
    assert wire.bind(True) == 1 and wire.bind("x") == "x"
    with pytest.raises(TypeError):
        wire.bind([1])
    with pytest.raises(ValueError):
        wire.sql_literal("a\0b")


def test_decoders(spark):
    rows = [('"a\\nb"',), ("1.5",), ("true",), ("null",), (None,), ('{"a":1}',), ("-3",), ('"open"',)]
    df = spark.createDataFrame(rows, "v string")
    v = F.col("v")
    got = df.select(wire.decode_field(v, "string").alias("s"), wire.decode_field(v, "number", True).alias("n"), wire.decode_field(v, "boolean").alias("b"), wire.decode_field(v, "enum", values=("new", "open")).alias("e"), wire.decode_field(v, "json", True).alias("j")).collect()
    assert [r.s for r in got] == ["a\nb", "", "", "", "", "", "", "open"]
    assert [r.n for r in got] == [None, 1.5, None, None, None, None, -3.0, None]
    assert [r.b for r in got] == [False, False, True] + [False] * 5
    assert [r.e for r in got] == ["new"] * 7 + ["open"]
    assert [r.j for r in got] == [r[0] for r in rows]


text = st.lists(st.sampled_from(["a", "b", "", "long line"]), min_size=1, max_size=4).map("\n".join)


@given(text, text, text)
def test_merge_laws(base, a, b):
    assert merge.merge_texts(base, a, a) == a and merge.merge_texts(base, base, b) == b and merge.merge_texts(base, a, base) == a


def test_merge_columns_equal_python(spark):
    rng = random.Random(4)
    some = lambda: "\n".join(rng.choice(["a", "b", "c", ""]) for _ in range(rng.choice([1, 2, 3, 3])))
    rows = [(some(), some(), some()) for _ in range(300)]
    out = spark.createDataFrame(rows, "b string, x string, y string").select("*", merge.merge3(F.col("b"), F.col("x"), F.col("y")).alias("m")).collect()
    assert all(r.m == merge.merge_texts(r.b, r.x, r.y) for r in out)
    assert merge.merge_texts("a\nb", "x\nb", "a\ny") == "x\ny"
    assert merge.merge_texts("a", "x", "y") == "<<<<<<< LOCAL\nx\n=======\ny\n>>>>>>> REMOTE"


@settings(max_examples=50)
@given(st.lists(st.tuples(st.floats(0, 1), st.sampled_from("abc")), max_size=60))
def test_ranks_always_fit_between(inserts):
    ranks = []
    for at, dev in inserts:
        k = int(at * len(ranks))
        low, high = ranks[k - 1] if k else None, ranks[k] if k < len(ranks) else None
        new = merge.rank_between(low, high, dev)
        assert (low is None or low < new) and (high is None or new < high)
        ranks.insert(k, new)
    assert ranks == sorted(ranks)


def test_rank_errors_and_shared_cores():
    assert merge.rank_between(None, None, "d") == "a:d"
    a, b = "a:x", "a:y"
    assert a < merge.rank_between(a, b, "d") < b
    for bad in (("b:d", "a:d"), ("a:d", "a:d")):
        with pytest.raises(ValueError):
            merge.rank_between(*bad, "d")
