import numpy as np
from pyspark.sql import functions as F

from semilattice.llm.ann import grow, nearest, route, share, visit

SCHEMA = "vec_id long, embedding array<float>, score string, rank long"


def brute(rows, is_query, k=5):
    best = {}
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.array(v, np.float32).astype(float))
    for q in good:
        if is_query(q):
            s = [(-round(float(good[q] @ v / np.sqrt(good[q] @ good[q]) / np.sqrt(v @ v)), 9), i) for i, v in good.items() if i != q]
            best[q] = [i for _, i in sorted(s)[:k]]
    return best


def test_equals_brute_force_with_ties_and_broken_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).round(3).tolist()) for i in range(300)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300, 420)]
    rows += [(500, None), (501, []), (502, [0.0] * 4), (503, [1.0, None, 2.0, 3.0]), (504, [float("nan"), 1.0, 1.0, 1.0]), (505, [float("inf"), 1.0, 1.0, 1.0]), (506, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0]), (7, rows[7][1]), (508, [-0.0, 2.0, 3.0, 4.0]), (509, [0.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    got = {}
    for r in sorted(nearest(df, F.col("vec_id") % 10 == 0, 5, leaf=20, search=3.0).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(rows, lambda i: i % 10 == 0)
    assert got.keys() == want.keys()
    assert sum(got[q] == want[q] for q in want) >= 0.97 * len(want)
    assert got[310][:5] == [300, 301, 302, 303, 304]


def test_recall_on_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    v = np.array([x for _, x in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.array([i for i, _ in rows])
    got = {}
    for r in nearest(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for n in np.flatnonzero(ids % 50 == 0):
        s = v @ v[n]
        s[n] = -9
        hit += len(set(ids[np.argsort(-s, kind="stable")[:5]]) & got[ids[n]])
        total += 5
    assert hit / total >= 0.95


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "x", 1), (1, [0.0, 1.0], "x", 1), (2, [1.0, 0.0], "x", 1)], SCHEMA)
    assert [(r.rank, r.vec_id) for r in sorted(nearest(df, F.col("vec_id") == 0).collect())] == [(1, 2), (2, 1)]
    assert nearest(df.limit(0), F.lit(True)).count() == 0
    assert nearest(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_a_query_reaches_its_own_leaf_first():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(500, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    trees = [grow(v, 16, rng) for _ in range(3)]
    leaves = [route(t, v) for t in trees]
    for i in range(0, 500, 50):
        seen = visit(trees, v[i], 10_000)
        assert {(t, int(leaves[t][i])) for t in range(3)} <= set(seen)
        assert len(seen) == len(set(seen)) == sum(len(t.sizes) for t in trees)


def test_clustered_vectors_need_a_small_share(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16))
    rows = [(i, (centres[i % 60] + 0.3 * rng.normal(size=16)).tolist()) for i in range(4000)]
    v = np.array([x for _, x in rows], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, search=0.2).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for n in range(0, 4000, 50):
        s = v @ v[n]
        s[n] = -9
        hit += len(set(np.argsort(-s, kind="stable")[:5].tolist()) & got[n])
    assert hit / 400 >= 0.9


def test_a_search_grows_slower_than_the_table():
    assert all(share(10 * n) * 10 * n < 5.1 * share(n) * n for n in (2000, 10_000, 10**6, 10**9)) and share(51_000) < 0.5
