import random

import duckdb

from semilattice.llm import decontam
from tests.llm.test_neardup import shingles

DOCS = "doc_id long, text string, item_id long, n_item string"
ITEMS = "item_id long, text string, doc_id string"


def brute(docs, items, num=80, den=100):
    out = []
    for d, t in docs:
        for i, x in items:
            s = shingles(x)
            if s and len(s & shingles(t)) * den >= len(s) * num:
                out.append((d, i, len(s), len(s & shingles(t))))
    return sorted(out, key=str)


def tables():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 9, 12, 20, 33, 64, 70, 150])))) for i in range(60)]
    items += [(60, None), (61, ""), (62, "a b c"), (63, "A B  C"), (None, items[5][1]), (64, items[6][1])]
    docs = []
    for d in range(120):
        w = [word() for _ in range(rng.choice([0, 3, 40, 300, 6000]))]
        for _ in range(rng.randint(0, 3)):
            x = (rng.choice(items)[1] or "").upper().split()
            for at in rng.sample(range(len(x)), min(len(x), rng.choice([0, 0, 1, 2]))) if len(x) > 30 else ():
                x[at] = word()
            at = rng.randint(0, len(w))
            w[at:at] = x
        docs.append((d, rng.choice([" ", "\n", "\t "]).join(w)))
    scattered = (items[8][1] or "").split()
    half = len(scattered) // 2
    docs.append((500, " ".join(scattered[: half + 4] + [word() for _ in range(900)] + scattered[half:])))
    return docs + [(501, None), (502, ""), (503, "a b c"), (None, items[0][1]), (0, docs[0][1])], items


def test_equals_brute_force(spark):
    docs, items = tables()
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    want = brute(docs, items)
    assert len(want) > 60
    got = sorted((tuple(r) for r in decontam.contaminated(d, b).collect()), key=str)
    assert got == want
    kept = decontam.decontaminate(d, b).collect()
    bad = {t for i, t in docs if any(len(shingles(x) & shingles(t)) * 100 >= len(shingles(x)) * 80 for _, x in items if shingles(x))}
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted((str(i), t or "") for i, t in docs if t not in bad)


def test_more_items_than_one_pass(spark, monkeypatch):
    docs, items = tables()
    monkeypatch.setattr(decontam, "PASS_SHINGLES", 400)
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    assert sorted((tuple(r) for r in decontam.contaminated(d, b).collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    full = spark.createDataFrame([(1, "a b c d e f", "x")], ITEMS)
    some = spark.createDataFrame([(1, "a b c d e f", 1, "x")], DOCS)
    assert decontam.contaminated(d, full).count() == 0
    assert decontam.contaminated(some, b).count() == 0 and decontam.decontaminate(some, b).count() == 1


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(con.execute(decontam.ORACLE_SQL).fetchall())
    got = decontam.contaminated(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert sorted(tuple(r) for r in got.collect()) == want and want
