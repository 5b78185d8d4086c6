import random
import re
from collections import defaultdict

import pytest

from semilattice.llm.common import Scratch
from semilattice.llm.neardup import connected_components, keep_first, near_duplicates

SCHEMA = "doc_id long, text string, n_shingles string, root long, a long"
CLASH = "doc_id long, text string, _id long, _rows long, _kept boolean, kept string, rep long, h1 int, key string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows, num, den):
    """Smallest id reachable over links between all pairs."""
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(shingles(t))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(x and y and len(x & y) * den >= len(x | y) * num for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def corpus(seed=3):
    """Groups of near copies at many similarities, chains that link through the middle, a shared passage, copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(30)]
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 300))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 1
    chain = [word() for _ in range(200)]
    for _ in range(10):
        rows.append((n, " ".join(chain)))
        chain = [*chain[9:], *(word() for _ in range(9))]
        n += 1
    for _ in range(25):
        w = [word() for _ in range(40)]
        rows.append((n, " ".join(w[:20] + passage + w[20:])))
        n += 1
    rows += [(n + i, rows[0][1].upper() if i % 2 else rows[0][1].replace(" ", "\n\t")) for i in range(6)]
    n += 6
    edge = [None, "", " \n ", "a b", "A B", "a b c d e", "one", "one", "x " * 5000, "x " * 4000, "é漢 " * 7]
    return rows + [(n + i, t) for i, t in enumerate(edge)]


@pytest.mark.parametrize("num,den", [(85, 100), (80, 100)])
def test_equals_brute_force(spark, num, den):
    rows = corpus()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", i, 1) for i, t in rows], SCHEMA)
    got = near_duplicates(df, num, den, collections=12 if num == 80 else 10).collect()
    want = brute(rows, num, den)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    by = dict(rows)
    assert all(r.n_shingles == len(shingles(by[r.doc_id])) and r.kept == (r.component_id == r.doc_id) for r in got)


def test_repeated_and_null_ids_and_keep_first(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(5, long), (5, long), (5, "other words entirely here now ok"), (7, long), (None, long), (None, None), (9, None), (9, "")]
    df = spark.createDataFrame([(i, t, "x", i, 1) for i, t in rows], SCHEMA)
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (7, 5), (9, 9), (None, None)}
    kept = keep_first(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["5", "9", "None", "None"]
    assert kept[0].asDict().keys() == set(df.columns)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(df).count() == 0 and keep_first(df).count() == 0


def test_a_large_group_below_the_threshold_is_settled(spark):
    """More members than one round's representatives, many of them not linked to one another."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(90):
        w = list(base)
        for at in rng.sample(range(100), 2):
            w[at] = f"x{i}_{at}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 85, 100)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i != 30], "a long, b long")
    got = {r.doc: r.root for r in connected_components(spark, edges, Scratch(spark, "t")).collect()}
    assert got == {i: (0 if i <= 30 else 31) for i in range(61)}


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 85, 100)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == want


def test_clashing_names_and_ties(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long, 9, 8, False, "k", 5, 1, "x"), (2, long, 9, 8, False, "k", 5, 1, "y"), (4, "z one", 2, 0, True, "b", 1, 1, "q"), (4, "a one", 7, 0, True, "b", 1, 1, "r"), (4, "a one", 3, 0, True, "b", 1, 1, "r")]
    got = keep_first(spark.createDataFrame(rows, CLASH))
    assert got.columns == [c.split()[0] for c in CLASH.split(", ")]
    assert sorted(tuple(r) for r in got.collect()) == [rows[0], rows[4]]


def test_many_that_share_text_without_a_link(spark):
    """A group that buckets hold together and that links nowhere costs far less than its pairs."""
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(60)]
    rows = [(i, " ".join([*shared, *(f"o{i}_{j}" for j in range(rng.randint(18, 30)))])) for i in range(2000)]
    rows += [(3000 + i, rows[i][1] + " end") for i in range(0, 2000, 100)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - 3000 if i >= 3000 else i for i, _ in rows}


def test_later_rounds_keep_what_is_open(spark, monkeypatch):
    """A round writes the shingles' holders that come after the last round's, where several components are left."""
    rows, write = [], Scratch.write

    def counted(self, df, name, codec="snappy"):
        out = write(self, df, name, codec)
        if name == "ranked":
            rows.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    rng = random.Random(8)
    docs = []
    for g in range(2):
        for i in range(60):
            w = [f"b{g}_{j}" for j in range(100)]
            for at in rng.sample(range(100), 1 if g else 3):
                w[at] = f"x{g}_{i}_{at}"
            docs.append((len(docs), " ".join(w)))
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 85, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(docs, 85, 100)
    assert len(rows) > 2 and all(b < a * 0.95 for a, b in zip(rows, rows[1:], strict=False))


def test_pairs_of_a_group_without_links_are_not_moved(spark, monkeypatch):
    """Sets that meet on rare shingles and share too few of them are no candidates, however large the group."""
    pairs, write = [], Scratch.write

    def counted(self, df, name, codec="snappy"):
        out = write(self, df, name, codec)
        if name == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    rng = random.Random(5)
    rows = []
    for i in range(300):  # three changes each, five shingles a change: two of them share some 72 of 114
        w = [f"b{j}" for j in range(100)]
        for at in rng.sample(range(100), 3):
            w[at] = f"x{i % 150}_{at}" if at % 2 else f"x{at}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 300, 30)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 85, 100)
    assert sum(pairs[1:]) < 2 * len(rows), pairs


def test_small_tables_take_few_files(spark, monkeypatch):
    """What has few rows is not written as a file for each shuffle partition, which costs executors processes."""
    files, write = {}, Scratch.write

    def counted(self, df, name, codec="snappy"):
        out = write(self, df, name, codec)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    rows = corpus()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 85, 100)
    assert all(files[n] <= 2 for n in ("candidates", "edges", "stars", "parts", "open", "unsettled", "prefixes", "ranked")), files
