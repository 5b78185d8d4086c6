import random

from semilattice.llm import queries
from semilattice.llm.common import Scratch
from semilattice.llm.linededup import common_blocks, dedup_lines, patience, run_table, shared_runs, split_lines

SCHEMA = "doc_id long, text string, n_removed string, first long, w string"


def line(rng, n=10):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def brute(rows, min_words, rare):
    """Each pair of a document and an earlier first holder of one of its lines, aligned by patience diff."""
    lines = {i: [x.decode() for x in split_lines(t.encode())] for i, t in rows if i is not None and t is not None}
    holders = {}
    for i in sorted(lines):
        for x in {y.strip() for y in lines[i] if y.strip()}:
            holders.setdefault(x, []).append(i)
    out = {}
    for i, own in lines.items():
        firsts = {holders[x.strip()][0] for x in own if x.strip() and (len(x.split()) >= min_words or len(holders[x.strip()]) <= rare and len(x.split()) >= 3)} - {i}
        gone = set()
        for f in firsts:
            gone |= set(common_blocks([x.strip() for x in lines[f]], [x.strip() for x in own], [len(x.split()) for x in own], min_words))
        out[i] = "".join(x for j, x in enumerate(own) if j not in gone)
    return out


def test_patience_is_an_alignment():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randint(0, 12) for _ in range(rng.randint(0, 25))] for _ in "ab")
        got = patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
    assert patience([1, 2, 3, 4], [9, 1, 2, 8, 4]) == [(0, 1), (1, 2), (3, 4)]
    assert patience(list("abc"), list("abc")) == [(0, 0), (1, 1), (2, 2)]


def test_equals_brute_force(spark):
    rng = random.Random(6)
    shared = [line(rng) for _ in range(6)] + [line(rng, 60), line(rng, 2), line(rng, 3)]
    rows = []
    for i in range(60):
        own = [line(rng, rng.randint(1, 12)) for _ in range(rng.randint(1, 6))]
        for _ in range(rng.randint(0, 5)):
            own.insert(rng.randint(0, len(own)), rng.choice(shared) + rng.choice(["", " ", "\r"]))
        rows.append((i, "\n".join(own)))
    rows += [(i, rows[i - 60][1]) for i in range(60, 66)]
    rows += [(70, None), (71, ""), (72, "\n\n\n"), (73, "a\n" * 3000), (74, "a\n" * 3000), (75, "\n".join(shared)), (76, "\n".join(reversed(shared)))]
    rng.shuffle(rows)
    got = dedup_lines(spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA), 8, 5)
    assert got.columns == ["doc_id", "text", "first", "w", "n_lines", "n_removed"]
    want = brute(rows, 8, 5)
    by = dict(rows)
    for r in got.collect():
        assert r.text == (None if by[r.doc_id] is None else want[r.doc_id]), r.doc_id
        if by[r.doc_id] is not None:
            assert r.n_lines == len(split_lines(by[r.doc_id].encode()))
    assert got.count() == len(rows)


def test_long_passages_go_from_all_but_the_first(spark):
    rng = random.Random(1)
    passage = line(rng, 55)
    rows = [(i, f"{line(rng)}\n{passage}\n{line(rng)}") for i in range(300)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    assert all(passage not in got[i] and got[i].count("\n") == 1 for i in range(1, 300))


def test_passages_within_lines_go_too(spark):
    rng = random.Random(9)
    passage = ". ".join(line(rng, 20) for _ in range(3)) + "."
    rows = [(i, f"{line(rng, 30)}. {passage}" if i % 2 else f"{line(rng, 30)}.\n{line(rng)}. {passage} {line(rng)}") for i in range(40)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    assert all(line not in got[i] for i in range(1, 40) for line in passage[:-1].split(". ")[:2])
    assert all(got[i].split(".")[0] == rows[i][1].split(".")[0] for i in range(40))


def test_lines_make_up_the_text():
    for t in (b"", b"\n", b"a. b! c?d\n\ne.", b"a.", b" . ", "é. ü\n".encode()):
        assert b"".join(split_lines(t)) == t and all(split_lines(t))


def test_repeated_ids_nulls_and_empty(spark):
    rng = random.Random(1)
    a, b = line(rng), line(rng)
    rows = [(1, a), (2, f"{a}\n{b}"), (2, f"{a}\n{b}"), (2, f"{b}\n{a}\nzz"), (None, a), (None, None), (3, b)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert sorted(r.text for r in got if r.doc_id == 2) == sorted([b, b, f"{b}\nzz"])
    assert [r.text for r in got if r.doc_id == 3] == [""]
    assert {r.text for r in got if r.doc_id is None} == {a, None}
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_of_short_lines_find_their_pairs(spark):
    rng = random.Random(4)
    shout = " ".join(line(rng, 1).upper() + "!!" for _ in range(60))
    rows = [(1, shout), (2, shout), (3, f"{line(rng)}\n{shout}\n{line(rng)}"), (4, "a\n" * 3000), (5, "a\n" * 3000), (6, "b\n" * 7), (7, "b\n" * 7)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    own = dict(rows)
    assert all(got[i] == own[i] for i in (1, 4, 6, 7)) and got[2] == got[5] == ""
    assert got[3] == own[3].replace(shout + "\n", "")


def test_frequent_passages_go_like_rare_ones(spark):
    rng = random.Random(5)
    passage = f"{line(rng, 5)}. {line(rng, 4)}."
    for n in (10, 120):
        rows = [(i, f"{line(rng)}\n{passage}\n{line(rng)}") for i in range(n)]
        got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {i: t if i == 0 else t.replace(passage + "\n", "") for i, t in rows}


def brute_all(rows, min_words):
    """The lines in every run of ``min_words`` words that an earlier document holds too go, by looking at all runs of all documents."""
    lines = {i: [x.decode() for x in split_lines(t.encode())] for i, t in rows}
    held, out = set(), {}
    for i in sorted(lines):
        own = [x.strip() for x in lines[i]]
        spans = [(a, b) for a in range(len(own)) for b in range(a + 1, len(own) + 1) if sum(len(x.split()) for x in own[a:b]) >= min_words]
        gone = {j for a, b in spans if tuple(own[a:b]) in held for j in range(a, b)}
        held |= {tuple(own[a:b]) for a, b in spans}
        out[i] = "".join(x for j, x in enumerate(lines[i]) if j not in gone)
    return out


def test_equals_all_runs_of_all_documents(spark):
    rng = random.Random(8)
    shared = [line(rng, n) for n in (1, 1, 2, 3, 4, 5, 7, 8, 9, 12)] + [""]
    rows = []
    for i in range(120):
        own = [rng.choice(shared) if rng.random() < 0.8 else line(rng, rng.randint(1, 9)) for _ in range(rng.randint(1, 14))]
        rows.append((i, "\n".join(own)))
    for min_words in (8, 3):
        got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words).collect()}
        assert got == brute_all(rows, min_words)


def test_repeated_and_crossing_passages_go(spark):
    rng = random.Random(3)
    p, q, r, s = (line(rng, 10) for _ in range(4))
    u = [line(rng) for _ in range(20)]
    texts = [[u[0], p, u[1], p, u[2]], [u[3], p, u[4]], [u[5], p, u[6], p, u[7]], [u[8], q, u[9], r, u[10], s, u[11]], [u[12], s, u[13], r, u[14], q, u[15]]]
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    got = {x.doc_id: x.text for x in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = [texts[0], [u[3], u[4]], [u[5], u[6], u[7]], texts[3], [u[12], u[13], u[14], u[15]]]
    assert got == {i: "\n".join(t) for i, t in enumerate(left)}


def plain_removed(rows, least):
    """Which lines go, from the requirement alone: all pairs of documents, all runs of lines, by the texts themselves."""
    parts = {}
    for i, t in rows:
        ends = [k + 1 for k, c in enumerate(t) if c == "\n" or (c == " " and k and t[k - 1] in ".!?")]
        cuts = sorted({0, *ends, len(t)})
        parts[i] = [t[a:b] for a, b in zip(cuts, cuts[1:])]
    out = {}
    for i, lines in parts.items():
        trimmed, gone = [x.strip() for x in lines], set()
        for j, other in parts.items():
            if j < i:
                held = [x.strip() for x in other]
                runs = {tuple(held[a:b]) for a in range(len(held)) for b in range(a + 1, len(held) + 1)}
                for a in range(len(trimmed)):
                    for b in range(a + 1, len(trimmed) + 1):
                        if tuple(trimmed[a:b]) in runs and sum(len(x.split()) for x in lines[a:b]) >= least:
                            gone |= set(range(a, b))
        out[i] = "".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_equals_all_pairs_without_the_modules_code(spark):
    rng = random.Random(21)
    pool = ["go on", "yes", "no no", "one two three", "a b c d", "stop", "the end", "x y", "more of it", "w1 w2 w3 w4 w5 w6 w7 w8 w9"]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.8 else f"own {i} {k}" for k in range(rng.randint(2, 9))]
        rows.append((i, "".join(x + rng.choice(["\n", ". ", "! ", " \n"]) for x in lines)))
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_removed(rows, 8)


def test_documents_meet_through_runs_whoever_holds_their_lines_first(spark):
    first, second = "alpha beta gamma delta one", "epsilon zeta eta theta two"
    rows = [(1, f"{first}\nown line of one"), (2, f"{second}\nown line of two"), (3, f"three\n{first}\n{second}\nthree too"), (4, f"four\n{first}\n{second}\nfour too")]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: "four\nfour too"}


def test_clashing_names(spark):
    rows = [(1, "one two three four five six seven eight\nmore", 7, "f", "g", 1), (2, "x\none two three four five six seven eight", 8, "f", "g", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id long, _fp string, _gone string, _own_fp long")
    got = sorted(tuple(r) for r in dedup_lines(df).collect())
    assert got == [(*rows[0], 2, 0), (2, "x\n", *rows[1][2:], 2, 1)]


def test_tables_take_few_files_for_many_partitions(spark, monkeypatch):
    """Each file starts processes beside its executor, which show the executor's memory as theirs."""
    rng = random.Random(12)
    shared = [line(rng, 9) for _ in range(40)]
    rows = [(i, f"{line(rng)}\n{rng.choice(shared)}\n{line(rng, 3)}") for i in range(400)]
    files, write = {}, Scratch.write

    def counted(self, df, name, *more):
        out = write(self, df, name, *more)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    held = {"spark.sql.shuffle.partitions": "36", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        assert queries.op4_line_dedup(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() <= 12
        files.clear()
        out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(36))
        assert {r.doc_id: r.text for r in out.collect()} == plain_removed(rows, 8)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert set(files) == {"lines", "anchors", "gone"} and max(files.values()) <= 12, files


def test_shared_runs_have_the_smallest_holder(spark):
    rng = random.Random(13)
    lines = [[rng.randrange(6) - 3 for _ in range(rng.randint(0, 5))] for _ in range(60)]
    rows = [(i, x, [(v * v) % 7 + 1 for v in x]) for i, x in enumerate(lines)] + [(70, [9, 9, 9], [4, 4, 4])]
    df = spark.createDataFrame(rows, "doc_id long, hashes array<long>, words array<int>").repartition(7)
    holders = {}
    for r in run_table(df, 8).collect():
        holders.setdefault(r.h, set()).add(r.doc_id)
    got = [tuple(r) for r in shared_runs(df, 8).collect()]
    assert sorted(got) == sorted((h, min(ids)) for h, ids in holders.items() if len(ids) > 1) and got
    assert shared_runs(df.where("doc_id < 0"), 8).count() == 0
