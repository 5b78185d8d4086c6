import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from semilattice.llm import langid, lm, queries, toxicity
from semilattice.llm.common import Words, crc_mod

SF = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = sum(y)
    return (rank[np.array(y) == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_toxicity_on_held_out_labels(spark):
    rows = queries.op3_toxicity(spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    assert auc([y for y, _ in held], np.array([s for _, s in held])) > 0.9


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, f"{'awful nasty ' if i % 2 else 'kind gentle '}{i} text", "x") for i in range(40)] + [(None, "x y", "s"), (50, None, "s"), (51, "", "s"), (52, "z" * 200_000, "s"), (1, "awful", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(40)] + [(None, 1, 1), (3, None, 1), (4, 7, 1), (5, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 45 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got if r.doc_id != 1}
    assert by[7] > 0.5 > by[8] and by[50] == by[51]
    empty = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs, empty).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_language_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in queries.op8_language_crf(spark, SF).collect()]
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    scores, moves = rng.normal(size=(11, 3)), rng.normal(size=(3, 3))
    first = np.array([0, 4, 4, 5, 11])
    post, expected = langid.forward_backward(scores, moves, first)
    total = np.zeros((3, 3))
    for a, b in zip(first[:-1], first[1:], strict=True):
        if a == b:
            continue
        paths = np.array(np.meshgrid(*[range(3)] * (b - a), indexing="ij")).reshape(b - a, -1).T
        w = np.exp([sum(scores[a + t, p[t]] for t in range(b - a)) + sum(moves[p[t - 1], p[t]] for t in range(1, b - a)) for p in paths])
        w /= w.sum()
        for t in range(b - a):
            assert np.allclose(post[a + t], [w[paths[:, t] == i].sum() for i in range(3)])
            if t:
                for i in range(3):
                    for j in range(3):
                        total[i, j] += w[(paths[:, t - 1] == i) & (paths[:, t] == j)].sum()
    assert np.allclose(expected, total)


def test_words_of_code_switched_text_change_language():
    rng = random.Random(3)
    en = ["the", "house", "thing", "with", "other", "weather"]
    de = ["schön", "nicht", "übung", "zeit", "schule", "straße"]
    text = lambda w, n: " ".join(rng.choice(w) for _ in range(n)).encode()
    field = langid.train([("en", text(en, 200)) for _ in range(8)] + [("de", text(de, 200)) for _ in range(8)])
    mixed = text(en, 30) + b" " + text(de, 30)
    w = Words([mixed])
    emitted, back = field.emissions(w)
    labels = field.posteriors(emitted[back], w.first).argmax(1)
    assert (labels[:29] == field.langs.index("en")).all() and (labels[31:] == field.langs.index("de")).all()


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, "the house with other weather " * 9, "en", 1) for i in range(8)] + [(i, "nicht schule zeit übung " * 9, "de", 1) for i in range(8, 16)] + [(20, None, "en", 1), (21, "", None, 1), (22, "123 !? §§", "en", 1), (23, "the house", None, 1), (None, "zeit", None, 1), (24, "a" * 100_000, "en", 1)], "doc_id long, text string, lang string, score long")
    field = langid.fit(docs.where("doc_id < 16"), F.lit(True))
    got = {r.doc_id: r for r in langid.identify(docs, field).collect()}
    assert len(got) == 22 and {got[i].lang_pred for i in (20, 21, 22)} == {"und"} and got[20].score == 0
    assert got[23].lang_pred == "en" and got[None].lang_pred == "de"
    kept = langid.keep_identified(docs, field, 0.5)
    assert kept.columns == docs.columns and {20, 21, 22}.isdisjoint({r.doc_id for r in kept.collect()})
    nothing = langid.fit(docs.where("lang is null"), F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), field).count() == 0


def words(t):
    return bytes((t or "").encode()).lower().split()


def unigram(rows, held):
    """The contract's base, by its own formula."""
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    return {i: (sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), None]), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n) for i, t in rows}


def test_lm_base_is_exact_and_the_model_better(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = unigram(docs, lambda i: fold(i, 5) == 1)
    got = queries.op7_context_mixing_lm(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        base, n, known, total = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, fold(r.doc_id, 5) == 1)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    # the base gives every unknown word one share, whatever its length, so documents without any are compared
    held = [r for r in got if r.held_out and r.n_known == r.n_tokens]
    n = sum(r.n_tokens for r in held)
    assert n > 5000 and sum(r.score for r in held) / n > sum(r.base_score for r in held) / n + 0.3


def tokens(seed=2, n=6000, words=40):
    """A stream in which the word before tells much: leaves, hashed words before, frequent words before, training or not."""
    rng = np.random.default_rng(seed)
    leaf = np.zeros(n, int)
    for i in range(1, n):
        leaf[i] = (leaf[i - 1] * 3 + 1) % words if rng.random() < 0.6 else min(int(rng.exponential(6)), words - 1)
    before, two = np.concatenate([[99], leaf[:-1]]), np.concatenate([[99, 99], leaf[:-2]])
    train = rng.random(n) < 0.8
    return leaf, before, two, np.minimum(before, 2), train


def model_of(leaf, before, two, last, train):
    code = lm.huffman(np.bincount(leaf[train], minlength=40))
    flat = lm.odds(code, np.bincount(leaf[train], minlength=40))
    n = np.zeros((40, 3), np.int64)
    np.add.at(n, (leaf[train], last[train]), 1)
    after = np.clip(np.rint(lm.odds(code, n) * lm.ODDS), -127, 127).astype(np.int8).T.reshape(-1).copy()
    return code, flat, after, lm.Stream(code, flat, after, leaf, before.astype(np.uint32), two.astype(np.uint32), last)


def test_lm_scores_equal_a_plain_scorer(monkeypatch):
    """The same model bit by bit: counts in dictionaries, weights and table as lists."""
    monkeypatch.setattr(lm, "table_shift", lambda entries: np.uint64(64 - 25))  # room for every context
    monkeypatch.setattr(lm, "BLOCK", 256)
    leaf, before, two, last, train = tokens()
    code, flat, after, stream = model_of(leaf, before, two, last, train)
    learners, mixer = np.flatnonzero(train), lm.Mixer(4)
    stream.learn(learners, mixer)
    got = stream.score(mixer)

    path = lambda x: [(int(code.nodes[code.begin[x] + k]), int(code.bits[code.begin[x] + k])) for k in range(code.length[x])]
    counts = {}
    odds = lambda c: np.log((c[1] + 0.4) / (c[0] + 0.4))
    level = lambda c: sum(sum(c) > k for k in (0, 3, 30))

    def predictors(i, node):
        c = [counts.get(k, (0, 0)) for k in ((before[i], node), (before[i], two[i], node))]
        return level(c[1]) * 4 + level(c[0]), [flat[node], after[last[i] * len(flat) + node] / lm.ODDS, odds(c[0]), odds(c[1]), 1.0]

    weights = [[0.3] * 4 + [0.0] for _ in range(16)]
    curve = [[50.0] * 5 for _ in range(16)]
    table = [[1 / (1 + np.exp(-(-8 + 0.5 * b))) for b in range(33)] for _ in range(16)]
    mixed = lambda g, x: min(8, max(-8, sum(w * v for w, v in zip(weights[g], x, strict=True))))
    for n, lo in enumerate(range(0, len(learners), 256)):
        rows = [(*predictors(i, node), bit) for i in learners[lo : lo + 256] for node, bit in path(leaf[i])]
        grad = [[0.0] * 5 for _ in range(16)]
        bend = [[0.0] * 5 for _ in range(16)]
        seen, ones = [[0] * 33 for _ in range(16)], [[0] * 33 for _ in range(16)]
        for g, x, bit in rows:
            z = mixed(g, x)
            p = 1 / (1 + np.exp(-z))
            for k in range(5):
                grad[g][k] += (bit - p) * x[k]
                bend[g][k] += max(p * (1 - p), 1e-3) * x[k] ** 2
            at = (z + 8) * 2
            b = min(int(at), 31)
            b += at - b > 0.5
            seen[g][b] += 1
            ones[g][b] += bit
        for g in range(16):
            for k in range(5):
                if n % 4 == 0:
                    curve[g][k] = curve[g][k] * 0.92 + 4 * bend[g][k]
                weights[g][k] += grad[g][k] / (5 * curve[g][k] + 1)
            for b in range(33):
                if seen[g][b]:
                    table[g][b] += 0.1 * seen[g][b] / (seen[g][b] + 100) * (ones[g][b] / seen[g][b] - table[g][b])
                table[g][b] = min(1 - 1e-4, max(1e-4, table[g][b]))
        for i in learners[lo : lo + 256]:  # counted once it has been predicted
            for node, bit in path(leaf[i]):
                for key in ((before[i], node), (before[i], two[i], node)):
                    counts.setdefault(key, [0, 0])[bit] += 1
    want = []
    for i in range(len(leaf)):
        total = 0.0
        for node, bit in path(leaf[i]):
            g, x = predictors(i, node)
            z = mixed(g, x)
            at = (z + 8) * 2
            b = min(int(at), 31)
            p = 0.5 / (1 + np.exp(-z)) + 0.5 * (table[g][b] + (at - b) * (table[g][b + 1] - table[g][b]))
            total += np.log(p if bit else 1 - p)
        want.append(total)
    # a few contexts share slots by chance
    off = np.abs(got - want)
    assert (off < 0.02).mean() > 0.99 and np.median(off) < 2e-3


def test_lm_is_a_distribution_over_tokens_and_learns():
    leaf, before, two, last, train = tokens()
    code, flat, after, stream = model_of(leaf, before, two, last, train)
    mixer = lm.Mixer(4)
    stream.learn(np.flatnonzero(train), mixer)
    plain = np.bincount(leaf[train], minlength=40) + 1.0
    held = ~train
    assert stream.score(mixer)[held].mean() > np.log(plain / plain.sum())[leaf[held]].mean() + 0.5
    for i in (5, 77, 4000):  # all tokens that could stand there
        every = lm.Stream(code, flat, after, np.arange(40), np.full(40, before[i], np.uint32), np.full(40, two[i], np.uint32), np.full(40, last[i]))
        every.tables, every.shift = stream.tables, stream.shift
        assert np.exp(every.score(mixer)).sum() == pytest.approx(1, abs=1e-4)


def test_spelling_is_a_distribution_and_has_no_floor():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))).encode() for _ in range(300)})
    speller = lm.Speller(words)
    known = speller.score([bytes([b]) for b in range(256) if b != 32])
    assert np.exp(known).sum() < 1
    short, long = speller.score([b"q" * 1000, b"q" * 100_000])
    assert long / short == pytest.approx(100, rel=0.05) and long < -1000
    assert np.allclose(speller.score(words), [speller.score([w])[0] for w in words])


def test_lm_edges(spark):
    rows = [(1, "the cat sat", 1), (2, "the cat ran", 2), (3, None, 3), (4, "", 4), (5, "x" * 50_000, 5), (None, "the dog", 6), (2, "the cat ran", 7), (6, "É the  CAT\n", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score long")
    got = lm.score_documents(df, F.col("doc_id") == 6).collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {4 + 4 + 1 + 1 + 2 + 4}
    by = {r.doc_id: r for r in got}
    assert by[3].n_tokens == by[4].n_tokens == 1 and by[3].score == by[4].score
    assert (by[6].n_tokens, by[6].n_known) == (4, 3) and by[None].held_out
    alone = lm.score_documents(df, F.lit(True)).collect()
    assert {r.train_tokens for r in alone} == {0} and all(np.isfinite(r.score) for r in alone)
    assert lm.score_documents(df.limit(0), F.lit(False)).count() == 0
    long = spark.createDataFrame([(i, "some words of a text " * 20) for i in range(5)] + [(10, "qz" * 40_000), (11, "qz" * 80_000)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in lm.score_documents(long, F.col("doc_id") >= 10).collect()}
    assert scores[11] < 1.9 * scores[10] < -1000  # no floor below the probability of a word


def test_folds(spark):
    got = spark.range(50).select("id", crc_mod("id", 5).alias("f")).collect()
    assert all(r.f == fold(r.id, 5) for r in got)



def test_counts_never_run_into_each_other():
    table = lm.Table(np.uint64(60))
    for _ in range(200):
        slot, bit = np.full(2000, 3), np.r_[np.zeros(500, int), np.ones(1500, int)]
        table.look(slot)
        table.add(slot, bit)
    low, high = int(table.both[3]) & 0xFFFF, int(table.both[3]) >> 16
    assert 2.9 < high / low < 3.1 and high < 1 << 16 and not table.both[[0, 1, 2, *range(4, 16)]].any()
    other = lm.Table(np.uint64(60))
    other.add_all(np.full(400_000, 5), np.ones(400_000, int))
    assert int(other.both[5]) & 0xFFFF == 0 and int(other.both[5]) >> 16 > 10_000
    table.close()
    assert table.look(np.array([3]))[0][0] == pytest.approx(np.log(high / low), abs=0.01)
    speller = lm.Speller([b"a" * 300_000, b"b"])
    assert np.isfinite(speller.score([b"a" * 1000, b"zz"])).all()


def test_a_path_meets_few_places_of_a_table():
    """Four levels of a path lie within 16 slots, and tokens that stand alike are scored once."""
    code = lm.huffman(np.ones(4000, np.int64))
    _, step, _, start = lm.paths(code, np.arange(4000))
    context = lm.mix(np.arange(4000, dtype=np.uint64)).repeat(np.diff(np.append(start, len(step))))
    places = lm.slots(context, step, lm.group_hashes(step), lm.table_shift(1 << 22)) >> 4
    assert max(len(set(x.tolist())) for x in np.split(places, start[1:])) <= 4 and code.length.min() >= 11

    n, met = 6000, []
    code, flat = lm.huffman(np.ones(40, np.int64)), np.zeros(39, np.float32)
    same = lm.Stream(code, flat, np.zeros(39, np.int8), np.arange(n) % 40, np.zeros(n, np.uint16), np.zeros(n, np.uint16), np.zeros(n, np.uint8))
    block = same.block
    same.block = lambda at: met.append(len(at)) or block(at)
    assert len(same.score(lm.Mixer(4))) == n and sum(met) == 40
