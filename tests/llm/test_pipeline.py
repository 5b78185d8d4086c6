import random

import corpus_pipeline
from semilattice.llm import queries
from semilattice.llm.common import Scratch
from tests.llm.test_neardup import shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BENCH = "item_id long, text string"


def test_stages_act_on_planted_cases(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["the", "er", "on", "in", "th", "ing", "re"]) for _ in range(rng.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    clean = {i: "\n".join(line(rng.randint(12, 40)) for _ in range(5)) for i in range(80)}
    item, passage = line(25), line(60)
    docs = dict(clean)
    docs[100] = clean[3]  # a copy: nothing is left of it
    near = clean[4].replace("\n", " ").split()
    near[7] = "changed"
    docs[101] = clean[4].replace("\n", " ")
    docs[102] = " ".join(near)  # a near copy
    docs[103] = f"{line(30)}\n{item}\n{line(30)}"
    docs[104] = f"{passage}\n{line(30)}"
    docs[105] = f"{line(30)}\n{passage}"
    docs[106] = "12 34 ?!"
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(200, None, None, None, None), (201, "", "en", None, 0)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], BENCH).write.parquet(f"{sf}/benchmark.parquet")
    seen, scratch = [spark.read.parquet(f"{sf}/documents.parquet")], Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        seen.append(scratch.write(stage(spark, seen[-1], sf), name))
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    assert all(s.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") for s in seen[:-1])
    assert ids[0] - ids[1] == {106, 200, 201}
    assert ids[1] - ids[2] == {100}
    assert ids[2] - ids[3] == {101, 102}
    assert ids[3] - ids[4] == {103} and ids[4] == ids[5]
    texts = {r.doc_id: r for r in seen[2].collect()}
    assert all(texts[i].text == t for i, t in clean.items())
    assert passage in texts[104].text and passage not in texts[105].text and texts[105].n_chars == len(texts[105].text)
    run = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, run.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, seen[5].select("doc_id", "piece", "start", "length", "ids_crc32").collect()))


def test_whole_documents_leave_no_near_copies_and_no_items(spark):
    sf = "/root/testdata/sf0.001"
    scratch = Scratch(spark, "test")
    docs = queries.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = scratch.write(stage(spark, docs, sf), name)
    sets = [shingles(r.text) for r in docs.collect()]
    assert all(len(a & b) * 100 < len(a | b) * 80 for n, a in enumerate(sets) for b in sets[n + 1 :] if a)
    items = [s for r in queries.table(spark, sf, "benchmark").collect() if (s := shingles(r.text))]
    assert not [1 for a in sets for i in items if len(a & i) * 100 >= len(i) * 80]


def test_stages_with_clashing_names_repeats_and_nulls(spark, tmp_path):
    """Columns named like the operators' own, repeated rows, rows without an id or a text."""
    sf = str(tmp_path)
    extra = "_id long, _fp long, _gone string, _own_fp long, _rows long, _kept string, gone string, n_lines long, key string, rep long"
    rng = random.Random(3)
    text = {i: " ".join(rng.choice(["the", "thing", "on", "other", "rain", "in", "water"]) + str(rng.randint(0, 9)) for _ in range(40)) for i in range(12)}
    rows = [(i, t, "en", "s", len(t), 1, 2, "g", 3, 4, "k", "x", 5, "y", 6) for i, t in text.items()]
    rows += [rows[2], rows[2], (None, text[3] + " more", "en", "s", 1, 1, 2, "g", 3, 4, "k", "x", 5, "y", 6), (40, None, None, None, None, *[None] * 10)]
    spark.createDataFrame(rows, f"{DOCS}, {extra}").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "nothing of the kind is here at all")], BENCH).write.parquet(f"{sf}/benchmark.parquet")
    docs, scratch = spark.read.parquet(f"{sf}/documents.parquet"), Scratch(spark, "test")
    names = [c for c in docs.columns if c != "n_lines"]
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = scratch.write(stage(spark, docs, sf), name)
        assert [c for c in docs.columns if c != "n_lines"] == names
    left = [r.doc_id for r in docs.collect()]
    assert sorted(x for x in left if x is not None) == sorted(text) and left.count(None) == 1


def test_empty_documents(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], BENCH).write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
