import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from semilattice.llm.packing import Encoder, pack, pack_documents, plan_best_fit, tokenize

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def one_by_one(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(200):
        c = rng.choice([7, 20, 64])
        lengths = [rng.randint(1, c) for _ in range(rng.randint(0, 90))]
        steps, bins = plan_best_fit(Counter(lengths), c)
        used = defaultdict(int)
        for length, low, high, first, each, at in steps:
            for r in range(low, high):
                assert used[first + (r - low) // each] == at + (r - low) % each * length
                used[first + (r - low) // each] += length
        assert sorted(c - v for v in used.values()) == one_by_one(lengths, c) and bins == len(used)


def test_encoder_equals_the_tokenizer(spark):
    e = Encoder(PATH)
    assert e.by_word
    odd = ["", " ", "a²b ½ x_y٣٤  \n\n  don't 'S 're  ñ×÷ é́ 漢字  x y \x1c z \x85 w", "  lead", "trail  ", "\t\ta", "ªº µ ß", "a\n\nb c\n d", "x <|endoftext|> y", "a　 b", "a\xa0b c", " a b", "a " * 3000]
    for text in odd + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]:
        assert e.encode(text) == np.asarray(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def check_packing(rows, capacity):
    spans = defaultdict(list)
    for r in rows:
        assert 0 < r.length <= capacity
        spans[r.sequence_id].append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    return len(spans)


def test_documents_with_nulls_repeats_and_clashing_names(spark):
    texts = [None, "", "word " * 5000, "tie", "tie", "x"]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(3, "tie", 1, 2), (None, "null id", 1, 2)]
    got = pack_documents(spark, spark.createDataFrame(rows, "doc_id long, text string, length long, sequence_id long"), PATH).collect()
    check_packing(got, 2048)
    e = Encoder(PATH)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = e.encode(t or "") + bytes(4)
        parts = sorted(by[i], key=lambda r: r.piece)[:: 2 if i == 3 else 1]
        assert [p.piece for p in parts] == list(range(len(parts))) and parts[0].start == 0
        assert sum(p.length for p in parts) == len(ids) // 4
        assert all(p.length == 2048 for p in parts[1:])
        assert all(zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for p in parts)
    assert len(by[3]) == 2 and len(by[None]) == 1


def test_as_few_sequences_as_one_by_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = tokenize(docs, PATH, 512).cache()
    got = pack(pieces, 512, salts=3).collect()
    assert check_packing(got, 512) == len(one_by_one([r.length for r in got], 512))
    assert len(got) == pieces.count()


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(spark, empty, PATH).count() == 0
    assert tokenize(spark.createDataFrame([(1, "")], "doc_id long, text string"), PATH, end_id=None).count() == 0
