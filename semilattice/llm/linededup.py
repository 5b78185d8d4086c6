"""Line deduplication by pairwise alignment: documents meet through shared runs of lines and are aligned by
patience diff, and by runs where that leaves lines open; common blocks go from the later document.

A line ends at a line break or at the end of a sentence, for a passage that documents share often runs on within
their lines. Anchors are the shortest runs of consecutive lines that hold ``min_words`` words, from each line on and up
to each line, so that every line of a block of that many words lies in an anchor within the block. Each document
that holds an anchor meets the anchor's first holder (the smallest doc_id) and no other, so an anchor costs its
holders, however many they are, and every shared block has pairs that hold all of its lines.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _power_tables, Scratch, arrow_map, column, distinct_sets, drop_caches, fewer, fresh, mix, need, texts

#: One in so many shuffle partitions makes a file of a table that holds numbers alone.
NUMBERS = 12

_END = re.compile(rb"\n|[.!?] ")


def split_lines(text: bytes) -> list[bytes]:
    """The lines of a text, which they make up again when joined."""
    ends = [m.end() for m in _END.finditer(text)]
    out = [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True)]
    return out if out[-1] else out[:-1]


def line_table(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, hashes, words``: of each text its fingerprint and, line by line, a hash of the trimmed line and its number of words."""

    def run(batch: pa.RecordBatch) -> dict:
        hashes, words = [], []
        for t in texts(batch):
            lines = split_lines(t or b"")
            hashes.append([xxhash.xxh3_64_intdigest(x.strip()) - (1 << 63) for x in lines])
            words.append([len(x.split()) for x in lines])
        return {"doc_id": column(batch, "doc_id"), "fp": column(batch, "fp"), "hashes": hashes, "words": words}

    return arrow_map(need(docs, doc_id="long", text="string").withColumn("fp", F.xxhash64("text")), run, "doc_id long, fp long, hashes array<long>, words array<int>")


def runs(hashes: np.ndarray, words: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shortest runs of ``min_words`` words or more from each line on and up to each line, inside one text.

    ``offsets`` says where each text's lines begin. Gives each run's text, first line, end and hash; a run may come twice.
    """
    n = len(hashes)
    at = np.arange(n)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    before = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    end = np.maximum(np.searchsorted(before, before[:-1] + min_words), at + 1)
    start = np.minimum(np.searchsorted(before, before[1:] - min_words, "right") - 1, at)
    on, upto = end <= offsets[1:][doc], start >= offsets[:-1][doc]
    # a run that is shortest both ways comes once
    upto &= ~((start >= 0) & (end[start] == at + 1))
    doc, start, end = np.concatenate([doc[on], doc[upto]]), np.concatenate([at[on], start[upto]]), np.concatenate([end[on], at[upto] + 1])
    pw, inv = _power_tables(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes.astype(np.uint64)) * pw[:n])])
    return doc, start, end, mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64)).view(np.int64)


def _batch_runs(batch: pa.RecordBatch, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows and hashes of the runs of a batch's documents, from their lines' hashes and words."""
    h, w = column(batch, "hashes"), column(batch, "words")
    offsets = h.offsets.to_numpy().astype(np.int64)
    doc, _, _, key = runs(h.flatten().to_numpy(), w.flatten().to_numpy(), offsets - offsets[0], min_words)
    return doc, key


def run_table(lines: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, h``: the hashes of each document's runs, each once."""

    def run(batch: pa.RecordBatch) -> dict:
        doc, key = _batch_runs(batch, min_words)
        key, begin = distinct_sets(key, doc, batch.num_rows)
        return {"doc_id": column(batch, "doc_id").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(begin)))), "h": key}

    return arrow_map(lines.select("doc_id", "hashes", "words"), run, "doc_id long, h long")


def shared_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """``h, first``: the hashes of the runs of several documents, and the smallest doc_id that holds each.

    A batch gives each run once, with its smallest and largest doc_id, so that a frequent run moves as a row a batch.
    Most runs have one holder, hence the shuffle before the groups: a map of them in each task would save nothing.
    """

    def run(batch: pa.RecordBatch) -> dict | None:
        doc, key = _batch_runs(batch, min_words)
        if not len(key):
            return None
        order = np.argsort(key)
        key, ids = key[order], column(batch, "doc_id").to_numpy()[doc[order]]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return {"h": key[begin], "first": np.minimum.reduceat(ids, begin), "last": np.maximum.reduceat(ids, begin)}

    ends = arrow_map(lines.select("doc_id", "hashes", "words"), run, "h long, first long, last long")
    return ends.repartition("h").groupBy("h").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first < last").select("h", "first")


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of equal places, ascending in both: equal ends, then lines unique to both sides in their longest
    increasing run, then the same between them."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        once: dict = {}
        for x in range(i, m):
            once[a[x]] = -1 if a[x] in once else x
        there: dict = {}
        for y in range(j, n):
            there[b[y]] = -1 if b[y] in there else y
        places = [(once[v], y) for v, y in there.items() if y >= 0 and once.get(v, -1) >= 0]
        if not places:
            continue
        places.sort(key=lambda p: p[1])
        tails: list[int] = []
        last: list[int] = []
        back: list[int] = []
        for at, (x, _) in enumerate(places):
            k = bisect_left(tails, x)
            back.append(last[k - 1] if k else -1)
            if k == len(tails):
                tails.append(x)
                last.append(at)
            else:
                tails[k], last[k] = x, at
        at, run = last[-1], []
        while at >= 0:
            run.append(places[at])
            at = back[at]
        run.reverse()
        out += run
        for (x0, y0), (x1, y1) in zip([(i - 1, j - 1), *run], [*run, (m, n)], strict=True):
            todo.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(out)


def common_blocks(a: list, b: list, words: list[int], min_words: int) -> list[int]:
    """The lines of b in blocks that equal consecutive lines of a and hold ``min_words`` words or more.

    What patience diff leaves open, for it takes lines once and in one order, is settled by runs.
    """
    out: list[int] = []
    block: list[int] = []
    before = (-2, -2)
    for pair in [*patience(a, b), (-9, -9)]:
        if pair != (before[0] + 1, before[1] + 1):
            if sum(words[j] for j in block) >= min_words:
                out += block
            block = []
        block.append(pair[1])
        before = pair
    if len(out) < len(b) and _open(a, b, words, min_words, set(out)):
        ids: dict = {}
        ys = [ids.setdefault(v, len(ids)) for v in b]
        xs = [ids.get(v, len(ids)) for v in a]
        size = dict(zip(ys, words, strict=True)) | {len(ids): min_words}
        _, _, _, held = runs(np.array(xs), np.array([size[x] for x in xs]), np.array([0, len(xs)]), min_words)
        _, start, end, key = runs(np.array(ys), np.array(words), np.array([0, len(ys)]), min_words)
        some = np.isin(key, held)
        step = np.bincount(start[some], minlength=len(b) + 1) - np.bincount(end[some], minlength=len(b) + 1)
        out = sorted({*out, *np.flatnonzero(np.cumsum(step)).tolist()})
    return out


def _open(a: list, b: list, words: list[int], min_words: int, done: set[int]) -> bool:
    """Whether consecutive lines of b that a holds somewhere have ``min_words`` words and a line that is not done."""
    known = set(a)
    total, some = 0, False
    for j, v in enumerate(b):
        if v not in known:
            total, some = 0, False
            continue
        total += words[j]
        some = some or j not in done
        if some and total >= min_words:
            return True
    return False


def dedup_lines(docs: DataFrame, min_words: int = 8, rare: int | None = None) -> DataFrame:
    """Documents with aligned common blocks deleted from all but the first that holds them.

    ``docs`` needs ``doc_id`` and ``text``; all its columns are kept, ``text`` without the deleted lines, and
    ``n_lines, n_removed`` are added (a column of such a name is replaced). The smaller doc_id is the earlier
    document. A null text stays null; a row without doc_id or with an empty text is unchanged; rows that share a
    doc_id are not compared with each other. With ``rare`` documents meet through single lines alone, those of
    ``min_words`` words and those of three or more that at most ``rare`` documents hold; without it all blocks find
    their pairs. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "linededup")
    id_, fp, gone_, own_fp = fresh(docs, "id", "fp", "gone", "own_fp")
    lines = scratch.write(fewer(line_table(docs)), "lines")
    named = lines.where("doc_id is not null")
    if rare is None:
        flat = run_table(named, min_words)
        # written, so that the join below can deal a frequent run to several tasks
        anchors = scratch.write(fewer(shared_runs(named, min_words), NUMBERS), "anchors")
    else:
        flat = named.select("doc_id", F.explode(F.arrays_zip("hashes", "words")).alias("x")).select("doc_id", F.col("x.hashes").alias("h"), F.col("x.words").alias("w")).where("w > 0").distinct()
        anchors = flat.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"), F.max("w").alias("w"))
        anchors = anchors.where("first < last").where((F.col("w") >= min_words) | ((F.col("n") <= rare) & (F.col("w") >= 3)))
    pairs = flat.join(anchors.select("h", "first"), "h").where("doc_id > first").select("first", "doc_id").distinct()
    later = named.select("doc_id", "fp", F.col("hashes").alias("b"), F.col("words").alias("w"))
    earlier = named.select(F.col("doc_id").alias("first"), F.col("hashes").alias("a"))
    met = pairs.join(later, "doc_id").join(earlier, "first").select("doc_id", "fp", "a", "b", "w")

    def align(batch: pa.RecordBatch) -> dict:
        a, b, w = (column(batch, c).to_pylist() for c in "abw")
        gone = [common_blocks(x, y, z, min_words) for x, y, z in zip(a, b, w, strict=True)]
        some = np.flatnonzero([bool(g) for g in gone])
        return {"doc_id": column(batch, "doc_id").take(pa.array(some)), "fp": column(batch, "fp").take(pa.array(some)), "gone": [gone[i] for i in some]}

    gone = arrow_map(met, align, "doc_id long, fp long, gone array<int>").select("doc_id", "fp", F.explode("gone").alias("line")).distinct()
    gone = gone.groupBy("doc_id", "fp").agg(F.collect_list("line").alias("gone_lines")).select(F.col("doc_id").alias(id_), F.col("fp").alias(fp), F.col("gone_lines").alias(gone_))
    gone = scratch.write(fewer(gone, NUMBERS), "gone")
    scratch.drop(lines)
    if rare is None:
        scratch.drop(anchors)

    # a doc_id nearly always has one text; the fingerprint tells repeated ones apart
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    joined = docs.select(*(F.col(f"`{c}`") for c in own), F.xxhash64(F.col("text").cast("string")).alias(own_fp)).join(gone, (F.col("doc_id").cast("long") == F.col(id_)) & (F.col(own_fp) == F.col(fp)), "left")
    kept = [f for f in docs.schema.fields if f.name in own]
    text_at = own.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for b in batches:
            values, gone = texts(b), column(b, gone_).to_pylist()
            lines = [split_lines(t or b"") for t in values]
            for i, g in enumerate(gone):
                if g:
                    drop = set(g)
                    values[i] = b"".join(x for j, x in enumerate(lines[i]) if j not in drop)
            columns = [b.column(i) for i in range(len(own))]
            columns[text_at] = pa.array(values, pa.binary()).cast(columns[text_at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in lines], pa.int64()), pa.array([len(g or ()) for g in gone], pa.int64())], [*own, "n_lines", "n_removed"])

    return joined.select(*(F.col(f"`{c}`") for c in own), gone_).mapInArrow(cut, T.StructType(kept).add("n_lines", "long").add("n_removed", "long"))
