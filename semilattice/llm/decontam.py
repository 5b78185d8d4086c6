"""Benchmark decontamination: MinHash containment search partitioned by size, verified on exact shingles.

Similarity between a short item and a long document is small however fully the document contains the item, so
the search compares like with like. Items are partitioned by the size of their shingle sets into classes
[u/2, u); for a class, documents are cut into windows of 2u shingles every u, so that each run of an item's
shingles lies whole in some window, at a similarity of at least a quarter. Sketches are one-permutation MinHash
of 64 bins: a window's is the minimum of its two blocks', and a coarser class's blocks are minima of finer ones.
An item and a window that agree in any bin make a candidate; the whole document's set then decides.

An occurrence of q shingles in a window of at most 4q is missed only if every occupied bin of the item has a
smaller stranger in the window: under 1e-4 for 8 shingles and fast less for more, and the parts of an item that
lies scattered over a document are so many further chances. Items of fewer than 8 shingles are compared with
windows of a single one, where nothing can hide them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Scratch, Words, arrow_map, bounded_batches, column, distinct_sets, drop_caches, need, steps, texts, union_all

BINS_LOG2 = 6
#: Items of fewer than 2**SINGLE shingles are compared with windows of one shingle.
SINGLE = 3
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Shingles of items that one pass over the documents carries (8 bytes each); more items take more passes.
PASS_SHINGLES = 1_000_000


class ItemIndex:
    """Sketches of a block of items, by size class, and a search over texts."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], num: int, den: int, k: int = 5) -> None:
        self.ids = [i for i, _ in items]
        self.num, self.den, self.k = num, den, k
        self.sets, self.first = distinct_sets(*Words([t for _, t in items]).shingles(k), len(items)) if items else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        self.size = np.diff(self.first)
        found: list[tuple[int, int, int]] = []
        for i in np.flatnonzero(self.size):
            h = self.sets[self.first[i] : self.first[i + 1]]
            bins = h >> np.uint64(64 - BINS_LOG2)
            keep = np.ones(len(h), bool)
            keep[1:] = bins[1:] != bins[:-1]  # ascending, so the first of each bin is its minimum
            found += [(int(v), int(i), int(self.size[i]).bit_length()) for v in h[keep]]
        found.sort()
        # an item of few shingles is compared with windows of one
        single = [f for f in found if f[2] <= SINGLE]
        self.single, self.single_owners = np.array([f[0] for f in single], np.uint64), [f[1] for f in single]
        found = [f for f in found if f[2] > SINGLE]
        self.values = np.array([f[0] for f in found], np.uint64)
        self.owners = np.array([f[1] for f in found], np.int64)
        self.classes = np.array([f[2] for f in found], np.int64)  # class c: sizes 2^(c-1) .. 2^c - 1
        self.levels = sorted(set(self.classes.tolist()))

    def search(self, values: list[bytes | None]) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) for every text that contains num/den of an item's shingles."""
        out: list[tuple[int, int, int]] = []
        if len(self.sets):
            for a, b in steps(values):
                out += [(a + d, i, n) for d, i, n in self._search(values[a:b])]
        return out

    def _search(self, values: list[bytes | None]) -> list[tuple[int, int, int]]:
        h, doc = Words(values).shingles(self.k)
        if not len(h):
            return []
        n = np.bincount(doc, minlength=len(values))
        first_word = np.concatenate([[0], np.cumsum(n)])
        pairs = self._windows(h, doc, n, first_word) if len(self.values) else set()
        if len(self.single):
            left = np.searchsorted(self.single, h, "left")
            for at in np.flatnonzero(self.single[np.minimum(left, len(self.single) - 1)] == h):
                e = int(left[at])
                while e < len(self.single) and self.single[e] == h[at]:
                    pairs.add((int(doc[at]), self.single_owners[e]))
                    e += 1
        out = []
        whole: dict[int, np.ndarray] = {}
        for d, i in sorted(pairs):
            if d not in whole:
                whole[d] = np.unique(h[first_word[d] : first_word[d + 1]])
            item = self.sets[self.first[i] : self.first[i + 1]]
            at = np.searchsorted(whole[d], item)
            shared = int((whole[d][np.minimum(at, len(whole[d]) - 1)] == item).sum())
            if shared * self.den >= len(item) * self.num:
                out.append((d, i, shared))
        return out

    def _windows(self, h: np.ndarray, doc: np.ndarray, n: np.ndarray, first_word: np.ndarray) -> set[tuple[int, int]]:
        """Candidates: items and texts some window of which agrees with the item in a bin."""
        base, top = self.levels[0], self.levels[-1]
        bins = 1 << BINS_LOG2
        # blocks of 2^base shingles; each document has a multiple of the coarsest block, and an empty one more
        step = 1 << (top - base)
        blocks = -(-n // (step << base)) * step + step
        first_block = np.concatenate([[0], np.cumsum(blocks)])
        block = first_block[doc] + ((np.arange(len(h)) - first_word[doc]) >> base)
        cell = block * bins + (h >> np.uint64(64 - BINS_LOG2)).astype(np.int64)
        order = np.lexsort((h, cell))
        c, v = cell[order], h[order]
        keep = np.ones(len(c), bool)
        keep[1:] = c[1:] != c[:-1]
        c, v = c[keep], v[keep]
        left = np.searchsorted(self.values, v, "left")
        hit = np.flatnonzero(self.values[np.minimum(left, len(self.values) - 1)] == v)
        if not len(hit):
            return set()
        sketch = np.full((first_block[-1], bins), _MOST)
        sketch.reshape(-1)[c] = v
        right = np.searchsorted(self.values, v[hit], "right")
        pairs: set[tuple[int, int]] = set()
        docs_of = np.searchsorted(first_block, c[hit] // bins, "right") - 1
        by_level = {base: sketch}
        for level in self.levels[1:]:
            fine = by_level[prev := max(by_level)]
            by_level[level] = fine.reshape(-1, 1 << (level - prev), bins).min(1)
        for at, lo, hi, d in zip(hit, left[hit], right, docs_of, strict=True):
            value, where, bin_ = v[at], int(c[at]) // bins, int(c[at]) % bins
            for e in range(lo, hi):
                level = int(self.classes[e])
                s, j = by_level[level], where >> (level - base)
                # the least of its block, and of a window: with the block before it or the one after it
                beside = s[j - 1 : j + 2 : 2, bin_] if j else s[1:2, bin_]
                if s[j, bin_] == value and (not j or (beside >= value).any()):
                    pairs.add((int(d), int(self.owners[e])))
        return pairs


def _indexes(items: DataFrame, num: int, den: int, k: int) -> Iterator[ItemIndex]:
    """Blocks of items, as they come to the driver one after the other."""
    block: list[tuple[int | None, bytes | None]] = []
    words = 0
    for r in need(items, item_id="long", text="string").orderBy("item_id", "text").toLocalIterator():
        block.append((r.item_id, None if r.text is None else r.text.encode()))
        words += len(block[-1][1] or b"") // 2 + 1
        if words > PASS_SHINGLES:
            yield ItemIndex(block, num, den, k)
            block, words = [], 0
    if block:
        yield ItemIndex(block, num, den, k)


def contaminated(docs: DataFrame, items: DataFrame, num: int = 80, den: int = 100, k: int = 5) -> DataFrame:
    """Documents that contain at least num/den of an item's distinct k-word shingles.

    Returns ``doc_id, item_id, n_item, n_shared``: one row for a document and an item. Shingles are op1's: words
    lower-cased in A-Z, a shorter text's whole sequence as its only one, none for a null or wordless text, which
    therefore neither matches nor is matched. Repeated rows give repeated results; null ids are kept; either
    table empty gives an empty result. Other columns are not read.
    """
    schema = "doc_id long, item_id long, n_item long, n_shared long"
    base = need(docs, doc_id="long", text="string")

    def search(index: ItemIndex) -> DataFrame:
        def run(batch: pa.RecordBatch) -> dict:
            ids = column(batch, "doc_id").to_pylist()
            found = index.search(texts(batch))
            return {"doc_id": [ids[d] for d, _, _ in found], "item_id": [index.ids[i] for _, i, _ in found], "n_item": [int(index.size[i]) for _, i, _ in found], "n_shared": [n for _, _, n in found]}

        return arrow_map(base, run, schema)

    out: list[DataFrame] = []
    scratch = Scratch(docs.sparkSession, "decontam")
    waiting: DataFrame | None = None
    for index in _indexes(items, num, den, k):
        if waiting is not None:  # more than one block: each is searched and written before the next is held
            out.append(scratch.write(waiting, "matches"))
        waiting = search(index)
    if waiting is None:
        return docs.sparkSession.createDataFrame([], schema)
    return union_all([*out, waiting])


def decontaminate(docs: DataFrame, items: DataFrame, num: int = 80, den: int = 100, k: int = 5) -> DataFrame:
    """The documents without those that ``contaminated`` finds, with all their columns, in passes without shuffle.

    A null, empty or wordless text stays, whatever the items; rows repeated with their text stay or go together; a
    null doc_id is judged by its text. Without documents or items the documents are returned. Items come to the
    driver in blocks of bounded size: one block is one lazy pass, of more each pass is written before the next
    block is held.
    """
    kept, scratch, waiting = docs, Scratch(docs.sparkSession, "clean"), False
    bounded_batches(docs.sparkSession)
    for index in _indexes(items, num, den, k):
        if waiting:
            kept = scratch.write(kept, "kept")
        waiting = True

        def clean(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            drop_caches()
            for b in batches:
                if b.num_rows:
                    keep = np.ones(b.num_rows, bool)
                    keep[[d for d, _, _ in index.search(texts(b))]] = False
                    yield b.filter(pa.array(keep))

        kept = kept.mapInArrow(clean, T.StructType(docs.schema.fields))
    return kept


ORACLE_SQL = r"""
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark
), shingles AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM words WHERE len(w) > 0
), items AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, max(items.n) AS n_item, count(*) AS n_shared
FROM shingles i JOIN shingles d ON d.kind = 0 AND i.kind = 1 AND d.s = i.s JOIN items ON items.id = i.id
GROUP BY d.id, i.id HAVING count(*) * 100 >= max(items.n) * 80
"""
