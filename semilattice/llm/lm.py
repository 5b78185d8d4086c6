"""Language-model scores by online logistic context mixing over bits.

A text is its words, lower-cased in A-Z, then an end. Every token is a path of bits: words with a code of their own
(at most ``SHORT``, the most frequent ones), the end and "another word" are the leaves of a Huffman tree over the
training tokens. Each bit is predicted by four predictors: by the place in the tree alone, by that and the last very
frequent word before it, by that and the word before it, and by that and the two words before it; the last two look
up counts under a hash of their context. Their log-odds are mixed by weights that a gate selects by how much the two
hashed contexts have seen. The weights are learned online, block by block along the stream of training tokens, and
an adaptive table refines the mixed probability. Another word is either known, and then has its share of such
tokens, or it is spelled, its bytes being paths of bits predicted under hashes of the last 1, 2, 3 and 4 bytes and of
all of them, mixed and refined in the same way. Every bit's two probabilities sum to one, so a text's score is a probability.

What is gathered grows with the corpus: tokens are dealt by the word before them to as many buckets as the corpus
asks for, words without a code by their own hash. A bucket goes along its training tokens block by block: each block is
predicted from what came before it, moves the weights, and is then counted in tables as large as the bucket needs;
with what it has learned in the end the bucket scores all its tokens. Very frequent words are dealt out further by the word
before them. Only the tree, the shares after very frequent words and counts of words with a code are broadcast, all
of a size that ``SHORT`` bounds. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, Scratch, Words, _power_tables, bounded_batches, give_back, mix, need, steps, texts

#: Words with a code of their own at most and their least count; very frequent words that tell the sort of text.
SHORT, LEAST, FREQUENT = 65_000, 3, 96
#: Text bytes in a chunk; tokens in a bucket from which buckets grow in number; words without a code likewise.
CHUNK_BYTES, BUCKET_TOKENS, BUCKET_WORDS = 1 << 20, 900_000, 200_000
#: Texts in a chunk at most.
CHUNK_ROWS = 50_000
#: Buckets of tokens at least, so that small corpora use several cores too.
LEAST_BUCKETS = 4
#: Tokens, and bytes that are spelled, in one online step.
BLOCK, SPELL_BLOCK = 2048, 1 << 13
LEVELS = 4  # of what a context has seen: nothing, 1-3, 4-30, more
GATES = LEVELS * LEVELS
BINS = 33  # of the refining table, over log-odds of -8 .. 8
SPELLERS = 5
ODDS = 12
_U = np.uint64
_END, _START = _U(1), _U(2)
_LOW, _HIGH, _HALF = np.uint32(0xFFFF), np.uint32(0x80008000), np.uint32(16)
#: Upper edges of the counts that one bin of the histogram of counts holds: exact to 64, then in eighths of powers of two.
_EDGES = np.unique(np.concatenate([np.arange(1, 65), np.rint(64 * 2 ** (np.arange(1, 8 * 50) / 8))])).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length after the other, compressed."""
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def from_planes(raw: bytes, n: int, at: int) -> np.ndarray:
    """Two-byte numbers that lie as their low bytes, then their high ones, which compress better, as whole numbers."""
    both = np.frombuffer(raw, np.uint8, 2 * n, at).reshape(2, n)
    return both[0].astype(np.int64) + (both[1].astype(np.int64) << 8)


def steps_up(a: np.ndarray) -> np.ndarray:
    """An ascending column as the steps between its numbers."""
    return np.diff(a, prepend=0).astype(np.uint16)


def columns_of(blob: bytes, *kinds: type) -> list[np.ndarray]:
    """The arrays of ``pack``, by their types."""
    raw, out, at = unpack(blob), [], 0
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


@dataclass
class Code:
    """A Huffman code: the paths of all leaves one after the other, and each inner node's counts of zeros and ones."""

    length: np.ndarray
    begin: np.ndarray
    steps: np.ndarray  # of each step of a path: its group's first node, the node, its place in the group, the bit
    parent: np.ndarray
    side: np.ndarray

    @property
    def nodes(self) -> np.ndarray:
        return self.steps >> 5 & 0xFFFFF

    @property
    def bits(self) -> np.ndarray:
        return self.steps & 1

    def counts(self, leaves: np.ndarray) -> np.ndarray:
        """Inner nodes x 2 counts from leaves' counts, or of many rows of them."""
        n = len(self.length)
        total = np.concatenate([leaves, np.zeros((n - 1, *leaves.shape[1:]), leaves.dtype)])
        out = np.zeros((n - 1, 2, *leaves.shape[1:]), leaves.dtype)
        for i in range(2 * n - 2):  # a node's children come before it
            p = self.parent[i]
            out[p - n, self.side[i]] = total[i]
            total[p] += total[i]
        return out


def huffman(counts: np.ndarray) -> Code:
    """The code of leaves with these counts (each counts one more); deterministic."""
    n = len(counts)
    heap = [(int(c) + 1, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8)
    for new in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i], parent[j], side[j] = new, new, 1
        heapq.heappush(heap, (a + b, new))
    # nodes come in groups of four levels, which a table holds side by side; a place in a group is a path below its first node
    depth, group, place = [0] * (2 * n - 1), list(range(2 * n - 1)), [1] * (2 * n - 1)
    for i, p, s in zip(range(2 * n - 3, -1, -1), parent[-2::-1].tolist(), side[-2::-1].tolist(), strict=True):
        depth[i] = depth[p] + 1
        if depth[i] % 4:
            group[i], place[i] = group[p], 2 * place[p] + s
    depth, of_node = np.array(depth, np.int64), (np.array(group, np.int64) - n << 25) + (np.arange(2 * n - 1) - n << 5) + (np.array(place, np.int64) << 1)
    length = depth[:n]
    begin = np.cumsum(length) - length
    both = np.zeros(int(length.sum()), np.int64)
    now, at, todo = np.arange(n), begin + length - 1, length.copy()
    while (some := np.flatnonzero(todo)).size:
        i = now[some]
        both[at[some]] = of_node[parent[i]] + side[i]
        now[some], at[some], todo[some] = parent[i], at[some] - 1, todo[some] - 1
    return Code(length, begin, both, parent, side)


# gathers below are of places that lie within bounds; ``mode="clip"`` spares them the check


def paths(code: Code, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For symbols one after the other: the symbol of each bit, its step, the bits, and where each symbol's begin."""
    size = code.length[leaf]
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(leaf)), size)
    at = (code.begin[leaf] - start).take(owner, mode="clip") + np.arange(len(owner))
    step = code.steps.take(at, mode="clip")
    return owner, step, step & 1, start


class Table:
    """Counts of zeros and ones in slots, two bytes each; once they are complete, their log-odds with the level."""

    def __init__(self, shift: np.uint64) -> None:
        self.both = np.zeros(1 << (64 - int(shift)), np.uint32)
        self.closed = False

    def look(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of a one, and how much the slot has seen."""
        at = self.both.take(slot, mode="clip")
        if self.closed:
            return (at >> 2) * np.float32(1 / 512), (at & 3).astype(np.int8)
        self.found = at
        return self._read(at)

    @staticmethod
    def _read(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        zeros, ones = at & _LOW, at >> _HALF
        seen = zeros + ones
        level = (seen > 0).view(np.int8) + (seen > 3).view(np.int8) + (seen > 30).view(np.int8)
        return np.log((ones + np.float32(0.4)).astype(np.float32) / (zeros + np.float32(0.4)).astype(np.float32)), level

    def add(self, slot: np.ndarray, bit: np.ndarray) -> None:
        """Counts the bits that were looked up last, fewer than 30,000 of which fall into one slot."""
        if (over := (self.found & _HIGH) != 0).any():
            self._halve(np.unique(slot[over]))
        np.add.at(self.both, slot, bit.astype(np.uint32) * _LOW + np.uint32(1))

    def add_all(self, slot: np.ndarray, bit: np.ndarray) -> None:
        """The same for any number of bits in one slot."""
        for lo in range(0, len(slot), 30_000):
            part = slot[lo : lo + 30_000]
            self.found = self.both.take(part, mode="clip")
            self.add(part, bit[lo : lo + 30_000])

    def _halve(self, full: np.ndarray) -> None:
        """Keeps counts within their two bytes."""
        self.both[full] = (self.both[full] >> np.uint32(1)) & np.uint32(0x7FFF7FFF)

    def close(self) -> None:
        out = np.empty(len(self.both), np.int16)
        for lo in range(0, len(out), 1 << 18):
            odds, seen = self._read(self.both[lo : lo + (1 << 18)])
            out[lo : lo + (1 << 18)] = np.rint(odds * 512).astype(np.int16) * 4 + seen
        self.both, self.closed = out, True


class Mixer:
    """Mixes predictors' log-odds by weights of a gate, refines the result, and learns both online."""

    def __init__(self, predictors: int) -> None:
        self.weights = np.full((GATES, predictors + 1), 1.2 / predictors, np.float64)
        self.weights[:, -1] = 0
        self.curve = np.full((GATES, predictors + 1), 50.0)  # of the code length, by weight
        self.steps = 0
        self.table = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, BINS))), GATES).astype(np.float32)

    def mix(self, gate: np.ndarray, inputs: list[np.ndarray]) -> np.ndarray:
        w = self.weights.astype(np.float32)
        z = w[:, -1].take(gate, mode="clip")
        for k, x in enumerate(inputs):
            z += w[:, k].take(gate, mode="clip") * x
        return np.clip(z, -8, 8, out=z)

    @staticmethod
    def place(gate: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The refining table's lower bin and the weight of the upper one."""
        x = (z + np.float32(8)) * np.float32((BINS - 1) / 16)
        low = np.minimum(x.astype(np.int64), BINS - 2)
        return gate * BINS + low, x - low.astype(np.float32)

    def learn(self, gate: np.ndarray, inputs: list[np.ndarray], bit: np.ndarray) -> None:
        """One online step: weights move along the gradient of the code length of a block's bits, over the curvature
        met lately, and the nearest places of the table move towards what came."""
        z = self.mix(gate, inputs)
        p = 1 / (1 + np.exp(-z))
        err, bend = bit - p, np.maximum(p * (1 - p), np.float32(1e-3))
        step = np.empty_like(self.weights)
        for k, x in enumerate([*inputs, np.float32(1)]):
            step[:, k] = np.bincount(gate, err * x, GATES)
        if self.steps % 4 == 0:  # it changes slowly
            self.curve *= 0.92
            for k, x in enumerate([*inputs, np.float32(1)]):
                self.curve[:, k] += 4 * np.bincount(gate, bend * x * x, GATES)
        self.steps += 1
        # so many times the diagonal bounds the whole curvature
        self.weights += step / (self.weights.shape[1] * self.curve + 1.0)
        at, part = self.place(gate, z)
        at += part > 0.5
        # both counts of a place from one pass
        at <<= 1
        at += bit.astype(np.int64)
        both = np.bincount(at, minlength=2 * GATES * BINS).reshape(-1, 2)
        seen, ones = both[:, 0] + both[:, 1], both[:, 1]
        self.table += (0.1 * seen / (seen + 100.0) * (ones / np.maximum(seen, 1) - self.table)).astype(np.float32)
        np.clip(self.table, 1e-4, 1 - 1e-4, out=self.table)

    def log_bits(self, gate: np.ndarray, inputs: list[np.ndarray], bit: np.ndarray) -> np.ndarray:
        """ln of the probability of each bit."""
        z = self.mix(gate, inputs)
        at, part = self.place(gate, z)
        low = self.table.take(at, mode="clip")
        refined = low + part * (self.table.take(at + 1, mode="clip") - low)
        p = np.float32(0.5) / (1 + np.exp(-z)) + np.float32(0.5) * refined
        return np.log(np.abs(p - (1 - bit)))


def slots(context: np.ndarray, step: np.ndarray, groups: np.ndarray, shift: np.uint64) -> np.ndarray:
    """The slot of a table for each bit's hashed context and step. A group's slots are neighbours, in an order that the
    hash gives, so that a path meets few places of memory and slots are shared evenly."""
    h = context ^ groups
    h *= _U(0x9E3779B97F4A7C15)
    h >>= shift
    return h.view(np.int64) ^ (step >> 1 & 15)


def group_hashes(step: np.ndarray) -> np.ndarray:
    return ((step >> 25).view(np.uint64) + _U(1)) * _U(0xC2B2AE3D27D4EB4F)


def table_shift(entries: int) -> np.uint64:
    """64 less the bits of a table with room for so many entries."""
    return _U(64 - max(10, int(entries - 1).bit_length() if entries > 1 else 0))


class Stream:
    """A bucket's tokens: the leaf of each, the words before it as hashed contexts, and the last very frequent word."""

    def __init__(self, code: Code, flat: np.ndarray, after: np.ndarray, leaf: np.ndarray, before: np.ndarray, two: np.ndarray, last: np.ndarray) -> None:
        self.code, self.flat, self.after = code, flat, after
        self.leaf, self.row = leaf, last.astype(np.int64) * len(flat)
        # all that a token's score follows from: words before by 16 bits each, the leaf and the last very frequent word
        self.key = (before.astype(np.uint64) << _U(48)) | (two.astype(np.uint64) << _U(32)) | (leaf.astype(np.uint64) << _U(8)) | last.astype(np.uint64)
        first = mix(before.astype(np.uint64) + _U(0x9E37))
        self.contexts = [first, mix(first + two.astype(np.uint64) + _U(1))]
        self.shift = table_shift(0)
        self.tables = [Table(self.shift) for _ in self.contexts]

    def block(self, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
        """For tokens at these places: each bit's gate, the predictors' log-odds, its slots, the bit, and where each token's begin."""
        owner, step, bit, start = paths(self.code, self.leaf[at])
        node, groups = step >> 5 & 0xFFFFF, group_hashes(step)
        found = [slots(c[at].take(owner, mode="clip"), step, groups, self.shift) for c in self.contexts]
        (one, seen), (two, often) = (t.look(s) for t, s in zip(self.tables, found, strict=True))
        after = self.after.take(self.row[at].take(owner) + node, mode="clip") * np.float32(1 / ODDS)
        gate = (often * np.int8(LEVELS) + seen).astype(np.int64)
        return gate, [self.flat.take(node, mode="clip"), after, one, two], found, bit, start

    def learn(self, train: np.ndarray, mixer: Mixer) -> None:
        """Goes along the training tokens: each block is predicted from those before it, then learned, then counted."""
        self.shift = table_shift(int(self.code.length[self.leaf[train]].sum()) // 2)
        self.tables = [Table(self.shift) for _ in self.contexts]
        for lo in range(0, len(train), BLOCK):
            gate, x, found, bit, _ = self.block(train[lo : lo + BLOCK])
            mixer.learn(gate, x, bit.astype(np.float32))
            for t, s in zip(self.tables, found, strict=True):
                t.add(s, bit)
        for t in self.tables:
            t.close()

    def score(self, mixer: Mixer) -> np.ndarray:
        """ln of the probability of each token's leaf."""
        # what stands in one context is scored once; side by side, tokens of one context find its counts at hand
        order = np.argsort(self.key)
        key = self.key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = order[new]
        found = np.empty(len(first))
        for lo in range(0, len(first), BLOCK):
            gate, x, _, bit, start = self.block(first[lo : lo + BLOCK])
            found[lo : lo + BLOCK] = np.add.reduceat(mixer.log_bits(gate, x, bit), start)
        out = np.empty(len(order))
        out[order] = found[np.cumsum(new) - 1]
        return out


class Speller:
    """Spells words byte by byte, each closed by a space; learns from distinct words, each once."""

    def __init__(self, words: list[bytes]) -> None:
        joined = np.frombuffer(b" ".join([*words, b""]), np.uint8)
        hist = np.bincount(joined, minlength=256)
        self.code = huffman(hist)
        self.shift = table_shift(int(self.code.length[joined].sum()) // 4)
        self.tables = [Table(self.shift) for _ in range(SPELLERS)]
        self.mixer = Mixer(SPELLERS)
        order = np.random.default_rng(len(words)).permutation(len(words)).tolist()  # neighbours in a list begin alike
        words = [words[i] for i in order]
        for a, b in steps(words, SPELL_BLOCK):
            found, bit, _ = self._bits(words[a:b])
            gate, x = self._inputs(found)
            self.mixer.learn(gate, x, bit.astype(np.float32))
            for t, s in zip(self.tables, found, strict=True):
                t.add_all(s, bit)
        for t in self.tables:
            t.close()

    def _bits(self, words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Each predictor's slots, the bits, and where each word's bits begin."""
        joined = np.frombuffer(b" ".join([*words, b""]), np.uint8)
        size = np.array([len(x) + 1 for x in words])
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(joined)) - begin[owner]
        pw, inv = _power_tables(len(joined))
        total = np.concatenate([[_U(0)], np.cumsum((joined.astype(np.uint64) + _U(1)) * pw[: len(joined)])])
        held = [mix((total[:-1] - total[begin[owner]]) * inv[: len(joined)][begin[owner]] + place.astype(np.uint64))]
        wide, h = np.concatenate([np.zeros(4, np.uint8), joined]), np.zeros(len(joined), np.uint64)
        for k in range(1, 5):
            byte = wide[4 - k : 4 - k + len(joined)].astype(np.uint64)
            h = mix(h * _U(3) + np.where(place >= k, byte + _U(2), np.where(place == k - 1, _U(1), _U(0))))
            held.append(h + _U(k))
        of, step, bit, start = paths(self.code, joined)
        groups = group_hashes(step)
        return [slots(c.take(of, mode="clip"), step, groups, self.shift) for c in held], bit, start[begin]

    def _inputs(self, found: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        out, seen = zip(*(t.look(s) for t, s in zip(self.tables, found, strict=True)), strict=True)
        return (seen[4] * np.int8(LEVELS) + seen[0]).astype(np.int64), list(out)

    def score(self, words: list[bytes]) -> np.ndarray:
        """ln of the probability of each word's spelling."""
        out = np.empty(len(words))
        for a, b in steps(words, SPELL_BLOCK):
            found, bit, start = self._bits(words[a:b])
            gate, x = self._inputs(found)
            out[a:b] = np.add.reduceat(self.mixer.log_bits(gate, x, bit), start)
        return out


def join_words(w: Words, at: np.ndarray) -> bytes:
    """The words at these places, a space after each."""
    size = w.end[at] - w.start[at] + 1
    begin = np.cumsum(size) - size
    out = np.full(int(size.sum()), 0x20, np.uint8)
    inside = np.arange(len(out)) - np.repeat(begin, size)
    word = inside < np.repeat(size - 1, size)
    out[word] = w.data[(np.repeat(w.start[at], size) + inside)[word]]
    return out.tobytes()


CHUNKS = "chunk long, ids array<long>, held binary, bytes binary, n binary, tokens long, stream binary, words binary, learned binary"
TOTALS = "bucket int, hashes binary, n binary, words long, tokens long, hist array<long>"
BLOBS = "bucket int, chunk long, payload binary, words binary"
REPLIES = "chunk long, kind int, payload binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of texts: per document its id, bytes, tokens; the stream of tokens as numbers of the chunk's distinct
    words, ends included; those words with their occurrences in training texts."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, values = batch.column(batch.schema.get_field_index("doc_id")), texts(batch)
        held_all = batch.column(batch.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False).astype(bool)
        for a, b in ((x, min(x + CHUNK_ROWS, b)) for a, b in steps(values, CHUNK_BYTES) for x in range(a, b, CHUNK_ROWS)):
            w, held = Words(values[a:b]), held_all[a:b]
            found, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)  # ascending hashes
            n = np.diff(w.first) + 1
            stream = np.full(len(inverse) + (b - a), len(found), np.uint32)
            stream[np.arange(len(inverse)) + w.doc] = inverse
            learned = np.bincount(inverse[~held[w.doc]], minlength=len(found)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 22 | number], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), ids[a:b]),
                    *(pa.array([x], pa.binary()) for x in (pack(held), pack(np.array([len(v or b"") + 1 for v in values[a:b]], np.int64)), pack(n.astype(np.int64)))),
                    pa.array([len(stream)], pa.int64()),
                    *(pa.array([x], pa.binary()) for x in (pack(stream if len(found) > 65535 else stream.astype(np.uint16)), pack(np.frombuffer(join_words(w, at), np.uint8)), pack(learned))),
                ],
                [c.split()[0] for c in CHUNKS.split(", ")],
            )
            number += 1
    give_back()


def hashes_of(words: bytes) -> np.ndarray:
    """The hashes that ``Words`` gives lower-cased words with a space after each."""
    data = np.frombuffer(words, np.uint8)
    end = np.flatnonzero(data == 0x20)
    if not len(end):
        return np.zeros(0, np.uint64)
    start = np.concatenate([[0], end[:-1] + 1])
    pw, inv = _power_tables(len(data) + 1)
    held = _BYTE.take(data)
    held *= pw[: len(data)]
    held[end] = 0
    return mix(np.add.reduceat(held, start) * inv[start])


def cut(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of ascending hashes begins."""
    return np.concatenate([[0], np.searchsorted(hashes, np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)), [len(hashes)]])


@dataclass
class Vocabulary:
    """Words with a code (ascending hashes) and their leaves and counts, the code, and what follows frequent words."""

    hashes: np.ndarray
    leaf: np.ndarray
    counts: np.ndarray  # of leaves: words by frequency, then the end, then another word
    code: Code
    tokens: int
    distinct: int
    once: int  # words without a code that training texts hold once
    flat: np.ndarray  # log-odds by node alone
    after: np.ndarray | None = None  # the same after each very frequent word, in steps of 1/ODDS

    @property
    def end(self) -> int:
        return len(self.hashes)

    @property
    def other(self) -> int:
        return len(self.hashes) + 1

    def plain(self, smooth: float) -> np.ndarray:
        """log10 of leaves' smoothed shares; 0 for another word, which its own count decides."""
        out = np.log10(self.counts + 0.5) - smooth
        out[self.other] = 0
        return out

    def leaves(self, hashes: np.ndarray) -> np.ndarray:
        """The leaves of a chunk's distinct words, and of the end."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        out = np.full(len(hashes) + 1, self.other, np.int64)
        if len(self.hashes):
            out[:-1] = np.where(self.hashes[at] == hashes, self.leaf[at], self.other)
        out[-1] = self.end
        return out


def last_frequent(leaf: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each token the last very frequent word before it in its text, FREQUENT where there is none."""
    place = np.maximum.accumulate(np.where(leaf < FREQUENT, np.arange(len(leaf)), -1))
    place = np.concatenate([[-1], place[:-1]])
    return np.where(place >= np.repeat(first, n), leaf[place], FREQUENT)


class Chunk:
    """One chunk's tokens, decoded."""

    def __init__(self, row: dict, vocabulary: Vocabulary) -> None:
        self.words = unpack(row["words"])
        self.hashes = hashes_of(self.words)
        raw = unpack(row["stream"])
        self.local = np.frombuffer(raw, np.uint16 if len(raw) < 4 * row["tokens"] else np.uint32).astype(np.int64)
        self.n, self.held = columns_of(row["n"], np.int64)[0], columns_of(row["held"], bool)[0]
        self.first = np.cumsum(self.n) - self.n
        self.leaf_of = vocabulary.leaves(self.hashes)
        self.leaf = self.leaf_of[self.local]
        self.last = last_frequent(self.leaf, self.first, self.n)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)

    def before(self, values: np.ndarray, by: int, start: int) -> np.ndarray:
        """The value of the token ``by`` places before each one in its text."""
        out = np.full(len(values), start, values.dtype)
        out[by:] = np.where(self.doc[by:] == self.doc[:-by], values[:-by], values.dtype.type(start))
        return out


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def score_documents(docs: DataFrame, held_out: Column, short: int = SHORT, bucket_tokens: int = BUCKET_TOKENS, least_buckets: int = LEAST_BUCKETS) -> DataFrame:
    """Scores every whole text, learning from the rows for which ``held_out`` (over doc_id) is false.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``, a row per
    input row. A null text has its end for its only token. A row without doc_id is held out. Repeated rows count
    and are scored each; an empty table gives an empty result; other columns are not read. With nothing to learn
    from, every bit has probability a half. base_score is the smoothed unigram one; bits_per_byte is that of
    ``score`` over the text's bytes and one for its end. A word may be of any length. Equal texts get equal scores,
    but for the share of the first token where so many texts begin that several buckets count beginnings.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "lm")
    base = need(docs, doc_id="long", text="string").withColumn("held_out", F.coalesce(held_out, F.lit(True)))
    chunks = scratch.write(base.mapInArrow(read_chunks, CHUNKS), "chunks", "none")
    tokens = int(chunks.agg(F.sum("tokens")).first()[0] or 0)
    vocabulary = gather(chunks, base, tokens, scratch, short)
    vocabulary.after = follow(chunks, vocabulary)
    model = spark.sparkContext.broadcast(vocabulary)  # of a size that SHORT and FREQUENT bound
    N, V = vocabulary.tokens, vocabulary.distinct
    rare_tokens = int(vocabulary.counts[-1])
    token_buckets = max(least_buckets, -(-tokens // bucket_tokens))
    # a word that more than an eighth of a bucket follows is dealt out by the word before it too
    hot = max(10_000, -(-tokens // token_buckets) // 8)
    word_buckets = max(1, -(-V // BUCKET_WORDS))

    smooth = float(np.log10(N + 0.5 * (V + 1)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = model.value
        share = np.append(v.counts[:-1] // hot, 0) + 1
        for row in rows_of(batches):
            c = Chunk(row, v)
            name = mix(np.append(c.hashes, _END))[c.local]
            first, second = c.before(name, 1, int(_START)), c.before(name, 2, int(_START))
            # a text's first token, with nothing before, goes by the text's number
            salt = np.where(first == _START, c.doc.astype(np.uint64), second) % c.before(share[c.leaf], 1, int(share[v.end])).astype(np.uint64)
            to = ((mix(first + salt) >> _U(32)) * _U(token_buckets) >> _U(32)).astype(np.int64)
            order = np.argsort(to.astype(np.uint16) if token_buckets < 65536 else to, kind="stable")
            edge = np.searchsorted(to[order], np.arange(token_buckets + 1))
            train = ~c.held[c.doc]
            first, second = (first & _U(0xFFFF)).astype(np.uint16)[order], (second & _U(0xFFFF)).astype(np.uint16)[order]
            doc, last = c.doc[order], (c.last | (train << 7)).astype(np.uint8)[order]
            steps_ = np.diff(doc, prepend=0)
            steps_[edge[:-1][edge[:-1] < len(doc)]] = doc[edge[:-1][edge[:-1] < len(doc)]]  # a bucket's first one counts from 0
            columns = np.stack([steps_.astype("<u2"), first, second, c.leaf[order].astype("<u2")]).view(np.uint8).reshape(4, -1, 2)
            columns = np.concatenate([np.ascontiguousarray(columns.transpose(0, 2, 1)).reshape(8, -1), last[None]])
            out: list[tuple] = []
            for i in np.flatnonzero(np.diff(edge)).tolist():
                out.append((i, pack(columns[:, edge[i] : edge[i + 1]]), None))
            # words without a code go by their own hash, which ascends
            rare = np.flatnonzero(c.leaf_of[:-1] == v.other)
            plain = v.plain(smooth)[c.leaf]
            known = (v.counts[c.leaf] > 0) & (c.leaf != v.other)
            base_ = np.add.reduceat(plain, c.first) if len(plain) else np.zeros(0)
            out.append((token_buckets + word_buckets + row["chunk"] % 64, pack(base_, np.add.reduceat(known.astype(np.float64), c.first)), None))
            if len(rare):
                number = np.full(len(c.hashes) + 1, -1, np.int64)
                number[rare] = np.arange(len(rare))
                mine = np.flatnonzero(c.leaf == v.other)
                which, times = np.unique(number[c.local[mine]] * len(c.n) + c.doc[mine], return_counts=True)
                word, doc = np.divmod(which, len(c.n))
                spelled = c.words.split(b" ")
                limits = cut(c.hashes[rare], word_buckets)
                for i in np.flatnonzero(np.diff(limits)).tolist():
                    a, b = limits[i], limits[i + 1]
                    x = slice(*np.searchsorted(word, [a, b]))
                    entry = pack(steps_up(word[x] - a), doc[x].astype(np.uint32), times[x].astype(np.uint32), c.held[doc[x]])
                    words = b" ".join([*(spelled[j] for j in rare[a:b].tolist()), b""])
                    out.append((token_buckets + i, entry, pack(np.frombuffer(words, np.uint8))))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([row["chunk"]] * len(out), pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], ["bucket", "chunk", "payload", "words"])
        give_back()

    # whether another word is known: by how many of such training tokens would still be without their own occurrence
    known_share = (rare_tokens - vocabulary.once + 0.5) / (rare_tokens + 1)

    def reply(chunk: list[int], edge: np.ndarray, doc: np.ndarray, *sums: np.ndarray) -> pa.Table:
        """What a bucket adds to each document of each chunk, from tokens that stand chunk by chunk."""
        number = np.repeat(np.arange(len(chunk)), np.diff(edge))
        if ((doc[1:] < doc[:-1]) & (number[1:] == number[:-1])).any():  # words' documents; tokens' ascend in each chunk
            order = np.lexsort((doc, number))
            number, doc, sums = number[order], doc[order], tuple(x[order] for x in sums)
        start = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])]))
        some, sums = doc[start].astype(np.uint32), tuple(np.add.reduceat(x, start, dtype=np.float64) for x in sums)
        limit = np.searchsorted(number[start], np.arange(len(chunk) + 1))
        blobs = [pack(some[a:b], *(x[a:b] for x in sums)) for a, b in zip(limit[:-1].tolist(), limit[1:].tolist(), strict=True)]
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "kind": pa.array([len(sums)] * len(chunk), pa.int32()), "payload": pa.array(blobs, pa.binary())})

    def score_bucket(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        chunk, payload = table.column("chunk").to_pylist(), table.column("payload").to_pylist()
        v: Vocabulary = model.value
        bucket = table.column("bucket")[0].as_py()
        if bucket >= token_buckets + word_buckets:  # what was settled where the tokens were dealt
            return pa.table({"chunk": pa.array(chunk, pa.int64()), "kind": pa.array([0] * len(chunk), pa.int32()), "payload": pa.array(payload, pa.binary())})
        if bucket < token_buckets:
            raw = [unpack(x) for x in payload]
            n = [len(x) // 9 for x in raw]
            edge = np.concatenate([[0], np.cumsum(n)])
            doc = np.concatenate([np.cumsum(from_planes(x, k, 0)) for x, k in zip(raw, n, strict=True)])
            first, second, leaf = (np.concatenate([from_planes(x, k, at * k) for x, k in zip(raw, n, strict=True)]) for at in (2, 4, 6))
            last = np.concatenate([np.frombuffer(x, np.uint8, k, 8 * k) for x, k in zip(raw, n, strict=True)])
            del raw, payload
            stream = Stream(v.code, v.flat, v.after, leaf, first, second, last & 127)
            train = np.flatnonzero(last >> 7)
            mixer = Mixer(4)
            stream.learn(train, mixer)
            out = reply(chunk, edge, doc, stream.score(mixer) / np.log(10))
            del stream
            give_back()
            return out
        read = [columns_of(x, np.uint16, np.uint32, np.uint32, bool) for x in payload]
        held_words = [unpack(x) for x in table.column("words").to_pylist()]
        hashes = [hashes_of(x) for x in held_words]
        words = [w for x in held_words for w in x.split(b" ")[:-1]]
        start = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
        _, at, number = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        entry = number[np.concatenate([np.cumsum(x[0], dtype=np.int64) + s for x, s in zip(read, start[:-1], strict=True)])]
        doc, times, held = (np.concatenate([x[i] for x in read]) for i in (1, 2, 3))
        count = np.bincount(entry, times * ~held, len(at))
        spelled = [words[i] for i in at.tolist()]
        del words
        new = np.flatnonzero(count == 0)
        speller = Speller([w for w, n in zip(spelled, count.tolist(), strict=True) if n > 0])
        each = np.log10(np.maximum(count, 1) / max(rare_tokens, 1)) + np.log10(known_share)
        if len(new):
            each[new] = np.log10(1 - known_share) + speller.score([spelled[i] for i in new.tolist()]) / np.log(10)
        edge = np.concatenate([[0], np.cumsum([len(x[0]) for x in read])])
        out = reply(chunk, edge, doc, each[entry] * times, (np.log10(count + 0.5) - smooth)[entry] * times, (count > 0)[entry] * times)
        del speller
        give_back()
        return out

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        """A chunk's documents with the sums of what all buckets added."""
        if not left.num_rows:
            return pa.table({f.split()[0]: pa.array([], t) for f, t in zip(SCORES.split(", "), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)})
        row = left.to_pylist()[0]
        held, size, n = columns_of(row["held"], bool)[0], columns_of(row["bytes"], np.int64)[0], columns_of(row["n"], np.int64)[0]
        sums = np.zeros((3, len(n)))
        # in one order, so that sums are the same in every run
        for kind, blob in sorted(zip(right.column("kind").to_pylist(), right.column("payload").to_pylist(), strict=True)):
            if not kind:
                sums[1:] += columns_of(blob, np.float64, np.float64)
                continue
            doc, *parts = columns_of(blob, np.uint32, *[np.float64] * kind)
            for s, x in zip(sums, parts, strict=False):
                s[doc] += x
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(held), "n_tokens": pa.array(n), "n_known": pa.array(np.rint(sums[2]).astype(np.int64)), "train_tokens": pa.array(np.full(len(n), N, np.int64)), "base_score": pa.array(sums[1]), "score": pa.array(sums[0]), "bits_per_byte": pa.array(-sums[0] / np.log10(2) / size)})

    dealt = chunks.select("chunk", "held", "n", "tokens", "stream", "words").mapInArrow(deal, BLOBS)
    replies = dealt.groupBy("bucket").applyInArrow(score_bucket, REPLIES)
    return chunks.select("chunk", "ids", "held", "bytes", "n").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(settle, SCORES)


def odds(code: Code, counts: np.ndarray) -> np.ndarray:
    """Log-odds of a one at each node, from counts of leaves."""
    n = code.counts(counts)
    return np.log((n[:, 1] + 0.4) / (n[:, 0] + 0.4)).astype(np.float32)


def gather(chunks: DataFrame, base: DataFrame, tokens: int, scratch: Scratch, short: int) -> Vocabulary:
    """Counts all words of training texts, and gives a code to the most frequent ones.

    The driver receives a histogram of counts and at most ``short`` words.
    """
    buckets = max(12, -(-tokens // 5_000_000))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            n = columns_of(row["learned"], np.uint32)[0]
            hashes = hashes_of(unpack(row["words"]))[n > 0]
            n = n[n > 0]
            edge = cut(hashes, buckets)
            some = np.flatnonzero(np.diff(edge)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([hashes[edge[i] : edge[i + 1]].tobytes() for i in some], pa.binary()), pa.array([pack(n[edge[i] : edge[i + 1]]) for i in some], pa.binary())], ["bucket", "hashes", "n"])
        give_back()

    def add(table: pa.Table) -> pa.Table:
        found, at = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]), return_inverse=True)
        n = np.bincount(at, np.concatenate([columns_of(x, np.uint32)[0] for x in table.column("n").to_pylist()]), len(found)).astype(np.int64)
        hist = np.bincount(np.searchsorted(_EDGES, n), minlength=len(_EDGES))
        give_back()
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "hashes": pa.array([found.tobytes()], pa.binary()), "n": pa.array([pack(n)], pa.binary()), "words": pa.array([len(found)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64()), "hist": pa.array([hist.tolist()], pa.list_(pa.int64()))})

    parts = chunks.select("words", "learned").mapInArrow(deal, "bucket int, hashes binary, n binary")
    totals = scratch.write(parts.groupBy("bucket").applyInArrow(add, TOTALS), "totals", "none")
    sums = totals.agg(F.sum("words"), F.sum("tokens")).first()
    ends = base.where("not held_out").count()
    hist = np.zeros(len(_EDGES), np.int64)
    for r in totals.select(F.posexplode("hist").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).collect():
        hist[r.bin] = r.n
    # the lowest bin from which on all words have room
    above = np.concatenate([np.cumsum(hist[::-1])[::-1], [0]])
    floor = int(_EDGES[max(LEAST - 1, int(np.argmax(above <= min(short, SHORT)))) - 1]) + 1

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            n = columns_of(row["n"], np.int64)[0]
            some = n >= floor
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["hashes"], np.uint64)[some].view(np.int64)), pa.array(n[some])], ["hash", "n"])

    got = totals.select("hashes", "n").mapInArrow(frequent, "hash long, n long").toArrow()
    hashes = got.column("hash").to_numpy().astype(np.int64).view(np.uint64)
    n = got.column("n").to_numpy().astype(np.int64)
    order = np.lexsort((hashes, -n))  # leaves go by frequency
    total = int(sums[1] or 0) + ends
    counts = np.concatenate([n[order], [ends], [total - ends - int(n.sum())]]).astype(np.int64)
    leaf = np.argsort(hashes[order], kind="stable")
    scratch.drop(totals)
    code = huffman(counts)
    return Vocabulary(hashes[order][leaf], leaf.astype(np.int64), counts, code, total, int(sums[0] or 0) + (ends > 0), int(hist[0]), odds(code, counts))


def follow(chunks: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Log-odds of nodes after each very frequent word, from all training tokens: one matrix a task, summed by rows."""
    v = chunks.sparkSession.sparkContext.broadcast(vocabulary)
    leaves = len(vocabulary.counts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, some = np.zeros((FREQUENT + 1) * leaves, np.int32), False
        for row in rows_of(batches):
            c, some = Chunk(row, v.value), True
            train = ~c.held[c.doc]
            np.add.at(table, c.last[train] * leaves + c.leaf[train], 1)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(FREQUENT + 1, dtype=np.int32)), pa.array([pack(x) for x in table.reshape(FREQUENT + 1, -1)], pa.binary())], ["word", "n"])
        give_back()

    def add(table: pa.Table) -> pa.Table:
        out = np.zeros(leaves, np.int64)
        for x in table.column("n").to_pylist():
            out += columns_of(x, np.int32)[0]
        return pa.table({"word": table.column("word")[:1], "n": pa.array([pack(out)], pa.binary())})

    got = chunks.select("held", "n", "tokens", "stream", "words").mapInArrow(count, "word int, n binary").groupBy("word").applyInArrow(add, "word int, n binary")
    n = np.zeros((leaves, FREQUENT + 1), np.int64)
    for r in got.toLocalIterator():
        n[:, r.word] = columns_of(r.n, np.int64)[0]
    v.unpersist()
    return np.clip(np.rint(odds(vocabulary.code, n) * ODDS), -127, 127).astype(np.int8).T.reshape(-1).copy()
