"""Best-fit-decreasing packing of token sequences, planned on counts of lengths.

Pieces of equal length are interchangeable, and so are bins of equal room. Best-fit decreasing is therefore run
once over the histogram of lengths (at most ``capacity`` rows, whatever the corpus): a segment tree over the
rooms that open bins have left gives the tightest that fits in logarithmic time, and a whole run of equal pieces
goes to a whole run of equal bins in one step. The plan is then applied in parallel to pieces ranked within
their length. The result is that of best-fit decreasing document by document.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, cache, column, need, shuffle_partitions, texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words whose ids a task remembers at most.
CACHE_WORDS = 400_000
#: A space beside other white space, which then splits together with it.
_DOUBLE, _BESIDE = re.compile(r"\s\s"), re.compile(r" \s|\s ")
#: Fixed value: the splitting pattern of this byte-level vocabulary.
_SPLIT = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit numbers.

    Byte-level BPE never merges across the pieces that its splitting pattern makes, and each piece begins at a
    single space or lies between two. So what stands between two spaces is encoded once and remembered. A text
    with other white space beside a space is encoded as a whole, one that holds a special token by the tokenizer
    itself, and so is everything where the tokenizer is of another kind. The merges run in a compiled encoder
    that is given this tokenizer's own vocabulary.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_word = spec.get("normalizer") is None and not spec.get("truncation") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model["type"] == "BPE"
        if self.by_word:
            byte = _byte_of()
            ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
            merged = [ranks[bytes(byte[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
            self.by_word = merged == sorted(merged)  # ids in the order of merges
            self.fast = tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, text: str) -> bytes:
        return array("I", self.fast.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_word or any(s in text for s in self.special):
            return self._ids(text)
        if _DOUBLE.search(text) and _BESIDE.search(text):
            return self._merged(text)
        head, *rest = text.split(" ")
        known = self.known
        got = list(map(known.get, rest))
        if None in got:
            at = -1
            for _ in range(got.count(None)):
                at = got.index(None, at + 1)
                word = rest[at]
                if (b := known.get(word)) is None:
                    b = self._merged(" " + word)
                    if len(known) < CACHE_WORDS:
                        known[word] = b
                got[at] = b
        return (self._merged(head) if head else b"") + b"".join(got)


_encoders: dict[str, Encoder] = cache("packing")


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids_crc32`` (and ``ids`` if asked for).

    A null text counts as empty; its only token is ``end_id`` (with ``end_id=None`` an empty text has no piece).
    A document of more than ``capacity`` tokens is cut into pieces of that many; its first piece is shorter if
    the number does not divide. Repeated rows give repeated pieces.
    """
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    wide = 4 * capacity

    def run(batch: pa.RecordBatch):
        enc = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        ids = column(batch, "doc_id").to_pylist()
        values = [(v or b"").decode("utf-8", "replace") for v in texts(batch)]
        out: list[list] = [[], [], [], [], [], []]

        def made() -> dict:
            got = dict(zip(("doc_id", "piece", "start", "length", "ids_crc32", "ids"), out, strict=True))
            if with_ids:
                got["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in out[5]], pa.list_(pa.int32()))
            return got

        for i, value in zip(ids, values, strict=True):
            b = enc.encode(value) + end
            at, piece = 0, 0
            while at < len(b):
                stop = at + ((len(b) - at - 1) % wide + 1 if piece == 0 else wide)
                part = b[at:stop]
                for o, x in zip(out, (i, piece, at // 4, (stop - at) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                    o.append(x)
                at, piece = stop, piece + 1
            if len(out[0]) >= 50_000 or with_ids and len(out[0]) >= 500:
                yield made()
                for o in out:
                    o.clear()
        yield made()

    return arrow_map(need(docs, doc_id="long", text="string"), run, PIECES + ", ids array<int>" * with_ids, "packing")


class RoomTree:
    """A segment tree over rooms 0..capacity; a leaf holds whether open bins have that much room left."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << (capacity + 1).bit_length()
        self.any = np.zeros(2 * self.size, bool)

    def set(self, room: int, value: bool) -> None:
        at = room + self.size
        self.any[at] = value
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int:
        """The smallest room of at least ``least`` that some bin has, or -1."""
        at = least + self.size
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return -1
        while at < self.size:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.size


def plan_best_fit(lengths: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over a histogram. Returns steps and the number of bins.

    A step (length, low, high, first_bin, each, used): pieces of a length ranked low..high-1 go, ``each`` at a
    time, to consecutive bins from ``first_bin``, which held ``used`` tokens before.
    """
    tree, open_bins = RoomTree(capacity), {}
    steps: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            open_bins.setdefault(room, []).append((first, count))
            tree.set(room, True)

    for length in sorted(lengths, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        left, low = lengths[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                # as many new bins as the rest fills; each takes what fits before the next opens
                room, each = capacity, capacity // length
                first, count = bins, -(-left // each)
                bins += count
            else:
                each = room // length
                first, count = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    tree.set(room, False)
            full = min(count, left // each)
            if full:
                steps.append((length, low, low + full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                low += full * each
                left -= full * each
            if left and full < count:
                steps.append((length, low, low + left, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                put(room, first + full + 1, count - full - 1)
                low, left = low + left, 0
            elif full < count:
                put(room, first + full, count - full)
    return steps, bins


def pack(pieces: DataFrame, capacity: int = 2048, salts: int | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (``doc_id, piece, length`` and more columns are kept).

    The lengths' counts alone come to the driver (``capacity`` rows at most), and the plan that goes to tasks has
    a few steps a length. A length that a third of all pieces share is ranked in ``salts`` parts, each in a task
    of its own. ``pieces`` is read twice and must give the same rows each time: pass a written table.
    """
    spark = pieces.sparkSession
    salts = salts or max(64, shuffle_partitions(spark))
    counts = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}
    steps, _ = plan_best_fit(counts, capacity)
    plan = np.array(sorted(steps), np.int64).reshape(-1, 6)

    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    parts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = parts.select("length", "_salt", (F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_salt", "_before")
    kept = [f for f in pieces.schema.fields]

    def place(batch: pa.RecordBatch) -> dict:
        length = column(batch, "length").to_numpy(zero_copy_only=False)
        rank = column(batch, "_rank").to_numpy(zero_copy_only=False)
        low = np.searchsorted(plan[:, 0], length, "left")
        high = np.searchsorted(plan[:, 0], length, "right")
        at = np.empty(len(length), np.int64)
        for v in np.unique(length):
            here = length == v
            a, b = low[here][0], high[here][0]
            at[here] = a + np.searchsorted(plan[a:b, 1], rank[here], "right") - 1
        step = plan[at]
        turn = rank - step[:, 1]
        out = {f.name: column(batch, f.name) for f in kept}
        return out | {"sequence_id": step[:, 3] + turn // step[:, 4], "offset": step[:, 5] + turn % step[:, 4] * length}

    schema = type(pieces.schema)([*kept]).add("sequence_id", "long").add("offset", "long")
    return arrow_map(ranked.select(*(f.name for f in kept), "_rank"), place, schema)


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 0) -> DataFrame:
    """Tokenizes and packs: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, a row a piece.

    Texts are tokenized once; the pieces' table, without ids, is written to the shared folder. An empty table
    gives an empty result. Documents' other columns are not read. A null doc_id is kept as it is.
    """
    scratch = Scratch(spark, "packing")
    return pack(scratch.write(tokenize(docs, tokenizer, capacity, end_id), "pieces"), capacity)
