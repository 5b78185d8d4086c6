"""Helpers shared by the training-data operators: scratch tables, columns, hashed words."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one vectorised step works on; temporaries take about 60 times as much.
STEP_BYTES = 1 << 18
#: Bytes of rows that one Arrow batch brings to Python; a longer text comes alone.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares, from ``spark.checkpoint.dir``.

    Where that is unset a session on one machine gets a folder of its own; on a cluster, whose executors would not
    see it, this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches in this session, unless it holds a lower bound itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    with contextlib.suppress(Exception):  # a session that forbids it keeps its own
        if int(re.sub(r"\D", "", spark.conf.get(key, "") or "0") or 0) not in range(1, BATCH_BYTES + 1):
            spark.conf.set(key, str(BATCH_BYTES))


_CACHES: dict[str, dict] = {}


def cache(name: str) -> dict:
    """What an operator's workers keep from task to task; other operators' tasks drop it."""
    return _CACHES.setdefault(name, {})


def drop_caches(keep: str | None = None) -> None:
    """Drops what other operators have left in this worker."""
    if any(held and name != keep for name, held in _CACHES.items()):
        for name, held in _CACHES.items():
            if name != keep:
                held.clear()
        give_back()


def give_back() -> None:
    """Returns freed memory to the system, as a worker stays beside its executor when its task has ended."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Scratch:
    """Tables that cut lineage, written below the shared folder.

    A lost executor loses none of them: whatever reads them later starts from the files. ``drop`` removes a
    table as soon as no later step reads it. What the returned result reads stays in the shared folder, whose owner
    removes it when the session has ended: a lazy result may be read at any time before.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def write(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame | str) -> None:
        for t in tables:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t._scratch_path)  # type: ignore[attr-defined]
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fewer(df: DataFrame, share: int = 3) -> DataFrame:
    """``df`` in a third (or other share) of the shuffle partitions at most, but two for each core; a task takes several, one after the other.

    For tables that are written with a file for each partition: for every file on a local file system Hadoop starts
    three processes beside its executor.
    """
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-shuffle_partitions(df.sparkSession) // share)))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` has none of, in either case of letters."""
    held, out = {c.lower() for c in df.columns}, []
    for n in names:
        while (n := f"_{n}").lower() in held:
            pass
        held.add(n.lower())
        out.append(n)
    return out


def need(df: DataFrame, **types: str) -> DataFrame:
    """The named columns alone, cast; a column that clashes with an operator's own names is thus left out."""
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict | None], schema: T.StructType | str, keep: str | None = None) -> DataFrame:
    """``fn`` turns each batch into columns (or several such); an operator without shuffle. ``keep``: its ``cache``."""
    bounded_batches(df.sparkSession)
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches(keep)
        for b in batches:
            if not b.num_rows:
                continue
            got = fn(b)
            for cols in [got] if isinstance(got, dict) else got or ():
                yield pa.RecordBatch.from_arrays([c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, f.type) for f in out_schema], schema=out_schema)
        give_back()

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A text column's UTF-8 bytes, without decoding."""
    c = column(batch, name)
    return c.cast(pa.large_binary() if pa.types.is_large_string(c.type) else pa.binary()).to_pylist()


def steps(values: list[bytes | None], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer text makes a range of its own."""
    start = total = 0
    for i, v in enumerate(values):
        n = len(v or b"")
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(values):
        yield start, len(values)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(1 << 16, _BASE)
_INV = _powers(1 << 16, pow(_BASE, -1, 1 << 64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if n > len(_POW):
        m = 1 << int(n - 1).bit_length()
        _POW, _INV = _powers(m, _BASE), _powers(m, pow(_BASE, -1, 1 << 64))
    return _POW, _INV


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of many texts, A-Z lower-cased, with a 64-bit hash each.

    data: the lower-cased bytes; start, end: of each word in data; doc: its text's place; first: the place of
    each text's first word, with the number of words at the end; hash: equal for equal words.
    """

    def __init__(self, values: list[bytes | None]) -> None:
        joined = np.frombuffer(b"\n".join(v or b"" for v in values) + b"\n", np.uint8)
        self.data = _LOWER[joined]
        self.offsets = np.concatenate([[0], np.cumsum([len(v or b"") + 1 for v in values])]).astype(np.int64)
        space = _SPACE[joined]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(values)), np.diff(self.first))
        pw, inv = _power_tables(len(joined) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[self.data] * pw[: len(joined)])])
        self.hash = mix((total[self.end] - total[self.start]) * inv[self.start])

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words inside one text, and their texts; of a shorter text, its whole sequence."""
        n = np.diff(self.first)
        size = np.where(n >= k, k, n)
        count = np.where(n > 0, n - size + 1, 0)
        doc = np.repeat(np.arange(len(n)), count)
        at = self.first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        wide = size[doc]
        out = np.zeros(len(doc), np.uint64)
        padded = np.concatenate([self.hash, np.zeros(k, np.uint64)])
        for i in range(k):
            part = mix(padded[at + i] + _U((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            out += part if (wide > i).all() else np.where(wide > i, part, _U(0))
        return mix(out + wide.astype(np.uint64)), doc


def distinct_sets(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, one text after the other, and where each text's begin."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h, np.searchsorted(d, np.arange(n + 1))


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def crc_mod(column_name: str, n: int) -> F.Column:  # type: ignore[name-defined]
    """crc32 of an id's decimal text, modulo n: the folds of the contracts."""
    return F.crc32(F.col(column_name).cast("string").cast("binary")) % n
