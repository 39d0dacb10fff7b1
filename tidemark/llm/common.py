"""Helpers that the operators share: shared scratch tables, Arrow plumbing and word hashing.

Words are `[^\\x20\\x09-\\x0D]+` over the UTF-8 bytes of a text; a null text has none. Hashes are
the same on every machine, so they can meet in a shuffle.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import math
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BATCH_BYTES = 4 << 20
STRETCH = 1 << 20


# -- scratch ------------------------------------------------------------------------------------


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset and all runs in this machine, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


@contextlib.contextmanager
def light_batches(spark: SparkSession):
    """Arrow batches of at most BATCH_BYTES while tables are written inside; then as the caller had it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_UNDER: contextvars.ContextVar[str | None] = contextvars.ContextVar("tidemark-scratch", default=None)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch_under(spark: SparkSession, path: str):
    """Scratch tables made inside lie under path, and go at the end: what was read of them must be written by then."""
    token = _UNDER.set(path)
    try:
        yield
    finally:
        _UNDER.reset(token)
        remove(spark, path)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{_UNDER.get() or shared_dir(spark) + '/tidemark'}/{name}-{uuid.uuid4().hex}"
    with light_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(df: DataFrame, target: int = 16 << 20) -> int:
    """How many shuffle parts so that each covers about `target` bytes of df's texts, which it has as `__text`.

    The texts are measured, in a scan of that column: sizes of files say little where they are compressed.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    size = df.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    return max(least, math.ceil(size / target))


# -- Arrow --------------------------------------------------------------------------------------


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def texts_of(arr: pa.Array) -> list[str]:
    return [x or "" for x in arr.to_pylist()]


def slices(batch: pa.RecordBatch, name: str, most: int = 8 << 20):
    """Cut a batch so that column `name` has about `most` bytes in each piece; a longer row stands alone."""
    size = np.asarray(pc.fill_null(pc.binary_length(column(batch, name)), 0)).astype(np.int64)
    at, n = 0, len(size)
    ends = np.cumsum(size)
    while at < n:
        base = ends[at] - size[at]
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


# -- hashing ------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer, a bijection of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_POW: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if len(_POW["up"]) >= n:
        return _POW["up"], _POW["down"]
    size, out = max(n, (1 << 20) + (1 << 16)), []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        step = np.full(size, b, U64)
        step[0] = 1
        out.append(np.multiply.accumulate(step))
    if n <= 1 << 22:  # longer ones, of single huge words, are not kept
        _POW["up"], _POW["down"] = out
    return out[0], out[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] the polynomial hash of data[s:e], times base**s."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words:
    """The words of many texts: hash of each, and `at`, the index of each text's first word (and the end).

    Bytes are hashed in stretches of about STRETCH that end between words, so that a very long text takes no
    more memory a byte than its words do.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        made, a, n = [], 0, len(data)
        while a < n:
            b = a + STRETCH
            while b < n:
                space = np.flatnonzero(_SPACE[data[b : b + STRETCH]])
                if len(space):
                    b += int(space[0])
                    break
                b += STRETCH
            b = min(b, n)
            made.append(self._stretch(data[a:b], offs[np.searchsorted(offs, a) : np.searchsorted(offs, b, "right")] - a, lower, a))
            a = b
        none = np.zeros(0, np.int64)
        self.hash, self.start, self.end = (np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0, U64), none, none)
        self.at = np.searchsorted(self.start, offs)

    @staticmethod
    def _stretch(data: np.ndarray, offs: np.ndarray, lower: bool, base: int):
        if lower:
            data = _LOWER[data]
        n = len(data)
        word = ~_SPACE[data]
        first = np.zeros(n + 1, bool)
        first[offs] = True
        start = word.copy()
        start[1:] &= ~word[:-1] | first[1:n]
        end = word.copy()
        end[:-1] &= ~word[1:] | first[1:n]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        p, down = prefix_hashes(data), powers(n + 1)[1]
        return mix((p[e] - p[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)), s + base, e + base

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, place in the text) of each run of k words that lies in one text."""
        n = len(self.hash)
        count = np.diff(self.at)
        doc = np.repeat(np.arange(len(count)), count)
        if n < k:
            return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = self.hash[: n - k + 1].copy()
        for j in range(1, k):
            h *= U64(_BASE)
            h += self.hash[j : n - k + 1 + j]
        place = np.arange(n) - self.at[doc]
        ok = doc[: n - k + 1] == doc[k - 1 :]
        return mix(h[ok] + U64(k)), doc[: n - k + 1][ok], place[: n - k + 1][ok]


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """A part in 0..parts-1 by the high bits of a hash."""
    return (((h >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int32)
