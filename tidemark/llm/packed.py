"""Compact rows for shuffles of very many (hash, text, place) triples.

A map task packs the triples of a slice of texts into one binary per part: per text its columns, then
per triple the place (as a difference, compressed) and the low bytes of the hash, whose high bits are
mostly given by the part. A part's task unpacks all its binaries and sorts plain arrays.

A binary of a row is a run of parcels, each behind its length: a map task gathers the parcels of many slices before
they leave it, so rows are as many as the blocks of the shuffle itself, not slices x parts.

Beyond ONE_STEP parts triples travel in two steps (`dealt`): to groups of parts, as many as a group has parts, and from there,
32 MB at a time, to the parts. A slice makes a parcel a group, so the work a triple stays nearly the same at any number of parts.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, U64, column, part_of

HOLD = 32 << 20
#: Parts up to which a slice sends to each part itself.
ONE_STEP = 4096


def steps(parts: int) -> tuple[int, int]:
    """(first receivers, parts of each): the parts themselves, or groups of them where a slice would have too little for each."""
    span = 1 if parts <= ONE_STEP else math.isqrt(parts - 1) + 1
    return -(-parts // span), span


def chunks(h: np.ndarray, text: np.ndarray, parts: int, per_text: list[np.ndarray], place: np.ndarray | None, width: int, span: int = 1):
    """(part // span, binary) pairs. text: ascending indexes into the arrays of per_text (int64 each).

    All columns are made for the whole slice at once; what is left for a binary is to cut and compress its bytes.
    """
    if not len(h):
        return
    part = part_of(h, parts) // span
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    part, t = part[order], text[order]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    new = np.r_[True, t[1:] != t[:-1]]
    new[cut] = True
    head = np.flatnonzero(new)
    first = np.searchsorted(head, cut)
    columns = [np.diff(np.r_[head, len(t)]).astype(np.uint32)]
    for values in per_text:
        own = values[t[head]]
        step = np.diff(own, prepend=0)
        step[first] = own[first]
        columns.append(step)
    if place is not None:
        own = place[order]
        step = np.diff(own, prepend=0)
        step[head] = own[head]
        step = step.astype(np.uint32).view(np.uint8).reshape(-1, 4)
    body = memoryview(np.ascontiguousarray(h[order].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
    ends, last = np.r_[cut, len(t)].tolist(), np.r_[first, len(head)].tolist()
    squeeze = zstandard.ZstdCompressor(level=1)
    for i, p in enumerate(part[cut].tolist()):
        a, b, x, y = ends[i], ends[i + 1], last[i], last[i + 1]
        meta = [c[x:y].tobytes() for c in columns]
        if place is not None:
            meta.append(step[a:b].T.tobytes())
        m = squeeze.compress(b"".join(meta))
        yield p, b"".join((struct.pack("<5I", y - x, b - a, len(per_text), place is not None, len(m)), m, body[a * width : b * width]))


def unpack(binaries: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray | None]:
    """(hashes, text index, per-text columns, places) of all binaries of one part."""
    hs, texts, columns, places, base = [], [], [], [], 0
    expand = zstandard.ZstdDecompressor()
    for raw in binaries:
        n_text, n, n_cols, has_place = np.frombuffer(raw, "<u4", 4).tolist()
        size = int.from_bytes(raw[16:20], "little")
        meta = expand.decompress(raw[20 : 20 + size])
        count = np.frombuffer(meta, np.uint32, n_text).astype(np.int64)
        at = 4 * n_text
        own = []
        for _ in range(n_cols):
            own.append(np.cumsum(np.frombuffer(meta, np.int64, n_text, at)))
            at += 8 * n_text
        columns.append(own)
        texts.append(np.repeat(np.arange(base, base + n_text, dtype=np.int32), count))
        if has_place:
            step = np.ascontiguousarray(np.frombuffer(meta, np.uint8, 4 * n, at).reshape(4, n).T).view(np.uint32)[:, 0].astype(np.int64)
            total = np.cumsum(step)
            head = np.cumsum(count) - count
            before = total[head] - step[head]
            places.append((total - np.repeat(before, count)).astype(np.uint32))
        h = np.zeros((n, 8), np.uint8)
        h[:, :width] = np.frombuffer(raw, np.uint8, n * width, 20 + size).reshape(n, width)
        hs.append(h.view("<u8")[:, 0])
        base += n_text
    if not hs:
        return np.zeros(0, U64), np.zeros(0, np.int32), [], None
    merged = [np.concatenate([c[i] for c in columns]) for i in range(len(columns[0]))]
    return np.concatenate(hs), np.concatenate(texts), merged, np.concatenate(places) if places else None


def gather(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indexes of runs of `count` from `first`, one run after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def planes(values: np.ndarray) -> bytes:
    """values with their first bytes together, then their second ones, and so on: columns compress well so."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def from_planes(raw: bytes, dtype) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


def bundles(values: np.ndarray, owner: np.ndarray, keys: np.ndarray, parts: int) -> tuple[list[int], list[bytes]]:
    """(part, binary) of values by their owners' keys: one binary for all keys of a part. owner: ascending."""
    count = np.bincount(owner, minlength=len(keys))
    has = np.flatnonzero(count)
    if not len(has):
        return [], []
    first = (np.cumsum(count) - count)[has]
    count, own = count[has], keys[has]
    dest = np.mod(own, parts)
    order = np.argsort(dest, kind="stable")
    values = values[gather(first[order], count[order])]
    dest, own, count = dest[order], own[order], count[order]
    at, to = np.searchsorted(dest, np.arange(parts + 1)), np.r_[0, np.cumsum(count)]
    where, bodies = [], []
    for p in np.flatnonzero(np.diff(at)).tolist():
        a, b = at[p], at[p + 1]
        where.append(p)
        bodies.append(int(b - a).to_bytes(4, "little") + own[a:b].astype("<i8").tobytes() + count[a:b].astype("<u4").tobytes() + planes(values[to[a] : to[b]]))
    return where, bodies


def unbundle(bodies: list[bytes], dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, ends, values): values[ends[i]:ends[i + 1]] are those of key i."""
    keys, counts, values = [], [], []
    for raw in bodies:
        n = int.from_bytes(raw[:4], "little")
        keys.append(np.frombuffer(raw, "<i8", n, 4))
        counts.append(np.frombuffer(raw, "<u4", n, 4 + 8 * n).astype(np.int64))
        values.append(from_planes(raw[4 + 12 * n :], dtype))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, dtype)
    key, count, flat = np.concatenate(keys), np.concatenate(counts), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    flat = flat[gather((np.cumsum(count) - count)[order], count[order])]
    own, at = np.unique(key[order], return_index=True)
    ends = np.r_[0, np.cumsum(count[order])]
    return own, np.r_[ends[at], ends[-1]], flat


def merged(dtype, name: str, reduce=None):
    """A mapInArrow function: rows (__body) of a part to one row (__key, name) a key, its values in one binary.

    reduce: replaces (ends, values) by those that are to be kept.
    """

    def run(batches):
        bodies = [x for batch in batches for x in parcels(batch)]
        keys, ends, values = unbundle(bodies, dtype)
        del bodies
        if reduce:
            ends, values = reduce(ends, values)
        step = 10_000
        for s in range(0, len(keys), step):
            few = ends[s : s + step + 1]
            offs = ((few - few[0]) * values.itemsize).astype(np.int64)
            flat = pa.Array.from_buffers(pa.large_binary(), len(few) - 1, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(values[few[0] : few[-1]].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(keys[s : s + step]), flat.cast(pa.binary())], names=["__key", name])

    return run


def rows(parts: list[int], bodies: list[bytes], settled: bool) -> pa.RecordBatch:
    """Rows for a part: settled ones are bundles on their way to merged(), the others wait for an answer. A body becomes a parcel."""
    framed = [len(x).to_bytes(4, "little") + x for x in bodies]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([settled] * len(parts), pa.bool_()), pa.array(framed, pa.binary())], names=["__part", "__settled", "__body"])


SCHEMA = "__part int, __settled boolean, __body binary"


def parcels(batch: pa.RecordBatch) -> list[memoryview]:
    """The bodies given to rows(), of all rows of a batch."""
    out = []
    for raw in column(batch, "__body").to_pylist():
        raw, at = memoryview(raw), 0
        while at < len(raw):
            n = int.from_bytes(raw[at : at + 4], "little")
            out.append(raw[at + 4 : at + 4 + n])
            at += 4 + n
    return out


def gathered(batches, most: int = HOLD):
    """Batches of rows(), with one row a part and kind for about every `most` bytes that a task sends."""
    held: dict[tuple[bool, int], list[bytes]] = {}
    size = 0

    def emit():
        keys, bodies, n = [], [], 0
        for key in sorted(held):
            body = b"".join(held.pop(key))
            keys.append(key)
            bodies.append(body)
            n += len(body)
            if n >= BATCH_BYTES or not held:
                yield pa.RecordBatch.from_arrays([pa.array([p for _, p in keys], pa.int32()), pa.array([s for s, _ in keys], pa.bool_()), pa.array(bodies, pa.binary())], names=["__part", "__settled", "__body"])
                keys, bodies, n = [], [], 0

    for batch in batches:
        for part, settled, body in zip(*(column(batch, c).to_pylist() for c in ("__part", "__settled", "__body")), strict=True):
            held.setdefault((settled, part), []).append(body)
            size += len(body)
        if size >= most:
            yield from emit()
            size = 0
    yield from emit()


def split(batches):
    """(batches of settled rows, to be passed on; list of the other bodies, complete once the batches are used up)."""
    waiting: list[memoryview] = []

    def settled():
        for batch in batches:
            own = column(batch, "__settled")
            waiting.extend(parcels(batch.filter(pc.invert(own))))
            passed = batch.filter(own)
            if len(passed):
                yield passed.select(["__part", "__settled", "__body"])

    return settled(), waiting


def dealt(asked: DataFrame, parts: int, width: int) -> DataFrame:
    """Rows by part. asked: rows of gathered(), whose triples chunks() made for steps(parts), with all eight bytes if they are groups."""
    groups, span = steps(parts)
    if span > 1:

        def deal(bodies):
            h, text, per_text, place = unpack(bodies, 8)
            sent = list(chunks(h, text, parts, per_text, place, width))
            return rows([p for p, _ in sent], [b for _, b in sent], False)

        def again(batches):
            held, size = [], 0
            for batch in batches:
                own = column(batch, "__settled")
                yield batch.filter(own).select(["__part", "__settled", "__body"])
                for body in parcels(batch.filter(pc.invert(own))):
                    held.append(body)
                    size += len(body)
                    if size >= HOLD // 2:
                        yield deal(held)
                        held, size = [], 0
            if held:
                yield deal(held)

        group = F.when(F.col("__settled"), F.floor(F.col("__part") / span)).otherwise(F.col("__part")).cast("int")
        asked = asked.repartitionById(groups, group).mapInArrow(lambda batches: gathered(again(batches)), SCHEMA)
    return asked.repartitionById(parts, F.col("__part"))
