"""Suffix-array dedup by merging shard Burrows-Wheeler transforms.

A byte goes when it lies in a string of `size` bytes that starts anywhere else too. Only suffixes that
can share so much are merged, in shards that meet in one place:

1. Every window of `size` bytes has an anchor, the leftmost least hash of its k-grams; equal windows have
   equal anchors. Anchors (about one in ninety bytes) are counted over the whole input from packed rows.
2. Runs of windows with one anchor that occurs again send their bytes to the part of that anchor. Equal
   runs (compared as bytes) are one string from there on: in a slice of documents before they are sent, in
   a part while they arrive, so a passage of very many documents takes the room of one.
3. In a part, the runs that share their anchor with a different run are the strings to be merged, in shards
   of about SHARD bytes. A symbol is a string of up to eight bytes, of an alphabet in byte order. A shard has its
   suffix order up to `size` bytes, by prefix doubling over symbols, and its transform (`Shard`): the symbol
   before each suffix, and the row of the suffix that begins there. Its own repeated windows follow from the order.
   Shards are then merged by their transforms alone (`merge`): the alphabets first, then the interleave, which starts with
   the shards one after the other, each in its order. Each pass deals it stably by the symbols before the suffixes,
   which gives the interleave of the suffixes one symbol further left; no text is read and no suffix compared. A border
   falls between neighbours where the dealt symbol or an earlier border separates them: they part at that common
   prefix. Of an interval whose suffixes all come from one shard, that shard knows order and common prefixes
   already, so it leaves. What is left after size bytes are the intervals of common prefix `size` or more.
   A shard hands on one suffix of each interval of its own; suffixes that lead to no window are left out from the start.

Texts are UTF-8 bytes; matches never cross documents. Defined results: a null or empty text has no bytes and no
spans; texts under `size` bytes keep all; rows with equal ids count as different places, each judged on its own, so
repeated rows of `size` bytes lose all; texts of any length are hashed in stretches of SPAN; an empty table gives no
rows; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, column, mix, part_of, parts_for, powers, prefix_hashes, scratch, slices, utf8
from .packed import SCHEMA, bundles, chunks, dealt, gather, gathered, merged, rows, split, steps, unpack
from .relative_lz import LAST

SIZE = 200
GRAM = 24
SPAN = 1 << 20
SHARD = 1 << 18
WIDTH = 7


def runs(data: np.ndarray, offs: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, anchor's hash) of each run of windows with one anchor."""
    first, last, anchor, hashes = [], [], [], []
    width = size - gram + 1
    for base in range(0, max(len(data) - size + 1, 0), SPAN - size):
        part = data[base : base + SPAN]
        if len(part) < size:
            break
        p = prefix_hashes(part)
        n = len(part) - gram + 1
        h = p[gram:] - p[:n]
        del p
        h *= powers(len(part) + 1)[1][:n]
        h = mix(h)
        m = (h & ~U64(SPAN - 1)) | np.arange(n, dtype=U64)
        span = 1
        while span < width:
            step = min(span, width - span)
            m = np.minimum(m[:-step], m[step:])
            span += step
        own = (m & U64(SPAN - 1)).astype(np.int64)
        bad = np.zeros(len(own) + size, np.int32)
        ends = offs[1:-1] - base  # a window over a border between texts is none
        ends = ends[(ends > 0) & (ends < len(part))]
        np.add.at(bad, np.maximum(ends - size + 1, 0), 1)
        np.add.at(bad, np.minimum(ends, len(bad) - 1), -1)
        at = np.flatnonzero(np.cumsum(bad)[: len(own)] == 0)
        if base + len(part) < len(data):  # the next stretch has the rest
            at = at[at < SPAN - size]
        if not len(at):
            continue
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (own[at[1:]] != own[at[:-1]])])
        first.append(at[new] + base)
        last.append(at[np.r_[new[1:] - 1, len(at) - 1]] + base)
        anchor.append(own[at[new]] + base)
        hashes.append(mix(h[own[at[new]]] + U64(0x9E3779B97F4A7C15)))  # least hashes have few high bits; parts need even ones
    if not first:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, U64)
    return np.concatenate(first), np.concatenate(last), np.concatenate(anchor), np.concatenate(hashes)


def stride(size: int) -> int:
    """Bytes of a symbol: the largest divisor of size up to eight."""
    return max(x for x in range(1, 9) if size % x == 0)


def _ranks(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each pair, 0 for (0, 0), else from 1; the places by rank, equal ones by place). Values up to their number."""
    n, bits = len(first), len(first).bit_length()
    if 3 * bits <= 64:
        key = first.astype(U64) << U64(2 * bits) | second.astype(U64) << U64(bits) | np.arange(n, dtype=U64)
        key.sort()
        at = (key & U64((1 << bits) - 1)).astype(np.int64)
        key >>= U64(bits)
    else:
        at = np.lexsort((second, first))
        key = first[at].astype(U64) << U64(32) | second[at].astype(U64)
    rank = np.empty(n, np.int64)
    rank[at] = np.cumsum(np.r_[key[:1] != 0, key[1:] != key[:-1]])
    return rank, at


class Shard:
    """Strings, one after the other, their suffix order and its transform.

    Rows are suffixes in order. first: the symbol a suffix begins with (0: its string ends before one is full);
    symbol: the transform, the symbol before it (0: none in its string); left: the row of the suffix that begins
    there. Symbols count from 1 in alphabet, the sorted distinct ones. windows: places of the windows, rank: the interval
    of common prefix `size` or more each is in, twice: whether it holds another window. leads, lead_rank: place and rank of
    one window of each interval.
    """

    __slots__ = ("lengths", "windows", "rank", "twice", "leads", "lead_rank", "row", "order", "alphabet", "first", "symbol", "left")

    def __init__(self, strings: list[bytes], size: int, step: int):
        text = np.frombuffer(b"".join(strings), np.uint8)
        self.lengths = np.array([len(x) for x in strings])
        n, place = len(text), np.arange(len(text))
        stop = np.repeat(np.cumsum(self.lengths), self.lengths)
        key = np.zeros(n - step + 1, U64)
        for j in range(step):
            key <<= U64(8)
            key |= text[j : n - step + 1 + j]
        full = np.flatnonzero(place + step <= stop)
        self.alphabet, inverse = np.unique(key[full], return_inverse=True)
        code = np.zeros(n, np.int64)
        code[full] = inverse + 1
        rank, order = _ranks(code, np.zeros(n, np.int64)) if step == size else (code, None)
        depth = 1
        while depth * step < size:
            to = min(2 * depth, size // step)
            shift = (to - depth) * step
            second = np.zeros(n, np.int64)
            second[: n - shift] = rank[shift:]
            second[place + shift >= stop] = 0
            rank, order = _ranks(rank, second)
            depth = to
        self.order, self.row = order.astype(np.int32), np.empty(n, np.int32)
        self.row[order] = place
        before = order - step
        inside = before >= (stop - np.repeat(self.lengths, self.lengths))[order]
        self.first = code[order].astype(np.int32)
        self.symbol = np.where(inside, code[before], 0).astype(np.int32)
        self.left = np.where(inside, self.row[before], -1).astype(np.int32)
        self.windows = np.flatnonzero(place + size <= stop).astype(np.int32)
        self.rank = rank[self.windows].astype(np.int32)
        self.twice = (np.bincount(self.rank) > 1)[self.rank]
        lead = np.full(n + 1, -1)
        lead[self.rank[::-1]] = self.windows[::-1]
        self.lead_rank = np.flatnonzero(lead >= 0)
        self.leads = lead[self.lead_rank]


def interleave(first: np.ndarray, symbol: np.ndarray, left: np.ndarray, rows: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, interval of each), in order: suffixes of `depth` symbols that begin a suffix of another shard too.

    first, symbol, left: those of all shards, one after the other; ends: where each shard's rows end. rows: the suffixes
    to begin with, whose symbols before them lead, `depth` symbols in all, to suffixes that differ from each other in a shard.
    """
    at, block = rows, np.zeros(len(rows), np.int64)
    for k in range(depth):
        key = (symbol if k else first)[at].astype(U64) << U64(32) | np.arange(len(at), dtype=U64)
        key.sort()  # by symbol, then by the interleave so far: a stable deal
        by, dealt = (key & U64(0xFFFFFFFF)).astype(np.int64), key >> U64(32)
        at, block = (left[at] if k else at)[by], block[by]
        new = np.r_[True, (dealt[1:] != dealt[:-1]) | (block[1:] != block[:-1])] if len(at) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        if not len(head):
            break
        own, count = np.searchsorted(ends, at, "right"), np.diff(np.r_[head, len(at)])
        open_ = np.repeat(np.minimum.reduceat(own, head) != np.maximum.reduceat(own, head), count)
        at, block = at[open_], np.cumsum(new)[open_]
    return at, block


def merge(shards: list[Shard], size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, interval of each, ends): rows of windows that another shard has too, by the shards' transforms; ends as for interleave."""
    alphabet = np.unique(np.concatenate([x.alphabet for x in shards]))
    ends = np.cumsum([len(x.first) for x in shards])
    first, symbol, left, rows = [], [], [], []
    for x, base in zip(shards, np.r_[0, ends[:-1]].tolist(), strict=True):
        code = np.r_[0, np.searchsorted(alphabet, x.alphabet) + 1].astype(np.int32)
        first.append(code[x.first])
        symbol.append(code[x.symbol])
        left.append(x.left + np.int32(base))
        rows.append(np.sort(x.row[x.leads + size - step]).astype(np.int64) + base)
        x.alphabet = x.order = x.first = x.symbol = x.left = None
    at, block = interleave(np.concatenate(first), np.concatenate(symbol), np.concatenate(left), np.concatenate(rows), ends, size // step)
    return at, block, ends


def shared_windows(strings: list[bytes], size: int, room: int = SHARD) -> list[np.ndarray]:
    """Per string, the places of its windows that another string has too; a string's own windows must differ."""
    step, shards, first = stride(size), [], 0
    while first < len(strings):
        last, held = first, 0
        while last < len(strings) and (last == first or held + len(strings[last]) <= room):
            held += len(strings[last])
            last += 1
        shards.append(Shard(strings[first:last], size, step))
        first = last
    if len(shards) > 1:
        hit, _, ends = merge(shards, size, step)
        hit = np.sort(hit)
        cut = np.searchsorted(hit, np.r_[0, ends])
        for x, base, a, b in zip(shards, np.r_[0, ends[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            also = np.zeros(len(x.row) + 1, bool)
            also[x.lead_rank[np.isin(x.row[x.leads], hit[a:b] - base)]] = True
            x.twice |= also[x.rank]
    out = []
    for x in shards:
        stop = np.cumsum(x.lengths)
        found = x.windows[x.twice]
        cut = np.searchsorted(found, np.r_[0, stop]).tolist()
        out += [found[a:b] - s for a, b, s in zip(cut[:-1], cut[1:], (stop - x.lengths).tolist(), strict=True)]
    return out


def _covered(place: np.ndarray, size: int) -> np.ndarray:
    """(first byte, end) of what windows at ascending places cover, one row each."""
    if not len(place):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(place) > 1)
    return np.stack([place[np.r_[0, cut + 1]], place[np.r_[cut, len(place) - 1]] + size], axis=1)


def _flat(pairs: np.ndarray) -> np.ndarray:
    """(first, end) pairs as one 64-bit value each."""
    return np.ascontiguousarray(pairs.astype("<u4")).view("<u8").reshape(-1)


def shared_anchors(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """(__key, __anchors): for rows with any, places of anchors that occur elsewhere."""
    parts = parts_for(docs)
    _, span = steps(parts)

    def ask(batches):
        for batch in batches:
            for piece in slices(batch, "__text", 1 << 20):
                data, offs = utf8(column(piece, "__text"))
                keys = np.asarray(column(piece, "__key")).astype(np.int64)
                _, _, anchor, h = runs(data, offs, size, gram)
                text = np.searchsorted(offs, anchor, "right") - 1
                place = anchor - offs[text]
                _, one, inverse, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                known = n[inverse] > 1
                one = np.sort(one)
                asks = list(chunks(h[one], text[one], parts, [keys], place[one], 8 if span > 1 else WIDTH, span))
                yield rows([p for p, _ in asks], [b for _, b in asks], False)
                yield rows(*bundles(place[known].astype("<u4"), text[known], keys, parts), True)

    def answer(batches):
        settled, raw = split(batches)
        yield from settled
        h, text, per_text, place = unpack(raw, WIDTH)
        raw.clear()
        if not len(h):
            return
        _, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
        hit = n[inverse] > 1
        yield rows(*bundles(place[hit].astype("<u4"), text[hit], per_text[0], parts), True)

    asked = docs.select("__key", "__text").mapInArrow(lambda batches: gathered(ask(batches)), SCHEMA)
    answered = dealt(asked, parts, WIDTH).mapInArrow(answer, SCHEMA)
    return answered.repartitionById(parts, F.col("__part")).mapInArrow(merged("<u4", "__anchors"), "__key long, __anchors binary")


class Runs:
    """The runs that come to a part: each distinct string once, and who has it."""

    def __init__(self, size: int):
        self.size, self.number, self.anchor, self.own, self.first, self.which = size, {}, [], [], [], []

    def add(self, raw: bytes) -> None:
        n = int.from_bytes(raw[:4], "little")
        flat = zstandard.ZstdDecompressor().decompress(raw[4:])
        key, first, windows, anchor = np.frombuffer(flat, "<i8", 4 * n).reshape(n, 4).T
        ends, which = (32 * n + np.cumsum(windows + self.size - 1)).tolist(), []
        for end, w, a in zip(ends, windows.tolist(), anchor.tolist(), strict=True):
            text = flat[end - w - self.size + 1 : end]
            i = self.number.setdefault(text, len(self.anchor))
            if i == len(self.anchor):
                self.anchor.append(a)
            which.append(i)
        self.own.append(key.copy())
        self.first.append(first.copy())
        self.which.append(np.array(which, np.int64))

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, (first byte, end)) of what is repeated elsewhere, ordered by key."""
        own, first, which = np.concatenate(self.own), np.concatenate(self.first), np.concatenate(self.which)
        texts, many = list(self.number), np.bincount(which, minlength=len(self.number)) > 1
        _, inverse, n = np.unique(np.array(self.anchor, np.int64), return_inverse=True, return_counts=True)
        order = np.argsort(inverse, kind="stable")
        merged_ = order[n[inverse[order]] > 1]  # runs of one anchor stand together
        found = [np.zeros((0, 2), np.int64)] * len(texts)
        for i, place in zip(merged_.tolist(), shared_windows([texts[i] for i in merged_.tolist()], self.size), strict=True):
            found[i] = _covered(place, self.size)
        for i in np.flatnonzero(many).tolist():
            found[i] = np.array([[0, len(texts[i])]])
        count = np.array([len(x) for x in found])
        flat, start = np.concatenate(found), np.cumsum(count) - count
        at = gather(start[which], count[which])
        key, pairs = np.repeat(own, count[which]), flat[at] + np.repeat(first, count[which])[:, None]
        by = np.argsort(key, kind="stable")
        return key[by], pairs[by]


def repeated_ranges(docs: DataFrame, anchors: DataFrame, size: int, gram: int) -> DataFrame:
    """(__key, __ranges): for rows with any, byte ranges that windows occurring elsewhere cover."""
    parts = parts_for(docs, 2 << 20)

    def ask(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for piece in slices(batch, "__text", 1 << 20):
                data, offs = utf8(column(piece, "__text"))
                keys = np.asarray(column(piece, "__key")).astype(np.int64)
                wanted = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + o for x, o in zip(column(piece, "__anchors").to_pylist(), offs.tolist(), strict=False)])
                first, last, anchor, h = runs(data, offs, size, gram)
                ok = np.isin(anchor, wanted)
                first, last, h = first[ok], last[ok], h[ok]
                text = np.searchsorted(offs, first, "right") - 1
                raw, seen = data.tobytes(), {}
                strings = [raw[a:b] for a, b in zip(first.tolist(), (last + size).tolist(), strict=True)]
                which = np.array([seen.setdefault(x, i) for i, x in enumerate(strings)], np.int64)
                known = np.bincount(which, minlength=len(strings))[which] > 1
                one = np.flatnonzero(which == np.arange(len(which)))
                part = part_of(h[one], parts)
                order = one[np.argsort(part, kind="stable")]
                ends = np.searchsorted(np.sort(part), np.arange(parts + 1))
                to, body = [], []
                for k in np.flatnonzero(np.diff(ends)).tolist():
                    at = order[ends[k] : ends[k + 1]]
                    head = np.stack([keys[text[at]], first[at] - offs[text[at]], last[at] - first[at] + 1, h[at].view(np.int64)], axis=1).astype("<i8").tobytes()
                    to.append(k)
                    body.append(len(at).to_bytes(4, "little") + squeeze.compress(head + b"".join([strings[i] for i in at.tolist()])))
                yield rows(to, body, False)
                pairs = np.stack([first - offs[text], last + size - offs[text]], axis=1)
                yield rows(*bundles(_flat(pairs[known]), text[known], keys, parts), True)

    def answer(batches):
        settled, waiting = split(batches)
        held = Runs(size)
        for batch in settled:
            yield batch
            while waiting:
                held.add(waiting.pop())
        while waiting:
            held.add(waiting.pop())
        if held.own:
            key, pairs = held.ranges()
            owners, text = np.unique(key, return_inverse=True)
            yield rows(*bundles(_flat(pairs), text, owners, parts), True)

    joined = docs.select("__key", "__text").join(anchors, "__key")
    asked = joined.mapInArrow(lambda batches: gathered(ask(batches)), SCHEMA)
    answered = asked.repartitionById(parts, F.col("__part")).mapInArrow(answer, SCHEMA)
    return answered.repartitionById(parts, F.col("__part")).mapInArrow(merged("<u8", "__ranges"), "__key long, __ranges binary")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row; spans: removed (first byte, end)."""
    own_rows = docs.select(F.col(key).alias("__own"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("__id"), F.col(text).alias("__text"))
    unique = own_rows.agg(F.count("*").alias("n"), F.count_distinct("__id").alias("d")).first()
    own_rows = own_rows.withColumn("__key", F.col("__id") if unique["n"] == unique["d"] else F.xxhash64("__id", F.coalesce("__text", F.lit("")))).drop("__id")
    # Written in between, so that no stage runs two Python functions and their workers at a time.
    anchors = scratch(shared_anchors(own_rows, size, gram), "op9-anchors")
    ranges = scratch(repeated_ranges(own_rows, anchors, size, gram), "op9-ranges")
    joined = own_rows.join(ranges, "__key", "left").select("__own", "__text", "__ranges")
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
            T.StructField("kept_sha256", T.StringType()),
            T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        ]
    )

    def finish(batches):
        for batch in batches:
            for piece in slices(batch, "__text", 1 << 20):
                n_bytes, n_removed, spans, digest = [], [], [], []
                for x, found in zip(column(piece, "__text").to_pylist(), column(piece, "__ranges").to_pylist(), strict=True):
                    raw = (x or "").encode()
                    own, at, kept, gone = [], 0, [], 0
                    if found:
                        pairs = np.frombuffer(found, "<u4").reshape(-1, 2).astype(np.int64)
                        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                        reach = np.maximum.accumulate(pairs[:, 1])
                        new = np.flatnonzero(np.r_[True, pairs[1:, 0] > reach[:-1]])
                        own = list(zip(pairs[new, 0].tolist(), reach[np.r_[new[1:] - 1, len(pairs) - 1]].tolist(), strict=True))
                    for s, e in own:
                        kept.append(raw[at:s])
                        gone += e - s
                        at = e
                    kept.append(raw[at:])
                    n_bytes.append(len(raw))
                    n_removed.append(gone)
                    spans.append([[s, e] for s, e in own])
                    digest.append(hashlib.sha256(b"".join(kept)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [column(piece, "__own"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(digest, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                    names=schema.names,
                )

    return joined.mapInArrow(finish, schema)


def op9_bwt_merge(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
