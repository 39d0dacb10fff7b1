"""Byte-level BPE encoding and decoding with a segment tree per piece.

Leaves are byte positions; a leaf holds rank * width + position of the pair that starts there, so the
root is the leftmost pair of least rank. A merge renews the leaves of the merged position, of its dead
right neighbour and of its live left neighbour, and their paths to the root: logarithmic work a merge.
Pieces of the same width are encoded side by side, one tree a row; pieces over WIDE bytes one by one.
A piece that is itself a token is that token. Special tokens are ordinary text.

Defined results: a null or empty text has no ids; a text of any length is encoded whole; repeated rows are encoded each on
its own; an empty table gives no rows; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe_files import default_path, default_pattern, ranks
from .common import column, slices, utf8
from .pieces import Pieces

CACHE = 400_000
WIDE = 128
NONE = np.int32(2**31 - 1)


class Encoder:
    def __init__(self, path: str, pattern: str):
        self.ranks = ranks(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.tokens[v] = k
        pairs = {}
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = r
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.first = self.rank(np.repeat(self.byte, 256), np.tile(self.byte, 256)).reshape(256, 256)
        self.pattern = pattern
        self.cache: dict[bytes, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it is no pair or a side is missing (negative)."""
        key = (a.astype(np.int64) << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.values[at], NONE)

    def side_by_side(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Encode pieces of at most `width` bytes, a power of two; ids as little-endian unsigned 32-bit integers."""
        n = len(pieces)
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(n, width)
        size = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.where(np.arange(width) < size[:, None], self.byte[raw], np.int32(-1))
        ids = np.concatenate([ids, np.full((n, 1), -1, np.int32)], axis=1)
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), (n, 1))
        after[after >= size[:, None]] = width
        before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))
        pair = np.full((n, width), NONE, np.int32)
        pair[:, :-1] = self.first[raw[:, :-1], raw[:, 1:]]
        pair[np.arange(width) >= size[:, None] - 1] = NONE
        tree = np.full((n, 2 * width), NONE, np.int32)
        tree[:, width:] = np.where(pair == NONE, NONE, pair * np.int32(width) + np.arange(width, dtype=np.int32))
        k = width
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            root = tree[live, 1]
            p, token = root & np.int32(width - 1), root // np.int32(width)
            q = after[live, p]
            beyond = after[live, q]
            ids[live, p] = token
            ids[live, q] = -1
            after[live, p] = beyond
            before[live, beyond] = p
            o = before[live, p]
            r_p = self.rank(token, np.where(beyond < width, ids[live, beyond], -1))
            r_o = self.rank(np.where(o >= 0, ids[live, o], -1), token)
            o = np.where(o >= 0, o, p)
            tree[live, width + q] = NONE
            has = r_o != NONE
            tree[live, width + o] = np.where(has, r_o * np.int32(width) + o, NONE)
            tree[live, width + p] = np.where(r_p != NONE, r_p * np.int32(width) + p, NONE)
            for at in (p, q, o):
                node = (at + width) >> 1
                while node[0]:
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
                    node = node >> 1
            live = live[tree[live, 1] != NONE]
        left = ids[:, :width] >= 0
        flat, ends = ids[:, :width][left].astype("<u4").tobytes(), np.cumsum(left.sum(axis=1)) * 4
        return [flat[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def alone(self, piece: bytes) -> bytes:
        """One long piece by the same tree, in scalars."""
        n, pairs = len(piece), self.pairs
        width = 1 << (n - 1).bit_length()
        none = 1 << 62
        ids = [int(self.byte[b]) for b in piece]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

        def leaf(i: int) -> int:
            j = after[i]
            r = pairs.get(ids[i] << 20 | ids[j]) if j < n else None
            return none if r is None else r * width + i

        tree = [none] * (2 * width)
        tree[width : width + n] = [leaf(i) for i in range(n)]
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def renew(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            k >>= 1
            while k:
                tree[k] = min(tree[2 * k], tree[2 * k + 1])
                k >>= 1

        while tree[1] != none:
            token, p = divmod(tree[1], width)
            q = after[p]
            ids[p], ids[q] = token, -1
            after[p] = after[q]
            if after[p] < n:
                before[after[p]] = p
            renew(q, none)
            renew(p, leaf(p))
            if before[p] >= 0:
                renew(before[p], leaf(before[p]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """The encoding of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, raw in enumerate(pieces):
            if (r := self.ranks.get(raw)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(raw) > WIDE:
                out[i] = self.alone(raw)
            else:
                by_width.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append(i)
        for width, own in by_width.items():
            step = max(1, (1 << 19) // width)
            for k in range(0, len(own), step):
                few = own[k : k + step]
                for i, ids in zip(few, self.side_by_side([pieces[i] for i in few], width), strict=True):
                    out[i] = ids
        return out

    def encode_many(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts one after the other, and where each text's begin (and the end)."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        p = Pieces(data, offs, self.pattern)
        keys, inverse = p.distinct()
        cache = self.cache
        new = [k for k in keys if k not in cache]
        cache.update(zip(new, self.learn(new), strict=True))
        own = [cache[k] for k in keys]
        size = np.fromiter(map(len, own), np.int64, len(own)) >> 2
        pool, first = np.frombuffer(b"".join(own), "<u4"), np.cumsum(size) - size
        n = size[inverse]
        ends = np.r_[0, np.cumsum(n)]
        ids = pool[np.repeat(first[inverse] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[p.at]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def each(self, texts: pa.Array):
        """The ids of each text."""
        data, offs = utf8(texts)
        ids, at = self.encode_many(data, offs)
        at = at.tolist()
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """key, ids (binary, little-endian unsigned 32-bit integers), decoded (binary)."""
    schema = T.StructType([docs.schema[key], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        e = encoder(path, pattern)
        for batch in batches:
            for piece in slices(batch, text, 4 << 20):
                ids = e.each(column(piece, text))
                yield pa.RecordBatch.from_arrays([column(piece, key), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([e.decode(x) for x in ids], pa.binary())], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, key: str, text: str, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: encode() with the two binaries digested where they are made.

    ids: also the column `ids`, the token ids.
    """
    schema = T.StructType([docs.schema[key], *(T.StructField(k, t) for k, t in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())))])
    wanted, schema = ids, T.StructType([*schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]) if ids else schema

    def run(batches):
        e = encoder(path, pattern)
        for batch in batches:
            for piece in slices(batch, text, 1 << 20):
                ids = e.each(column(piece, text))
                more = [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))] if wanted else []
                yield pa.RecordBatch.from_arrays(
                    [
                        column(piece, key),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(e.decode(x)).hexdigest() for x in ids], pa.string()),
                        *more,
                    ],
                    names=schema.names,
                )

    return docs.select(key, text).mapInArrow(run, schema)


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_digests(docs, "doc_id", "text", default_path("byte_bpe_50k.tiktoken"), default_pattern())
