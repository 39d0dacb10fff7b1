"""Exact token counts at every prefix of a text, by dynamic programming.

Byte-level BPE splits a text into pieces and encodes each alone. For a piece, the program keeps for
every prefix the last token of that prefix's encoding and its count: the last token of prefix i is the
one token t = piece[j:i] that stays apart from the last token of prefix j, and count[i] = count[j] + 1.
Two tokens stay apart when no merge would cross the border between them; that is read off by undoing
their merges, latest first, and asking at each stage whether the pair at the border would have merged
sooner than what was undone.

A text keeps its pieces' starts and the running count. A cut inside a piece changes that piece alone
(the pattern looks one character ahead), so the count of any prefix is the running count before the
piece plus the program's count of the rest: truncation and budget questions need no encoding.

Counts are those of the tokenizers library with its defaults: strings of added special tokens inside a
text count as one token each.

Defined results: a null or empty text has 0 tokens and is under every limit; a text of any length is counted whole;
repeated rows are counted each on its own; an empty table gives no rows; other columns are not read, so their names cannot
clash.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe_files import default_path, default_pattern, merges, splitter
from .common import column, slices, texts_of
from .pieces import Pieces

LIMIT = 512
CACHE = 400_000


class Prefixes:
    """The dynamic program for one vocabulary."""

    def __init__(self, path: str):
        self.ids, order, self.added = merges(path)
        size = max(self.ids.values()) + 1
        self.born, self.left, self.right = [-1] * size, list(range(size)), list(range(size))
        self.rank = {}
        for r, (a, b, c) in enumerate(order):
            self.rank[a << 20 | b] = r
            self.born[c], self.left[c], self.right[c] = r, a, b
        self._automaton()
        self.known: dict[int, bool] = {}

    def _automaton(self) -> None:
        """Which tokens end after each byte: a trie of all tokens with links to the longest proper suffix."""
        self.go: dict[int, int] = {}
        ends: list[tuple] = [()]
        for token, t in self.ids.items():
            node = 0
            for b in token:
                nxt = self.go.get(node << 8 | b)
                if nxt is None:
                    nxt = self.go[node << 8 | b] = len(ends)
                    ends.append(())
                node = nxt
            ends[node] = ((len(token), t),)
        suffix = [0] * len(ends)
        level = [0]
        children: list[list[tuple[int, int]]] = [[] for _ in ends]
        for k, v in self.go.items():
            children[k >> 8].append((k & 255, v))
        while level:
            following = []
            for node in level:
                for b, child in children[node]:
                    f = suffix[node]
                    while node and f and f << 8 | b not in self.go:
                        f = suffix[f]
                    suffix[child] = self.go.get(f << 8 | b, 0) if node else 0
                    ends[child] += ends[suffix[child]]
                    following.append(child)
            level = following
        self.ends, self.suffix = ends, suffix

    def step(self, state: int, b: int) -> int:
        at = state
        while at and at << 8 | b not in self.go:
            at = self.suffix[at]
        out = self.go.get(at << 8 | b, 0)
        if len(self.go) < 4_000_000:
            self.go[state << 8 | b] = out
        return out

    def apart(self, x: int, y: int) -> bool:
        """True if the encoding of x's and y's bytes together is x, y."""
        key = x << 20 | y
        if (out := self.known.get(key)) is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            out = self.known[key] = self._apart(x, y)
        return out

    def _apart(self, x: int, y: int) -> bool:
        rank, born, limit = self.rank.get, self.born, 1 << 60
        while True:
            r = rank(x << 20 | y)
            if r is not None and r < limit:
                return False
            bx, by = born[x], born[y]
            if bx < 0 and by < 0:
                return True
            if bx > by:  # x's own last merge lies left of the border and goes first among equals
                limit, x = bx, self.right[x]
            else:
                limit, y = by + 1, self.left[y]

    def counts(self, piece: bytes) -> list[int]:
        """Token count of each prefix of a piece, from the empty one on."""
        count: list[int] = []
        self.totals([piece], count)
        return count

    def totals(self, pieces: list[bytes], count: list[int] | None = None) -> list[int]:
        """Token count of each piece. Pieces in sorted order share the program of their common prefixes."""
        go, ends, known = self.go.get, self.ends, self.known.get
        count = [] if count is None else count
        count.append(0)
        last, states, before, out = [-1], [0], b"", []
        for piece in pieces:
            i = 0
            for x, y in zip(before, piece):  # noqa: B905
                if x != y:
                    break
                i += 1
            del last[i + 1 :], states[i + 1 :], count[i + 1 :]
            state = states[i]
            for b in piece[i:]:
                i += 1
                nxt = go(state << 8 | b)
                state = self.step(state, b) if nxt is None else nxt
                for size, t in ends[state]:
                    j = i - size
                    if j:
                        ok = known(last[j] << 20 | t)
                        if ok is None:
                            ok = self.apart(last[j], t)
                        if not ok:
                            continue
                    last.append(t)
                    count.append(count[j] + 1)
                    states.append(state)
                    break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            before = piece
            out.append(count[-1])
        return out


class Counter:
    """Counts of pieces and texts for one vocabulary, with a bounded cache of pieces."""

    def __init__(self, path: str, pattern: str):
        self.program = Prefixes(path)
        self.pattern, self.find = pattern, splitter(pattern)
        added = sorted(self.program.added, key=len, reverse=True)
        self.marks = set(added)
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.cache: dict[bytes, int] = {}

    def sections(self, text: str) -> list[str]:
        """The text cut around added tokens, which are sections of their own."""
        return [x for x in self.special.split(text) if x] if self.special and self.special.search(text) else [text]

    def split(self, text: str) -> list[str]:
        return [y for x in self.sections(text) for y in ([x] if x in self.marks else self.find(x))]

    def piece(self, piece: str) -> int:
        return 1 if piece in self.marks else self.program.counts(piece.encode())[-1]

    def count(self, text: str) -> int:
        return sum(map(self.piece, self.split(text)))

    def columns(self, texts: list[str]) -> tuple[Pieces, np.ndarray, np.ndarray, np.ndarray, bytes]:
        """(pieces, running counts, first piece of each text, which are added tokens, bytes) of many texts."""
        cut = [self.sections(x) for x in texts]
        flat = [y for x in cut for y in x]
        raw = [y.encode() for y in flat]
        offs = np.cumsum([0, *map(len, raw)])
        data = b"".join(raw)
        p = Pieces(np.frombuffer(data, np.uint8), offs, self.pattern)
        mark = np.zeros(len(p.hash), bool)
        marks = [i for i, y in enumerate(flat) if y in self.marks]
        for i in marks:
            mark[p.at[i] : p.at[i + 1]] = True
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        keys, inverse = p.distinct()
        new = sorted(k for k in keys if k not in cache)
        cache.update(zip(new, self.program.totals(new), strict=True))
        n = np.array([cache[k] for k in keys], np.int64)[inverse]
        n[mark] = 0
        for i in marks:
            n[p.at[i]] = 1
        first = p.at[np.cumsum([0, *map(len, cut)])]
        return p, np.r_[0, np.cumsum(n)], first, mark, data


class PrefixCounts:
    """Counts of every prefix of one text."""

    def __init__(self, counter: Counter, text: str):
        self.counter, self.text = counter, text
        self.pieces = counter.split(text)
        self.start = [0, *accumulate(map(len, self.pieces))]
        self.total = [0, *accumulate(map(counter.piece, self.pieces))]

    def at(self, chars: int) -> int:
        """Tokens of the first `chars` code points."""
        k = bisect_right(self.start, chars) - 1
        if self.start[k] == chars:
            if not k or chars == len(self.text):
                return self.total[k]
            k -= 1  # a cut at a border: white space may have been split because of what follows
        return self.total[k] + self.counter.count(self.text[self.start[k] : chars])

    def every(self) -> list[int]:
        return [self.at(i) for i in range(len(self.text) + 1)]


@lru_cache(2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def token_counts(docs: DataFrame, key: str, text: str, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit, limit_chars: code points up to which the running count stays within the limit."""
    schema = T.StructType([docs.schema[key], *(T.StructField(k, t) for k, t in (("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()), ("limit_chars", T.LongType())))])

    def run(batches):
        c = counter(path, pattern)
        for batch in batches:
            for part in slices(batch, text, 4 << 20):
                texts = texts_of(column(part, text))
                p, total, first, mark, data = c.columns(texts)
                n = np.diff(total[first])
                sizes = np.array([len(x.encode()) for x in texts], np.int64)
                chars = np.array([len(x) for x in texts], np.int64)
                for i in np.flatnonzero(n > limit).tolist():
                    spare = total[first[i]] + limit
                    k = int(np.searchsorted(total, spare, "right")) - 1
                    whole = data[p.start[first[i]] : p.start[k]].decode()
                    piece = data[p.start[k] : p.end[k]]
                    chars[i] = len(whole)
                    if not mark[k]:
                        by_byte = c.program.counts(piece)
                        size = 0
                        for j, ch in enumerate(piece.decode(), 1):
                            size += len(ch.encode())
                            if total[k] + by_byte[size] > spare:
                                break
                            chars[i] = len(whole) + j
                yield pa.RecordBatch.from_arrays([column(part, key), pa.array(sizes), pa.array(n), pa.array(n > limit), pa.array(chars)], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, "doc_id", "text", default_path("byte_bpe_50k.json"), default_pattern())
