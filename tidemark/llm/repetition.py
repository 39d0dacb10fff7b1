"""Quality rules on repetition inside a text, by suffix array.

Words are the symbols. The suffix arrays of all texts of a slice are built together by prefix
doubling (only suffixes whose order is still open are sorted again), with the text's number inside
the first rank so that suffixes of different texts never tie. Neighbours in the suffix array give
the longest common prefixes, and a stack over these the intervals of common prefix l or more, which cannot be
prolonged to the right. An interval whose suffixes do not all follow the same word cannot be prolonged to the left
either: it is a maximal repeated substring. The union of the spans of these is the union, over all suffixes, of the
deepest interval of each (one that can be prolonged to the left lies inside the spans of the longer one), so it is
filled in from each pair of neighbours.

A text fails when repeats of at least `min_words` words cover more than `max_fraction` of its word
characters, or when the longest repeat has more than `max_longest` words.

Defined results: a null or empty text has no words, all counts are 0 and it fails the base rule; a very long
text is one suffix array of its words; repeated rows are judged each on its own; an empty table gives no rows; input
columns pass through unchanged, whatever their names, but `into` must not be one of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, column, mix, slices, texts_of, utf8

MIN_WORDS = 8
MAX_FRACTION = 0.30
MAX_LONGEST = 400

_SYMBOLS = b"#*$%&|<>"
_BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"

FIELDS = [
    ("n_words", "long"),
    ("word_chars", "long"),
    ("n_symbols", "long"),
    ("n_dup_lines", "long"),
    ("n_repeat_words", "long"),
    ("base_failed", "boolean"),
    ("kept", "boolean"),
    ("covered_chars", "long"),
    ("longest_repeat", "long"),
    ("n_maximal", "long"),
]


def suffix_ranks(symbols: np.ndarray, text: np.ndarray, least: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """Final suffix ranks, and the ranks by the first 1, 2, 4, ... symbols until all repeats of `least` are settled."""
    n = len(symbols)
    _, rank = np.unique(symbols + mix(text.astype(np.uint64)), return_inverse=True)
    order = np.argsort(rank, kind="stable")
    first = np.r_[True, rank[order][1:] != rank[order][:-1]] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    levels, k = [rank.copy()], 1
    size = np.bincount(rank, minlength=n)
    open_ = np.flatnonzero(size[rank] > 1)
    while len(open_):
        ahead = open_ + k
        inside = ahead < n
        second = np.zeros(len(open_), np.int64)
        second[inside] = np.where(text[ahead[inside]] == text[open_[inside]], rank[ahead[inside]] + 1, 0)
        by = np.argsort(rank[open_] * (n + 1) + second, kind="stable")
        at, key2 = open_[by], second[by]
        base = rank[at]
        head = np.r_[True, base[1:] != base[:-1]]
        new = head | np.r_[True, key2[1:] != key2[:-1]]
        i = np.arange(len(at))
        rank[at] = base + (i - i[head][np.cumsum(head) - 1])[new][np.cumsum(new) - 1]
        levels.append(rank.copy())
        k *= 2
        size = np.bincount(rank[at], minlength=n)
        open_ = np.sort(at[size[rank[at]] > 1])
    return rank, levels


def common_prefix(levels: list[np.ndarray], text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common prefix of suffixes a and b, from the ranks of each level."""
    n, out = len(text), np.zeros(len(a), np.int64)
    a, b, home = a.copy(), b.copy(), text[a]
    for level in range(len(levels) - 1, -1, -1):
        r, ok = levels[level], np.flatnonzero((a < n) & (b < n))
        ok = ok[(text[a[ok]] == home[ok]) & (text[b[ok]] == home[ok])]
        ok = ok[r[a[ok]] == r[b[ok]]]
        step = 1 << level
        out[ok] += step
        a[ok] += step
        b[ok] += step
    return out


def intervals(at: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Rows (l, first, last) of all intervals of common prefix l or more.

    lcp[i]: common prefix of the suffixes at[i] and at[i] + 1 of the suffix array; at ascends, what it leaves out is no repeat.
    """
    out, stack, before = [], [], -2
    for i, l in zip(at.tolist(), lcp.tolist(), strict=True):
        if i != before + 1:
            out += [(x, lo, before + 1) for x, lo in stack]
            stack.clear()
        lo = i
        while stack and stack[-1][0] > l:
            x, lo = stack.pop()
            out.append((x, lo, i))
        if not stack or stack[-1][0] < l:
            stack.append((l, lo))
        before = i
    out += [(x, lo, before + 1) for x, lo in stack]
    return np.array(out, np.int64).reshape(-1, 3)


def repeats(w: Words, min_words: int):
    """Per text: mask of words in repeats of min_words or more, longest repeat, number of maximal repeats."""
    count = np.diff(w.at)
    n, texts = len(w.hash), len(count)
    text = np.repeat(np.arange(texts), count)
    longest, maximal, cover = np.zeros(texts, np.int64), np.zeros(texts, np.int64), np.zeros(n, bool)
    if not n:
        return cover, longest, maximal
    rank, levels = suffix_ranks(w.hash, text)
    sa = np.argsort(rank, kind="stable")
    a, b = sa[:-1], sa[1:]
    near = text[a] == text[b]
    for level, r in enumerate(levels):
        if (1 << level) <= min_words:
            near &= r[a] == r[b]
    at = np.flatnonzero(near)
    lcp = common_prefix(levels, text, a[at], b[at])
    ok = lcp >= min_words
    at, lcp = at[ok], lcp[ok]
    edge = np.zeros(n + 1, np.int64)
    for s in (a[at], b[at]):
        np.add.at(edge, s, 1)
        np.add.at(edge, s + lcp, -1)
    cover = np.cumsum(edge)[:-1] > 0
    np.maximum.at(longest, text[a[at]], lcp)
    found = intervals(at, lcp)
    first = w.at[:-1][text[sa]] == sa
    left = np.where(first, np.arange(n, dtype=np.uint64), w.hash[sa - 1])
    change = np.cumsum(np.r_[False, (left[1:] != left[:-1]) | first[1:] | first[:-1]])
    found = found[change[found[:, 2]] > change[found[:, 1]]]
    np.add.at(maximal, text[sa[found[:, 1]]], 1)
    return cover, longest, maximal


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(values, dtype=np.int64)][at])


def measure(texts: pa.Array, min_words: int, max_fraction: float, max_longest: int) -> list[np.ndarray]:
    data, offs = utf8(texts)
    w = Words(data, offs)
    n_words = np.diff(w.at)
    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    length = chars[w.end] - chars[w.start]
    symbols, dup_lines = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
    for i, x in enumerate(texts_of(texts)):
        raw = x.encode()
        symbols[i] = len(raw) - len(raw.translate(None, _SYMBOLS))
        lines = [y for y in raw.split(b"\n") if y and y.translate(None, _BLANK)]
        dup_lines[i] = len(lines) - len(set(lines))
    h, text, place = w.windows(3)
    key = h + mix(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    in_window = np.zeros(len(w.hash), bool)
    start = (w.at[text] + place)[twice]
    for j in range(3):
        in_window[start + j] = True
    word_chars, n_repeat = _sums(length, w.at), _sums(in_window, w.at)
    cover, longest, maximal = repeats(w, min_words)
    covered = _sums(np.where(cover, length, 0), w.at)
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    kept = ~failed & (covered <= max_fraction * word_chars) & (longest <= max_longest)
    return [n_words, word_chars, symbols, dup_lines, n_repeat, failed, kept, covered, longest, maximal]


def score(
    docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_fraction: float = MAX_FRACTION, max_longest: int = MAX_LONGEST, into: str = "repetition"
) -> DataFrame:
    """docs with a struct column `into`, which must not be one of docs, holding FIELDS."""
    if into in docs.columns:
        raise ValueError(f"docs has a column {into}")
    kind = T.StructType([T.StructField(k, T.LongType() if t == "long" else T.BooleanType()) for k, t in FIELDS])
    schema = T.StructType([*docs.schema.fields, T.StructField(into, kind)])

    def run(batches):
        for batch in batches:
            for piece in slices(batch, text, 1 << 20):
                got = measure(column(piece, text), min_words, max_fraction, max_longest)
                struct = pa.StructArray.from_arrays([pa.array(x) for x in got], names=[k for k, _ in FIELDS])
                yield pa.RecordBatch.from_arrays([*piece.columns, struct], names=[*piece.schema.names, into])

    return docs.mapInArrow(run, schema)


def op2_repetition(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs).select("doc_id", *(F.col(f"repetition.{k}").alias(k) for k, _ in FIELDS))
