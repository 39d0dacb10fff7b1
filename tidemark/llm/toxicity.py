"""Toxicity by a linear-chain conditional random field over terms.

Labels are of documents; tokens get theirs from the sample: a term, or a beginning of terms, is offending if it stands
between many different neighbours in toxic documents (so that copies of one text are no evidence) and is, in proportion,
in far fewer clean ones; tokens that are or begin so in a toxic document are tagged toxic. A chain of two tags is fitted to them by
maximum likelihood (L-BFGS; each evaluation is a Spark job that sums log-likelihood and gradient over the sample):
features are the term, its neighbours, its first 4 to 7 bytes, and the transitions between tags.

Scoring is one pass without a shuffle. Forward-backward marginals of all tokens come from segments of SEGMENT tokens side by
side: products of the segments' transfer matrices join them, so a text of any length costs the same a token. Spans
are runs of tokens whose marginal is a half or more, with offsets in code points; the document's score is a logistic function,
fitted to the sample, of its greatest marginal and of the expected number of offending tokens.

The sample: labelled rows that are not held out, by hash of the id about FIT_ROWS of them, texts of at most FIT_LONGEST
bytes. Everything fitted (VOCABULARY terms, weights) is bounded by these parameters; all rows are scored, in full.

Defined results: a null or empty text has no tokens, hence the score of a document without offending ones; without
both toxic and clean rows in the sample every score is the share of toxic ones (0 without labels); labels of an id that
occurs twice count as their greatest; null labels and null ids are no labels; repeated rows are scored each on its own; an empty table gives no
rows; other columns pass through, and `into` must not be one of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, mix, powers, prefix_hashes, scratch, slices, utf8
from .terms import Terms

FIT_ROWS = 8192
FIT_LONGEST = 64 << 10
VOCABULARY = 20_000
#: Lengths, in bytes, of the beginnings of terms that have weights.
STARTS = (4, 5, 6, 7)
#: An offending term or beginning has at least so many different neighbours on either side in toxic rows (of 64 classes), and is in so many times more of them, in proportion, than of clean rows.
CONTEXTS, ODDS = 5, 8.0
#: A term or beginning in fewer rows of the sample has no weight of its own.
LEAST_ROWS = 3
SEGMENT = 128
SLICE = 2 << 20
PENALTY = 0.5
ITERATIONS = 18
FIELDS = [("score", "double"), ("n_tokens", "long"), ("offending", "double"), ("spans", "array<struct<start:long,end:long,p:double>>")]


# -- the chain ----------------------------------------------------------------------------------


class Chain:
    """Forward-backward over many texts at once. e: each token's score for the toxic tag; at: index of each text's first token (and the end)."""

    def __init__(self, e: np.ndarray, at: np.ndarray, trans: np.ndarray):
        self.at, n = at, np.diff(at)
        many = -(-n // SEGMENT)
        self.first = np.r_[0, np.cumsum(many)]
        doc = np.repeat(np.arange(len(n)), many)
        j = np.arange(len(doc)) - self.first[doc]
        start = at[doc] + j * SEGMENT
        self.many, self.width = many, min(SEGMENT, int(n.max(initial=0)))
        place = start[None, :] + np.arange(self.width)[:, None]
        self.mask = place < at[doc + 1][None, :]
        self.place = np.where(self.mask, place, 0)
        x = np.exp(np.clip(e, -30, 30))[self.place] if len(e) else np.zeros(self.place.shape)
        ot, to, tt = np.exp(trans)
        # Transfer matrices [[1, m01], [m10, m11]] from tag to tag (clean, toxic); past a text's end the identity.
        self.m01 = np.where(self.mask, ot * x, 0.0)
        self.m10 = np.where(self.mask, to, 0.0)
        self.m11 = np.where(self.mask, tt * x, 1.0)

    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the toxic tag: forward before each segment, backward after it."""
        k = len(self.first) and self.first[-1]
        before, after = np.zeros(k), np.full(k, 0.5)
        deepest = int(self.many.max(initial=0))
        if deepest > 1:
            p = [np.ones(k), np.zeros(k), np.zeros(k), np.ones(k)]
            for i in range(self.width):
                a, b, c, d = p
                m01, m10, m11 = self.m01[i], self.m10[i], self.m11[i]
                p = [a + b * m10, a * m01 + b * m11, c + d * m10, c * m01 + d * m11]
                total = p[0] + p[1] + p[2] + p[3]
                p = [v / total for v in p]
            order = np.argsort(-self.many, kind="stable")
            sizes = self.many[order]
            for j in range(1, deepest):
                at = self.first[order[: np.searchsorted(-sizes, -j, "left")]] + j  # documents with more than j segments
                f = before[at - 1]
                t0, t1 = (1 - f) * p[0][at - 1] + f * p[2][at - 1], (1 - f) * p[1][at - 1] + f * p[3][at - 1]
                before[at] = t1 / (t0 + t1)
            for j in range(deepest - 1, 0, -1):
                at = self.first[order[: np.searchsorted(-sizes, -j, "left")]] + j
                g = after[at]
                t0, t1 = p[0][at] * (1 - g) + p[1][at] * g, p[2][at] * (1 - g) + p[3][at] * g
                after[at - 1] = t1 / (t0 + t1)
        return before, after

    def run(self, pairs: bool = False):
        """(marginal of the toxic tag for each token, log of the partition function, expected transitions or None)."""
        out = np.zeros(int(self.at[-1]))
        before, after = self._edges()
        ahead, log_z = [before], 0.0
        for i in range(self.width):
            f = ahead[-1]
            t0, t1 = (1 - f) + f * self.m10[i], (1 - f) * self.m01[i] + f * self.m11[i]
            total = t0 + t1
            log_z += float(np.log(total).sum()) if pairs else 0.0
            ahead.append(t1 / total)
        g, moves = after, np.zeros(3)
        for i in range(self.width - 1, -1, -1):
            f, ok = ahead[i + 1], self.mask[i]
            toxic = f * g
            share = toxic / (toxic + (1 - f) * (1 - g))
            out[self.place[i][ok]] = share[ok]
            b0, b1 = 1 - g, g
            to0, to1 = b0 + self.m01[i] * b1, self.m10[i] * b0 + self.m11[i] * b1
            if pairs:
                p = ahead[i]
                z = (1 - p) * to0 + p * to1
                moves += [float(((1 - p) * self.m01[i] * b1 / z)[ok].sum()), float((p * self.m10[i] * b0 / z)[ok].sum()), float((p * self.m11[i] * b1 / z)[ok].sum())]
            g = to1 / (to0 + to1)
        return out, log_z, moves if pairs else None


# -- features -----------------------------------------------------------------------------------


def bytes_of(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of large binaries."""
    if not len(names):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    data = names.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)), offs - offs[0]


def begins(names: pa.Array, k: int) -> pa.Array:
    """The first k bytes of each term; null for shorter ones."""
    data, offs = bytes_of(names)
    ok = np.diff(offs) >= k
    at = (offs[:-1][ok][:, None] + np.arange(k)[None, :]).ravel()
    made = pa.Array.from_buffers(pa.large_binary(), int(ok.sum()), [None, pa.py_buffer(np.arange(int(ok.sum()) + 1, dtype=np.int64) * k), pa.py_buffer(data[at])])
    return made.take(pa.array(np.where(ok, np.cumsum(ok) - 1, 0), mask=~ok))


def hashes(names: pa.Array) -> np.ndarray:
    """A hash of each term, the same everywhere."""
    data, offs = bytes_of(names)
    p, down = prefix_hashes(data), powers(len(data) + 1)[1]
    return mix((p[offs[1:]] - p[offs[:-1]]) * down[offs[:-1]] + np.diff(offs).astype(np.uint64))


class Features:
    """Numbers of weights: term, left and right neighbour by vocabulary (the last number is for all others), first bytes of the term, bias, transitions."""

    def __init__(self, vocabulary: pa.Array, starts: pa.Array):
        self.vocabulary, self.starts, self.v = vocabulary, starts, len(vocabulary) + 1
        self.start = 3 * self.v
        self.bias = self.start + len(starts) + 1
        self.size = self.bias + 4

    def of(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(vocabulary number, numbers of the known beginnings, one row a length) of each distinct term."""
        number = lambda x, among: np.asarray(pc.fill_null(pc.index_in(x, value_set=among, skip_nulls=True), len(among))).astype(np.int64)
        return number(names, self.vocabulary), np.stack([number(begins(names, k), self.starts) for k in STARTS])

    @staticmethod
    def _inner(code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each token but the first has the one before it in its own text."""
        inner = np.ones(len(code) + 1, bool)
        inner[at] = False
        return inner[1:-1] if len(code) else inner[:0]

    def scores(self, w: np.ndarray, term: np.ndarray, starts: np.ndarray, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Score for the toxic tag of each token; code: the number of each token's distinct term."""
        v, inner = self.v, self._inner(code, at)
        own = (w[term] + w[self.start + starts].sum(0) + w[self.bias])[code]
        own[1:] += w[v + term][code[:-1]] * inner
        own[:-1] += w[2 * v + term][code[1:]] * inner
        return own

    def gradient(self, rest: np.ndarray, term: np.ndarray, starts: np.ndarray, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sum over tokens of rest times the token's features."""
        v, n, inner = self.v, len(term), self._inner(code, at)
        per = np.bincount(code, rest, n)
        left = np.bincount(code[:-1], rest[1:] * inner, n) if len(code) else np.zeros(n)
        right = np.bincount(code[1:], rest[:-1] * inner, n) if len(code) else np.zeros(n)
        out = np.zeros(self.size)
        for base, number, what in ((0, term, per), (v, term, left), (2 * v, term, right), *((self.start, x, per) for x in starts)):
            np.add.at(out, base + number, what)
        out[self.bias] = rest.sum()
        return out


class Model:
    """base: the score of every text if nothing could be fitted."""

    def __init__(self, base: float, features: Features | None = None, weights: np.ndarray | None = None, logistic: np.ndarray | None = None, offending: list[list[bytes]] = ()):
        self.base, self.features, self.weights, self.logistic, self.offending = base, features, weights, logistic, list(offending)

    def marginals(self, data: np.ndarray, offs: np.ndarray) -> tuple[Terms, np.ndarray]:
        t = Terms(data, offs)
        names, code = t.encoded()
        e = self.features.scores(self.weights, *self.features.of(names), code, t.at)
        return t, Chain(e, t.at, self.weights[self.features.bias + 1 :]).run()[0]


def evidence(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text: log-odds of its greatest marginal (within 12), log of 1 + expected number of tokens of marginal a half and more."""
    n = len(at) - 1
    odds = np.full(n, -12.0)
    held = np.flatnonzero(np.diff(at) > 0)
    if len(held):
        most = np.maximum.reduceat(p, at[held])
        odds[held] = np.clip(np.log(np.maximum(most, 1e-9) / np.maximum(1 - most, 1e-9)), -12, 12)
    total = np.r_[0, np.cumsum(np.where(p >= 0.5, p, 0.0))]
    return np.stack([np.ones(n), odds, np.log1p(np.maximum(total[at[1:]] - total[at[:-1]], 0))], 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


# -- fitting ------------------------------------------------------------------------------------


def descend(f, w: np.ndarray, iterations: int, keep: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; f gives (value, gradient)."""
    value, g = f(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        d, alphas = -g, []
        for s, y in reversed(pairs):
            a = s @ d / (s @ y)
            alphas.append(a)
            d = d - a * y
        d = d * (pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1])) if pairs else d / max(1.0, np.abs(g).sum())
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            d = d + (a - y @ d / (s @ y)) * s
        step, slope = 1.0, g @ d
        while True:
            new = w + step * d
            value_, g_ = f(new)
            if value_ <= value + 1e-4 * step * slope or step < 1e-4:
                break
            step /= 4
        if value_ >= value:
            break
        if (new - w) @ (g_ - g) > 1e-10:
            pairs = [*pairs, (new - w, g_ - g)][-keep:]
        done = value - value_ < 1e-5 * max(1.0, abs(value))
        w, value, g = new, value_, g_
        if done:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small penalty."""
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[0.1] * (x.shape[1] - 1)])
    for _ in range(25):
        p = sigmoid(x @ w)
        w = w + np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ w)
    return w


def units(sample: DataFrame) -> DataFrame:
    """(whole, unit, t, c, left, right) for terms (whole) and their beginnings: toxic and clean rows that have it, and bitmaps of its neighbours in toxic rows."""
    names_ = ["whole", "unit", "t", "c", "left", "right"]

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                t = Terms(*utf8(column(piece, "text")))
                if not len(t.start):
                    continue
                names, code = t.encoded()
                doc = np.repeat(np.arange(len(piece)), np.diff(t.at))
                toxic = np.asarray(column(piece, "toxic")) == 1
                inner = Features._inner(code, t.at)
                bit = np.uint64(1) << (hashes(names) % np.uint64(64))
                left, right = np.ones(len(code), np.uint64), np.ones(len(code), np.uint64)  # a text's end is a neighbour too
                left[1:] = np.where(inner, bit[code[:-1]], left[1:])
                right[:-1] = np.where(inner, bit[code[1:]], right[:-1])
                for k in (0, *STARTS):
                    if k:
                        of = begins(names, k).dictionary_encode()
                        known, number = of.dictionary, np.asarray(of.indices.fill_null(-1)).astype(np.int64)[code]
                    else:
                        known, number = names, code
                    ok = number >= 0
                    pair = np.unique(number[ok] * len(piece) + doc[ok])
                    in_toxic = toxic[pair % len(piece)]
                    count = lambda which: pa.array(np.bincount(pair[which] // len(piece), minlength=len(known)).astype(np.int64))  # noqa: B023, E731
                    masks = [np.zeros(len(known), np.uint64), np.zeros(len(known), np.uint64)]
                    ok &= toxic[doc]
                    for mask, side in zip(masks, (left, right), strict=True):
                        np.bitwise_or.at(mask, number[ok], side[ok])
                    cols = [pa.array(np.full(len(known), k == 0)), known.cast(pa.binary()), count(in_toxic), count(~in_toxic), *(pa.array(x.view(np.int64)) for x in masks)]
                    yield pa.RecordBatch.from_arrays(cols, names=names_)

    made = sample.mapInArrow(run, "whole boolean, unit binary, t bigint, c bigint, left bigint, right bigint")
    return made.groupBy("whole", "unit").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.expr("bit_count(bit_or(left))").alias("left"), F.expr("bit_count(bit_or(right))").alias("right"))


def terms_of_sample(sample: DataFrame, toxic: int, clean: int) -> tuple[list[list[bytes]], list[list[bytes]]]:
    """(vocabulary, offending) of whole terms and of beginnings."""
    each = scratch(units(sample).filter(F.col("t") + F.col("c") >= LEAST_ROWS), "toxicity-units")
    bad = (F.least("left", "right") >= CONTEXTS) & (F.col("t") >= ODDS * toxic / clean * (F.col("c") + 0.5))
    known, offending = [], []
    for whole in (True, False):
        of = each.filter(F.col("whole") == whole)
        words = {bytes(r[0]) for r in of.filter(bad).orderBy(F.desc("t"), "unit").limit(VOCABULARY).select("unit").collect()}
        often = of.orderBy(F.desc(F.col("t") + F.col("c")), "unit").limit(VOCABULARY).select("unit").collect()
        known.append(sorted(words | {bytes(r[0]) for r in often}))
        offending.append(sorted(words))
    return known, offending


def sample_of(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """(text, toxic) of about `rows` labelled documents, by hash of their id."""
    n = labels.count()
    share = min(1.0, rows / max(n, 1))
    chosen = lambda df: df.filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)) < int(share * (1 << 20)))
    marks = chosen(labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())).groupBy(F.col(key).alias("__id")).agg(F.max(label).cast("int").alias("toxic"))
    texts = chosen(docs).select(F.col(key).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter(F.octet_length("text") <= FIT_LONGEST)
    # Copies of one text say no more than one of them.
    return texts.join(marks, "__id").select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")).dropDuplicates()


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS, iterations: int = ITERATIONS) -> Model:
    sample = scratch(sample_of(docs, labels, key, text, label, rows), "toxicity-sample")
    counts = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        return Model(toxic / max(toxic + clean, 1))
    known, offending = terms_of_sample(sample, toxic, clean)
    features = Features(*(pa.array(x, pa.large_binary()) for x in known))
    bad, bad_starts = (pa.array(x, pa.large_binary()) for x in offending)

    def coded(batches):
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                t = Terms(*utf8(column(piece, "text")))
                names, code = t.encoded()
                odd = np.asarray(pc.is_in(names, value_set=bad))
                for k in STARTS:
                    odd = odd | np.asarray(pc.is_in(begins(names, k), value_set=bad_starts, skip_nulls=True))
                tags = odd[code] & np.repeat(np.asarray(column(piece, "toxic")) == 1, np.diff(t.at))
                term, starts = features.of(names)
                cols = [x.astype(np.int32).tobytes() for x in (term, starts, code, t.at)] + [tags.tobytes(), np.asarray(column(piece, "toxic")).astype(np.int32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c]) for c in cols], names=kinds)

    kinds = ["term", "starts", "code", "at", "tags", "toxic"]
    table = scratch(sample.mapInArrow(coded, ", ".join(f"{k} binary" for k in kinds)), "toxicity-coded")

    def each(batches):
        for batch in batches:
            for i in range(len(batch)):
                raw = [batch.column(j)[i].as_buffer() for j in range(len(kinds))]
                term, starts, code, at = (np.frombuffer(x, np.int32).astype(np.int64) for x in raw[:4])
                yield term, starts.reshape(len(STARTS), -1), code, at, np.frombuffer(raw[4], bool), np.frombuffer(raw[5], np.int32)

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        def sums(batches):
            value, g = 0.0, np.zeros(features.size)
            for term, starts, code, at, tags, _ in each(batches):
                e = features.scores(w, term, starts, code, at)
                trans = w[features.bias + 1 :]
                p, log_z, moves = Chain(e, at, trans).run(pairs=True)
                before = np.r_[False, tags[:-1]][: len(tags)]
                before[at[:-1][at[:-1] < len(tags)]] = False
                own = np.array([(~before & tags).sum(), (before & ~tags).sum(), (before & tags).sum()], float)
                value += log_z - float(e[tags].sum()) - float(own @ trans)
                g += features.gradient(p - tags, term, starts, code, at)
                g[features.bias + 1 :] += moves - own
            yield pa.RecordBatch.from_pydict({"value": [value], "g": [g.tobytes()]})

        got = table.mapInArrow(sums, "value double, g binary").collect()  # one row a task of a bounded sample
        value = sum(r["value"] for r in got) + PENALTY / 2 * float(w @ w)
        return value, sum((np.frombuffer(r["g"], float) for r in got), PENALTY * w)

    start = np.zeros(features.size)
    start[features.bias] = -4.0
    w = descend(objective, start, iterations)

    def measured(batches):
        for term, starts, code, at, _, toxic_ in each(batches):
            p = Chain(features.scores(w, term, starts, code, at), at, w[features.bias + 1 :]).run()[0]
            x = evidence(p, at)
            yield pa.RecordBatch.from_pydict({"odds": x[:, 1], "many": x[:, 2], "toxic": toxic_.astype(np.int32)})

    rows_ = table.mapInArrow(measured, "odds double, many double, toxic int").collect()  # about FIT_ROWS rows of three numbers
    x = np.array([[1.0, r["odds"], r["many"]] for r in rows_])
    return Model(toxic / (toxic + clean), features, w, logistic(x, np.array([r["toxic"] for r in rows_], float)), offending)


# -- scoring ------------------------------------------------------------------------------------


def spans_of(data: np.ndarray, offs: np.ndarray, t: Terms, p: np.ndarray) -> pa.Array:
    """Runs of tokens of marginal a half and more, as offsets in code points of their text with their greatest marginal."""
    hot = np.flatnonzero(p >= 0.5)
    doc = np.searchsorted(t.at, hot, "right") - 1
    new = np.r_[True, (hot[1:] != hot[:-1] + 1) | (doc[1:] != doc[:-1])] if len(hot) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(hot)] - 1 if len(hot) else first
    point = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    base = point[offs[doc[first]]]
    struct = pa.StructArray.from_arrays([pa.array(point[t.start[hot[first]]] - base), pa.array(point[t.end[hot[last]]] - base), pa.array(np.maximum.reduceat(p[hot], first) if len(hot) else np.zeros(0))], names=["start", "end", "p"])
    many = np.bincount(doc[first], minlength=len(offs) - 1)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), struct)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with a struct column `into`: score, n_tokens, offending (expected number of offending tokens), spans."""
    if into in docs.columns:
        raise ValueError(f"docs has a column {into}")
    kind = T.StructType.fromDDL(", ".join(f"{k} {'bigint' if t == 'long' else t.replace('long', 'bigint')}" for k, t in FIELDS))
    schema = T.StructType([*docs.schema.fields, T.StructField(into, kind)])

    def run(batches):
        for batch in batches:
            for piece in slices(batch, text, SLICE):
                data, offs = utf8(column(piece, text))
                if model.features is None:
                    t = Terms(data, offs)
                    p, result = np.zeros(len(t.start)), np.full(len(offs) - 1, model.base)
                    x = evidence(p, t.at)
                else:
                    t, p = model.marginals(data, offs)
                    x = evidence(p, t.at)
                    result = sigmoid(x @ model.logistic)
                struct = pa.StructArray.from_arrays([pa.array(result), pa.array(np.diff(t.at).astype(np.int64)), pa.array(np.expm1(x[:, 2])), spans_of(data, offs, t, p)], names=[k for k, _ in FIELDS])
                yield pa.RecordBatch.from_arrays([*piece.columns, struct], names=[*piece.schema.names, into])

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    model = fit(docs, labels)
    got = score(docs, model).select("doc_id", "toxicity")
    s = F.col("toxicity.score")
    return got.select("doc_id", held_out().alias("held_out"), s.alias("score"), F.when(s >= 0.5, 1).otherwise(0).alias("predicted"), F.size("toxicity.spans").cast("long").alias("n_spans"))
