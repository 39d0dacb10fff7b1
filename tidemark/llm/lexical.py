"""Ranked lexical search over a length-stratified index.

A document of n terms has the normaliser m = 25 + (75 * n * N) div L, where N counts the documents with a term and L
their terms. A stratum is the documents of one m. The index is a table of segments, one a slice of some megabytes of
text: its documents numbered by stratum, and for each of its terms the postings by stratum and, within one, by tf. As the
impact of a term, (1e9 * tf) div (1000 * tf + 8 * m), depends on m and tf alone, it is computed once for each tf of a
stratum, and the greatest tf of a stratum bounds it there. Documents are split over segments, so no term's postings
ever meet in one task, however common the term is.

A search is one pass over the segments with a block of queries. For each query the sums of the stratum bounds order the
visits: strata are scored from the highest bound down, some at a time, until no further bound reaches the k-th
best score of the task so far. Equal bounds are visited, as ties go to the smaller id. Each task gives k rows a query at
most; the best of these are ranked by a window. Queries are taken in blocks of about QUERY_BYTES, so what a task holds of
them is bounded, and every block is searched in full.

Jobs: count (N, L), build (the index is written to the shared folder), document frequencies of a block's terms, search.

Defined results: a null text or one without terms is not in N and never found; a query without terms, or whose terms
occur nowhere, has no rows; repeated query rows are ranked each on its own; repeated documents are ranked each on its
own; equal scores go by ascending id, null ids last; a term repeated in a query counts as often. A text longer than a slice
is a segment of its own. An empty table of documents or queries gives no rows. Columns beside id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, scratch, slices, utf8
from .terms import Terms, terms_of

K = 10
SLICE = 4 << 20
QUERY_BYTES = 4 << 20
#: Documents scored before the first look at the bounds; each further visit doubles.
FIRST_VISIT = 64


def normaliser(n: np.ndarray, docs: int, length: int) -> np.ndarray:
    return 25 + (75 * n.astype(np.int64) * docs) // max(length, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _count(batches):
    docs = length = 0
    for batch in batches:
        for piece in slices(batch, "text", SLICE):
            n = np.diff(Terms(*utf8(column(piece, "text"))).at)
            docs, length = docs + int((n > 0).sum()), length + int(n.sum())
    yield pa.RecordBatch.from_pydict({"docs": [docs], "length": [length]})


def segment(ids: pa.Array, texts: pa.Array, docs: int, length: int) -> dict | None:
    """One segment as columns, or None if no text has a term."""
    t = Terms(*utf8(texts))
    n = np.diff(t.at)
    held = np.flatnonzero(n > 0)
    if not len(held):
        return None
    m = normaliser(n[held], docs, length)
    order = np.argsort(m, kind="stable")
    held, m = held[order], m[order]
    place = np.zeros(len(n), np.int64)
    place[held] = np.arange(len(held))
    names, code = t.encoded()
    # Postings: one number a (term, document), counted; documents are in the order of strata.
    key, tf = np.unique(code * len(held) + place[np.repeat(np.arange(len(n)), n)], return_counts=True)
    term, doc = key // len(held), key % len(held)
    by = np.lexsort((doc, tf, m[doc], term))
    df = np.bincount(term, minlength=len(names))
    return {
        "ids": ids.take(pa.array(held)),
        "m": m.tobytes(),
        "names": names.cast(pa.binary()),
        "df": df.astype(np.int32).tobytes(),
        "doc": doc[by].astype(np.int32).tobytes(),
        "tf": tf[by].astype(np.int32).tobytes(),
    }


class Index:
    """docs: documents with a term; length: their terms; segments: the table of segments."""

    def __init__(self, docs: int, length: int, segments: DataFrame, id_type: T.DataType):
        self.docs, self.length, self.segments, self.id_type = docs, length, segments, id_type


def build(documents: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    rows = documents.select(F.col(key).alias("id"), F.col(text).alias("text"))
    total = rows.select("text").mapInArrow(_count, "docs bigint, length bigint").agg(F.sum("docs"), F.sum("length")).first()
    docs, length = total[0] or 0, total[1] or 0
    id_type = rows.schema["id"].dataType
    kind = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("m", T.BinaryType()), T.StructField("names", T.ArrayType(T.BinaryType())), *(T.StructField(x, T.BinaryType()) for x in ("df", "doc", "tf"))])

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                s = segment(column(piece, "id"), column(piece, "text"), docs, length)
                if s is not None:
                    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                    yield pa.RecordBatch.from_arrays([one(s["ids"]), pa.array([s["m"]]), one(s["names"]), *(pa.array([s[x]]) for x in ("df", "doc", "tf"))], names=kind.fieldNames())

    return Index(docs, length, scratch(rows.mapInArrow(run, kind), "lexical-index"), id_type)


class Query:
    """A query's terms with how often each occurs, and the best hits a task has for it so far: (-score, id is null, id)."""

    def __init__(self, number: int, terms: dict[int, int]):
        self.number, self.terms, self.best = number, terms, []


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] numbers, then those of start[1], ..."""
    return np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())


class Searcher:
    """Searches one segment after the other for a block of queries; vocabulary: the block's distinct terms."""

    def __init__(self, queries: list[list[tuple[int, int]]], vocabulary: pa.Array, weights: np.ndarray, k: int):
        self.queries = [Query(i, dict(q)) for i, q in enumerate(queries) if q]
        self.vocabulary, self.weights, self.k = vocabulary, weights, k

    def visit(self, ids: pa.Array, m: np.ndarray, names: pa.Array, df: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> None:
        where = pc.index_in(self.vocabulary, value_set=names)
        known = np.asarray(where.is_valid())
        where = np.asarray(where.fill_null(0)).astype(np.int64)
        # Only postings of the block's terms are looked at from here on, term by term.
        found = np.flatnonzero(known)
        if not len(found):
            return
        at = np.r_[0, np.cumsum(df)]
        count = df[where[found]].astype(np.int64)
        take = spread(at[where[found]], count)
        doc, tf = doc[take].astype(np.int64), tf[take].astype(np.int64)
        ms, stratum = np.unique(m, return_inverse=True)
        term, s = np.repeat(np.arange(len(found)), count), stratum[doc]
        # Runs of one tf in one stratum of one term: the impact of each is computed once.
        new = np.r_[True, (term[1:] != term[:-1]) | (s[1:] != s[:-1]) | (tf[1:] != tf[:-1])]
        run = np.flatnonzero(new)
        gain = impact(tf[run], ms[s[run]])
        # (term, stratum) groups of runs; the last run has the greatest tf, so its impact is the bound.
        rt, rs = term[run], s[run]
        last = np.flatnonzero(np.r_[(rt[1:] != rt[:-1]) | (rs[1:] != rs[:-1]), True])
        bound, group_t, group_s = gain[last], rt[last], rs[last]
        group_at = np.r_[0, np.r_[run, len(doc)][last + 1]]
        gain = gain[np.cumsum(new) - 1]
        groups_of = np.searchsorted(group_t, np.arange(len(found) + 1))
        number = {int(v): i for i, v in enumerate(found)}
        size = np.bincount(stratum)
        rank = np.empty(len(m), np.int64)
        rank[np.asarray(pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_end"))] = np.arange(len(m))
        for q in self.queries:
            mine = [(number[v], n * int(self.weights[v])) for v, n in q.terms.items() if v in number and self.weights[v] > 0]
            if mine:
                self._query(q, mine, ids, rank, size, doc, gain, bound, group_s, group_at, groups_of)

    def _query(self, q, mine, ids, rank, size, doc, gain, bound, group_s, group_at, groups_of) -> None:
        t = np.array([x for x, _ in mine])
        counts = groups_of[t + 1] - groups_of[t]
        groups = spread(groups_of[t], counts)
        w = np.repeat(np.array([x for _, x in mine], np.int64), counts)
        most = np.zeros(len(size), np.int64)
        np.add.at(most, group_s[groups], w * bound[groups])
        order = np.argsort(-most, kind="stable")
        order = order[: int((most > 0).sum())]
        turn = np.zeros(len(size), np.int64)  # the visit in which a stratum is scored
        seen, want, at = np.cumsum(size[order]), FIRST_VISIT, 0
        while at < len(order):
            if len(q.best) == self.k and most[order[at]] < -q.best[-1][0]:
                return
            to = max(at + 1, int(np.searchsorted(seen, (seen[at - 1] if at else 0) + want, "right")))
            turn[:] = 0
            turn[order[at:to]] = 1
            sel = np.flatnonzero(turn[group_s[groups]])
            g = groups[sel]
            n = group_at[g + 1] - group_at[g]
            post = spread(group_at[g], n)
            docs, into = np.unique(doc[post], return_inverse=True)
            score = np.zeros(len(docs), np.int64)
            np.add.at(score, into, gain[post] * np.repeat(w[sel], n))
            self._keep(q, docs, score, ids, rank)
            at, want = to, want * 2

    def _keep(self, q, docs, score, ids, rank) -> None:
        if len(q.best) == self.k:
            ok = score >= -q.best[-1][0]
            docs, score = docs[ok], score[ok]
        ok = np.flatnonzero(score > 0)
        top = ok[np.lexsort((rank[docs[ok]], -score[ok]))[: self.k]]
        hits = [(-int(score[i]), (v := ids[int(docs[i])].as_py()) is None, v) for i in top]
        q.best = sorted([*q.best, *hits], key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))[: self.k]


def _segments(batches):
    for batch in batches:
        for i in range(len(batch)):
            yield {f.name: batch.column(j)[i] for j, f in enumerate(batch.schema)}


def _ints(value: pa.Scalar, kind=np.int32) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def search(index: Index, queries: DataFrame, key: str = "item_id", text: str = "text", k: int = K) -> DataFrame:
    """(key, rank, doc_id, score): each query's k highest-scoring documents with a score above 0."""
    spark = queries.sparkSession
    rows = queries.select(F.col(key).alias("id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / QUERY_BYTES))
    item_type = rows.schema["id"].dataType
    kind = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("number", T.IntegerType()), T.StructField("doc_id", index.id_type), T.StructField("score", T.LongType())])
    parts = []
    for b in range(blocks):
        # A block is bounded by QUERY_BYTES (about, as queries are dealt by hash), whatever the number of queries.
        block = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect() if blocks > 1 else rows.collect()
        found = _search_block(index, [terms_of(r["text"]) for r in block], b, k, kind)
        if found is not None:
            names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(block)], T.StructType([T.StructField("number", T.IntegerType()), T.StructField("item", item_type)]))
            parts.append((found, names))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(key, item_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", index.id_type), T.StructField("score", T.LongType())]))
    out = None
    order = W.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for found, names in parts:
        top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        top = top.join(F.broadcast(names), "number").select(F.col("item").alias(key), "rank", "doc_id", "score")  # bounded by QUERY_BYTES
        out = top if out is None else out.unionByName(top)
    return out


def _search_block(index: Index, block: list[list[bytes]], b: int, k: int, kind: T.StructType) -> DataFrame | None:
    vocabulary = sorted({t for q in block for t in q})
    if not vocabulary:
        return None
    words = pa.array(vocabulary, pa.binary())

    def frequencies(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for s in _segments(batches):
            where = pc.index_in(words, value_set=s["names"].values)
            known = np.asarray(where.is_valid())
            total[known] += _ints(s["df"])[np.asarray(where.fill_null(0))[known]]
        yield pa.RecordBatch.from_pydict({"term": np.flatnonzero(total).astype(np.int32), "df": total[total > 0]})

    df = index.segments.select("names", "df").mapInArrow(frequencies, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row a term of the block
    weights = np.zeros(len(vocabulary), np.int64)
    for r in df:
        weights[r["term"]] = weight(index.docs, r["df"])
    number = {t: i for i, t in enumerate(vocabulary)}
    coded = []
    for q in block:
        n: dict[int, int] = {}
        for t in q:
            n[number[t]] = n.get(number[t], 0) + 1
        coded.append(sorted(n.items()))

    def run(batches):
        task = Searcher(coded, words, weights, k)
        for s in _segments(batches):
            task.visit(s["ids"].values, _ints(s["m"], np.int64), s["names"].values, _ints(s["df"]), _ints(s["doc"]), _ints(s["tf"]))
        hits = [(q.number, v, -neg) for q in task.queries for neg, _, v in q.best]
        if hits:
            arrays = [pa.array([b] * len(hits), pa.int32()), pa.array([h[0] for h in hits], pa.int32()), pa.array([h[1] for h in hits]), pa.array([h[2] for h in hits], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=kind.fieldNames())

    return scratch(index.segments.mapInArrow(run, kind), "lexical-hits")


def op12_lexical(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(build(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_T = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_T} AS w FROM documents),
q AS (SELECT item_id, item, t, count(*) AS times FROM (SELECT item_id, item, unnest(w) AS t FROM (SELECT item_id, row_number() OVER () AS item, {_T} AS w FROM benchmark)) GROUP BY ALL),
g AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS length FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
v AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, g GROUP BY t, docs),
s AS (SELECT item_id, item, r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w)::BIGINT * docs) // length))))::BIGINT AS score
      FROM p JOIN q USING (t) JOIN v USING (t) JOIN d USING (r), g GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""
