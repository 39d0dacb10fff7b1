"""Substring dedup by relative Lempel-Ziv parsing.

The reference of a document is the text of all documents with smaller ids. It is indexed in blocks: a
block holds the seeds, runs of `size` words, whose hash falls into it, each with the smallest document that
has it and the word it starts at there. Every document asks the blocks for its own seeds, wherever they may lie, and
gets back where the reference has them. It is then parsed greedily: a factor (start, length, source, position)
starts at the first seed that the reference has and is prolonged by a word while the next seed stands at the
next word of the same source, so its words are those of the source from the position on. Where it ends, the
seeds that begin inside its last words are looked at too: a factor from another source, or from another place,
may overlap it. A factor has at least `size` words; the factors' union is removed.

Seeds meet as packed hashes, never as text; a slice of documents sends a seed only for its smallest
document, the others are settled on the spot, so a passage of a third of all documents costs one
triple a slice. A block's task is bounded by the number of blocks, which grows with the input.

Words: `[^\\x20\\x09-\\x0D]+`, unchanged. Defined results: a null or empty text has no words; texts of fewer
than `size` words keep all; rows with equal ids are no reference to each other and each is parsed on its
own; a null id counts as larger than any other; of equal seeds in one source the first is its position; texts of any
length are hashed in stretches; an empty table gives no rows. Columns of docs pass through; they go by place
inside, so that their names cannot clash, but `into` must not be one of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, column, parts_for, slices, texts_of, utf8
from .packed import SCHEMA, bundles, chunks, dealt, gathered, merged, rows, split, steps, unpack

SIZE = 13
WIDTH = 7
LAST = 2**63 - 1


#: A seed that the reference has: its word here, the source's id, and how much further on the source has it.
HIT = np.dtype([("place", "<u4"), ("source", "<i8"), ("shift", "<i4")])
FACTOR = np.dtype([("start", "<u4"), ("length", "<u4"), ("source", "<i8"), ("position", "<u4")])


def factors(ends: np.ndarray, hits: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends, factors) of the greedy parses; hits[ends[i]:ends[i + 1]] are those of document i, in any order."""
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    order = np.lexsort((hits["place"], text))
    hits, text = hits[order], text[order]
    place, source, shift = hits["place"].astype(np.int64), hits["source"], hits["shift"].astype(np.int64)
    new = np.ones(len(hits), bool)
    if len(hits):
        repeat = (text[1:] == text[:-1]) & (place[1:] == place[:-1])  # repeated rows bring a seed twice
        kept = np.r_[True, ~repeat]
        place, source, shift, text = place[kept], source[kept], shift[kept], text[kept]
        new = np.r_[True, (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1) | (source[1:] != source[:-1]) | (shift[1:] != shift[:-1])]
    head = np.flatnonzero(new)
    out = np.zeros(len(head), FACTOR)
    out["start"], out["source"], out["position"] = place[head], source[head], place[head] + shift[head]
    out["length"] = np.diff(np.r_[head, len(place)]) + size - 1
    return np.searchsorted(text[head], np.arange(len(ends))), out


def removed_words(n: int, found: np.ndarray) -> np.ndarray:
    """Mask of the words that factors cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found["start"], 1)
    np.add.at(edge, found["start"].astype(np.int64) + found["length"], -1)
    return np.cumsum(edge)[:-1] > 0


def _referred(h: np.ndarray, id_: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the seeds that a smaller id has, HIT of each such)."""
    order = np.lexsort((place, id_, h))
    h = h[order]
    head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    first = np.repeat(order[head], np.diff(np.r_[head, len(h)]))
    ok = id_[order] > id_[first]
    mask = np.zeros(len(order), bool)
    mask[order[ok]] = True
    source = np.zeros(len(order), np.int64)
    source[order] = first
    source = source[mask]
    out = np.zeros(len(source), HIT)
    out["place"], out["source"], out["shift"] = place[mask], id_[source], place[source].astype(np.int64) - place[mask]
    return mask, out


def repeated_factors(docs: DataFrame, size: int) -> DataFrame:
    """(__key, __factors): for rows with any, the factors of their parse.

    docs: __id (long, never null), __key (unique to a row but for equal rows), __text.
    """
    parts = parts_for(docs)
    _, span = steps(parts)

    def ask(batches):
        for batch in batches:
            for piece in slices(batch, "__text", 1 << 20):
                w = Words(*utf8(column(piece, "__text")))
                h, text, place = w.windows(size)
                del w
                ids, keys = (np.asarray(column(piece, c)).astype(np.int64) for c in ("__id", "__key"))
                # Of equal seeds in this slice, only those of its smallest id have to ask.
                known, hits = _referred(h, ids[text], place)
                open_ = np.flatnonzero(~known)
                asks = list(chunks(h[open_], text[open_], parts, [ids, keys], place[open_], 8 if span > 1 else WIDTH, span))
                yield rows([p for p, _ in asks], [b for _, b in asks], False)
                yield rows(*bundles(hits, text[known], keys, parts), True)

    def answer(batches):
        settled, raw = split(batches)
        yield from settled
        h, text, per_text, place = unpack(raw, WIDTH)
        raw.clear()
        if not len(h):
            return
        ids, keys = per_text
        # Only seeds that occur twice can have a reference.
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        h, text, place = h[twice], text[twice], place[twice]
        del order, same, twice
        hit, hits = _referred(h, ids[text], place)
        yield rows(*bundles(hits, text[hit], keys, parts), True)

    asked = docs.select("__id", "__key", "__text").mapInArrow(lambda batches: gathered(ask(batches)), SCHEMA)
    answered = dealt(asked, parts, WIDTH).mapInArrow(answer, SCHEMA)
    own = merged(HIT, "__factors", lambda ends, hits: factors(ends, hits, size))
    return answered.repartitionById(parts, F.col("__part")).mapInArrow(own, "__key long, __factors binary")


def parse(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, cut: bool = False, into: str = "relative_lz") -> DataFrame:
    """The rows of docs with a struct `into` (n_words, n_removed, kept_sha256, factors).

    cut: also replace the text by what is left of it, runs of kept words as they stood, joined by a blank.
    """
    if into in docs.columns:
        raise ValueError(f"docs has a column {into}")
    # Inside, columns go by place, so that no name of the table clashes with those used here.
    inside = [f"c{i}" for i in range(len(docs.columns))]
    own_key, own_text = inside[docs.columns.index(key)], inside[docs.columns.index(text)]
    own = docs.toDF(*inside).withColumn("__id", F.coalesce(F.col(own_key).cast("long"), F.lit(LAST)))
    ids = own.agg(F.count("*").alias("n"), F.count_distinct("__id").alias("d")).first()
    own = own.withColumn("__key", F.col("__id") if ids["n"] == ids["d"] else F.xxhash64("__id", F.coalesce(F.col(own_text), F.lit(""))))
    found = repeated_factors(own.select("__id", "__key", F.col(own_text).alias("__text")), size)
    joined = own.drop("__id").join(found, "__key", "left").select(*inside, "__factors")
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("factors", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in FACTOR.names])))])
    schema, names = T.StructType([*docs.schema.fields, T.StructField(into, kind)]), inside
    listed = pa.list_(pa.struct([(c, pa.int64()) for c in FACTOR.names]))

    out_names = schema.names

    def finish(batches):
        for batch in batches:
            for piece in slices(batch, own_text, 1 << 20):
                got, left = [], []
                for x, found in zip(column(piece, own_text).to_pylist(), column(piece, "__factors").to_pylist(), strict=True):
                    words = (x or "").encode().split()
                    if not found:
                        got.append((len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), []))
                        left.append(x)
                        continue
                    parsed = np.frombuffer(found, FACTOR)
                    gone = removed_words(len(words), parsed)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    got.append((len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), [dict(zip(FACTOR.names, x, strict=True)) for x in parsed.tolist()]))
                    if cut:
                        raw = x.encode()
                        w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                        edge = np.diff(np.r_[1, gone.astype(np.int8), 1])
                        runs = zip(np.flatnonzero(edge == -1).tolist(), (np.flatnonzero(edge == 1) - 1).tolist(), strict=True)
                        left.append(b" ".join(raw[w.start[a] : w.end[b]] for a, b in runs).decode())
                struct = pa.StructArray.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), listed))], names=kind.names)
                cols = [pa.array(left, pa.string()) if cut and n == own_text else column(piece, n) for n in names]
                yield pa.RecordBatch.from_arrays([*cols, struct], names=out_names)

    return joined.mapInArrow(finish, schema)


def op8_relative_lz(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return parse(docs).select("doc_id", *(F.col(f"relative_lz.{c}").alias(c) for c in ("n_words", "n_removed", "kept_sha256")))
