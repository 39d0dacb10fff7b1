"""Operators on documents against plain versions, with nulls, ties, repeated rows, clashing names and empty tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bwt_merge, byte_bpe, jaccard_join, relative_lz, repetition, token_counts, winnowing
from tidemark.llm.bpe_files import default_path, default_pattern, ranks

from . import brute


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_repetition_base_and_verdict(frame, docs, empty):
    rows = repetition.score(frame).select("doc_id", "repetition.*")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert got(rows, "doc_id", *base) == sorted(((i, *brute.op2_base(t)) for i, t in docs), key=repr)
    short = [(i, t) for i, t in docs if len(brute.words(t)) < 700]
    want = sorted(((i, *brute.covered(t, repetition.MIN_WORDS)) for i, t in short), key=repr)
    ids = {i for i, _ in short}
    assert [x for x in got(rows, "doc_id", "covered_chars", "longest_repeat") if x[0] in ids] == want
    for r in rows.collect():
        assert r.kept == (not r.base_failed and r.covered_chars <= 0.3 * r.word_chars and r.longest_repeat <= repetition.MAX_LONGEST)
    assert repetition.score(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), min_size=1, max_size=5))
def test_repetition_property(texts):
    texts = [" ".join(t) for t in texts]
    out = repetition.measure(pa.array(texts), 2, 1.0, 10**6)
    assert list(zip(out[7].tolist(), out[8].tolist(), strict=True)) == [brute.covered(t, 2) for t in texts]
    assert out[9].tolist() == [brute.maximal_repeats(t, 2) for t in texts]


def test_winnowing(frame, docs, bench, empty, spark):
    b = spark.createDataFrame(bench, "item_id int, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert got(winnowing.contamination(frame, b), *columns) == sorted(brute.op5(docs, bench), key=repr)
    assert winnowing.contamination(empty, b).count() == 0
    none = winnowing.contamination(frame, b.filter("false")).collect()
    assert len(none) == len(docs) and not any(r.contaminated or r.n_hit for r in none)
    kept = winnowing.clean(frame, b)
    assert kept.columns == frame.columns
    assert got(kept, "doc_id", "text") == sorted(((i, t) for (i, t), r in zip(docs, brute.op5(docs, bench), strict=True) if not r[5]), key=repr)


def test_winnowing_without_ids(spark, docs, bench):
    import duckdb

    from tidemark.llm import oracles

    first = {i: t for i, t in reversed(docs)}
    rows = [*docs, (None, " ".join(first[0].split()[5:45])), (None, " ".join(first[3].split()[:30])), (900, " ".join(first[3].split()[:25]))]
    items = [*bench, (None, " ".join(first[3].split()[:20])), (None, " ".join(first[0].split()[12:30]))]
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    d, b = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id int, text string")
    with duckdb.connect() as con:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id INTEGER, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
        want = con.sql(oracles.OP5).fetchall()
    assert sum(r[0] is None and r[5] for r in want) >= 2
    assert got(winnowing.contamination(d, b), *columns) == sorted(want, key=repr)
    kept = [t for t, r in zip((t for _, t in rows), brute.op5(rows, items), strict=True) if not r[5]]
    assert sorted(map(repr, kept)) == sorted(repr(r.text) for r in winnowing.clean(d, b).collect())


def test_winnowing_is_native(frame, spark):
    b = spark.createDataFrame([(1, "one two three")], "item_id int, text string")
    plan = winnowing.contamination(frame, b)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_jaccard(frame, docs, empty):
    assert got(jaccard_join.jaccard_components(frame), "doc_id", "n_shingles", "component_id") == sorted(brute.op6(docs), key=repr)
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_in_many_tiles(frame, docs, monkeypatch):
    """Tiny tiles and blocks, so that groups are dealt over several and met again."""
    monkeypatch.setattr(jaccard_join, "TILE", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "FREQUENT_FROM", 3)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 1)
    assert got(jaccard_join.jaccard_components(frame), "doc_id", "n_shingles", "component_id") == sorted(brute.op6(docs), key=repr)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**63), max_size=40), st.sets(st.integers(0, 2**63), max_size=40))
def test_bitmaps_bound_the_overlap(a, b):
    x, y = (np.array(sorted(v), np.uint64) for v in (a, b))
    bound = jaccard_join.overlap_bound(np.array([len(x)]), len(y), jaccard_join.bitmap(x)[None], jaccard_join.bitmap(y))
    assert bound[0] >= len(a & b) == jaccard_join.common(x, y)


def test_relative_lz(frame, docs, empty):
    out = relative_lz.parse(frame)
    assert out.columns == [*frame.columns, "relative_lz"]
    flat = out.select("doc_id", "text", "relative_lz.*")
    by_id = {}
    for i, t in docs:
        by_id.setdefault(i, []).append(brute.words(t))
    n = 0
    for r in flat.collect():
        own = brute.words(r.text)
        for f in r.factors:  # each is, word for word, a substring of its source, a smaller document
            n += 1
            assert f.length >= 13 and f.source < (r.doc_id if r.doc_id is not None else 2**63)
            assert any(w[f.position : f.position + f.length] == own[f.start : f.start + f.length] for w in by_id[f.source])
    assert n > 10
    assert got(flat, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op8(docs), key=repr)
    assert relative_lz.parse(empty).count() == 0


def test_relative_lz_cuts_the_text(frame, docs):
    kept = {}
    for i, w, m in brute.op8_kept(docs):
        kept.setdefault(i, []).append([x for x, y in zip(w, m, strict=True) if not y])
    for r in relative_lz.parse(frame, cut=True).collect():
        assert brute.words(r.text) in kept[r.doc_id]


def test_bwt_merge(frame, docs, empty):
    out = bwt_merge.dedup(frame)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op9(docs), key=repr)
    assert bwt_merge.dedup(empty).count() == 0


def _plain_intervals(strings, size):
    """Intervals of common prefix `size` or more of one plain suffix array: in byte order, members in the order of strings."""
    suffixes = sorted((s[i:], k, i) for k, s in enumerate(strings) for i in range(len(s) - size + 1))
    groups = {}
    for suffix, k, i in suffixes:
        groups.setdefault(suffix[:size], []).append((k, i))
    return [sorted(v) for v in groups.values() if len({k for k, _ in v}) > 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=14), min_size=1, max_size=8), st.sampled_from([3, 4, 6, 5]), st.sampled_from([1, 20, 1000]))
def test_merge_of_shards_equals_one_suffix_array(texts, size, room):
    strings = []
    for x in texts:  # strings whose own windows differ, as runs are
        x = x.encode()
        grams = [x[i : i + size] for i in range(len(x) - size + 1)]
        if len(set(grams)) == len(grams) and len(x) >= size:
            strings.append(x)
    want = _plain_intervals(strings, size)
    got_ = bwt_merge.shared_windows(strings, size, room)
    assert [sorted(p.tolist()) for p in got_] == [sorted(i for v in want for k, i in v if k == s) for s in range(len(strings))]


def _distinct(texts, size):
    """Strings whose own windows differ, as runs are."""
    out = [x.encode() for x in texts if len(x) >= size]
    return [x for x in out if len({x[i : i + size] for i in range(len(x) - size + 1)}) == len(x) - size + 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=14), min_size=1, max_size=8), st.sampled_from([3, 4, 6, 5, 11]))
def test_transform_of_a_shard_equals_a_plain_suffix_array(texts, size):
    strings, step = [x.encode() for x in texts if len(x) >= size], bwt_merge.stride(size)
    if not strings:
        return
    shard = bwt_merge.Shard(strings, size, step)
    symbols = [(k, i, [x[j : j + step] for j in range(i, min(i + size, len(x) - step + 1), step)]) for k, x in enumerate(strings) for i in range(len(x))]
    plain = sorted(symbols, key=lambda v: (v[2], v[0], v[1]))
    start = np.cumsum([0, *map(len, strings)])
    assert shard.order.tolist() == [int(start[k]) + i for k, i, _ in plain]
    named = [b"", *(int(x).to_bytes(step, "big") for x in shard.alphabet)]
    assert [named[c] for c in shard.symbol.tolist()] == [strings[k][i - step : i] if i >= step else b"" for k, i, _ in plain]
    assert [named[c] for c in shard.first.tolist()] == [v[0] if v else b"" for _, _, v in plain]
    for (_, i, _), left, row in zip(plain, shard.left.tolist(), range(len(plain)), strict=True):
        assert left == -1 if i < step else shard.order[left] == shard.order[row] - step


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text("ab", min_size=6, max_size=14), min_size=1, max_size=4), min_size=2, max_size=4), st.sampled_from([4, 6, 5, 11]))
def test_merge_of_transforms_is_in_suffix_order(groups, size):
    """Intervals of windows that several shards have: in byte order, one window a shard."""
    groups = [g for g in (_distinct(x, size) for x in groups) if g]
    if len(groups) < 2:
        return
    step = bwt_merge.stride(size)
    shards = [bwt_merge.Shard(g, size, step) for g in groups]
    orders, flats = [x.order for x in shards], [b"".join(g) for g in groups]
    rows, block, ends = bwt_merge.merge(shards, size, step)
    found = {}
    for r, b in zip(rows.tolist(), block.tolist(), strict=True):
        k = int(np.searchsorted(ends, r, "right"))
        p = int(orders[k][r - (ends[k - 1] if k else 0)])
        found.setdefault(b, []).append((flats[k][p : p + size], k))
    have = [{x[i : i + size] for x in g for i in range(len(x) - size + 1)} for g in groups]
    every = sorted(set().union(*have))
    assert list(found.values()) == [[(w, k) for k in range(len(groups)) if w in have[k]] for w in every if sum(w in h for h in have) > 1]


def test_bpe(frame, docs, empty):
    import tiktoken

    path = default_path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=default_pattern(), mergeable_ranks=ranks(path), special_tokens={})
    ids = [(i, enc.encode_ordinary(t or ""), t or "") for i, t in docs]
    want = sorted(((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), brute.sha(t.encode())) for i, x, t in ids), key=repr)
    assert got(byte_bpe.encode_digests(frame, "doc_id", "text", path, default_pattern()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert all(bytes(r.decoded).decode() in {t for _, _, t in ids} for r in byte_bpe.encode(frame, "doc_id", "text", path, default_pattern()).collect())
    assert byte_bpe.encode_digests(empty, "doc_id", "text", path, default_pattern()).count() == 0


TRICKY = st.text(st.sampled_from("'stredvmlLVE  \n\t.,1²Ⅷéñ日😀\xa0\x85\x1c_-́"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(TRICKY)
def test_bpe_property(text):
    import tiktoken

    path = default_path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=default_pattern(), mergeable_ranks=ranks(path), special_tokens={})
    e = byte_bpe.encoder(path, default_pattern())
    assert e.each(pa.array([text]))[0].tolist() == enc.encode_ordinary(text)
    if text:
        assert e.alone(text.encode()) == e.side_by_side([text.encode()], 1 << max(2, (len(text.encode()) - 1).bit_length()))[0]


def test_token_counts(frame, docs, empty):
    from tokenizers import Tokenizer

    path = default_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    n = [len(x.ids) for x in t.encode_batch([x or "" for _, x in docs], add_special_tokens=False)]
    want = sorted(((i, len((x or "").encode()), k, k > 512) for (i, x), k in zip(docs, n, strict=True)), key=repr)
    rows = token_counts.token_counts(frame, "doc_id", "text", path, default_pattern())
    assert got(rows, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    by_id = {i: x for i, x in docs if i is not None}
    alone = {i for i in by_id if [j for j, _ in docs].count(i) == 1}
    for r in rows.filter("over_limit").dropDuplicates(["doc_id"]).collect():
        if r.doc_id in alone:
            assert len(t.encode(by_id[r.doc_id][: r.limit_chars], add_special_tokens=False).ids) <= 512
            assert len(t.encode(by_id[r.doc_id][: r.limit_chars + 1], add_special_tokens=False).ids) > 512
    assert token_counts.token_counts(empty, "doc_id", "text", path, default_pattern()).count() == 0


def test_pieces_of_one_hash_are_told_apart_by_bytes():
    import numpy as np

    from tidemark.llm.pieces import Pieces

    data = "ab cd ab ef ab".encode()
    p = Pieces(np.frombuffer(data, np.uint8), np.array([0, len(data)]), default_pattern())
    plain = [p.distinct()[0][i] for i in p.distinct()[1]]
    p.hash[:] = 7
    keys, inverse = p.distinct()
    assert [keys[i] for i in inverse] == plain == [b"ab", b" cd", b" ab", b" ef", b" ab"]
    assert sorted(keys) == [b" ab", b" cd", b" ef", b"ab"]


@pytest.mark.parametrize("text", ["don't you're 'rex  x   \n\n y\t 're  a", "", "a<|endoftext|>  <|endoftext|> 's", "naïve 日本語 😀😀  "])
def test_count_of_every_prefix(text):
    from tokenizers import Tokenizer

    path = default_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    c = token_counts.counter(path, default_pattern())
    cut = lambda i: text[:i]
    want = [len(t.encode(cut(i), add_special_tokens=False).ids) for i in range(len(text) + 1)]
    if "<|" in text:  # a cut inside the special string is another text; whole prefixes alone compare
        assert c.count(text) == want[-1]
    else:
        assert token_counts.PrefixCounts(c, text).every() == want


@settings(max_examples=200, deadline=None)
@given(TRICKY)
def test_counts_property(text):
    from tokenizers import Tokenizer

    path = default_path("byte_bpe_50k.json")
    c = token_counts.counter(path, default_pattern())
    assert c.count(text) == c.columns([text])[1][-1] == len(_tokenizer(Tokenizer, path).encode(text, add_special_tokens=False).ids)


def _tokenizer(kind, path, kept={}):  # noqa: B006
    if path not in kept:
        kept[path] = kind.from_file(path)
    return kept[path]


def test_result_column_must_be_free(frame):
    for made in (lambda d: repetition.score(d, into="n_words"), lambda d: relative_lz.parse(d, into="__key")):
        with pytest.raises(ValueError):
            made(frame)
