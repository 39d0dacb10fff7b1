"""Operators on pages: archives, extraction and the URL filter."""

from __future__ import annotations

import hashlib
import io
import time
import zipfile
import zlib

import duckdb
import pytest

from tidemark.llm import registry, url_filter, warc_zip, wrapper

LONG = "<p>" + "same page " * 30 + "</p>"


@pytest.fixture(scope="module")
def rows():
    page = lambda i, body: f"<html><body><div class='lead'>Constant line</div><div>{body}</div></body></html>"
    out = [(i, f"https://Host.example.net/en/{i}?utm_source=x", page(i, f"slot {i} &amp; more")) for i in range(6)]
    out += [(10, "http://a.org/fr/1", LONG), (11, "http://a.org/fr/1#x", LONG), (12, "no scheme", "x"), (13, None, "x"), (14, "http://b.net", None), (15, "http://b.net?q=1", ""), (16, "http://example.com/de/", LONG), (16, "http://x.example.com/de/é", "ü" * 60), (None, "http://c.com/", LONG)]
    return out


@pytest.fixture(scope="module")
def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", "s") for r in rows], "page_id bigint, url string, html string, __key string, text string").repartition(3)


def test_archives(pages, rows, spark):
    archives = warc_zip.archive(pages)
    out = warc_zip.read_archives(archives)
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = first[b] if b in first and first[b] != i else None
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    path = archives.first().path.removeprefix("file:")
    with zipfile.ZipFile(path) as z:  # another reader agrees that the archive is sound
        assert set(z.namelist()) == {warc_zip.DATA, warc_zip.INDEX} and z.testzip() is None
    none = warc_zip.read_archives(warc_zip.archive(pages.filter("false")))
    assert none.count() == 0


def test_archives_without_a_stored_index(spark, tmp_path, monkeypatch):
    """Members that no stored index covers are scanned; other record types are left out; a packed data member raises."""
    import gzip

    from pyspark.errors import PythonException

    monkeypatch.setattr(warc_zip, "SCAN_READ", 64)

    def warc(kind, body, head=b"", ctype=None):
        block = head + body
        extra = f"Content-Type: {ctype}\r\n" if ctype else ""
        return gzip.compress(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://x\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\n\r\n"
    records = [warc("warcinfo", b"made by", ctype="application/warc-fields"), warc("response", b"A" * 900, http, "application/http; msgtype=response"), warc("request", b"", b"GET / HTTP/1.1\r\n\r\n", "application/http"), warc("resource", b"no head\r\n\r\nhere", ctype="text/plain"), warc("conversion", b"text", ctype="text/plain"), warc("response", b"old", http)]
    names = [str(tmp_path / f"{k}.zip") for k in ("none", "deflated", "packed")]
    for path, how in zip(names, (None, zipfile.ZIP_DEFLATED, None)):
        with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
            z.writestr("archive/a.warc.gz", b"".join(records), zipfile.ZIP_DEFLATED if "packed" in path else zipfile.ZIP_STORED)
            if how is not None:
                z.writestr("indexes/index.cdxj", "junk" * 100, how)
    read = lambda path: sorted((r.record_type, bytes(r.payload)) for r in warc_zip.read_records(warc_zip.locate_records(spark.createDataFrame([(f"file://{path}",)], "path string"))).collect())
    want = sorted([("response", b"A" * 900), ("resource", b"no head\r\n\r\nhere"), ("conversion", b"text"), ("response", b"old")])
    assert read(names[0]) == want and read(names[1]) == want
    with pytest.raises(PythonException, match="not stored"):
        read(names[2])


def test_archive_of_another_writer(spark, tmp_path):
    """Several data members, a compressed CDXJ index, records without the writer's own fields."""
    import gzip

    def warc(url, body, kind="response"):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        return gzip.compress(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")

    data = {"a.warc.gz": [warc("http://x/1", b"one"), warc("http://x/2", "zwei ü".encode())], "b.warc.gz": [warc("http://x/3", b"", "revisit")]}
    lines = []
    for name, records in data.items():
        at = 0
        for k, raw in enumerate(records):
            lines.append(f'x)/{k} 20240101000000 {{"url": "u", "filename": "{name}", "offset": "{at}", "length": "{len(raw)}"}}')
            at += len(raw)
    path = tmp_path / "other.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for name, records in data.items():
            z.writestr(f"archive/{name}", b"".join(records))
        z.writestr("indexes/index.cdxj.gz", gzip.compress(("!meta {}\n" + "\n".join(lines)).encode()))
        z.writestr("pages/pages.jsonl", b"{}")
    out = warc_zip.read_records(warc_zip.locate_records(spark.createDataFrame([(f"file://{path}",)], "path string"))).collect()
    got = sorted((r.url, r.page_id, r.payload_bytes, r.payload_digest, r.record_type, bytes(r.payload)) for r in out)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == [("http://x/1", None, 3, sha(b"one"), "response", b"one"), ("http://x/2", None, 7, sha("zwei ü".encode()), "response", "zwei ü".encode()), ("http://x/3", None, None, None, "revisit", b"")]


def test_directory_of_plain_zip():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a", b"stored", zipfile.ZIP_STORED)
        z.writestr("b", b"packed" * 50, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6 in a comment"
    data = raw.getvalue()
    read = lambda at, n: data[at : at + n]
    members = warc_zip.directory(read, len(data))
    assert list(members) == ["a"] and read(*members["a"]) == b"stored"
    with pytest.raises(ValueError):
        warc_zip.directory(lambda at, n: b"x" * n, 100)


def test_url_filter(pages, rows, spark):
    listed = pages.filter("page_id % 50 = 0").select(url_filter.canonical(pages["url"]))
    out = url_filter.judge(pages, "page_id", "url", spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string"), listed)
    duckdb.sql("CREATE OR REPLACE TABLE pages (page_id BIGINT, url VARCHAR)")
    duckdb.executemany("INSERT INTO pages VALUES (?, ?)", [(i, u) for i, u, _ in rows])
    want = duckdb.sql(url_filter.ORACLE).fetchall()
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert url_filter.judge(pages.filter("false"), "page_id", "url", spark.createDataFrame([], "host string, path string, verdict string"), listed.filter("false")).count() == 0


def test_bloom_loses_nothing(spark):
    keys = spark.range(5000).selectExpr("cast(id as string) as k")
    bloom = url_filter.BlockedBloom(keys)
    every = spark.range(20000).selectExpr("cast(id as string) as k")
    passing = bloom.passing(every, "k").count()
    assert 5000 <= passing < 5600 and bloom.exact(every, "k").count() == 5000


def test_trees_and_blocks():
    page = """<!DOCTYPE html><html><head><title>no</title><script>var t="</p><article>no</article>";</script></head><body><nav>no</nav>
    <article><h1>Head  line</h1><p>One <b>bold<br>two<p>Three &amp; four&nbsp;five<ul><li>a<li>b</ul><div class="comments">no</div>
    <aside>no</aside><form>no</form><!-- no <p> --><p hidden>no</p><p>a < b</article><footer>no</footer></body>"""
    root = wrapper.parse(page)
    assert wrapper.blocks(wrapper.article_of(root)) == ["Head line", "One bold two", "Three & four five", "a", "b", "a < b"]
    assert wrapper.blocks([wrapper.parse("")]) == []


def test_tree_matching():
    m = wrapper.Matcher()
    a, b = (wrapper.parse(x) for x in ("<div><p>1</p><ul><li>x</li><li>y</li></ul></div>", "<div><h1>0</h1><p>2</p><ul><li>z</li></ul></div>"))
    m.shape(a), m.shape(b)
    assert m.match(a, b) == 5 and len(m.pairs(a, b)) == 5  # root, div, p, ul, li


def test_wrapper(pages, rows):
    out = {(r.page_id, r.url): r for r in wrapper.extract(pages).collect()}
    assert len(out) == len({(i, u) for i, u, _ in rows})
    for i in range(6):  # the line that is the same on the host's pages is template, the slot is content
        r = out[i, rows[i][1]]
        assert r.text == f"slot {i} & more" and r.n_template == 1
    assert out[14, "http://b.net"].text == "" and out[14, "http://b.net"].n_chars == 0
    assert out[10, "http://a.org/fr/1"].text == " ".join(["same page"] * 30)
    assert wrapper.extract(pages.filter("false")).count() == 0


def test_registry_names():
    names = sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(registry.oracle_sql()) <= set(names)


def _extracted(spark, pages):
    frame = spark.createDataFrame([(i, f"http://{host}/{i}", h) for i, (host, h) in enumerate(pages)], "page_id bigint, url string, html string")
    return {r.page_id: r for r in wrapper.extract(frame).collect()}


def _story(i, n=40):
    return " ".join(f"w{(i * 7919 + k * 104729) % 99991}" for k in range(n))


def test_template_inside_article(spark):
    """Constant lines in articles go, wherever they stand; copies and near copies of an article stay."""
    page = lambda body: f"<body><article>{body}</article></body>"
    pages = [("own.org", page("".join(f"<p>{_story(i * 10 + k)}</p>" for k in range(1 + i % 3)) + "<p>Read more on our site</p>")) for i in range(12)]
    pages += [("copy.org", page(f"<h1>One title</h1><p>{_story(1)}</p>") + " " * i) for i in range(12)]
    pages += [("near.org", page(f"<h1>One title</h1><p>{_story(1)}</p><p>{_story(2, 60)}</p><p>{_story(3, 60)} end {i}</p>")) for i in range(12)]
    out = _extracted(spark, pages)
    for i in range(12):
        assert out[i].text == "\n".join(_story(i * 10 + k) for k in range(1 + i % 3)) and out[i].n_template == 1
        assert out[12 + i].text == f"One title\n{_story(1)}" and out[12 + i].n_template == 0
        assert out[24 + i].text == f"One title\n{_story(1)}\n{_story(2, 60)}\n{_story(3, 60)} end {i}"


def test_sketch_is_the_plain_formula_and_cheaper():
    """F op3_wrapper: marks took most of the induction's time, one Python step an order and run of words."""

    def plain(text):
        words = text.split()
        grams = {zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "replace")) for i in range(max(len(words) - 2, 1))}
        return [min((g ^ (j * 0x9E3779B9 & 0xFFFFFFFF)) * 0x85EBCA6B + (g >> 13) * 0xC2B2AE35 & 0xFFFFFFFF for g in grams) for j in range(wrapper.MARKS)]

    for text in ("", " \n", "one", "one two", "a b c", "a\u00a0b\u3000c\nd", "z\ud800y \u00e9 \U0001f600 x", "a a a a a", "nul\0 in it \x1c x", _story(3, 500)):
        assert wrapper.sketch(text) == plain(text)
    took, stories = {plain: [], wrapper.sketch: []}, [_story(i, 400) for i in range(20)]
    for _ in range(5):
        for make, all_ in took.items():
            began = time.process_time()
            for story in stories:
                make(story)
            all_.append(time.process_time() - began)
    assert min(took[wrapper.sketch]) < 0.6 * min(took[plain])


def test_template_of_layouts_and_mixed_nodes(spark):
    """Two layouts of half the pages each, an odd first page, ids per page, template nodes with children."""
    pages = [("two.org", "<table><tr><td>odd</table>")]
    for i in range(8):
        pages.append(("two.org", f"<body class=post-{i}><div id=p{i}>{_story(i)}</div><div>Copyright <a>X</a> 2020</div></body>"))
        pages.append(("two.org", f"<body id='slug-{'abcdefgh'[i]}'><section><p>{_story(50 + i)}</p><p>All rights<br>kept by <b>us</b></p></section></body>"))
    out = _extracted(spark, pages)
    assert out[0].text == "odd"
    for i in range(8):
        assert out[1 + 2 * i].text == _story(i) and out[2 + 2 * i].text == _story(50 + i)
