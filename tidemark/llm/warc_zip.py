"""WARC archives packaged in ZIP files: a writer, and a reader that never extracts a member.

The reader finds the end-of-directory record from the file's tail, follows the ZIP64 locator and record
where there are any, parses the central directory with its ZIP64 extra fields, and takes the stored
(uncompressed) members alone: the index, and the WARC member whose records are gzip members of their
own. Index entries give each record's range inside the WARC member, so a record is one range read of
the ZIP file. A task reads ranges of a bounded number of records; ranges that touch are read at once. Stored data members
that no stored index covers are scanned for their records; a data member that is not stored raises.

Files lie in the shared folder and are reached through pyarrow's file systems (local, HDFS, S3, GCS). A
writing task gives its file a name of its own and reports it when it is complete; a file of an attempt
that was lost is in no report and never read.

A record's payload is the html in UTF-8 (null: empty). Of records with equal payloads of at least
`least` bytes, that with the smallest page_id is a response and the others revisit it; smaller ones are
all responses. Rows with a null page_id never are the smallest; rows that share the smallest are all
responses. A null or odd url is written percent-encoded; an html of any length is one record; an empty table gives no
archive; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, scratch, shared_dir

LEAST = 100
ROLL_BYTES = 256 << 20
ROLL_RECORDS = 20_000
RECORDS_A_READ = 256
GAP_READ = 8 << 20
SCAN_READ = 1 << 20
#: Record types that carry a page; others (warcinfo, request, metadata) are left out.
PAGES = ("response", "revisit", "resource", "conversion")
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
STORED = 0


# -- writing ------------------------------------------------------------------------------------


class ZipWriter:
    """Stored members in a stream that cannot seek; sizes follow the data, the directory is ZIP64."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        self.put(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0x808, STORED, 0, 0x21, 0, 0, 0, len(raw), 0) + raw)

    def data(self, raw: bytes) -> None:
        m = self.members[-1]
        m[2], m[3] = zlib.crc32(raw, m[2]), m[3] + len(raw)
        self.put(raw)

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self.put(struct.pack("<4sIQQ", b"PK\7\x08", crc, size, size))

    def close(self) -> None:
        start = self.at
        for name, at, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
            self.put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0x808, STORED, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra)
        size, n, record = self.at - start, len(self.members), self.at
        self.put(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start))
        self.put(struct.pack("<4sIQI", b"PK\6\7", 0, record, 1))
        self.put(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisits: int | None) -> bytes:
    """One WARC record as a gzip member; revisits: the response's page_id, or None for a response."""
    head = [("WARC-Type", "response" if revisits is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>")]
    if url:
        head.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("Page-Id", str(page_id)))
    if revisits is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page-Id", str(revisits))]
    block = HTTP + (payload if revisits is None else b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write (__id, __url, __html, __digest, __revisits) as archives; (path, records) of each."""

    def run(batches):
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        open_ = None

        def start():
            path = f"{base}/{uuid.uuid4().hex}.zip"
            z = ZipWriter(store.open_output_stream(path))
            z.begin(DATA)
            return [z, path, [], 0]

        def finish(state):
            z, path, index, _ = state
            z.end()
            z.begin(INDEX)
            z.data("".join(index).encode())
            z.end()
            z.close()
            z.out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rpartition('/')[2]}"]), pa.array([len(index)], pa.int64())], names=["path", "records"])

        for batch in batches:
            for page_id, url, html, digest, revisits in zip(*(column(batch, c).to_pylist() for c in ("__id", "__url", "__html", "__digest", "__revisits")), strict=True):
                open_ = open_ or start()
                raw = record(page_id, url, (html or "").encode(), digest, revisits)
                open_[2].append(json.dumps({"filename": DATA.rpartition("/")[2], "offset": open_[3], "length": len(raw), "page": page_id}) + "\n")
                open_[0].data(raw)
                open_[3] += len(raw)
                if open_[3] >= ROLL_BYTES or len(open_[2]) >= ROLL_RECORDS:
                    yield finish(open_)
                    open_ = None
        if open_:
            yield finish(open_)

    return records.mapInArrow(run, "path string, records long")


# -- reading ------------------------------------------------------------------------------------


def directory(read, size: int, packed_too: list[str] | None = None) -> dict[str, tuple[int, int]]:
    """(offset of the data, bytes) of each stored member; read(offset, length) gives bytes of the file."""
    tail_at = max(0, size - (22 + 0xFFFF + 20))
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\6\7" and (n == 0xFFFF or 0xFFFFFFFF in (length, start)):
        at = int.from_bytes(tail[end - 12 : end - 4], "little")
        big = read(at, 56)
        if big[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = struct.unpack("<QQQ", big[32:56])
    raw, at, out = read(start, length), 0, {}
    for _ in range(n):
        if raw[at : at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, _, _, _, packed, plain, a, b, c = struct.unpack("<HHHIIIHHH", raw[at + 10 : at + 34])
        header = int.from_bytes(raw[at + 42 : at + 46], "little")
        name, extra = raw[at + 46 : at + 46 + a].decode(), raw[at + 46 + a : at + 46 + a + b]
        while len(extra) >= 4:
            tag, m = struct.unpack("<HH", extra[:4])
            if tag == 1:
                wide = iter(struct.unpack(f"<{m // 8}Q", extra[4 : 4 + m // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            extra = extra[4 + m :]
        if method != STORED and packed_too is not None:
            packed_too.append(name)
        if method == STORED:
            local = read(header, 30)
            if local[:4] != b"PK\3\4":
                raise ValueError("broken local header")
            out[name] = (header + 30 + sum(struct.unpack("<HH", local[26:30])), packed)
        at += 46 + a + b + c
    return out


_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*(.*?)\r?$", re.M)


def parse_record(packed: bytes) -> dict:
    """Fields of one record, with its payload: the block, without the HTTP head that exchanges have."""
    raw = gzip.decompress(packed)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(head)}
    block, kind = rest[: int(fields["content-length"])], fields.get("content-type", "")
    http = kind.lower().startswith("application/http") if kind else fields.get("warc-type") in ("response", "revisit", "request")
    fields["payload"] = block.partition(b"\r\n\r\n")[2] if http else block
    return fields


def _opened(uri: str):
    store, path = pafs.FileSystem.from_uri(uri)
    f = store.open_input_file(path)

    def read(offset: int, length: int) -> bytes:
        f.seek(offset)
        raw = f.read(length)
        if len(raw) != length:
            raise EOFError(f"{uri} ends before {offset + length}")
        return raw

    return f, read


def index_entries(name: str, raw: bytes, members: dict[str, tuple[int, int]]) -> list[tuple[int, int]]:
    """(offset in the file, bytes) of the records that an index member lists.

    A line ends with a JSON object of filename, offset and length, after a key and a time in the CDXJ form or alone.
    filename is a member's whole name or its last part; an archive of one data member may leave it out.
    """
    data = {k: v for k, v in members.items() if k.startswith("archive/")}
    known = {k.rpartition("/")[2]: at for k, (at, _) in data.items()} | {k: at for k, (at, _) in members.items()}
    out = []
    for line in (gzip.decompress(raw) if name.endswith(".gz") else raw).splitlines():
        if line.strip() and not line.startswith(b"!"):
            x = json.loads(line[line.index(b"{") :])
            if x.get("filename") is None and len(data) != 1:
                raise ValueError("an index entry names none of several archive members")
            base = known[x["filename"]] if x.get("filename") is not None else next(iter(data.values()))[0]
            out.append((base + int(x["offset"]), int(x["length"])))
    return sorted(out)


def scanned(read, at: int, size: int):
    """(offset in the file, bytes) of each gzip member of a data member, found by inflating it piece by piece."""
    begin, end = at, at + size
    while begin < end:
        member, to = zlib.decompressobj(31), begin
        while not member.eof:
            if to >= end:
                raise EOFError("a record ends after its archive member")
            raw = read(to, min(SCAN_READ, end - to))
            to += len(raw)
            while raw and not member.eof:
                member.decompress(raw, SCAN_READ)
                raw = member.unconsumed_tail
        length = to - begin - len(member.unused_data)
        yield begin, length
        begin += length


def records_of(path: str, read, size: int) -> list[tuple[int, int]]:
    """Ranges of the records of an archive: those its indexes list, and of data members that no stored index covers those found by a scan.

    A data member that is compressed as a whole cannot be read by ranges: ValueError.
    """
    packed: list[str] = []
    members = directory(read, size, packed)
    whole = sorted(n for n in packed if n.startswith("archive/"))
    if whole:
        raise ValueError(f"{path}: members {', '.join(whole)} are not stored")
    out: list[tuple[int, int]] = []
    for name, (at, n) in members.items():
        if name.startswith("indexes/"):
            out += index_entries(name, read(at, n), members)
    for name, (at, n) in members.items():
        if name.startswith("archive/") and name.endswith(".gz") and not any(at <= x < at + n for x, _ in out):
            out += scanned(read, at, n)
    return sorted(set(out))


def locate_records(archives: DataFrame) -> DataFrame:
    """(path, offsets, lengths): ranges of records in each archive, RECORDS_A_READ a row."""

    def run(batches):
        for batch in batches:
            for path in column(batch, "path").to_pylist():
                f, read = _opened(path)
                entries = records_of(path, read, f.size())
                rows = [entries[i : i + RECORDS_A_READ] for i in range(0, len(entries), RECORDS_A_READ)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(rows), pa.string()),
                        pa.array([[x for x, _ in r] for r in rows], pa.list_(pa.int64())),
                        pa.array([[x for _, x in r] for r in rows], pa.list_(pa.int64())),
                    ],
                    names=["path", "offsets", "lengths"],
                )
                f.close()

    return archives.mapInArrow(run, "path string, offsets array<long>, lengths array<long>")


def ranges(offsets: list[int], lengths: list[int], read):
    """The bytes of each range; ranges that touch are read together, up to GAP_READ bytes."""
    i = 0
    while i < len(offsets):
        j, end = i, offsets[i] + lengths[i]
        while j + 1 < len(offsets) and offsets[j + 1] == end and end + lengths[j + 1] - offsets[i] <= GAP_READ:
            j += 1
            end += lengths[j]
        raw = read(offsets[i], end - offsets[i])
        for k in range(i, j + 1):
            yield raw[offsets[k] - offsets[i] : offsets[k] - offsets[i] + lengths[k]]
        i = j + 1


def read_records(located: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload of each located record.

    A response's payload is measured and digested; of a revisit these are what its header says, null if it says nothing.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            for path, offsets, lengths in zip(*(column(batch, c).to_pylist() for c in ("path", "offsets", "lengths")), strict=True):
                f, read = _opened(path)
                rows = []
                for raw in ranges(offsets, lengths, read):
                    x = parse_record(raw)
                    if x["warc-type"] not in PAGES:
                        continue
                    said = x.get("warc-payload-digest", "")
                    said, n = said.removeprefix("sha256:") if said.startswith("sha256:") else None, x.get("payload-length")
                    digest, n = (said, n and int(n)) if x["warc-type"] == "revisit" else (hashlib.sha256(x["payload"]).hexdigest(), len(x["payload"]))
                    if said not in (None, digest):
                        raise ValueError(f"a payload in {path} does not have its digest")
                    page, to = x.get("page-id"), x.get("refers-to-page-id")
                    rows.append((page and int(page), n, digest, x["warc-type"], to and int(to), x.get("warc-target-uri"), x["payload"]))
                f.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return located.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """Write every row of pages into archives of the shared folder; (path, records) of each archive."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("__id"), F.col(url).alias("__url"), F.col(html).alias("__html"), F.sha2(body, 256).alias("__digest"))
    sized = pages.select(F.col(key).cast("long").alias("__id"), F.sha2(body, 256).alias("__digest"), F.length(body).alias("__n")).filter(F.col("__n") >= least)
    first = sized.groupBy("__digest").agg(F.min("__id").alias("__first"), F.count("*").alias("__rows")).filter("__rows > 1").drop("__rows")
    typed = rows.join(first, "__digest", "left")
    revisits = F.when(F.col("__first").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__first")), F.col("__first"))
    folder = f"{shared_dir(pages.sparkSession)}/tidemark/warc-{uuid.uuid4().hex}"
    return scratch(write_archives(typed.select("__id", "__url", "__html", "__digest", revisits.alias("__revisits")), folder), "op1-archives")


def read_archives(archives: DataFrame) -> DataFrame:
    n = max(1, archives.count())
    located = scratch(locate_records(archives.repartition(n)), "op1-index")
    return read_records(located.repartition(max(n, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def op1_warc_zip(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read_archives(archive(pages)).drop("url", "payload")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first IS NULL OR d.page_id IS NOT DISTINCT FROM f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
