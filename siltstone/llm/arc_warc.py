"""Operator 5, legacy archive converter: ARC (versions 1 and 2) to WARC 1.1.

*Reading ARC.* A file starts with a version block (``filedesc://``) whose second line gives the version
and whose third line names the fields of every record line; records are then cut by those fields and by
their declared lengths, never by searching for a separator. Version 1 lines have five fields, version 2
lines ten.

*Converting.* What ARC lacks is synthesised from what it has: record ids are name-based UUIDs of archive,
offset, address and date; ``WARC-Date`` is the 14-digit ARC date; the type follows from the address and the
block (``warcinfo`` for the version block, ``response`` for HTTP, ``resource`` otherwise, ``revisit`` for a
payload that an earlier record has); block and payload digests are base32 SHA-1. Of records with equal
payloads of at least ``least`` bytes, the one with the smallest source id (null first; then archive and
offset) is the response. Finding it is a partial aggregation over digests; payloads move once, in the join
that tells each record whether it is a revisit, which the adaptive planner splits where copies are many.

*Files.* Archives are written and read by Spark's own text writer and binary reader, so they go wherever
the session's file systems reach, and an attempt that is lost leaves nothing. A task writes one archive of
what its input split holds; archives are read as a stream of records from the compressed bytes.

Defined results: null html is an empty payload; a null address is written as ``urn:x-none``, white space in
an address as %20; a null page_id has no source id and comes back null; repeated rows are records of their
own; an empty table gives archives without records and an empty result; other columns are left behind. A broken archive (no
version block, a bad record line, a record cut short, a line that is no UTF-8) raises; with ``set_aside`` it gives its records
up to there and one row of type ``broken`` with the reason in ``url``, which ``convert`` passes over.
"""

from __future__ import annotations

import zlib
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass, replace
from hashlib import sha1

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import kernels as K
from siltstone.llm.tables import made, shared_dir, stored

V1 = "URL IP-address Archive-date Content-type Archive-length"
V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
SOURCE_ID = "X-Source-Id"
REFERS_ID = "X-Refers-To-Source-Id"


@dataclass(frozen=True)
class ArchiveParams:
    date: str = "20260101000000"
    ip: str = "0.0.0.0"
    least: int = 0
    level: str = "DEFAULT_COMPRESSION"
    rows: int = 256
    set_aside: bool = False


def digest(data: bytes) -> str:
    return b32encode(sha1(data).digest()).decode()


def record_uuid(name: str) -> str:
    h = bytearray(sha1(name.encode()).digest()[:16])
    h[6], h[8] = h[6] & 0x0F | 0x50, h[8] & 0x3F | 0x80
    x = h.hex()
    return f"urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}"


def iso_date(d: str) -> str:
    d = (d + "00000000000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


class Stream:
    """Bytes of a plain or gzip file held in memory, given out piece by piece; several gzip members follow on."""

    def __init__(self, data: bytes):
        self.data, self.at, self.buf, self.pos, self.offset = memoryview(data), 0, b"", 0, 0
        self.gz = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        piece = self.data[self.at : self.at + (1 << 18)]
        self.at += len(piece)
        if self.gz is None:
            got = bytes(piece)
        else:
            got = self.gz.decompress(piece)
            while self.gz.eof and (rest := self.gz.unused_data.lstrip(b"\0")):
                self.gz = zlib.decompressobj(31)
                got += self.gz.decompress(rest)
            if self.gz.eof:
                self.gz = zlib.decompressobj(31) if self.at < len(self.data) else self.gz
        self.buf = self.buf[self.pos :] + got
        self.pos = 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end (\\n or \\r\\n); None at the end of the file."""
        look = 0
        while (end := self.buf.find(b"\n", self.pos + look)) < 0:
            look = len(self.buf) - self.pos
            if not self._more():
                if look == 0:
                    return None
                end = len(self.buf)
                break
        out = self.buf[self.pos : end]
        self.offset += end + 1 - self.pos
        self.pos = min(end + 1, len(self.buf))
        return out[:-1] if out.endswith(b"\r") else out

    def take(self, n: int) -> bytes:
        parts, need = [], n
        while need:
            have = self.buf[self.pos : self.pos + need]
            parts.append(have)
            self.pos += len(have)
            need -= len(have)
            if need and not self._more():
                raise ValueError(f"record is cut short by {need} bytes at {self.offset}")
        self.offset += n
        return b"".join(parts)


def http_parts(block: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields (lower-case names) and body of an HTTP response; None if it is not one."""
    if not block.startswith(b"HTTP/"):
        return None
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        head, _, body = block.partition(b"\n\n")
    fields = (x.partition(":") for x in head.decode("latin-1").splitlines()[1:])
    return {k.strip().lower(): v.strip() for k, _, v in fields}, body


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of each record after the version block, which comes first with field ``version``."""
    s = Stream(data)
    head = s.line()
    if head is None:
        return
    if not head.startswith(b"filedesc://"):
        raise ValueError("no ARC version block")
    block = s.take(int(head.rsplit(b" ", 1)[1]))
    version, names = block.split(b"\n")[:2]
    names = names.decode("latin-1").split()
    if version.split()[0] not in (b"1", b"2") or names[-1] != "Archive-length":
        raise ValueError(f"unknown ARC version block {block[:80]!r}")
    first = dict(zip(V1.split() if len(head.split(b" ")) == 5 else V2.split(), head.decode().split(" "), strict=False))
    yield 0, first | {"version": version.split()[0].decode()}, block
    while True:
        offset = s.offset
        line = s.line()
        if line is None:
            return
        if not line:
            continue
        got = line.decode().split(" ")
        if len(got) != len(names):
            raise ValueError(f"record line at {offset} has {len(got)} fields, not {len(names)}")
        fields = dict(zip(names, got, strict=True))
        yield offset, fields, s.take(int(fields["Archive-length"]))


def _readable(data: bytes, set_aside: bool) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``arc_records``; where the archive is broken, it ends with (-1, no fields, reason) if it is to be set aside."""
    try:
        yield from arc_records(data)
    except (ValueError, IndexError, zlib.error) as e:
        if not set_aside:
            raise
        yield -1, {}, f"{type(e).__name__}: {e}".encode()


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    s = Stream(data)
    while (line := s.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at {s.offset}")
        fields = {}
        while line := s.line():
            k, _, v = line.decode().partition(":")
            fields[k.strip()] = v.strip()
        yield fields, s.take(int(fields["Content-Length"]))


def warc_record(fields: dict[str, str | None], block: bytes) -> bytes:
    """Header and block; the writer puts the closing blank lines after it."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


# ---------------------------------------------------------------- archives as files


def _write(values: DataFrame, path: str, sep: str, p: ArchiveParams) -> str:
    """Each partition's values (binary) as one gzip file."""
    values.select(F.col("value").cast("string").alias("value")).write.option("lineSep", sep).option("compression", "gzip").option("zlib.compress.level", p.level).text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, params: ArchiveParams | None = None) -> str:
    """ARC archives of ``pages`` (page_id, url, html): version 1 from even tasks, version 2 from odd ones."""
    p = params or ArchiveParams()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId()
        v2, name = n % 2, f"pages-{n:06d}.arc"
        body = f"{1 + v2} 0 siltstone\n{V2 if v2 else V1}\n".encode()
        extra = lambda code: f" {code} - - 0 {name}" if v2 else ""
        out = [f"filedesc://{name} {p.ip} {p.date} text/plain{extra(200)} {len(body)}\n".encode() + body]
        for b in batches:
            for one in range(0, b.num_rows, p.rows):
                rows = b.slice(one, p.rows)
                for i, url, html in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    html = html or b""
                    url = "%20".join((url or "urn:x-none").split()) or "urn:x-none"
                    ident = "" if i is None else f"{SOURCE_ID}: {i}\r\n"
                    doc = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{ident}Content-Length: {len(html)}\r\n\r\n".encode() + html
                    out.append(f"{url} {p.ip} {p.date} text/html{extra(200)} {len(doc)}\n".encode() + doc)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    K.small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("html"))
    return _write(rows.mapInArrow(run, "value binary"), path, "\n", p)


ARC = "archive string, offset long, source_id long, url string, date string, type string, content_type string, version string, payload_bytes long, payload_digest string, record_id string"


def read_arc(spark: SparkSession, path: str, blocks: bool, params: ArchiveParams | None = None) -> DataFrame:
    """The records of the archives below ``path``, with their blocks (deflated: they are about to be shuffled) if asked."""
    p = params or ArchiveParams()
    names = [x.split()[0] for x in ARC.split(", ")] + ["block"] * blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                archive = file.rsplit("/", 1)[1]
                version = ""
                for offset, f, block in _readable(content.as_buffer(), p.set_aside):
                    if not f:
                        rows.append((archive, offset, None, block.decode(), None, "broken", None, version, 0, None, None, *([b""] if blocks else [])))
                        continue
                    version = f.get("version", version)
                    http = http_parts(block)
                    kind = "warcinfo" if offset == 0 else "response" if http else "resource"
                    body = http[1] if http else block
                    ident = http[0].get(SOURCE_ID.lower()) if http else None
                    rows.append((archive, offset, None if ident is None else int(ident), f["URL"], f["Archive-date"], kind, f["Content-type"], version, len(body), digest(body), record_uuid(f"{archive}|{offset}|{f['URL']}|{f['Archive-date']}"), *([zlib.compress(block, 1)] if blocks else [])))
                    size += len(block) * blocks + 200
                    if size > 1 << 20:
                        yield _batch(rows, ARC + ", block binary" * blocks, names)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, ARC + ", block binary" * blocks, names)

    return _files(spark, path).mapInArrow(run, ARC + ", block binary" * blocks)


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str, names: list[str]) -> pa.RecordBatch:
    kinds = [_TYPES[x.split()[1]] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def broken_archives(spark: SparkSession, path: str, params: ArchiveParams | None = None) -> DataFrame:
    """(archive, reason) of the archives that cannot be read to their end."""
    return read_arc(spark, path, False, replace(params or ArchiveParams(), set_aside=True)).where("type = 'broken'").select("archive", F.col("url").alias("reason"))


def convert(spark: SparkSession, arc: str, warc: str, params: ArchiveParams | None = None) -> str:
    """WARC archives below ``warc`` of the ARC archives below ``arc``."""
    p = params or ArchiveParams()
    light = stored(read_arc(spark, arc, False, p).where("type not in ('warcinfo', 'broken')"), "arc-index")
    order = F.struct("source_id", "archive", "offset", "record_id", "url", "date")
    first = light.where((F.col("payload_bytes") >= p.least) & (F.col("type") == "response")).groupBy("payload_digest", "payload_bytes").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    full = read_arc(spark, arc, True, p).where("type not in ('warcinfo', 'broken')").join(first, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("first").isNotNull() & (F.col("first.record_id") != F.col("record_id"))
    full = full.select("archive", "offset", "url", "date", "content_type", F.when(revisit, "revisit").otherwise(F.col("type")).alias("type"), "payload_digest", "record_id", F.col("first.record_id").alias("to_id"), F.col("first.url").alias("to_url"), F.col("first.date").alias("to_date"), F.col("first.source_id").alias("to_source"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = b"software: siltstone\r\nformat: WARC File Format 1.1\r\nconversion: ARC\r\n"
        n = TaskContext.get().partitionId()
        out = [warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<{record_uuid(f'{warc}|{n}')}>", "WARC-Date": iso_date(p.date), "WARC-Filename": f"pages-{n:06d}.warc.gz", "Content-Type": "application/warc-fields"}, info)]
        for b in batches:
            for one in range(0, b.num_rows, p.rows):
                for r in b.slice(one, p.rows).to_pylist():
                    block, f = zlib.decompress(r["block"]), {"WARC-Type": r["type"], "WARC-Record-ID": f"<{r['record_id']}>", "WARC-Target-URI": r["url"], "WARC-Date": iso_date(r["date"]), "WARC-Payload-Digest": f"sha1:{r['payload_digest']}"}
                    http = r["type"] != "resource"
                    if r["type"] == "revisit":
                        cut = block.find(b"\r\n\r\n") + 4
                        block = block[: cut if cut > 3 else block.find(b"\n\n") + 2]
                        f |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{r['to_id']}>", "WARC-Refers-To-Target-URI": r["to_url"], "WARC-Refers-To-Date": iso_date(r["to_date"]), REFERS_ID: r["to_source"]}
                    f |= {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": "application/http; msgtype=response" if http else r["content_type"]}
                    out.append(warc_record(f, block))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return _write(full.mapInArrow(run, "value binary"), warc, "\r\n\r\n", p)


WARC = "record_id string, type string, url string, date string, source_id long, payload_bytes long, payload_digest string, refers_to_id string, refers_to_source long"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below ``path``; digests of blocks and payloads are recomputed and must agree."""
    names = [x.split()[0] for x in WARC.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for content in b.column(1):
                for f, block in warc_records(content.as_buffer()):
                    if f["WARC-Type"] == "warcinfo":
                        continue
                    if f"sha1:{digest(block)}" != f["WARC-Block-Digest"]:
                        raise ValueError(f"block digest of {f['WARC-Record-ID']}")
                    http = http_parts(block)
                    fields, body = http or ({}, block)
                    known = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(fields["content-length"]) if f["WARC-Type"] == "revisit" else len(body)
                    if f["WARC-Type"] != "revisit" and digest(body) != known:
                        raise ValueError(f"payload digest of {f['WARC-Record-ID']}")
                    ident, to = fields.get(SOURCE_ID.lower()), f.get(REFERS_ID)
                    rows.append((f["WARC-Record-ID"], f["WARC-Type"], f.get("WARC-Target-URI"), f["WARC-Date"], None if ident is None else int(ident), size, known, f.get("WARC-Refers-To"), None if to is None else int(to)))
                    if len(rows) >= 5000:
                        yield _batch(rows, WARC, names)
                        rows = []
        if rows:
            yield _batch(rows, WARC, names)

    return _files(spark, path).mapInArrow(run, WARC)


def pages_through_archives(pages: DataFrame, params: ArchiveParams | None = None) -> DataFrame:
    """``pages`` as ARC, converted to WARC, read back: one row for each record."""
    import uuid

    p, spark = params or ArchiveParams(), pages.sparkSession
    at = made(spark, f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}")
    return read_warc(spark, convert(spark, write_arc(pages, f"{at}/arc", p), f"{at}/warc", p))
