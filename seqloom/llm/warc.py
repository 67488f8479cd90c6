"""WARC archives: written with deduplication and segments, read back with segment reassembly.

Writing. A page is an HTTP response record whose body has chunked transfer framing; a block of more
than `segment` characters becomes a first segment and continuation records, the last of which
carries the total length. Pages with equal payloads of at least MIN_DEDUP bytes: those of the
largest page_id are responses, others are revisit records without a body that refer to it. The
text sink writes the archives to any file system Spark knows: a record is a row, and the row
separator is the blank lines that end a record.

Reading. Files are parsed by Content-Length alone. Whole records are decoded where they are read; of
segmented ones only the segments travel, grouped by the origin's identifier, ordered by segment number, held
against the announced total length, joined, and their transfer framing removed.

Defined cases: null html is empty; equal rows each get their own record; pages of one page_id and
one payload are all responses if that page_id is the largest; a null page_id never is
another's response; line ends in URLs are percent-encoded; an empty table gives an empty result;
a block whose segments are missing, repeated or of another total length has `complete` false and
no payload; other columns are not read. A page of any length is cut into segments; it must fit in an executor's memory a
few times.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm._common import new_path, written
from seqloom.tables import if_small

MIN_DEDUP, SEGMENT, HTTP_CHUNK, PER_FILE = 1000, 2_048, 1_024, 8000
#: Bytes that are decompressed in one go; characters or bytes of records after which a task gives them on.
STEP, GIVEN_ON = 65_536, 1_000_000
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = CRLF.join(("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Transfer-Encoding: chunked", "", ""))
PARSED = "record_id string, page_id long, record_type string, refers_to long, digest string, payload_bytes long, segment int, total long, block binary"


def chunked(text: str, size: int = HTTP_CHUNK) -> str:
    """Chunked transfer framing of text in UTF-8; chunks end between characters."""
    parts = [text[i : i + size] for i in range(0, len(text), size)]
    return "".join(f"{len(p.encode()):x}{CRLF}{p}{CRLF}" for p in parts) + f"0{CRLF}{CRLF}"


def unchunked(body: bytes) -> bytes:
    """The framing removed; a broken frame raises ValueError."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        at = end + 2
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk of another length than announced")
        out.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(kind: str, record_id: str, block: str, **fields: str) -> str:
    """A record without the two line ends behind it, which the sink adds."""
    named = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE} | {k.replace("_", "-"): v for k, v in fields.items()}
    named["Content-Length"] = str(len(block.encode()))
    return "WARC/1.1" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in named.items()) + CRLF + block


def records_of(urn: str, serial: str, url: str, digest: str, html: str, refers_to: str | None, segment: int = SEGMENT) -> Iterator[str]:
    """The records of one page, the continuation records behind the first."""
    uri = url.replace("\r", "%0D").replace("\n", "%0A")
    name = f"{urn}:{serial}"
    same = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha1:{digest}"}
    if refers_to is not None:
        yield record("revisit", name, "HTTP/1.1 200 OK" + CRLF + CRLF, **same, WARC_Refers_To=f"<{refers_to}>", WARC_Profile=REVISIT, Content_Type="application/http;msgtype=response")
        return
    block = HTTP_HEAD + chunked(html)
    if len(block) <= segment:
        yield record("response", name, block, **same, Content_Type="application/http;msgtype=response")
        return
    total = str(len(block.encode()))
    for k, at in enumerate(range(0, len(block), segment), 1):
        last = {"WARC_Segment_Total_Length": total} if at + segment >= len(block) else {}
        if k == 1:
            yield record("response", name, block[:segment], **same, WARC_Segment_Number="1", Content_Type="application/http;msgtype=response")
        else:
            yield record("continuation", f"{name}:{k}", block[at : at + segment], WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Number=str(k), **last)


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, min_dedup: int = MIN_DEDUP) -> None:
    """pages (page_id, url, html) as gzipped WARC files under path.

    Payloads are equal if their SHA-256 and lengths are. Which page is a revisit is settled on these alone and written as
    a list; the payloads meet it where they are if it is small by count, else they are shuffled once. A record holds
    `segment` characters at most, so files are bounded by bytes as well as records.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    same = F.concat(F.sha2("html", 256), F.octet_length("html").cast("string"))
    large = p.where((F.octet_length("html") >= min_dedup) & F.col("page_id").isNotNull()).select("page_id", "digest", same.alias("same")).distinct()
    first = large.groupBy("same").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    revisits = large.join(first.select("same", "first"), "same").where("page_id < first").select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "first")
    revisits, _ = written(revisits.dropDuplicates(["_p", "_d"]), "revisits")
    rows = p.join(if_small(revisits), (F.col("page_id") == F.col("_p")) & (F.col("digest") == F.col("_d")), "left")
    rows = rows.select("page_id", "url", "html", "digest", "first")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        urn = lambda page, digest: f"urn:x-page:{'' if page is None else page}:{digest}"
        for b in batches:
            out, size = [], 0
            for row in zip(*b.columns, strict=True):  # a page is a Python string only while its records are made
                page, url, text, digest, first = (x.as_py() for x in row)
                n += 1
                for r in records_of(urn(page, digest), f"{part}-{n}", url, digest, text, None if first is None else urn(first, digest), segment):
                    out.append(r)
                    size += len(r)
                    if size > GIVEN_ON:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    rows.mapInArrow(made, "value string").write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


class _Source:
    """Bytes of a gzip or plain archive, decompressed as they are asked for. What has been taken is passed by, and cut off a few times a megabyte."""

    def __init__(self, content) -> None:
        self._in, self._at, self._buffer, self._from = memoryview(content), 0, bytearray(), 0
        self._gzip = zlib.decompressobj(31) if bytes(self._in[:2]) == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self._at >= len(self._in):
            return False
        if self._from > STEP:
            del self._buffer[: self._from]
            self._from = 0
        part = self._in[self._at : self._at + STEP]
        self._at += len(part)
        while part:
            if self._gzip is None:
                self._buffer += part
                break
            self._buffer += self._gzip.decompress(part)
            part = self._gzip.unused_data  # the next gzip member
            if part:
                self._gzip = zlib.decompressobj(31)
        return True

    def take(self, n: int) -> bytes:
        while len(self._buffer) - self._from < n:
            if not self._more():
                raise ValueError("archive ends within a record")
        out = bytes(memoryview(self._buffer)[self._from : self._from + n])
        self._from += n
        return out

    def head(self) -> bytes | None:
        """Up to the blank line behind the named fields; None at the end."""
        seen = 0
        while (end := self._buffer.find(b"\r\n\r\n", self._from + seen)) < 0:
            seen = max(0, len(self._buffer) - self._from - 3)
            if not self._more():
                if bytes(memoryview(self._buffer)[self._from :]).strip():
                    raise ValueError("archive ends within a record's head")
                return None
        return self.take(end + 4 - self._from)


def parse(content) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of each record of an archive."""
    source = _Source(content)
    while (head := source.head()) is not None:
        lines = head.decode().lstrip("\r\n").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins here: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        block = source.take(int(fields["content-length"]))
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than announced")
        yield fields, block


def _page(urn: str | None) -> int | None:
    said = (urn or "").strip("<>").split(":")
    return int(said[2]) if len(said) > 2 and said[2] else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per page record: page_id, payload_bytes, payload_digest, record_type, refers_to, complete."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in PARSED.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for f, block in parse(content.as_buffer()):
                    name = f["warc-record-id"].strip("<>")
                    kind, number = f["warc-type"], f.get("warc-segment-number")
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    total = f.get("warc-segment-total-length")
                    size += 200
                    if kind == "continuation":
                        rows.append((f["warc-segment-origin-id"].strip("<>"), None, None, None, None, None, int(number), int(total) if total else None, block))
                        size += len(block)
                    elif number:
                        rows.append((name, _page(name), kind, None, None, None, int(number), None, block))
                        size += len(block)
                    elif kind == "revisit":
                        rows.append((name, _page(name), kind, _page(f["warc-refers-to"]), digest, None, None, None, None))
                    else:
                        payload = payload_of(block)
                        rows.append((name, _page(name), kind, None, hashlib.sha1(payload).hexdigest(), len(payload), None, None, None))
                    if size > GIVEN_ON:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page, total, parts in zip(*b.columns, strict=True):  # a page's segments are Python bytes only while they are joined
                total, parts = total.as_py(), parts.as_py()
                block = b"".join(x["block"] for x in parts)
                whole = [x["segment"] for x in parts] == list(range(1, len(parts) + 1)) and len(block) == total
                payload = payload_of(block) if whole else None
                rows.append((page.as_py(), len(payload) if whole else None, hashlib.sha1(payload).hexdigest() if whole else None, whole))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["page_id", "payload_bytes", "digest", "complete"])

    files = spark.read.format("binaryFile").load(path).select("content")
    found, _ = written(files.mapInArrow(parsed, PARSED), "warc-records")
    whole = found.where("segment is null and record_type <> 'revisit'").select("page_id", "payload_bytes", "digest", F.lit(True).alias("complete"))
    parts = found.where("segment is not null").groupBy("record_id").agg(F.max("page_id").alias("page_id"), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    responses = whole.unionByName(parts.select("page_id", "total", "parts").mapInArrow(joined, "page_id long, payload_bytes long, digest string, complete boolean"))
    responses, _ = written(responses, "warc-responses")
    of = responses.where("complete").groupBy("page_id", "digest").agg(F.max("payload_bytes").alias("payload_bytes")).select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "payload_bytes")
    revisits = found.where("record_type = 'revisit'").select("page_id", "digest", "refers_to").join(of, (F.col("refers_to") == F.col("_p")) & (F.col("digest") == F.col("_d")), "left")
    out = lambda d, kind, to, ok: d.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit(kind).alias("record_type"), to.alias("refers_to"), ok.alias("complete"))
    return out(responses, "response", F.lit(None).cast("long"), F.col("complete")).unionByName(out(revisits, "revisit", F.col("refers_to"), F.col("payload_bytes").isNotNull()))


def warc_report(pages: DataFrame) -> DataFrame:
    """The contract's columns for all pages, read back from archives in the shared folder."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS m FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < m THEN m END AS refers_to FROM d
"""
