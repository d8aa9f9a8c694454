"""WARC archives, index first.

Every page becomes a WARC 1.1 record in a gzip member of its own.  The task that
writes an archive also yields one index row per record: file, offset, length,
URL, digest.  Reading starts from the index: whatever rows of it are selected
are sorted by file and offset, neighbouring byte ranges are coalesced into one
read, and each record is unpacked from its slice and held against its digest.

A task writes files with names of its own, so a task that is run again never
touches what another attempt wrote; only files named by the index (a table that
Spark commits as a whole) count.  The folder must be one that all executors
share and Arrow's file systems open (local or mounted, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravel.llm.common import arrow_rows, slices
from ravel.operators.joins import join_per_key

FILE_BYTES = 1 << 30
RUN_BYTES = 4 << 20
GAP_BYTES = 64 << 10
LEVEL = 5
DATE = "2000-01-01T00:00:00Z"
_CRLF = b"\r\n"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long, length long"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    uri = re.sub(r"\Afile:/+", "/", uri)
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(kind: str, page_id: int | None, digest: str) -> bytes:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}/{page_id}/{digest}')}>".encode()


def _target(url: str) -> bytes:
    """The URL as a header value: bytes that can't stand in a URI are percent-encoded."""
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode())


def _head(version: bytes, fields: list[tuple[bytes, bytes]]) -> bytes:
    return version + _CRLF + b"".join(k + b": " + v + _CRLF for k, v in fields) + _CRLF


def pack_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str) -> bytes:
    """The record of a page; a revisit has the HTTP head only."""
    block = _head(b"HTTP/1.1 200 OK", [(b"Content-Type", b"text/html; charset=UTF-8"), (b"Content-Length", b"%d" % len(payload))])
    kind = "revisit" if revisit else "response"
    fields = [(b"WARC-Type", kind.encode()), (b"WARC-Record-ID", _record_id(kind, page_id, digest)), (b"WARC-Date", DATE.encode()),
              (b"WARC-Payload-Digest", b"sha1:" + digest.encode()), (b"X-Payload-Length", b"%d" % len(payload))]
    if url is not None:
        fields.append((b"WARC-Target-URI", _target(url)))
    if page_id is not None:
        fields.append((b"X-Page-Id", b"%d" % page_id))
    if revisit:
        fields += [(b"WARC-Profile", _PROFILE), (b"WARC-Refers-To", _record_id("response", refers_to, digest)), (b"X-Refers-To-Page-Id", b"%d" % refers_to)]
    else:
        block += payload
    fields += [(b"Content-Type", b"application/http; msgtype=response"), (b"Content-Length", b"%d" % len(block))]
    return _head(b"WARC/1.1", fields) + block + _CRLF + _CRLF


def member(data: bytes) -> bytes:
    """``data`` as one gzip member (without a time, so equal data give equal bytes)."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def unpack_record(body: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record's gzip member; a member that is cut or damaged raises ValueError."""
    z = zlib.decompressobj(31)
    try:
        data = z.decompress(body)
    except zlib.error as e:
        raise ValueError(f"damaged record: {e}") from e
    head, _, rest = data.partition(_CRLF + _CRLF)
    lines = head.split(_CRLF)
    fields = dict(line.decode().split(": ", 1) for line in lines[1:])
    size = int(fields.get("Content-Length", -1))
    if not z.eof or z.unused_data or not lines[0].startswith(b"WARC/") or rest[size:] != _CRLF + _CRLF:
        raise ValueError("damaged record")
    return fields, rest[:size].partition(_CRLF + _CRLF)[2]


def _write(out: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = folder(out)
        sink, name, at = None, "", 0
        for batch in slices(batches, "html"):
            rows: list[tuple] = []
            for page_id, url, html, rep, shared in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "rep", "shared")), strict=True):
                if sink is None or at >= file_bytes:
                    if sink is not None:
                        sink.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                    info = b"format: WARC File Format 1.1\r\n"
                    at += sink.write(member(_head(b"WARC/1.1", [(b"WARC-Type", b"warcinfo"), (b"WARC-Record-ID", _record_id("warcinfo", None, name)), (b"WARC-Date", DATE.encode()),
                                                                (b"WARC-Filename", name.encode()), (b"Content-Type", b"application/warc-fields"), (b"Content-Length", b"%d" % len(info))]) + info + _CRLF + _CRLF))
                payload = (html or "").encode()
                revisit = bool(shared) and rep is not None and rep != page_id
                digest = base32_sha1(payload)
                body = member(pack_record(page_id, url, payload, rep if revisit else None, revisit, digest))
                rows.append((page_id, url, "revisit" if revisit else "response", rep if revisit else None, len(payload), digest, name, at, len(body)))
                at += sink.write(body)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            names = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "file", "offset", "length")
            yield arrow_rows({c: (v, t) for c, v, t in zip(names, zip(*rows, strict=True), kinds, strict=True)})
        if sink is not None:
            sink.close()

    return run


def write_archives(pages: DataFrame, out: str, least: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Archives of ``pages`` (``page_id``, ``url``, ``html``) and their index below the folder ``out``.

    Of the pages with equal payloads of ``least`` bytes or more, the one with the largest page_id is the
    response and the others revisit it; all smaller ones are responses.  Null html is an
    empty payload.  A null page_id revisits a page with an id if there is one, otherwise it
    is a response; rows that repeat the largest page_id are responses each.  A null URL is left out of the record.  An
    empty table gives an empty index and no archive.  Other columns are ignored.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = source.withColumn("key", F.sha2(F.col("html").cast("binary"), 256))
    shared = (
        keyed.where(F.octet_length("html") >= least).groupBy("key").agg(F.max("page_id").alias("rep"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("key", "rep", "n", F.lit(True).alias("shared"))
    )
    rows = join_per_key(keyed, shared, "key", "n", "left", spread="page_id").select("page_id", "url", "html", "rep", "shared")
    rows.mapInArrow(_write(f"{out}/archives", file_bytes), _INDEX).write.parquet(f"{out}/index")


def read_index(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(f"{out}/index")


def coalesced(rows: list[tuple[str, int, int]], run_bytes: int = RUN_BYTES, gap: int = GAP_BYTES) -> Iterator[tuple[int, int]]:
    """Borders ``[lo, hi)`` of the stretches of sorted ``(file, offset, length)`` that one read each fetches.

    A stretch stays in one file, passes over at most ``gap`` bytes between two records, and
    holds ``run_bytes`` or a single record.
    """
    lo = 0
    for i in range(1, len(rows) + 1):
        if i < len(rows):
            file, offset, length = rows[i]
            before = rows[i - 1]
            if file == before[0] and offset - before[1] - before[2] <= gap and offset + length - rows[lo][1] <= run_bytes:
                continue
        if i > lo:
            yield lo, i
        lo = i


def read_records(selected: DataFrame, out: str, payload: bool = True, run_bytes: int = RUN_BYTES, gap: int = GAP_BYTES) -> DataFrame:
    """The records of the ``selected`` index rows, read from the archives below ``out``.

    Returns what the records say: page_id, record_type, refers_to, payload_bytes and payload_digest (for a
    response those of the payload that was read; it must agree with the record's own and the index), the index's url, and with
    ``payload`` the payload itself (empty for a revisit).
    """
    where = f"{out}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = folder(where)
        name, source = None, None
        for batch in batches:
            table = batch.to_pydict()
            places = list(zip(table["file"], table["offset"], table["length"], strict=True))
            for lo, hi in coalesced(places, run_bytes, gap):
                file, start, _ = places[lo]
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(f"{root}/{file}")
                body = source.read_at(places[hi - 1][1] + places[hi - 1][2] - start, start)
                out_rows = []
                for i in range(lo, hi):
                    at = places[i][1] - start
                    fields, content = unpack_record(body[at : at + places[i][2]])
                    kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    if kind == "response" and (base32_sha1(content) != digest or len(content) != size) or digest != table["payload_digest"][i]:
                        raise ValueError(f"{file} at {places[i][1]}: the payload's digest differs")
                    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                    out_rows.append((None if page is None else int(page), table["url"][i], kind, None if refers is None else int(refers), size, digest, content))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 6 + payload]
                names = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
                yield arrow_rows({c: (v, t) for c, v, t in zip(names, zip(*out_rows, strict=True), kinds)})
        if source is not None:
            source.close()

    rows = selected.select("file", "offset", "length", "url", "payload_digest", F.floor(F.col("offset") / run_bytes).alias("stretch"))
    dealt = rows.repartition("file", "stretch").sortWithinPartitions("file", "offset").drop("stretch")
    return dealt.mapInArrow(run, _RECORD + (", payload binary" if payload else ""))


ARCHIVES_SQL = r"""
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS hex, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS rep
  FROM pages
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN rep IS NULL OR page_id = rep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN rep IS NULL OR page_id = rep THEN NULL ELSE rep END AS refers_to
FROM p
"""
