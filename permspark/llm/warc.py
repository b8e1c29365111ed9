"""WARC archives: a record per page, one gzip member per record, read back in sequence.

write_archives() turns pages into archive parts, each a valid ``.warc.gz`` of whole
records; read_archives() reads parts by incremental zlib decompression, frames records
by Content-Length and verifies block and payload digests. Equal payloads of at least
``min_dup_bytes`` are stored once: the record of the largest page_id is the response,
the others are revisit records that name it.

The reader takes archives of others, too: all record types, folded header lines, chunked
bodies, digests that are absent or by MD5, SHA-1, SHA-256 or SHA-512 in base 16 or 32. A digest by an
algorithm that isn't known is not verified. The payload of HTTP messages is their body, of other
records their block; ``payload_digest`` is that of the header, as hex, else the payload's SHA-1.

Defined cases: null html is an empty payload; a null url is left out of the header;
rows that repeat a page_id with the same payload are all responses where that id is the
largest, and share one record id; a record's id names page_id and payload, without page_id its place in the archive; without any page_id in a group of equal payloads all its rows are responses,
and a row without page_id beside one that has it is a revisit. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permspark.llm.common import cut, table

#: Parts of an archive are closed at so many compressed bytes.
PART_BYTES = 4 << 20
CHUNK = 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARTS = "archive string, part long, n_records long, content binary"
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary"
)


def mark_duplicates(pages: DataFrame, min_dup_bytes: int = 1000) -> DataFrame:
    """pages with digest, payload size and the page_id of the response of equal payloads.

    Digests are grouped with map-side maxima, so a payload that a third of all pages
    share is reduced before the shuffle; the join back may be split by AQE.
    """
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    keepers = (
        p.where(F.col("size") >= min_dup_bytes)
        .groupBy(F.col("digest").alias("k_digest"), F.col("size").alias("k_size"))
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    return p.join(
        keepers, (F.col("digest") == F.col("k_digest")) & (F.col("size") == F.col("k_size")), "left"
    ).select("page_id", "url", "payload", "digest", "size", "keeper")


def _urn(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, 'page:' + ':'.join(map(str, parts)))}>"


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _header_safe(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, url, payload: bytes, digest: str, keeper, date: str, place: str = "") -> bytes:
    """The bytes of one record, not compressed; place: where it stands, the name of a record without page_id."""
    revisit = keeper is not None and keeper != page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(place, digest) if page_id is None else _urn(page_id, digest)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_header_safe(url)}"] if url is not None else []),
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(keeper, digest)}", f"X-Refers-To-Page: {keeper}"] if revisit else []),
        f"X-Payload-Length: {len(payload)}",
        f"WARC-Payload-Digest: {_b32(bytes.fromhex(digest))}",
        f"WARC-Block-Digest: {_b32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(pages: DataFrame, min_dup_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archive parts (archive, part, n_records, content) of all pages."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"pages-{TaskContext.get().partitionId():06d}"
        part, members, size = 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([part], pa.int64()), pa.array([len(members)], pa.int64()), pa.array([b"".join(members)], pa.binary())],
                names=["archive", "part", "n_records", "content"],
            )

        for batch in batches:
            cols = [batch.column(n) for n in ("page_id", "url", "payload", "digest", "keeper")]
            for i in range(batch.num_rows):
                members.append(_member(record(*(c[i].as_py() for c in cols), date, f"{name}/{part}/{len(members)}")))
                size += len(members[-1])
                if size >= PART_BYTES:
                    yield out()
                    part, members, size = part + 1, [], 0
        if members:
            yield out()

    return mark_duplicates(pages, min_dup_bytes).mapInArrow(write, PARTS)


class WarcError(ValueError):
    """An archive is cut short or a digest doesn't fit."""


def members(content: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, each decompressed by chunks."""
    at = 0
    while at < len(content):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            chunk = content[at : at + CHUNK]
            if not chunk:
                raise WarcError("the last gzip member is cut short")
            try:
                out.append(z.decompress(chunk))
            except zlib.error as e:
                raise WarcError(f"not a gzip member at byte {at}: {e}") from e
            at += len(chunk) - len(z.unused_data)
        yield b"".join(out)


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a space continues the one before."""
    out, last = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _digest(value: str) -> tuple[str, bytes] | None:
    """Algorithm and bytes of a labelled digest in base 16 or 32; None if it can't be told."""
    name, _, text = value.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    size, text = hashlib.new(name).digest_size, text.strip()
    try:
        if len(text) == 2 * size:
            return name, bytes.fromhex(text)
        raw = base64.b32decode(text.upper().rstrip("=") + "=" * (-len(text.rstrip("=")) % 8))
    except ValueError:
        raw = b""
    if len(raw) != size:
        raise WarcError(f"not a {name} digest: {text!r}")
    return name, raw


def _fits(value: str | None, *bodies: bytes) -> bool:
    """Whether a digest, if there is one that can be told, is that of one of the bodies."""
    told = _digest(value) if value else None
    return told is None or any(hashlib.new(told[0], x).digest() == told[1] for x in bodies)


def _unchunked(body: bytes) -> bytes | None:
    """A body without its chunk framing; None if that doesn't hold."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            n = int(body[at:end].split(b";")[0], 16) if end > at else -1
        except ValueError:
            n = -1
        if n < 0 or end + 2 + n > len(body):
            return None
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def parse(data: bytes) -> dict:
    """One record from its bytes: headers in lower case, block, payload; digests verified."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    headers = _fields(lines[1:])
    if "warc-type" not in headers or not headers.get("content-length", "").isdecimal():
        raise WarcError("a header without WARC-Type or Content-Length")
    length = int(headers["content-length"])
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise WarcError("Content-Length doesn't frame the record")
    if not _fits(headers.get("warc-block-digest"), block):
        raise WarcError("the block digest doesn't fit")
    payload = whole = block
    if headers.get("content-type", "").split(";")[0].strip().lower() == "application/http":
        message, _, whole = block.partition(b"\r\n\r\n")
        payload = whole
        if _fields(message.decode("latin-1").split("\r\n")[1:]).get("transfer-encoding", "").lower() == "chunked":
            payload = _unchunked(whole)
            payload = whole if payload is None else payload
    if headers["warc-type"] != "revisit" and not _fits(headers.get("warc-payload-digest"), payload, whole):
        raise WarcError("the payload digest doesn't fit")
    return {"headers": headers, "block": block, "payload": payload}


def _row(data: bytes, keep_payload: bool) -> tuple:
    r = parse(data)
    h, revisit = r["headers"], r["headers"]["warc-type"] == "revisit"
    number = lambda k: int(h[k]) if re.fullmatch(r"-?\d+", h.get(k, "")) else None
    url, told = h.get("warc-target-uri"), _digest(h.get("warc-payload-digest", ""))
    return (
        number("x-page-id"),
        None if url is None else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url) if "x-page-id" in h or "x-payload-length" in h else url,
        h["warc-type"],
        number("x-refers-to-page"),
        number("x-payload-length") if revisit else len(r["payload"]),
        told[1].hex() if told else None if revisit else hashlib.sha1(r["payload"]).hexdigest(),
        None if revisit or not keep_payload else r["payload"],
    )


def read_archives(parts: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The records of archive parts (a column ``content``), in their order within each part."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for data in members(content.as_py()):
                    rows.append(_row(data, keep_payload))
                    size += len(data) if keep_payload else 100
                    if size >= PART_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return parts.select("content").mapInArrow(read, RECORDS)


def save(parts: DataFrame, folder: str) -> int:
    """Write each part as ``<archive>-<part>.warc.gz`` in a folder; the number of parts.

    ``folder`` is a path or the URI of a store (file, hdfs, s3, gs) that all executors reach.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        store.create_dir(base, recursive=True)
        for b in batches:
            for name, part, content in zip(*(b.column(c) for c in ("archive", "part", "content")), strict=True):
                path = f"{base}/{name}-{part.as_py():06d}.warc.gz"
                hidden = f"{base}/.{uuid.uuid4().hex}"
                with store.open_output_stream(hidden) as out:
                    out.write(content.as_buffer())
                store.move(hidden, path)  # a task that runs again leaves whole files only
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return parts.select("archive", "part", "content").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def load(spark: SparkSession, folder: str) -> DataFrame:
    """Parts from files, in any store that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = cut(write_archives(table(spark, sf_dir, "pages")))
    return read_archives(parts, keep_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


QUERIES = {"op9_warc": op9_warc}
ORACLE = {
    "op9_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS digest FROM pages
), k AS (
  SELECT digest, max(page_id) AS keeper FROM p WHERE size >= 1000 GROUP BY digest HAVING count(*) > 1
)
SELECT p.page_id, CAST(size AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper = page_id THEN NULL ELSE keeper END AS refers_to
FROM p LEFT JOIN k ON p.digest = k.digest AND size >= 1000
"""
}
