"""Secret scans: patterns, then structural confirmation of encoded candidates.

Base kinds are patterns alone: assign, access, hex. The method adds spans of candidates
that decode and parse: ``jwt`` (a signed token: base64url header and claims are JSON
objects, the header names its algorithm), ``pem`` (an armoured private key whose body
parses: DER or OpenSSH as below, a body sealed by a block cipher as its DEK-Info says, or PGP packets
that begin with a secret key, with their checksum) and ``key`` (base64 or hex that decodes to a private key in DER, nested lengths
fitting exactly, or to an OpenSSH key with its length-prefixed fields).

Defined cases: null text is empty; empty texts have no spans; overlapping spans of
different kinds are all reported; repeated rows are scanned alike; other columns are
kept by redact() and ignored by scan(). Spans are code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permspark.llm.common import SPACE, table, texts_of

KINDS = ("assign", "access", "hex", "jwt", "pem", "key")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]{6,}\.e[wy][A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY((?: BLOCK)?)-----([^-]*(?:-(?!----)[^-]*)*)-----END \1PRIVATE KEY\2-----")
DEK = re.compile(r"DEK-Info:\s*[A-Z0-9]+(?:-[A-Z0-9]+)*,\s*([0-9A-Fa-f]+)")
BASE64 = re.compile(r"(?:(?<![A-Za-z0-9+/_-])(?!(?<=\\)[nrt])|(?<=\\[nrt]))[A-Za-z0-9+/_-]{40,}={0,2}")
LINE = re.compile(r"(?:\s|\\[nrt])+([A-Za-z0-9+/_-]+={0,2})")  # the next of wrapped base64, also after escaped line ends
MIXED_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")


def unbase64(text: str) -> bytes | None:
    text = text.translate({45: "+", 95: "/"}).rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, depth: int = 0) -> list[tuple[int, object]] | None:
    """Tags with contents (nested lists for constructed ones) if all lengths fit exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth > 12:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > len(data):
                return None
            n = int.from_bytes(data[at : at + size], "big")
            if n < 0x80:  # DER wants the short form
                return None
            at += size
        if at + n > len(data):
            return None
        body = data[at : at + n]
        inner = der(body, depth + 1) if tag & 0x20 else body
        if inner is None:
            return None
        out.append((tag, inner))
        at += n
    return out


def private_key(data: bytes) -> bool:
    """Whether data is a private key: PKCS#1, PKCS#8 (plain or encrypted), SEC1 or OpenSSH."""
    if data.startswith(b"openssh-key-v1\0"):
        return openssh(data[15:])
    if data[:1] != b"\x30":
        return False
    top = der(data)
    if not top or len(top) != 1 or not isinstance(top[0][1], list):
        return False
    parts = top[0][1]
    tags = [t for t, _ in parts]
    if tags[:3] == [0x02, 0x30, 0x04]:  # version, algorithm, key
        algorithm = parts[1][1]
        return parts[0][1] in (b"\0", b"\1") and bool(algorithm) and algorithm[0][0] == 0x06 and len(parts[2][1]) >= 16
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:  # version and eight numbers
        return parts[0][1] in (b"\0", b"\1") and len(parts[1][1]) >= 32
    if tags[:2] == [0x02, 0x04] and set(tags[2:]) <= {0xA0, 0xA1}:  # version and scalar of a curve
        return parts[0][1] == b"\1" and len(parts[1][1]) >= 16
    if tags == [0x30, 0x04]:  # an encryption scheme with its parameters, the sealed key
        scheme = parts[0][1]
        return len(scheme) >= 2 and scheme[0][0] == 0x06 and len(parts[1][1]) >= 16
    return False


def openssh(data: bytes) -> bool:
    """Cipher, key derivation, its options, number of keys, public and private part."""

    def field(at: int) -> tuple[bytes, int] | None:
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        return (data[at + 4 : at + 4 + n], at + 4 + n) if at + 4 + n <= len(data) else None

    at = 0
    for _ in range(3):
        if (got := field(at)) is None:
            return False
        at = got[1]
    if at + 4 > len(data) or not 1 <= int.from_bytes(data[at : at + 4], "big") <= 16:
        return False
    public = field(at + 4)
    return public is not None and (rest := field(public[1])) is not None and len(rest[0]) >= 8 and rest[1] == len(data)


def extent(data: bytes) -> tuple[int, bool]:
    """Bytes of the DER value or OpenSSH key that starts here, by its outer lengths; False: that many at least."""
    if data.startswith(b"openssh-key-v1\0"):
        at = 15
        for k in range(6):  # cipher, key derivation, options, number of keys, public and private part
            if at + 4 > len(data):
                return at + 4, False
            at += 4 + (int.from_bytes(data[at : at + 4], "big") if k != 3 else 0)
        return at, True
    size = data[1] & 0x7F
    if data[1] < 0x80 or size > 4:
        return 2 + size, True
    return 2 + size + int.from_bytes(data[2 : 2 + size], "big"), True


def wrapped_key(text: str, start: int, end: int) -> int | None:
    """End of the private key whose base64 begins with the line [start, end) and goes on in the next ones."""
    parts, have = [text[start:end]], end - start
    head = unbase64(parts[0][: have // 4 * 4])
    if not head or not (head[0] == 0x30 or head.startswith(b"openssh-key-v1\0")):
        return None
    need, told = extent(head)
    while not told or have < -(-need * 4 // 3):
        line = LINE.match(text, end)
        if line is None or parts[-1].endswith("="):
            return None
        parts.append(line[1])
        have, end = have + len(line[1]), line.end()
        if not told and have // 4 * 3 >= need:
            data = unbase64("".join(parts)[: have // 4 * 4])
            if not data:
                return None
            need, told = extent(data)
    data = unbase64("".join(parts))
    return end if len(parts) > 1 and data and private_key(data) else None


def signed_token(text: str) -> bool:
    header, claims = (unbase64(x) for x in text.split(".")[:2])
    try:
        head, body = json.loads(header or b""), json.loads(claims or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def _lines(armoured: str) -> list[str]:
    """The lines of an armoured key, also of one written as in JSON."""
    return [x.strip() for x in armoured.replace("\\r", "\n").replace("\\n", "\n").replace("\\/", "/").splitlines()]


def _body(lines: list[str]) -> bytes | None:
    """The bytes in an armoured key, without header lines like ``Proc-Type: ...``."""
    return unbase64("".join("".join(x.split()) for x in lines if ":" not in x))


def crc24(data: bytes) -> int:
    """The checksum of PGP armour."""
    crc = 0xB704CE
    for x in data:
        crc ^= x << 16
        for _ in range(8):
            crc = (crc << 1) ^ (0x1864CFB if crc & 0x800000 else 0)
    return crc


def pgp_packets(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and bodies of PGP packets if all lengths fit exactly."""
    out, at = [], 0
    while at < len(data):
        head = data[at]
        at += 1
        if not head & 0x80:
            return None
        if head & 0x40:  # the new form
            tag, n = head & 0x3F, data[at] if at < len(data) else 255
            if n < 192:
                at += 1
            elif n < 224 and at + 1 < len(data):
                n, at = ((n - 192) << 8) + data[at + 1] + 192, at + 2
            elif n == 255 and at + 5 <= len(data):
                n, at = int.from_bytes(data[at + 1 : at + 5], "big"), at + 5
            else:
                return None
        else:
            tag, size = head >> 2 & 0xF, (1, 2, 4, 0)[head & 3]
            n = int.from_bytes(data[at : at + size], "big") if size else len(data) - at
            at += size
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def pgp_secret(lines: list[str]) -> bool:
    """Whether armour holds packets that begin with a secret key (version 3 to 6), and its checksum, if any, fits."""
    check = next((x for x in lines if re.fullmatch("=[A-Za-z0-9+/]{4}", x)), None)
    data = _body([x for x in lines if x != check])
    packets = pgp_packets(data) if data else None
    if not packets or packets[0][0] != 5 or packets[0][1][:1] not in (b"\3", b"\4", b"\5", b"\6") or len(packets[0][1]) < 20:
        return False
    return check is None or unbase64(check[1:]) == crc24(data).to_bytes(3, "big")


def sealed(armoured: str, data: bytes) -> bool:
    """Whether a body is as its DEK-Info says: whole blocks of a cipher whose start value has the block's size."""
    m = DEK.search(armoured)
    return m is not None and len(m[1]) in (16, 32) and len(data) >= 32 and len(data) % (len(m[1]) // 2) == 0


def armoured_key(kind: str, block: bool, body: str) -> bool:
    """Whether the body of an armoured private key parses."""
    lines = _lines(body)
    if block:
        return kind == "PGP " and pgp_secret(lines)
    data = _body(lines)
    return bool(data) and (private_key(data) or sealed(body, data))


def base_spans(text: str, longest: int | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds; longest: bytes of the longest run without spaces."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if longest is None or longest >= 32:
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def confirmed_spans(text: str, longest: int | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of candidates whose structure holds."""
    out = []
    if "-----BEGIN " in text:
        out += [(m.start(), m.end(), "pem") for m in PEM.finditer(text) if armoured_key(m[1], bool(m[2]), m[3])]
    if longest is None or longest >= 20:
        if ".e" in text:
            out += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if signed_token(m[0])]
    if longest is None or longest >= 40:
        armoured = [(a, b) for a, b, k in out if k == "pem"]
        inside = lambda m: any(a <= m.start() < b for a, b in armoured)
        last = 0
        for m in BASE64.finditer(text):
            if m[0][0] in "Mb" and m.start() >= last and not inside(m):
                if (data := unbase64(m[0])) and private_key(data):
                    out.append((m.start(), m.end(), "key"))
                elif end := wrapped_key(text, m.start(), m.end()):
                    out.append((m.start(), end, "key"))
                    last = end
        out += [(m.start(), m.end(), "key") for m in MIXED_HEX.finditer(text) if m[0][:2] in ("30", "6f", "6F") and private_key(bytes.fromhex(m[0]))]
    return out


def spans_of(data: np.ndarray) -> tuple[str, list[tuple[int, int, str]]]:
    """The text in UTF-8 bytes, and all its spans by start, then kind."""
    raw = data.tobytes()
    text = raw.decode()
    gaps = np.flatnonzero(SPACE[data])
    longest = int(np.diff(gaps, prepend=-1, append=len(data)).max()) - 1
    low = raw.lower()
    plain, armour = any(w in low for w in WORDS), b"-----BEGIN " in raw
    if not plain and not armour and longest < 16:
        return text, []
    found = base_spans(text, longest) if plain or longest >= 32 or "AKIA" in text else []
    if longest >= 20 or armour:
        found += confirmed_spans(text, longest)
    return text, sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans for every row of docs. Row by row: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = texts_of(b.column("text"))
            rows = []
            for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
                spans = spans_of(data[lo:hi])[1] if hi > lo else []
                base = [s for s in spans if s[2] in KINDS[:3]]
                counts = [sum(s[2] == k for s in base) for k in KINDS[:3]]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=[x.split()[0] for x in SCANNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCANNED)


def redacted(text: str, spans: list[tuple[int, int, str]], mask: str = "[REDACTED]") -> str:
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mask: str = "[REDACTED]") -> DataFrame:
    """docs with every span in ``text`` replaced; overlapping spans become one. Null stays null."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(at)
            data, offsets = texts_of(column)
            out = [None if null else redacted(*spans_of(data[lo:hi]), mask) if hi > lo else "" for null, lo, hi in zip(column.is_null().to_pylist(), offsets[:-1], offsets[1:], strict=True)]
            cols = list(b.columns)
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op5_secrets": op5_secrets}
