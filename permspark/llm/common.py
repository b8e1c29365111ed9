"""Shared helpers: tables, cuts of lineage, vectorised hashing of words.

A *word* is a run of bytes other than space and 0x09-0x0D; in UTF-8 those bytes
never occur inside a longer character, so words can be cut on raw bytes.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_cuts: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("permspark.shared.dir", None)
    if not found:
        if not conf.get("spark.master", "").split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="permspark-")
        spark.conf.set("permspark.shared.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    Lost executors then cost a re-read, not a re-run; what is written stays until
    release() or the end of the process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _cuts:
        atexit.register(_release_quietly)
    _cuts.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._permspark_cut = path
    return out


def uncut(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files behind frames made by cut(), once nothing needs them."""
    for df in frames:
        path = getattr(df, "_permspark_cut", None)
        if path in _cuts:
            _delete(spark, path)
            _cuts.remove(path)


def release(spark: SparkSession) -> None:
    """Delete all files that cut() has written in this process."""
    while _cuts:
        _delete(spark, _cuts.pop())


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _release_quietly() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            release(spark)
        except Exception:  # the JVM may be gone already; the folder's owner cleans up then
            pass


def give_back() -> None:
    """Returns memory that this Python process holds but doesn't use to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


# --- vectorised hashing --------------------------------------------------------

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 2**64)
_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)

#: Texts are hashed in slices of about so many bytes, cut between words.
SLICE = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, SLICE + 4096)

        def grown(base: int) -> np.ndarray:
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        _pow, _inv = grown(_BASE), grown(_INV)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def hash_words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in data; a word never spans an edge."""
    n = len(data)
    if n == 0:
        none = np.empty(0, dtype=np.int64)
        return none, none, np.empty(0, dtype=np.uint64)
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    inner = edges[(edges > 0) & (edges < n)]
    begins[inner] = solid[inner]
    stops[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    pw, iv = _powers(n + 1)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * pw[:n], out=total[1:])
    h = (total[ends] - total[starts]) * iv[starts]
    return starts, ends, mix(h + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words of one text (uint8 array), in order."""
    if lower:
        data = LOWER[data]
    out, at = [], 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            gap = np.flatnonzero(SPACE[data[at:end]])
            while not len(gap) and end < len(data):  # one word fills the slice
                end += SLICE
                gap = np.flatnonzero(SPACE[data[at:end]])
            end = at + int(gap[-1]) + 1 if len(gap) and end < len(data) else len(data)
        out.append(hash_words(data[at:end], np.empty(0, dtype=np.int64))[2])
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n, first = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[first : first + n + 1]
    buffer = column.buffers()[2]
    return (np.frombuffer(buffer, dtype=np.uint8) if buffer else np.empty(0, dtype=np.uint8)), offsets


def hashed_words(column: pa.Array, lower: bool = False):
    """For each text of a string column, the hashes of its words."""
    data, offsets = texts_of(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
        j = min(j, n)
        if j == i + 1 or offsets[j] - offsets[i] > SLICE:
            j = i + 1
            yield word_hashes(data[offsets[i] : offsets[j]], lower)
        else:
            part = data[offsets[i] : offsets[j]]
            edges = offsets[i : j + 1] - offsets[i]
            starts, _, h = hash_words(LOWER[part] if lower else part, edges)
            for a, b in zip(*(lambda x: (x[:-1], x[1:]))(np.searchsorted(starts, edges)), strict=True):
                yield h[a:b]
        i = j


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes; of fewer words, none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = h[:n] * _STEP[0]
    for j in range(1, k):
        out += h[j : j + n] * _STEP[j % 64]
        out ^= out >> np.uint64(29)
    return mix(out)


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; fewer words count as one shingle."""
    if not len(h):
        return np.empty(0, dtype=np.uint64)
    if len(h) < k:
        return runs_of(h, len(h)) ^ np.uint64(len(h))
    return np.unique(runs_of(h, k))


# --- filters of ids --------------------------------------------------------------

#: A filter of ids has at most so many bits (32 MB).
FILTER_BITS = 1 << 28


def filter_bits(n: int, most: int = FILTER_BITS) -> int:
    """Sixteen bits an id or more, as a power of two, up to a bound."""
    return min(most, 1 << max(16, (16 * n - 1).bit_length()))


def id_filter(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """A one-hash Bloom filter of ids; it never misses an id.

    Each task marks its ids; tasks' bitmaps are merged by block on the executors, and the
    driver gets the merged blocks, bits / 8 bytes in all.
    """
    block = min(bits, 1 << 20)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            at = _slots(b.column(0).to_numpy(zero_copy_only=False), bits)
            which = at // block
            for k in np.unique(which).tolist():
                found.setdefault(k, np.zeros(block, dtype=bool))[at[which == k] % block] = True
        for k, v in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(v).tobytes()], pa.binary())], names=["block", "marks"])

    def merge(t: pa.Table) -> pa.Table:
        out = np.zeros(block // 8, dtype=np.uint8)
        for x in t.column("marks"):
            out |= np.frombuffer(x.as_buffer(), dtype=np.uint8)
        return pa.table({"block": t.column("block")[:1], "marks": pa.array([out.tobytes()], pa.binary())})

    whole = np.zeros(bits // 8, dtype=np.uint8)
    schema = "block long, marks binary"
    for r in ids.select(column).mapInArrow(mark, schema).groupBy("block").applyInArrow(merge, schema).toLocalIterator():
        whole[r.block * block // 8 : (r.block + 1) * block // 8] = np.frombuffer(r.marks, dtype=np.uint8)
    return whole


def _slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def marker(wanted: DataFrame, wanted_id: str):
    """f(batch, column, want): the rows whose id (``column``) is among those wanted, and perhaps a few others; or the rest.

    wanted is a stored table. The filter is as large as their number asks for, up to a bound;
    it is broadcast and used within a function over Arrow batches. A row without id is in the rest.
    """
    shared = wanted.sparkSession.sparkContext.broadcast(id_filter(wanted, wanted_id, filter_bits(wanted.count())))

    def chosen(b: pa.RecordBatch, column: str, want: bool = True) -> pa.RecordBatch:
        marks, ids = shared.value, b.column(column)
        at = _slots(ids.fill_null(0).to_numpy(zero_copy_only=False), len(marks) * 8)
        hit = ((marks[at >> 3] >> (7 - (at & 7))) & 1 == 1) & ids.is_valid().to_numpy(zero_copy_only=False)
        return b if hit.all() == want and hit.any() == want else b.filter(pa.array(hit if want else ~hit))

    return chosen


def marked(rows: DataFrame, chosen, column: str) -> DataFrame:
    """The rows that a marker's function takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield chosen(b, column)

    return rows.mapInArrow(run, rows.schema)
