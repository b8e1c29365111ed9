"""Substring dedup: words covered by a 50-word window that also starts in an earlier document.

Every window has an anchor, the least hash of its 25-word runs. Equal windows have equal
anchors, so a window occurs at most as often as its anchor, and a sketch that never
underestimates anchors never underestimates windows. Neighbouring windows mostly share
theirs: a text has some 0.07 distinct anchors a word, and the sketch of anchors is that much smaller than one
of windows, which no executor could hold. Steps:

1. Each task counts its documents' anchors in a count-min sketch (two rows of ``2**bits``
   counters that saturate at two). Sparse partial sketches are merged by block on the
   executors into one bitmap per row of the counters that reached two. The size follows the
   bytes of the texts, four counters an anchor, up to ``MAX_BITS`` (2 x 32 MB of bitmaps).
2. The texts are read again, and the runs of windows whose anchor is estimated repeated are
   written as (anchor, document, place). Anchors that no second text has, which the sketch let
   through, are taken out by an exact group-by with map-side minima. A sketch that is too
   small for its input costs rows in this step, a quarter of the texts' size at most, and nothing later.
3. Texts with repeated anchors alone are read a third time, for the hashes of those windows; they are
   grouped exactly by anchor and window hash (64 bits each), the least doc_id taken map-side
   first. The join back may be split by AQE where a window is very common.

Windows are judged on the input. Defined cases: texts without 50 words keep all words;
null text has none; rows that repeat a doc_id with the same text are treated alike, neither is
earlier than the other; rows that share a doc_id but not the text are judged each on its own;
rows without doc_id are neither judged nor count as earlier; other columns, whatever their
names, are kept by strip() and ignored otherwise; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permspark.llm.common import cut, hashed_words, marked, marker, mix, runs_of, table, texts_of, uncut

WINDOW, RUN = 50, 25
MAX_BITS = 28
#: A text has an anchor for about so many bytes.
ANCHOR_BYTES = 88
BLOCK = 1 << 20
_ROWS = (np.uint64(0x3C6EF372FE94F82B), np.uint64(0xA54FF53A5F1D36F1))
_BASE = 0xD1342543DE82EF95
_INV = pow(_BASE, -1, 2**64)
#: A task hands on its counts after so many anchors.
FLUSH = 2_000_000
PARTIAL = "row int, block int, at binary, twice binary"


def sliding_min(g: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every n neighbours, n >= 2."""
    m, size = g, 1
    while 2 * size <= n:
        m, size = np.minimum(m[:-size], m[size:]), 2 * size
    return m if size == n else np.minimum(m[: len(g) - n + 1], m[n - size :])


def anchors(w: np.ndarray) -> np.ndarray:
    """The anchor of every window of hashed words."""
    if len(w) < WINDOW:
        return np.empty(0, dtype=np.uint64)
    return sliding_min(runs_of(w, RUN), WINDOW - RUN + 1)


def window_hashes(w: np.ndarray) -> np.ndarray:
    """Rolling hashes of all windows."""
    n = len(w)
    power, back = np.full(n, _BASE, dtype=np.uint64), np.full(n, _INV, dtype=np.uint64)
    power[0] = back[0] = 1
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(w) * np.multiply.accumulate(power))])
    return mix((total[WINDOW:] - total[:-WINDOW]) * np.multiply.accumulate(back)[: n - WINDOW + 1])


def counter(a: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(a ^ _ROWS[row]) >> np.uint64(64 - bits)).astype(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")


def sketch_bits(docs: DataFrame) -> int:
    """Counters for about four times as many anchors as the texts have, as a power of two up to a bound."""
    size = _texts(docs).agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(MAX_BITS, max(20, (4 * size // ANCHOR_BYTES).bit_length()))


def count_min(docs: DataFrame, bits: int) -> np.ndarray:
    """Bitmaps, one a row, of the counters that reach two over all documents' anchors."""

    def partial(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        whole = np.concatenate(found)
        for row in range(2):
            at, n = np.unique(counter(whole, row, bits), return_counts=True)
            edges = np.searchsorted(at, np.arange(0, (1 << bits) + 1, min(BLOCK, 1 << bits)))
            for block, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if hi > lo:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([(at[lo:hi] % BLOCK).astype("<u4").tobytes()], pa.binary()), pa.array([np.packbits(n[lo:hi] > 1).tobytes()], pa.binary())],
                        names=["row", "block", "at", "twice"],
                    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for b in batches:
            for w in hashed_words(b.column("text")):
                if len(w) >= WINDOW:
                    found.append(np.unique(anchors(w)))
                    size += len(found[-1])
                    if size >= FLUSH:
                        yield from partial(found)
                        found, size = [], 0
        if found:
            yield from partial(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds partial sketches that come sorted by row and block; holds one block."""
        now, c = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([np.packbits(c > 1).tobytes()], pa.binary())], names=["row", "block", "marks"])

        for b in batches:
            for row, block, at, twice in zip(*(b.column(n).to_pylist() for n in ("row", "block", "at", "twice")), strict=True):
                if (row, block) != now:
                    if now:
                        yield out()
                    now, c = (row, block), np.zeros(min(BLOCK, 1 << bits), dtype=np.uint8)
                where = np.frombuffer(at, dtype="<u4")
                more = np.unpackbits(np.frombuffer(twice, dtype=np.uint8), count=len(where))
                c[where] = np.minimum(c[where] + 1 + more, 2)
        if now:
            yield out()

    marks = np.zeros((2, (1 << bits) // 8), dtype=np.uint8)
    parts = _texts(docs).mapInArrow(sketch, PARTIAL).repartition("row", "block").sortWithinPartitions("row", "block")
    step = min(BLOCK, 1 << bits) // 8
    for r in parts.mapInArrow(merge, "row int, block int, marks binary").toLocalIterator():
        marks[r.row, r.block * step : (r.block + 1) * step] = np.frombuffer(r.marks, dtype=np.uint8)
    return marks


def repeated(a: np.ndarray, marks: np.ndarray, bits: int) -> np.ndarray:
    """Whether anchors are estimated to occur twice or more."""
    out = np.ones(len(a), dtype=bool)
    for row in range(2):
        at = counter(a, row, bits)
        out &= (marks[row][at >> 3] >> (7 - (at & 7))) & 1 == 1
    return out


RUNS = "anchor long, doc_id long, place long, n int"
WINDOWS = "anchor long, doc_id long, place long, windows array<long>"


def key_of(text: Column) -> Column:
    """31 bits of a text's hash, that tell it from others of its doc_id; they stand in front of the place of a window."""
    return F.shiftright(F.xxhash64(text), 33).bitwiseAND(F.lit((1 << 31) - 1))


def _keyed(docs: DataFrame) -> DataFrame:
    return _texts(docs).select("doc_id", "text", key_of(F.col("text")).alias("key"))


def candidates(docs: DataFrame, bits: int) -> DataFrame:
    """Runs of neighbouring windows that share an anchor estimated repeated: where they begin, and how many."""
    shared = docs.sparkSession.sparkContext.broadcast(count_min(docs, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value

        def out(found: list[tuple]) -> pa.RecordBatch:
            a, d, p, n = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(d), pa.array(p), pa.array(n.astype(np.int32))], names=["anchor", "doc_id", "place", "n"])

        for b in batches:
            ids, keys, found, size = *(b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "key")), [], 0
            for doc, key, w in zip(ids, keys, hashed_words(b.column("text")), strict=True):
                if len(w) < WINDOW:
                    continue
                a = anchors(w)
                starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                keep = repeated(a[starts], marks, bits)
                if keep.any():
                    n = np.diff(np.append(starts, len(a)))[keep]
                    starts = starts[keep]
                    found.append((a[starts], np.full(len(starts), doc, dtype=np.int64), starts | (int(key) << 32), n))
                    size += len(starts)
                if size > 200_000:
                    yield out(found)
                    found, size = [], 0
            if found:
                yield out(found)

    return _keyed(docs).mapInArrow(run, RUNS)


def repeated_runs(docs: DataFrame, bits: int) -> DataFrame:
    """(id, key, runs): by text, the runs whose anchor occurs in texts of two doc_ids; a stored table."""
    c = cut(candidates(docs, bits))
    twice = c.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    held = c.join(twice, "anchor", "left_semi").withColumn("key", F.shiftright("place", 32))
    runs = F.sort_array(F.collect_list(F.struct(F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("start"), "n", "anchor")))
    out = cut(held.groupBy(F.col("doc_id").alias("id"), F.col("key").alias("of")).agg(runs.alias("runs")))
    uncut(docs.sparkSession, c)
    return out


def windows(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """The hashes of the windows of runs. Only texts that have runs, and a few others, are shuffled."""
    texts = marked(_keyed(docs), marker(runs, "id"), "doc_id")
    joined = texts.join(runs, (F.col("doc_id") == F.col("id")) & (F.col("key") == F.col("of"))).select("doc_id", "key", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            a, d, p, n, h = (np.concatenate(x) for x in zip(*found, strict=True))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(h.view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(d), pa.array(p), lists], names=["anchor", "doc_id", "place", "windows"])

        for b in batches:
            found, size = [], 0
            for doc, key, r, w in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key")), b.column("runs"), hashed_words(b.column("text")), strict=True):
                starts, n, a = (r.values.field(c).to_numpy() for c in ("start", "n", "anchor"))
                h = window_hashes(w)
                ok = starts + n <= len(h)  # but for a text whose key is another's
                starts, n, a = starts[ok].astype(np.int64), n[ok].astype(np.int64), a[ok]
                if not len(n):
                    continue
                at = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                found.append((a, np.full(len(n), doc, dtype=np.int64), starts | (key << 32), n, h[at]))
                size += len(at)
                if size > 200_000:
                    yield out(found)
                    found, size = [], 0
            if found:
                yield out(found)

    return joined.mapInArrow(run, WINDOWS)


def removals(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """(removal_id, removal_key, starts array<int>): windows of a text that also start in an earlier doc_id; a stored table."""
    runs = repeated_runs(docs, bits or sketch_bits(docs))
    c = cut(windows(docs, runs))
    each = c.select("anchor", "doc_id", "place", F.posexplode("windows").alias("i", "h"))
    first = c.select("anchor", "doc_id", F.explode("windows").alias("h")).groupBy("anchor", "h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = first.select(F.col("anchor").alias("fa"), F.col("h").alias("fh"), "first")
    late = each.select("anchor", "h", "doc_id", (F.col("place") + F.col("i")).alias("place")).join(first, (F.col("anchor") == F.col("fa")) & (F.col("h") == F.col("fh"))).where("doc_id > first")
    start = F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    out = cut(late.groupBy(F.col("doc_id").alias("removal_id"), F.shiftright("place", 32).alias("removal_key")).agg(F.sort_array(F.collect_set(start)).alias("starts")))
    uncut(docs.sparkSession, c, runs)
    return out


def kept_words(words: list[bytes], starts: np.ndarray) -> list[bytes]:
    """words without those covered by windows at starts."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    starts = starts[starts <= len(words) - WINDOW]  # others are of a text with the same key
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    return [w for w, c in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if c == 0]


def _starts(column: pa.Array) -> list[np.ndarray | None]:
    """Of each row, the starts of windows; None without."""
    return [x.values.to_numpy() if x.is_valid else None for x in column]


def _on_starts(rows: DataFrame, gone: DataFrame, change, schema) -> DataFrame:
    """change(batch, starts of each row) over rows (_sd_id, _sd_key and any others).

    Only rows that may lose words are shuffled, told by a filter of ids of bounded size; the
    others are changed where they are read.
    """
    chosen = marker(gone, "removal_id")

    def lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = chosen(b, "_sd_id", False)
            if b.num_rows:
                yield change(b, [None] * b.num_rows)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield change(b, _starts(b.column("starts")))

    on = (F.col("_sd_id") == F.col("removal_id")) & (F.col("_sd_key") == F.col("removal_key"))
    hit = marked(rows, chosen, "_sd_id").join(gone, on, "left").drop("removal_id", "removal_key")
    return hit.mapInArrow(met, schema).union(rows.mapInArrow(lone, schema))


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def judge(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """Counts and digest of the kept words of every row of docs."""
    gone = removals(docs, bits)
    rows = docs.select(F.col("doc_id").cast("long").alias("_sd_id"), F.col("text").cast("string").alias("text"))

    def change(b: pa.RecordBatch, found: list) -> pa.RecordBatch:
        data, offsets = texts_of(b.column("text"))
        out = []
        for starts, lo, hi in zip(found, offsets[:-1], offsets[1:], strict=True):
            words = data[lo:hi].tobytes().split()
            kept = kept_words(words, starts) if starts is not None else words
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, lost, sha = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([b.column("_sd_id"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _on_starts(rows.select("_sd_id", key_of(F.col("text")).alias("_sd_key"), "text"), gone, change, RESULT)


def strip(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """docs with repeated words taken out of ``text``: kept words are joined by one space.

    Texts that lose nothing stay as they are; all rows and other columns stay, whatever their names.
    """
    gone = removals(docs, bits)
    at, names = docs.columns.index("text"), docs.columns
    own = docs.toDF(*(f"c{i}" for i in range(len(names))))  # no input name clashes with ours
    own_names, key = own.columns, key_of(F.col(f"c{at}").cast("string"))
    rows = own.select(F.col(f"c{names.index('doc_id')}").cast("long").alias("_sd_id"), key.alias("_sd_key"), *own_names)

    def change(b: pa.RecordBatch, found: list) -> pa.RecordBatch:
        cols, out = [b.column(c) for c in own_names], []
        for text, starts in zip(cols[at], found, strict=True):
            t = text.as_py()
            out.append(b" ".join(kept_words(t.encode().split(), starts)).decode() if starts is not None and t else t)
        cols[at] = pa.array(out, pa.string())
        return pa.RecordBatch.from_arrays(cols, names=own_names)

    return _on_starts(rows, gone, change, own.schema).toDF(*names)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op7_substrings": op7_substrings}
ORACLE = {
    "op7_substrings": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)
), f AS (SELECT h, min(doc_id) AS d FROM x GROUP BY h
), g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM x JOIN f USING (h) WHERE doc_id > d
), k AS (
  SELECT w.doc_id, count(g.j) AS n_removed, string_agg(CASE WHEN g.j IS NULL THEN u.word END, ' ' ORDER BY u.j) AS kept
  FROM w, LATERAL (SELECT unnest(w.w) AS word, unnest(range(1, len(w.w) + 1)) AS j) u LEFT JOIN g ON g.doc_id = w.doc_id AND g.j = u.j
  GROUP BY w.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
}
