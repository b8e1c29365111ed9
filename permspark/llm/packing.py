"""Packing token streams into sequences: first-fit decreasing over a tournament tree.

Texts are tokenised a slice at a time, each distinct word once and with a bounded cache
(no token spans white space), and cut at every ``capacity`` ids. Pieces, without their text, are dealt
at random into groups of about ``group_rows``; in each group first-fit decreasing puts
them into bins, the leftmost bin with room being found in a tournament tree of free
capacities in O(log n). Groups are independent, so packing scales out; each loses at
most about one bin. A group holds small rows only and its size is fixed.

Defined cases: null and empty texts have the end id alone; rows that repeat are packed
each on their own; a null doc_id stays null; texts of any length give pieces as they are
tokenised; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permspark.llm.common import LOWER, SPACE, cut, give_back, hash_words, table, texts_of

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
#: Bytes of text whose equal words are looked up once.
SLICE = 4 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _letters(word: str) -> bool:
    """Whether a word is letters alone, also as the tokenizer writes it: composed and in lower case."""
    return word.isalpha() and unicodedata.normalize("NFC", word).lower().isalpha()


class WordEncoder:
    """Ids of texts as little-endian uint32 bytes, by a tokenizer that never spans white space,
    lowers case and parts letters from full stops and commas.

    Encodings are kept for up to 2 * max_words words, in two generations: words that are
    used again outlive the older one.
    """

    def __init__(self, path: str, max_words: int = 200_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.max_words = Tokenizer.from_file(path), max_words
        self.kept: tuple[dict, dict] = {}, {}

    def _ask(self, words: list[bytes]) -> list[bytes]:
        """Ids of words from the tokenizer: words of letters are joined by spaces, 200 in one call."""
        texts = [w.decode() for w in words]
        letters = [i for i, t in enumerate(texts) if t.isalpha()]
        out: list = [None] * len(words)
        for k in range(0, len(letters), 200):
            part = letters[k : k + 200]
            e = self.tokenizer.encode(" ".join([texts[i] for i in part]), add_special_tokens=False)
            word = np.array(e.word_ids)
            if len(word) and word[-1] == len(part) - 1:  # else lower case has parted a word
                at = (np.searchsorted(word, np.arange(len(part) + 1)) * 4).tolist()
                raw = array("I", e.ids).tobytes()
                for i, a, b in zip(part, at, at[1:], strict=False):
                    out[i] = raw[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = array("I", e.ids).tobytes()
        return out

    def _known(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, each looked up as it is."""
        new, old = self.kept
        got = [*map(new.get, words)]
        lacks = [i for i, ids in enumerate(got) if not ids]
        cores = [words[i] for i in lacks]
        found = [*map(old.get, cores)]
        ask = [k for k, ids in enumerate(found) if not ids]
        for k, ids in zip(ask, self._ask([cores[k] for k in ask]), strict=True):
            found[k] = ids
        for i, c, ids in zip(lacks, cores, found, strict=True):
            got[i] = ids
            if len(c) <= 48:  # longer ones hardly come again
                new[c] = ids
        return got

    def _distinct(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words; letters before a stop or comma are looked up apart from it."""
        cores, tails = [], []
        for w in words:
            core = w.rstrip(b".,")
            if core.isalpha() or _letters(core.decode()):
                cores.append(core.lower())
                tails.append(w[len(core) :])
            else:
                cores.append(w)
                tails.append(b"")
        units = [*({*cores, *tails} - {b""})]
        found = dict(zip(units, self._known(units), strict=True))
        found[b""] = b""
        return [found[c] + found[t] if t else found[c] for c, t in zip(cores, tails, strict=True)]

    def encode(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of adjoining texts, and where each text's ids end.

        Equal words of the slice are looked up once; they are told apart by 64-bit hash and length.
        Words of A-Z and a-z alone are looked up in lower case, without one last stop or comma.
        """
        if len(self.kept[0]) >= self.max_words:
            self.kept = {}, self.kept[0]
        bare, plain, stop = _bare(data, edges)
        starts, ends, hashes = _words_at(bare, edges)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        raw = bare.tobytes()
        words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        simple = plain[first]
        got = np.empty(len(words) + 3, dtype=object)
        for of, look in ((simple, self._known), (~simple, self._distinct)):
            at = np.flatnonzero(of)
            got[at] = np.array([*look([words[i] for i in at.tolist()]), None], dtype=object)[:-1]
        got[-3:] = [b"", *self._known([b".", b","])]
        sizes = np.fromiter(map(len, got), dtype=np.int64, count=len(got)) // 4
        pool = np.frombuffer(b"".join(got.tolist()), dtype="<u4")
        begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        units = np.stack([which, len(words) + stop], axis=1).ravel()  # a word, and what was cut from it
        counts = sizes[units]
        stops = np.concatenate([[0], np.cumsum(counts)])
        ids = pool[np.arange(stops[-1]) + np.repeat(begins[units] - stops[:-1], counts)]
        return ids, stops[2 * np.searchsorted(starts, edges[1:])]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(number of the text, some of its ids, whether they are the last), in order."""
        i, n = 0, len(offsets) - 1
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1))
            if offsets[j] - offsets[i] <= SLICE:
                ids, stops = self.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k, (lo, hi) in enumerate(zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)):
                    yield i + k, ids[lo:hi], True
            else:  # one text, a slice at a time, cut at white space
                at, end = int(offsets[i]), int(offsets[i + 1])
                while at < end:
                    stop = min(end, at + SLICE)
                    while stop < end and not SPACE[data[stop]]:
                        stop += 1
                    yield i, self.encode(data[at:stop], np.array([0, stop - at]))[0], stop == end
                    at = stop
                j = i + 1
            i = j


def _bare(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """data with words of A-Z and a-z alone in lower case and a space for the one stop or comma that
    ends them; by word, whether it is one of these, and what was cut: 0, 1 a stop, 2 a comma."""
    n = len(data)
    solid = ~SPACE[data]
    goes_on = solid.copy()
    goes_on[1:] &= solid[:-1]
    goes_on[edges[edges < n]] = False  # a word never spans an edge
    goes_on[:1] = False
    starts = np.flatnonzero(solid & ~goes_on)
    ends = np.flatnonzero(solid & ~np.concatenate([goes_on[1:], [False]])) + 1
    odd = np.concatenate([[0], np.cumsum(~LETTER[data], dtype=np.int32)])
    odd = odd[ends] - odd[starts]
    last = data[ends - 1]
    stop = np.where((odd == 1) & (ends - starts > 1), (last == 46) + 2 * (last == 44), 0)
    plain = (odd == 0) | (stop > 0)
    step = np.zeros(n + 1, dtype=np.int8)
    step[starts[plain]] += 1
    step[ends[plain]] -= 1
    within = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    bare = np.where(within, LOWER[data], data)
    bare[ends[stop > 0] - 1] = 32
    return bare, plain, stop


def _words_at(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of words; hashed in parts between words, to save memory."""
    out, at, part = [], 0, 1 << 19
    while at < len(data):
        stop = min(len(data), at + part)
        while stop < len(data) and not SPACE[data[stop]]:
            stop += 1
        inside = edges[(edges >= at) & (edges <= stop)] - at
        s, e, h = hash_words(data[at:stop], inside)
        out.append((s + at, e + at, h))
        at = stop
    if not out:
        none = np.empty(0, dtype=np.int64)
        return none, none, np.empty(0, dtype=np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def forget(path: str) -> None:
    """Drops this worker's encoder and gives its memory back."""
    _encoders.pop(path, None)
    give_back()


class Cutter:
    """Cuts the ids of one text into pieces as they come."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.rest, self.start, self.pieces = capacity, b"", 0, []

    def add(self, ids: np.ndarray) -> None:
        buffer, at, full = self.rest + ids.tobytes(), 0, self.capacity * 4
        while len(buffer) - at > full:
            self.pieces.append((self.start, self.capacity, zlib.crc32(memoryview(buffer)[at : at + full])))
            self.start, at = self.start + self.capacity, at + full
        self.rest = buffer[at:]

    def end(self, end_id: int) -> tuple[list[tuple[int, int, int]], int]:
        """(start, length, crc32) of each piece, and the number of ids, the end id included."""
        self.add(np.array([end_id], dtype="<u4"))
        n = len(self.rest) // 4
        return [*self.pieces, (self.start, n, zlib.crc32(self.rest))], self.start + n


def tokenise(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = 4096, seed: int = 0, resident: bool = True) -> DataFrame:
    """The pieces of all documents; ``deal`` is random, for groups. Row by row: no shuffle.

    A Python worker keeps its encoder for later tasks if ``resident``, else gives its memory back after each.
    """
    path = tokenizer or default_tokenizer()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for b in batches:
            data, offsets = texts_of(b.column("text"))
            rows, ids_of, cutter = [], b.column("doc_id").to_pylist(), Cutter(capacity)
            for i, ids, last in enc.texts(data, offsets):
                cutter.add(ids)
                if last:
                    found, n = cutter.end(end_id)
                    rows += [(ids_of[i], *piece, n) for piece in found]
                    cutter = Cutter(capacity)
            if rows:
                cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(rng.integers(0, 1 << 62, len(rows)))], names=[x.split()[0] for x in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cut_up(batches)
        if not resident:
            forget(path)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


class Tournament:
    """A complete tree over n bins; each node holds the largest free capacity below it."""

    def __init__(self, n: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (n - 1)).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The leftmost bin with room for size, and the room it had."""
        free, at = self.free, 1
        if free[1] < size:
            raise ValueError("no bin has room")
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        had = free[at]
        free[at] = had - size
        node = at >> 1
        while node:
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
            node >>= 1
        return at - self.leaves, had


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size; sizes are taken from the largest, ties in their order."""
    tree, out = Tournament(max(1, len(sizes)), capacity), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b, had = tree.place(sizes[i])
        out[i] = (b, capacity - had)
    return out


def pack(pieces: DataFrame, capacity: int = 4096, group_rows: int = 8192) -> DataFrame:
    """Pieces with sequence_id and offset. ``pieces`` should be a stored table: it is counted first."""
    groups = max(1, math.ceil(pieces.count() / group_rows))

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("deal", "ascending")])
        placed = first_fit_decreasing(t.column("length").to_pylist(), capacity)
        base = key[0].as_py() << 32
        return t.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).append_column("sequence_id", pa.array([base + b for b, _ in placed], pa.int64())).append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    return pieces.withColumn("pack_group", F.col("deal") % F.lit(groups).cast("long")).groupBy("pack_group").applyInArrow(fit, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = 4096, resident: bool = True) -> DataFrame:
    return pack(cut(tokenise(docs, tokenizer, end_id, capacity, resident=resident)), capacity)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op6_packing": op6_packing}
