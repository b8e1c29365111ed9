"""SentencePiece BPE with seeded merge-dropout, and its lossless decoder.

Segmentation works an agenda of candidate merges, best piece first, leftmost among
equals. With dropout each candidate that is taken from the agenda is skipped at the rate,
by draws of a counter-based generator keyed by (seed, doc_id, text) and read in the order
of the text: every occurrence of a word has draws of its own. Nothing else is random, so
a seed always gives the same ids, on any machine, and other seeds other segmentations.
At rate 0 the ids are those of the library.

A text is cut into words, which no piece can span. The draws of a short word are the bits of a
mask, and its ids a function of word and mask. Only that function is kept, in a bounded cache; what
it lacks for the texts of a group is computed for all of them at once, with the agendas as
columns of a matrix. What an occurrence drew is never kept. Words of more symbols than a mask has
bits for are cut into units and draw by a keyed hash.

Spaces become U+2581 with one put in front; a literal U+2581 is written as byte pieces,
so decoding is lossless for any text. Defined cases: null and empty texts have no ids;
unknown characters become byte pieces; a null doc_id draws as doc_id 0; repeated rows get
the same ids; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permspark.llm.common import table, texts_of

META = "▁"
_M = (1 << 64) - 1
SLICE = 1 << 18
SHORT = 22  # a word of n symbols takes at most 3 (n - 1) draws: so many fit a mask of 64 bits
PLANES = 16  # binary digits of the rate
STOPS = (".", ",")
PLACE = 7  # bits for the place of a symbol in a word
NONE = np.int32(2**31 - 1)  # no candidate merge
#: No word takes the 64th draw: it marks what isn't in the cache.
_TOP = np.uint64(1 << 63)
UNKNOWN = (1 << 63, b"", {}, b"", b"")
_AWAY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Draws:
    """The draws of one text, in order: masks whose bits are set at the rate."""

    def __init__(self, limit: int, key: int, source: np.random.Philox | None = None) -> None:
        self.key, self.at = key, 0  # at: the words drawn for
        limit = min(limit, (1 << PLANES) - 1)
        low = (limit & -limit).bit_length() - 1  # planes of lower digits decide nothing
        self.digits = [limit >> k & 1 for k in range(low, PLANES)] if limit else []
        if limit:
            source = source or np.random.Philox(key=0)
            halves = np.array([key & _M, key >> 64 & _M], dtype=np.uint64)
            zeros = np.zeros(4, dtype=np.uint64)
            source.state = {"bit_generator": "Philox", "state": {"counter": zeros, "key": halves}, "buffer": zeros, "buffer_pos": 4, "has_uint32": 0, "uinteger": 0}
            self.raw = source.random_raw

    def masks(self, n: int) -> np.ndarray:
        """n masks; a bit is set if the number of its planes' bits is below the rate, digit by digit."""
        out = np.zeros(n, dtype=np.uint64)
        for digit in self.digits if n else ():
            drawn = self.raw(n)
            out = np.bitwise_or(out, drawn, out=out) if digit else np.bitwise_and(out, drawn, out=out)
        self.at += n
        return out


class Merges:
    """The agendas of many short words at once, one word a column.

    Symbols are ranks of pieces, and the bytes of characters that are none, which merge with nothing. Pairs of symbols that merge are found in a cuckoo hash of two tables.
    """

    def __init__(self, rank: dict[str, int], ids: dict[str, int], byte: dict[int, int]) -> None:
        self.end = len(rank)  # stands before and after a word; bytes follow
        if self.end >= 1 << 19:
            raise ValueError("the model has too many pieces")
        self.ids = np.zeros(self.end + 257, dtype="<u4")
        self.ids[[rank[p] for p in rank]] = [ids[p] for p in rank]
        self.ids[self.end + 1 :] = [byte[b] for b in range(256)]
        self.char = np.full(0x110000, -1, dtype=np.int32)
        for p, r in rank.items():
            if len(p) == 1:
                self.char[ord(p)] = r
        pairs = {(rank[p[:i]], rank[p[i:]]): r for p, r in rank.items() for i in range(1, len(p)) if p[:i] in rank and p[i:] in rank}
        both = np.array(list(pairs), dtype=np.uint64).reshape(-1, 2)
        self.bits = max(8, (4 * len(pairs)).bit_length() - 1)
        entries = both[:, 0] << np.uint64(44) | both[:, 1] << np.uint64(24) | np.array(list(pairs.values()), dtype=np.uint64)
        self.tables = np.full((2, 1 << self.bits), np.uint64(_M))
        left, side, rounds = entries, 0, 0
        while len(left):
            if (rounds := rounds + 1) > 500:
                raise ValueError("the merges do not fit their tables")
            t, at = self.tables[side], self._at(left >> np.uint64(24), side)
            held = t[np.unique(at)]
            t[at] = left
            out = np.concatenate([left[t[at] != left], held[held != np.uint64(_M)]])
            left, side = out, 1 - side

    def _at(self, key: np.ndarray, side: int) -> np.ndarray:
        x = (key ^ key >> np.uint64(17)) * _AWAY[side]
        return ((x ^ x >> np.uint64(29)) * _AWAY[1 - side] >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merges of symbols, or NONE >> PLACE."""
        key = a.astype(np.uint64) << np.uint64(20) | b.astype(np.uint64)
        x, y = self.tables[0][self._at(key, 0)], self.tables[1][self._at(key, 1)]
        got = np.where(x >> np.uint64(24) == key, x, y)
        return np.where(got >> np.uint64(24) == key, (got & np.uint64(0xFFFFFF)).astype(np.int32), NONE >> PLACE)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The first symbols of all words, and how many each has."""
        whole, sizes = "".join(words), np.array([*map(len, words)])
        points = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
        found = self.char[points]
        if not len(found) or found.min() >= 0:
            return found, sizes
        spans = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        width, spelt = np.where(found < 0, spans, 1), np.frombuffer(whole.encode(), dtype=np.uint8).astype(np.int32)
        first = np.cumsum(width) - width
        within = np.arange(width.sum()) - np.repeat(first, width)
        out = np.repeat(found, width)
        bare = out < 0
        out[bare] = self.end + 1 + spelt[(np.repeat(np.cumsum(spans) - spans, width) + within)[bare]]
        return out, np.add.reduceat(width, np.cumsum(sizes) - sizes)

    def run(self, words: list[str], masks: np.ndarray) -> tuple[list[int], list[bytes]]:
        """Of words in META form and masks: masks of the draws that they take, and ids."""
        if not words:
            return [], []
        told = self.symbols(words)
        n, sizes = len(words), told[1]
        rows = int(sizes.max()) + 2
        symbols = np.full(rows * n, self.end, dtype=np.int32)  # place i of word c is at i * n + c
        column = np.repeat(np.arange(n), sizes)
        first = np.arange(len(column)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        at = first * n + column
        symbols[at] = told[0]
        alive = np.zeros(rows * n, dtype=bool)
        alive[at] = True
        after, before = np.arange(rows * n) + n, np.arange(rows * n) - n
        agenda = np.full(rows * n, NONE)
        agenda[at] = self.find(symbols[at], symbols[at + n]) << PLACE | first
        agenda[at[agenda[at] >> PLACE == NONE >> PLACE]] = NONE
        grid, drawn, active = agenda.reshape(rows, n), np.zeros(n, dtype=np.uint64), np.arange(n)
        while True:
            best = grid.min(axis=0)[active]
            active = active[best < NONE]
            if not len(active):
                break
            best = best[best < NONE]
            j = (best & (1 << PLACE) - 1).astype(np.int64) * n + active
            agenda[j] = NONE
            took = masks[active] >> drawn[active] & np.uint64(1) == 0
            drawn[active] += np.uint64(1)
            j, merged = j[took], best[took] >> PLACE
            k = after[j]
            e, p = after[k], before[j]
            symbols[j], after[j], before[e] = merged, e, j
            agenda[k], alive[k] = NONE, False
            places = np.concatenate([j, p])
            rank = self.find(np.concatenate([merged, symbols[p]]), np.concatenate([symbols[e], merged]))
            agenda[places] = np.where(rank == NONE >> PLACE, NONE, rank << PLACE | (places // n).astype(np.int32))
        kept = alive.reshape(rows, n).T
        raw = self.ids[symbols.reshape(rows, n).T[kept]].tobytes()
        ends = [0, *(4 * np.cumsum(kept.sum(axis=1))).tolist()]
        return ((np.uint64(1) << drawn) - np.uint64(1)).tolist(), [raw[lo:hi] for lo, hi in pairwise(ends)]


class DropoutBPE:
    """Encodes and decodes with the pieces of a SentencePiece BPE model with byte fallback."""

    streams = 1 << 64  # one for each doc_id

    def __init__(self, path: str, rate: float = 0.1, seed: int = 0, max_units: int = 500_000) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if len(self.byte) != 256:
            raise ValueError("the model lacks byte fallback")
        self.ids = {pieces[i]: i for i in plain}
        self.rank = {pieces[i]: r for r, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
        self.meets = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(a != META and b == META for a, b in self.meets):
            raise ValueError("a piece spans a space")
        self.literal = b"".join(self._bytes(META))
        self.coded = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.stops = {c: self._ids([c]) for c in STOPS}
        self.out = [b""] * n
        for i in plain:
            self.out[i] = pieces[i].replace(META, " ").encode()
        for b, i in self.byte.items():
            self.out[i] = bytes([b])
        self.spelt = pa.array(self.out, pa.large_binary())
        self.limit, self.seed = round(rate * 2**PLANES), seed & _M
        self.max_units = max_units
        self.merges = Merges(self.rank, self.ids, self.byte)
        self.source = np.random.Philox(key=0)
        #: By word: mask of the draws taken if none is skipped, its ids then, ids by skipped draws,
        #: ids of a stop that no piece joins to it, and both ids if none is skipped. Two generations.
        self.trees: tuple[dict, dict] = ({}, {})
        self.grown = 0  # words and their ids in the newer generation

    def _bytes(self, char: str) -> list[bytes]:
        return [self.byte[b].to_bytes(4, "little") for b in char.encode()]

    def _skip(self, key: int, i: int, m: int, e: int) -> bool:
        """Whether dropout takes the merge of the symbols [i, m) and [m, e) of a long unit."""
        x = (key ^ (i * 0x9E3779B97F4A7C15 + m * 0xC2B2AE3D27D4EB4F + e * 0x165667B19E3779F9)) & _M
        x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & _M
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _M
        return x >> 64 - PLANES < self.limit

    def _ids(self, pieces: list[str]) -> bytes:
        """Ids of pieces, as little-endian uint32 bytes."""
        try:
            return b"".join([*map(self.coded.__getitem__, pieces)])
        except KeyError:
            return b"".join([self.coded.get(p) or b"".join(self._bytes(p)) for p in pieces])

    def _long_agenda(self, unit: str, key: int) -> list[str]:
        """The pieces of a unit of any length, by a heap and a keyed hash."""
        n, rank = len(unit), self.rank
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(rank[unit[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if unit[i : i + 2] in rank]
        heapq.heapify(agenda)
        while agenda:
            _, i, m, e = heapq.heappop(agenda)
            if end[i] != m or m >= n or end[m] != e or (self.limit and self._skip(key, i, m, e)):
                continue
            end[i], end[m] = e, -1
            p = before[i]
            if p >= 0 and (r := rank.get(unit[p:e])) is not None:
                heapq.heappush(agenda, (r, p, i, e))
            if e < n:
                before[e] = i
                if (r := rank.get(unit[i : end[e]])) is not None:
                    heapq.heappush(agenda, (r, i, e, end[e]))
        return [unit[i : end[i]] for i in range(n) if end[i] > 0]

    def _cut(self, word: str) -> list[str]:
        """Units of a word in META form; they end where two characters never meet."""
        core = word.rstrip(".,")
        if core[1:].isalpha():
            if core == word:
                return [word]
            if core[-1] + word[len(core)] not in self.meets:
                return [core, word[len(core) :]]
        out, at, meets, n = [], 0, self.meets, len(word)
        for i in range(1, n + 1):
            if i == n or word[i - 1 : i + 1] not in meets:
                out.append(word[at:i])
                at = i
        return out

    def _large(self, word: str, key: int, place: int) -> bytes:
        """Ids of a word of any length in META form, whose place in the text keys its draws."""
        out = []
        for k, u in enumerate(self._cut(word)):
            own = xxhash.xxh64_intdigest(b"%d,%d,%d" % (key, place, k), seed=self.seed) if self.limit else 0
            out.append(self._ids(self._long_agenda(u, own)))
        return b"".join(out)

    def _split(self, word: str) -> tuple[str, bytes]:
        """A word without, and the ids of, a last stop or comma that no piece joins to it."""
        core = word[:-1]
        if word[-1:] in STOPS and core and core[-1] not in STOPS and core[-1] + word[-1] not in self.meets:
            return core, self.stops[word[-1]]
        return word, b""

    def _grow(self, words: list[str]) -> None:
        """Puts words into the newer generation."""
        new, had = self.trees[0], self.trees[1].get
        fresh, cores, afters = [], [], []
        for w in words:
            got = had(w)
            if got is not None:
                new[w] = got
                continue
            core, after = w, b""
            if w[-1:] in STOPS:
                core, after = self._split(w)
                if after and (same := new.get(core) or had(core)):
                    new[w] = (*same[:3], after, same[1] + after)
                    continue
            fresh.append(w)
            cores.append(META + core)
            afters.append(after)
        for w, after, used, ids in zip(fresh, afters, *self.merges.run(cores, np.zeros(len(cores), dtype=np.uint64)), strict=True):
            new[w] = (used, ids, {}, after, ids + after if after else ids)
        self.grown += len(words)

    def _look(self, words: list[str], masks: np.ndarray) -> tuple[list[bytes], np.ndarray, list[tuple]]:
        """Ids of words by the cache; places of the words it lacks; places, entries, masks and
        bits that decide of those whose ids by these skipped draws it lacks."""
        told = [*map(self.trees[0].get, words, repeat(UNKNOWN))]
        out = [*map(itemgetter(4), told)]  # as if nothing were skipped
        takes = np.fromiter(map(itemgetter(0), told), dtype=np.uint64, count=len(told))
        skips = takes & (masks | _TOP)
        odd = np.flatnonzero((skips != 0) & (skips != _TOP))
        # a skipped draw may bring one more draw, so these bits nearly always decide
        reach = (takes[odd] + np.uint64(1) << np.bitwise_count(skips[odd]).astype(np.uint64)) - np.uint64(1)
        missed = []
        for i, decide, key in zip(odd.tolist(), reach.tolist(), (masks[odd] & reach).tolist(), strict=True):
            _, _, leaves, after, _ = entry = told[i]
            ids = leaves.get(key)
            if ids is None:
                missed.append((i, entry, int(masks[i]), decide))
            else:
                out[i] = ids + after if after else ids
        return out, np.flatnonzero(skips == _TOP), missed

    def _resolve(self, words: list[str], masks: np.ndarray, texts: list[tuple[int, Draws, int]]) -> list[bytes]:
        """Ids of words after a space, with the start of each text's words, its draws and their place in it."""
        if self.grown >= self.max_units:
            self.trees, self.grown = ({}, self.trees[0]), 0
        out, lacks, missed = self._look(words, masks)
        places = lacks.tolist()
        unknown = [words[i] for i in places]
        self._grow([w for w in dict.fromkeys(unknown) if len(w) < SHORT])
        got, large, more = self._look(unknown, masks[lacks])
        for i, ids in zip(places, got, strict=True):
            out[i] = ids
        for k in large.tolist():
            i = places[k]
            start, draws, place = texts[bisect_right(texts, i, key=lambda t: t[0]) - 1]
            out[i] = self._large(META + words[i], draws.key, place + i - start)
        missed += [(places[k], *rest) for k, *rest in more]
        cores = [META + (words[i][:-1] if entry[3] else words[i]) for i, entry, _, _ in missed]
        found = self.merges.run(cores, np.array([m for _, _, m, _ in missed], dtype=np.uint64))
        for (i, entry, m, decide), used, ids in zip(missed, *found, strict=True):
            out[i] = ids + entry[3]
            if used <= decide:  # no draw was taken but those of the bits that decide
                entry[2][m & decide] = ids
                self.grown += 1
        return out

    def _parts(self, text: str) -> list[str]:
        """Words, each after one space that it lacks, of text without META that a space stands before."""
        if "  " in text or text[:1] == " " or text[-1:] == " ":  # runs of spaces are pieces, too
            return [w[1:] for w in re.findall("▁+[^▁]*", META + text.replace(" ", META))]
        return text.split(" ")

    def _spaced(self, text: str, draws: Draws) -> bytes:
        """Ids of text without META, whose start stands for a space."""
        words, place = self._parts(text), draws.at
        return b"".join(self._resolve(words, draws.masks(len(words)), [(0, draws, place)]))

    def _draws(self, text: str, doc: int, source: np.random.Philox | None = None) -> Draws:
        key = xxhash.xxh64_intdigest(text.encode(), seed=self.seed) if self.limit else 0
        return Draws(self.limit, (doc & _M) << 64 | key, source)

    def stream_ids(self, text: str, doc: int = 0) -> Iterator[bytes]:
        """Ids of a text, slice by slice; slices end before single spaces."""
        draws = self._draws(text, doc)
        at = 0
        while at < len(text):
            end = at + SLICE
            while end < len(text) and not (text[end] == " " and text[end - 1] not in (" ", META) and text[end + 1 : end + 2] not in ("", " ", META)):
                end += 1
            part = text[at:end]
            if META in part:
                chunks = part.split(META)
                for k, c in enumerate(chunks):
                    if k:
                        yield self.literal
                    if k == 0 and (c or at == 0):
                        yield self._spaced(c, draws)
                    elif c:
                        yield self._bare(c, draws)
            else:
                yield self._spaced(part, draws)
            at = end + 1 if end < len(text) else end

    def _bare(self, text: str, draws: Draws) -> bytes:
        """Ids of text that follows a literal META: no space stands in front."""
        core = re.match("[^ ]*", text)[0]
        out = [self._large(core, draws.key, -1 - draws.at)] if core else []
        if len(core) < len(text):
            out.append(self._spaced(text[len(core) + 1 :], draws))
        return b"".join(out)

    def group_ids(self, rows: list[tuple[str, int]]) -> Iterator[bytes]:
        """The ids of each of many texts, given with their doc_ids; groups of about a slice are worked at once."""
        at = 0
        while at < len(rows):
            end, size = at, 0
            while end < len(rows) and (end == at or size + len(rows[end][0]) <= SLICE):
                size += len(rows[end][0])
                end += 1
            words, masks, texts = [], [], []
            for text, doc in rows[at:end]:
                if text and META not in text and len(text) <= SLICE:
                    draws, parts = self._draws(text, doc, self.source), self._parts(text)
                    texts.append((len(words), draws, 0))
                    masks.append(draws.masks(len(parts)))
                    words += parts
            out = self._resolve(words, np.concatenate(masks), texts) if words else []
            starts = iter([*(t[0] for t in texts[1:]), len(words)])
            lo = 0
            for text, doc in rows[at:end]:
                if text and META not in text and len(text) <= SLICE:
                    hi = next(starts)
                    yield b"".join(out[lo:hi])
                    lo = hi
                else:
                    yield b"".join(self.stream_ids(text, doc))
            at = end

    def encode(self, text: str, doc: int = 0) -> np.ndarray:
        return np.frombuffer(b"".join(self.stream_ids(text, doc)), dtype="<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        got = self.spelt.take(pa.array(ids))
        offsets = np.frombuffer(got.buffers()[1], dtype="<i8")
        return got.buffers()[2].slice(1, int(offsets[got.offset + len(got)]) - 1).to_pybytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; exact for what encode() gave."""
        return self.decode_bytes(ids).decode()


_models: dict[tuple, DropoutBPE] = {}


def model(*args) -> DropoutBPE:
    """One for each Python worker and setting."""
    if args not in _models:
        _models[args] = DropoutBPE(*args)
    return _models[args]


ENCODED = "doc_id long, n_ids long, ids binary, ids_sha256 string, decoded_sha256 string, lossless boolean"


def encode(docs: DataFrame, path: str | None = None, rate: float = 0.1, seed: int = 0, keep_ids: bool = True) -> DataFrame:
    """Ids (little-endian uint32) of every text, with a digest of what they decode to.

    Row by row: no shuffle. Of a text, its ids are held besides it.
    """
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path, rate, seed)
        for b in batches:
            data, offsets = texts_of(b.column("text"))
            rows, size = [], 0
            docs_ = b.column("doc_id").to_pylist()
            raws = [data[lo:hi].tobytes() for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
            for doc, raw, ids in zip(docs_, raws, bpe.group_ids([(r.decode(), d or 0) for r, d in zip(raws, docs_, strict=True)]), strict=True):
                back = bpe.decode_bytes(np.frombuffer(ids, dtype="<u4"))
                rows.append((doc, len(ids) // 4, ids if keep_ids else None, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), back == raw))
                size += len(ids) if keep_ids else 200
                if size > 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in ENCODED.split(", ")])


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of what encode() gave."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path, 0.0, 0)
        for b in batches:
            texts = [None if x is None else bpe.decode(np.frombuffer(x, dtype="<u4")) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op3_bpe_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")


QUERIES = {"op3_bpe_dropout": op3_bpe_dropout}
