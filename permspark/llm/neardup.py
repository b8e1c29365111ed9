"""Near-duplicates: MinHash bands propose, odd sketches verify, full shingle sets confirm.

1. One pass over the texts gives each document the size and a 128-bit digest of its set
   of five-word shingles (64-bit hashes), 128 MinHash samples in 32 band keys, and an odd
   sketch: a 2048-bit parity bitmap into which each of the set's 512 least hashes (its
   bottom-k MinHash samples; of smaller sets all hashes) flips one bit. The XOR population
   count of two sketches estimates how many samples differ, and so the similarity, most
   precisely where that is high; it never exceeds the number of samples that differ.
2. Documents with equal sets form a class at once; only class representatives go on.
3. In each band bucket every member is paired with the bucket's least member (a star, so
   rows grow with the members, not their square). Pairs whose sketches allow a similarity
   near the limit are confirmed on full sets; each representative first tries the one of
   the highest estimate.
4. Links give components. A bucket all of whose members are in one component is done. In
   the others, for a few rounds, each member is tried with members drawn from up to eight
   other components; again rows grow with the members only, and large groups of copies
   grow together.
5. The members of buckets that are still mixed are joined by prefix filtering: shingles are
   ordered by how many of these members have them, rarest first, and two sets that overlap
   enough share one of the first few. Texts that share a template but not enough of it have
   shingles of their own in front, so they don't meet, however many they are. Members of one
   component are never paired. What passes the sketch test is confirmed; no link is lost.

A pair at the limit shares no bucket with probability (1 - 0.75**4)**32, about 5e-6. The
sketch test loses no pair of sets of up to 512 shingles, others at five standard deviations.

Links are joined by alternating large and small stars, on labels that earlier links have
already contracted. A set that many pairs need is dealt in salted copies. Ids whose texts are
read again are marked in a filter sized by their number up to a bound; beyond it more sets
than needed are shuffled, none is missed.

Defined cases: texts without words have an empty set and link with nothing; null text is
empty; a text of fewer than five words is one shingle; rows that share a doc_id count as
one node; rows without doc_id have no component and are kept; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from permspark.llm.common import cut, hashed_words, marker, mix, shingles, table, uncut

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_SAMPLES, SKETCH_BITS = 512, 2048
FEATURES = "doc_id long, n_shingles long, digest binary, sketch array<long>, bands array<long>"
#: A set is dealt in one more copy for each so many pairs that need it.
SALT_PAIRS = 256

_rng = np.random.Generator(np.random.PCG64(77))
_XOR = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)[:, None]
_MUL = (_rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_SALT = np.uint64(0x7F4A7C159E3779B9)


def minhash(s: np.ndarray) -> np.ndarray:
    """The SAMPLES minima of a set of hashes."""
    low = np.full(SAMPLES, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(low, ((s[None, at : at + 2048] ^ _XOR) * _MUL).min(axis=1), out=low)
    return low


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Parity bitmap of the least hashes of a sorted set, as 64-bit words."""
    at = mix(s[:SKETCH_SAMPLES] ^ _SALT) & np.uint64(SKETCH_BITS - 1)
    bits = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A key for each band of ROWS samples; keys of different bands differ."""
    x = samples.reshape(BANDS, ROWS)
    h = mix(np.arange(len(x), dtype=np.uint64) + np.uint64(1))
    for j in range(ROWS):
        h = mix(h ^ x[:, j])
    return h.view(np.int64)


def max_flips(na: Column, nb: Column, percent: int) -> Column:
    """The most samples that may differ if sets of these sizes overlap by percent or more.

    Of the least overlap, the share k / (larger size) is among both sets' samples; sampled
    sets get five standard deviations of that.
    """
    k = SKETCH_SAMPLES
    overlap = (na + nb) * (percent / (100 + percent))
    share = F.least(F.lit(1.0), k / F.greatest(na, nb))
    return F.least(na, F.lit(k)) + F.least(nb, F.lit(k)) - 2 * share * overlap + 5 * F.sqrt(k * (1 - share))


def flips(a: Column, b: Column) -> Column:
    return functools.reduce(operator.add, (F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH_BITS // 64)))


def likeness(flipped: Column, na: Column, nb: Column) -> Column:
    """The similarity that the XOR population count of two sketches estimates, from set sizes.

    Of d samples that differ, B(1 - exp(-2d/B))/2 bits of B are expected to. The rest of the
    samples are common; their share among the larger set's samples scales them to the sets.
    """
    k, bits = F.lit(SKETCH_SAMPLES), float(SKETCH_BITS)
    differ = -bits / 2 * F.log(F.greatest(1 - 2 * flipped / bits, F.lit(1 / bits)))
    common = F.greatest((F.least(na, k) + F.least(nb, k) - differ) / 2, F.lit(0.0)) * F.greatest(F.lit(1.0), F.greatest(na, nb) / k)
    return F.least(F.lit(1.0), common / F.greatest(na + nb - common, F.lit(1.0)))


def features(docs: DataFrame) -> DataFrame:
    """FEATURES of every row with a doc_id. Row by row: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            rows, at = [], 0
            for w in hashed_words(b.column("text"), lower=True):
                s = shingles(w)
                if len(s):
                    m = minhash(s)
                    rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), odd_sketch(s), band_keys(m)))
                else:
                    rows.append((0, None, None, None))
                if len(rows) == 2000:
                    yield _features(ids[at : at + len(rows)], rows)
                    rows, at = [], at + len(rows)
            if rows:
                yield _features(ids[at:], rows)

    return _texts(docs).mapInArrow(run, FEATURES)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")


def _features(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    n, digest, sketch, bands = zip(*rows, strict=True)
    longs = lambda x: pa.array(x, pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), longs(sketch), longs(bands)], names=["doc_id", "n_shingles", "digest", "sketch", "bands"])


def sets_of(docs: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """(id, shingles array<long>) of the documents wanted, and perhaps a few others.

    Reads the texts again and hashes those that pass a filter of bounded size; texts are
    not shuffled.
    """
    chosen = marker(wanted, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = chosen(b, "doc_id")
            ids, rows, size, first = b.column("doc_id"), [], 0, 0
            for w in hashed_words(b.column("text"), lower=True):
                rows.append(shingles(w).view(np.int64))
                size += len(rows[-1])
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([ids[first : first + len(rows)], pa.array(rows, pa.list_(pa.int64()))], names=["id", "shingles"])
                    first, rows, size = first + len(rows), [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([ids[first:], pa.array(rows, pa.list_(pa.int64()))], names=["id", "shingles"])

    return _texts(docs).mapInArrow(run, "id long, shingles array<long>")


def _salted(pairs: DataFrame, side: str) -> DataFrame:
    """How many copies of a set a side's pairs are dealt to: (side, parts), for ids that many pairs need."""
    return pairs.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / SALT_PAIRS).cast("int").alias(f"parts_{side}"))


def confirm(sets: DataFrame, pairs: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) of ids whose full sets overlap by percent or more. Both are stored tables.

    Sets of ids with many pairs are joined in salted copies, so that no task has all pairs of one id.
    """
    out = pairs.select("a", "b")
    for side, other in ("ab", "ba"):
        out = out.join(_salted(pairs, side), side).withColumn(f"salt_{side}", F.pmod(F.xxhash64(other), F.col(f"parts_{side}")).cast("int"))
    for side in "ab":
        copies = sets.join(_salted(pairs, side).withColumnRenamed(side, "id"), "id")
        copies = copies.select(F.col("id").alias(side), F.explode(F.sequence(F.lit(0), F.col(f"parts_{side}") - 1)).alias(f"salt_{side}"), F.col("shingles").alias(f"s{side}"))
        out = out.join(copies, [side, f"salt_{side}"])
    out = out.withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return cut(out.where(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b").distinct())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the least id reachable, for ids in links (a, b) that isn't the id itself; a stored table.

    Alternates large and small stars until the edges are stars around least ids; each round
    is written to the shared folder. Minima are taken map-side first.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    for _ in range(max_rounds):
        near = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = near.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = edges.join(least, F.col("v") == F.col("x")).select("u", F.col("m").alias("v")).distinct()
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("x")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.union(low.select("x", "m")).distinct())
        uncut(spark, edges)
        edges = new
        # stars: an id points to one other, and none points to an id that points on
        ends = edges.select(F.col("u").alias("x"), F.col("v").alias("to"), F.lit(0).alias("centre")).union(edges.select(F.col("v").alias("x"), F.lit(None).cast("long").alias("to"), F.lit(1).alias("centre")))
        ends = ends.groupBy("x").agg(F.min("to").alias("lo"), F.max("to").alias("hi"), F.max("centre").alias("centre"))
        if ends.where("lo < hi OR (lo IS NOT NULL AND centre = 1)").isEmpty():
            out = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            out._permspark_cut = edges._permspark_cut
            return out
    raise RuntimeError("components did not settle")


def relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (id, component, without ids that are their own) after more links (a, b); a stored table.

    Only links between components go through components(), as links of their least ids.
    """
    if labels is None:
        return components(links)
    la, lb = (labels.select(F.col("id").alias(f"i{x}"), F.col("component").alias(f"c{x}")) for x in "ab")
    between = links.join(la, F.col("a") == F.col("ia"), "left").join(lb, F.col("b") == F.col("ib"), "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = components(cut(between.where("a <> b").distinct()))
    to = moved.select(F.col("id").alias("component"), F.col("component").alias("to"))
    return cut(labels.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component")).union(moved))


def _close(percent: int) -> Column:
    """Whether sketches and set sizes of a joined pair allow the similarity, in different components."""
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return (F.col("ca") != F.col("cb")) & fits & (flips(F.col("sa"), F.col("sb")) <= max_flips(F.col("na"), F.col("nb"), percent))


def _side(df: DataFrame, x: str, *more: str) -> DataFrame:
    return df.select("key", *more, F.col("rep").alias(x), F.col("component").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of buckets (key) with members of more than one component."""
    mixed = placed.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("key")
    return placed.join(mixed, "key", "left_semi")


def prefix_pairs(sets: DataFrame, members: DataFrame, percent: int = 75) -> DataFrame:
    """Pairs (a, b) of members of different components that overlap by percent, and a few others.

    members: rep, component, n, sketch; sets: id, shingles. Shingles are ordered by the number
    of members that have them. Of two sets that overlap enough, the first shingle in common is
    among the first n(100-p)/(100+p) + 1 of the one that is not the larger, and among the first n(100-p)/100 + 1
    of the other. In a shingle's group the members of its largest component are only met by
    others, and groups of one component are left out.
    """
    who = members.select(F.col("rep").alias("id"), "component", "n", "sketch")
    each = sets.join(who.select("id"), "id", "left_semi").select("id", F.explode("shingles").alias("h"))
    count = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = each.join(count, "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("hs"))
    own = F.col("n") - F.size("hs")  # shingles that nobody else has come first
    first = F.floor(F.col("n") * (100 - percent) / 100) + 1
    short = F.floor(F.col("n") * (100 - percent) / (100 + percent)) + 1
    front = shared.join(who.select("id", "component", "n"), "id").where(first > own)
    front = front.select("id", "component", "n", short.alias("short"), own.alias("own"), F.posexplode(F.slice("hs", F.lit(1), (first - own).cast("int"))).alias("i", "x"))
    front = cut(front.select("id", "component", "n", F.col("x.h").alias("h"), (F.col("own") + F.col("i") < F.col("short")).alias("early")))
    sizes = front.groupBy("h", "component").agg(F.count(F.lit(1)).alias("size"), F.max("early").alias("early"))
    groups = sizes.groupBy("h").agg(F.max(F.struct("size", "component")).alias("x"), F.count(F.lit(1)).alias("k"), F.max("early").alias("early")).where("k > 1 AND early")
    groups = groups.select("h", F.col("x.component").alias("largest"))
    met = front.join(groups, "h").join(who.select("id", "sketch"), "id")
    a, b = (met.select("h", *(["largest"] if x == "a" else []), F.col("id").alias(x), F.col("component").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("early").alias(f"e{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    once = (F.col("cb") == F.col("largest")) | (F.col("a") < F.col("b"))
    early = ((F.col("na") <= F.col("nb")) & F.col("ea")) | ((F.col("nb") <= F.col("na")) & F.col("eb"))
    return a.where("ca <> largest").join(b, "h").where(once & early & _close(percent)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, rounds: int = 2, leaders: int = 8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs, as a stored table."""
    spark = docs.sparkSession
    f = cut(features(docs))
    classes = cut(f.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    # rows that share a doc_id are one node: their classes are linked, rows without shingles go with them
    many = cut(f.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"))
    node = shared = None
    if not many.isEmpty():
        theirs = f.where("n_shingles > 0").join(many, "doc_id", "left_semi").join(classes.select("digest", "rep"), "digest").select("doc_id", "rep").distinct()
        node = cut(theirs.groupBy("doc_id").agg(F.min("rep").alias("least")))
        shared = theirs.join(node, "doc_id").select(F.col("rep").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    sketches = classes.select("rep", "n", "sketch")
    banded = classes.select("rep", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").select("key", "leader")
    active = cut(banded.join(buckets, "key").select("key", "rep", "leader"))

    flipped = flips(F.col("sa"), F.col("sb"))
    s1, s2 = (sketches.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"), F.col("rep").alias(f"c{x}")) for x in "ab")
    near = active.where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct().join(s1, "a").join(s2, "b")
    tried = labels = None
    for turn in range(rounds + 1):
        near = near.where(_close(percent)).select("a", "b", likeness(flipped, F.col("na"), F.col("nb")).alias("like"))
        if tried is not None:
            near = near.join(tried, ["a", "b"], "left_anti")
        pairs = cut(near.groupBy("a").agg(F.max(F.struct("like", (-F.col("b")).alias("b"))).alias("x")).select("a", (-F.col("x.b")).alias("b")))
        tried = pairs if tried is None else tried.union(pairs)
        if turn and pairs.isEmpty():
            break
        sets = cut(sets_of(docs, cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "id"))
        links = confirm(sets, pairs, percent)
        uncut(spark, sets)
        if turn == 0 and shared is not None:
            links = cut(links.select("a", "b").union(shared))
        if turn and links.isEmpty():  # nothing more to gain from drawing
            break
        before, labels = labels, relabelled(labels, links)
        if before is not None:
            uncut(spark, before)
        place = active.select("key", "rep").join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
        old, active = active, cut(_mixed(place))
        uncut(spark, old, links)
        if turn == rounds:
            break
        # up to `leaders` members of other components, one drawn from each
        drawn = active.groupBy("key", "component").agg(F.min_by("rep", F.xxhash64("rep", F.lit(turn))).alias("rep"))
        drawn = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("component", F.lit(turn)), "component"))).where(F.col("rank") <= leaders)
        near = _side(active.join(sketches, "rep"), "a").join(_side(drawn.select("key", "rep", "component").join(sketches, "rep"), "b"), "key")

    members = cut(active.select("rep", "component").distinct().join(sketches, "rep"))
    if not members.isEmpty():
        sets = cut(sets_of(docs, members, "rep"))
        rest = prefix_pairs(sets, members, percent)
        done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        rest = cut(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(done, ["a", "b"], "left_anti"))
        links = confirm(sets, rest, percent)
        uncut(spark, sets)
        if not links.isEmpty():
            labels = relabelled(labels, links)

    # texts without words have no class; they stay out of the join, where they would all meet in one task
    named = f.where("digest IS NOT NULL").select("doc_id", "n_shingles", "digest").join(classes.select("digest", "rep"), "digest")
    rep = named.select("doc_id", "n_shingles", "rep").union(f.where("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("rep")))
    if node is not None:
        rep = rep.join(node, "doc_id", "left").withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.coalesce("least", "rep")))
    out = rep.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    lone = docs.where(F.col("doc_id").isNull())
    counted = features(lone.withColumn("doc_id", F.lit(-1))).select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    done = cut(out.union(counted))
    uncut(spark, f, classes, many, active, members, labels)
    return done


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one document of each component, and one row of those alike in doc_id and text."""
    ids = docs.select(F.col("doc_id").cast("long").alias("_nd_id"))
    many = cut(ids.where("_nd_id IS NOT NULL").groupBy("_nd_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("_nd_id"))
    gone = cut(near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("_nd_id")).distinct())
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone["_nd_id"], "left_anti")
    if many.isEmpty():
        return kept
    on = kept["doc_id"].cast("long") == many["_nd_id"]
    return kept.join(many, on, "left_anti").union(kept.join(many, on, "left_semi").dropDuplicates(["doc_id", "text"]))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op10_neardup": op10_neardup}
ORACLE = {
    "op10_neardup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS h FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(id, x) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.x = e.a
), c AS (SELECT id, min(x) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id
"""
}
