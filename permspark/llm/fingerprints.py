"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch keeps every 64-bit shingle hash below a fixed share of the hash range (1/4 by
default). As the threshold is the same for all documents, sketches of parts merge into
the sketch of the whole, and containment between very unequal documents is estimated
from the smaller one's hashes. A shingle is five consecutive words; fewer words are one
shingle. The fingerprint is ``hash of the text . number of distinct shingles kept . the hashes``.

Likeness of two fingerprints: 1 for equal texts; else shared hashes over all hashes of
both, 0 without any hash (short texts may keep none).

Defined cases: null text is empty; empty texts have a fingerprint without hashes;
repeated rows have equal fingerprints; the next document is the next row by descending
doc_id, then text, so rows that share an id follow each other; a row without doc_id has
no place in that order and is edited with the empty text; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from permspark.llm.common import cut, table, text_or_empty
from permspark.llm.quality_rules import words_of

#: Keys are dealt to groups of so many at each level when neighbours are sought.
FAN = 12


def threshold(share: float) -> int:
    """The largest hash kept, as a signed number."""
    return int(share * 2**64) - 2**63 - 1


def sketch_of(df: DataFrame, text: str, out: str, share: float = 0.25, k: int = 5) -> DataFrame:
    """Adds the sketch of a text column: sorted distinct hashes, array<long>."""
    w, n = F.col("_fp_w"), F.size("_fp_w")
    full = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))
    hashes = F.when(n >= k, full).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
    return (
        df.withColumn("_fp_w", words_of(F.col(text)))
        .withColumn(out, F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h <= threshold(share)))))
        .drop("_fp_w")
    )


def fingerprint(text: Column, sketch: Column) -> Column:
    """A string; equal texts have equal fingerprints."""
    hashes = F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")
    return F.concat(F.lower(F.lpad(F.hex(F.xxhash64(text)), 16, "0")), F.lit("."), F.size(sketch).cast("string"), F.lit("."), hashes)


def sketch_from(printed: Column) -> Column:
    """The sketch that a fingerprint holds."""
    h = F.substring_index(printed, ".", -1)
    places = F.filter(F.sequence(F.lit(0), F.length(h)), lambda i: (i % 16 == 0) & (i < F.length(h)))
    half = lambda i, j: F.conv(F.substr(h, i + j, F.lit(8)), 16, 10).cast("long")
    return F.transform(places, lambda i: F.shiftleft(half(i, 1), 32).bitwiseOR(half(i, 9)))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Estimated Jaccard likeness of two sketches; equal: whether the texts are."""
    both = shared(a, b)
    either = F.size(a) + F.size(b) - both
    return F.when(equal, 1.0).when(either > 0, both / either).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null if a keeps none."""
    return F.when(F.size(a) > 0, shared(a, b) / F.size(a))


def merge(df: DataFrame, key: str, sketch: str = "sketch") -> DataFrame:
    """The sketch of each key's documents together.

    Hashes are made distinct by key before they meet, so a key with a third of all rows is
    reduced map-side; what a key keeps at last is the sketch itself.
    """
    return (
        df.select(key, F.explode_outer(sketch).alias("_fp_h"))
        .distinct()
        .groupBy(key)
        .agg(F.sort_array(F.collect_list("_fp_h")).alias(sketch))
    )


def next_lower(keys: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """(key, lower): for each distinct key between low and high the next lower one, null for the least.

    Keys are grouped by their leading bits, level on level, until one group of at most
    2**FAN is left; a group never holds more than 2**FAN keys.
    """
    k = keys.select(F.col(key).alias("k"))
    if high - low < 1 << FAN:
        return k.select(F.col("k").alias(key), F.lag("k").over(Window.partitionBy(F.lit(0)).orderBy("k")).alias("lower"))
    grouped = k.withColumn("up", F.shiftright("k", FAN))
    within = grouped.withColumn("lag", F.lag("k").over(Window.partitionBy("up").orderBy("k")))
    tops = grouped.groupBy("up").agg(F.max("k").alias("top"))
    above = next_lower(tops, "up", low >> FAN, high >> FAN).where("lower IS NOT NULL")
    before = above.join(tops.select(F.col("up").alias("lower"), "top"), "lower").select(F.col("up").alias("up2"), F.col("top").alias("before"))
    return within.join(before, F.col("up") == F.col("up2"), "left").select(F.col("k").alias(key), F.coalesce("lag", "before").alias("lower"))


#: More heads of buckets than these are joined by shuffling, not broadcast (some 40 MB).
MAX_BROADCAST_HEADS = 1_000_000


def bucket_shift(ids: DataFrame, rows: int) -> int:
    """By how many bits ids are shifted to make buckets: the most that leaves none with over 2 * rows rows.

    ids: a column ``doc_id``, without nulls. Counts decide, not the range of ids, so outliers and
    gaps don't matter; where one id alone has more rows, the smallest shift.
    """
    low = 6
    counts = ids.groupBy(F.shiftright("doc_id", low).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    each = counts.select("n", F.explode(F.transform(F.sequence(F.lit(low), F.lit(62), F.lit(2)), lambda s: F.struct(s.alias("s"), F.expr("b").alias("b")))).alias("x"))
    each = each.select(F.col("x.s").alias("s"), F.expr(f"shiftright(x.b, x.s - {low})").alias("b"), "n").groupBy("s", "b").agg(F.sum("n").alias("n"))
    fits = each.groupBy("s").agg(F.max("n").alias("n")).where(F.col("n") <= 2 * rows)
    return fits.agg(F.max("s")).first()[0] or low


def with_next(docs: DataFrame, share: float = 0.25, rows: int = 1024, max_heads: int = MAX_BROADCAST_HEADS) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch) by descending doc_id; after the last the first.

    Texts are shuffled once, into buckets of neighbouring ids of about ``rows`` rows. The first
    row of each bucket is what the last row of the bucket before it needs: heads are found
    from ids alone, and their texts picked by a broadcast of those ids, if they are few enough, else
    by a join. No window or task grows with the input, unless a single doc_id has very many rows.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    lone = sketch_of(sketch_of(d.where(F.col("doc_id").isNull()).withColumn("next_text", F.lit("")), "text", "sketch", share), "next_text", "next_sketch", share)
    columns = ["doc_id", "text", "sketch", "next_text", "next_sketch"]
    ids = d.where(F.col("doc_id").isNotNull()).select("doc_id")
    low, high = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return lone.select(*columns)
    shift = bucket_shift(ids, rows)
    bucketed = d.where(F.col("doc_id").isNotNull()).withColumn("bucket", F.shiftright("doc_id", shift))
    order = Window.partitionBy("bucket").orderBy(F.desc("doc_id"), "text")
    rowed = sketch_of(bucketed.repartition("bucket"), "text", "sketch", share).select(
        "bucket", "doc_id", "text", "sketch", F.lead("text").over(order).alias("lead_text"), F.lead("sketch").over(order).alias("lead_sketch")
    )
    firsts = cut(ids.groupBy(F.shiftright("doc_id", shift).alias("head_bucket")).agg(F.max("doc_id").alias("head_id")))
    n = firsts.count()
    heads = bucketed.join(F.broadcast(firsts) if n <= max_heads else firsts, F.col("doc_id") == F.col("head_id"))
    heads = heads.groupBy("head_bucket").agg(F.min("text").alias("head_text"))  # of rows that share the id the first
    heads = sketch_of(heads, "head_text", "head_sketch", share)
    follows = next_lower(firsts.select(F.col("head_bucket").alias("b")), "b", low >> shift, high >> shift).select("b", F.coalesce("lower", F.lit(high >> shift)).alias("head_of"))
    heads = heads.join(follows, F.col("head_bucket") == F.col("head_of")).select("b", "head_text", "head_sketch")
    out = rowed.join(heads, F.col("bucket") == F.col("b"), "left").select(
        "doc_id", "text", "sketch", F.coalesce("lead_text", "head_text").alias("next_text"), F.coalesce("lead_sketch", "head_sketch").alias("next_sketch")
    )
    return out.unionByName(lone.select(*columns))


def edited(docs: DataFrame) -> DataFrame:
    """with_next() and ``n_chars``, ``edited`` and ``edited_sketch``: the second half taken from the next text's start."""
    df = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next_text", F.lit(1), half)))
    return sketch_of(df, "edited", "edited_sketch")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they and the next text's are."""
    return edited(docs).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text"), F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited"), F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), F.col("text") == F.col("next_text")).alias("near_next"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))


QUERIES = {"op4_fingerprints": op4_fingerprints}
