"""Quality rules: base rules and distribution divergence, in DataFrame functions only.

Each text has a histogram over character classes and one over the common words of its
language. Language references are the mean histograms of all texts of a language that are
long enough, from a first pass over the corpus. A text is rejected when the
Jensen-Shannon distance (base 2, 0 to 1) of a histogram to its reference exceeds a limit;
as short texts scatter more, the limit is widened by ``slack / sqrt(n)``, and texts below
a minimum length have no verdict from that histogram.

References are one small row per language; they are broadcast after their number has
been checked, else joined by language. Texts are never shuffled for them.

Defined cases: null text is empty and fails the base rules; null lang is a language of
its own; languages without a word list or with fewer than ``min_docs`` long texts give no
verdict for that histogram; repeated rows are judged alike; all other columns pass
through untouched, also those named like a result (results are added under the prefix ``_qr_``; judge()
replaces input columns of these names, keep() drops no other column); an empty table gives no rows.
Repeated windows are found by 64-bit hashes of their five words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permspark.llm.common import cut, table, text_or_empty

SPACES = r"[\x20\x09-\x0D]+"
#: Frequent function words.
COMMON = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour", "est", "par", "qui", "dans"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "su", "una"],
}
#: Lower case a-z, white space, upper case, other letters, digits, symbols, the rest.
N_CLASSES = 7
MAX_BROADCAST_LANGUAGES = 10_000
P = "_qr_"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _among(listed: list[str]):
    return lambda w: w.isin(listed)


def _histograms(docs: DataFrame) -> DataFrame:
    """Adds text, words, class counts and common-word counts, each under the prefix."""
    gone = lambda a, pattern: F.regexp_replace(F.col(a), pattern, "")
    rest = [P + "text", *(f"{P}r{i}" for i in range(N_CLASSES - 1))]
    df = docs.withColumn(P + "text", text_or_empty())
    for i, pattern in enumerate([r"[a-z]+", SPACES, r"\p{Lu}+", r"\p{L}+", r"\p{Nd}+", r"[#*$%&|<>]+"]):
        df = df.withColumn(rest[i + 1], gone(rest[i], pattern))
    lengths = [F.length(r) for r in rest]
    df = df.withColumn(P + "chars", F.array(*(a - b for a, b in zip(lengths, lengths[1:], strict=False)), lengths[-1])).drop(*rest[1:])
    df = df.withColumn(P + "words", words_of(F.col(P + "text")))
    lists = F.create_map(*(x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    df = df.withColumn(P + "list", F.try_element_at(lists, F.coalesce(F.col("lang").cast("string"), F.lit(""))))
    hits = F.when(F.lit(False), F.array(F.lit("")))
    for k, v in COMMON.items():
        hits = F.when(F.col("lang") == k, F.filter(P + "words", _among(v))).otherwise(hits)
    df = df.withColumn(P + "hits", hits)
    counts = F.transform(P + "list", lambda c: F.size(F.filter(P + "hits", lambda x: x == c)))
    return (
        df.withColumn(P + "n", F.size(P + "words"))
        .withColumn(P + "common", F.concat(counts, F.array(F.col(P + "n") - F.size(P + "hits"))))
        .drop(P + "list", P + "hits")
    )


def references(docs: DataFrame, min_chars: int = 300, min_words: int = 50, min_docs: int = 5) -> DataFrame:
    """Mean histograms by language: ``_qr_lang``, ``_qr_ref_chars``, ``_qr_ref_common``."""
    h = _histograms(docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    total = F.length(P + "text")
    long_c, long_w = total >= min_chars, F.col(P + "n") >= min_words

    def means(column: str, n: int, ok: Column, size: Column) -> Column:
        return F.when(F.count(F.when(ok, 1)) >= min_docs, F.array(*(F.avg(F.when(ok, F.get(F.col(column), F.lit(i)) / size)) for i in range(n))))

    n_common = len(COMMON["en"]) + 1
    return h.groupBy(F.col("lang").alias(P + "lang")).agg(
        means(P + "chars", N_CLASSES, long_c, total).alias(P + "ref_chars"),
        means(P + "common", n_common, long_w & F.col(P + "common").isNotNull(), F.col(P + "n")).alias(P + "ref_common"),
    )


def jensen_shannon(counts: Column, size: Column, reference: Column) -> Column:
    """Distance of a histogram of counts to reference shares; null without either."""
    half = lambda a, m: F.when(a > 0, a * F.log2(a / m) / 2).otherwise(0.0)
    terms = F.zip_with(counts, reference, lambda c, q: half(c / size, (c / size + q) / 2) + half(q, (c / size + q) / 2))
    return F.when(counts.isNotNull() & reference.isNotNull() & (size > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))))))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds the number of words in five-word windows that occur twice or more."""
    w, n = F.col(P + "words"), F.col(P + "n")
    df = df.withColumn(P + "h", F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(5))))))
    h = F.col(P + "h")
    # only texts with a repeated window pay for the sort
    df = df.withColumn(P + "s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col(P + "s")
    same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    df = df.withColumn(P + "p", F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])))
    p = F.col(P + "p")
    gaps = F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5))))
    return df.withColumn(P + "repeat", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop(P + "h", P + "s", P + "p")


def judge(
    docs: DataFrame,
    max_char_distance: float = 0.14,
    max_word_distance: float = 0.14,
    char_slack: float = 3.0,
    word_slack: float = 1.4,
    min_chars: int = 300,
    min_words: int = 50,
) -> DataFrame:
    """docs with the columns of RESULTS (under the prefix ``_qr_``) for every row."""
    refs = cut(references(docs, min_chars, min_words))
    if refs.count() <= MAX_BROADCAST_LANGUAGES:
        refs = F.broadcast(refs)
    df = _repeat_words(_histograms(docs))
    lines = F.filter(F.split(F.col(P + "text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn(P + "lines", lines)
    df = df.withColumns(
        {
            P + "n_words": F.col(P + "n").cast("long"),
            P + "word_chars": (F.length(P + "text") - F.get(F.col(P + "chars"), F.lit(1))).cast("long"),
            P + "n_symbols": F.get(F.col(P + "chars"), F.lit(5)).cast("long"),
            P + "n_dup_lines": (F.size(P + "lines") - F.size(F.array_distinct(P + "lines"))).cast("long"),
            P + "size": F.length(P + "text"),
        }
    ).drop(P + "text", P + "words", P + "lines")
    df = df.join(refs, F.col("lang").cast("string").eqNullSafe(F.col(P + "lang")), "left")
    df = df.withColumns(
        {
            P + "char_distance": F.when(F.col(P + "size") >= min_chars, jensen_shannon(F.col(P + "chars"), F.col(P + "size"), F.col(P + "ref_chars"))),
            P + "word_distance": F.when(F.col(P + "n") >= min_words, jensen_shannon(F.col(P + "common"), F.col(P + "n"), F.col(P + "ref_common"))),
            P + "base_failed": (F.col(P + "n_words") < 10) | (100 * F.col(P + "repeat") > 20 * F.col(P + "n_words")),
        }
    )
    over = lambda d, limit, slack, n: F.coalesce(F.col(P + d) > limit + slack / F.sqrt(F.col(P + n)), F.lit(False))
    far = over("char_distance", max_char_distance, char_slack, "size") | over("word_distance", max_word_distance, word_slack, "n")
    return df.withColumn(P + "kept", ~(F.col(P + "base_failed") | far))


RESULTS = {"n_words": "n_words", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_dup_lines": "n_dup_lines", "repeat": "n_repeat_words", "base_failed": "base_failed", "kept": "kept", "char_distance": "char_distance", "word_distance": "word_distance"}


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    # a row number bars the filter from being pushed down, which would inline (and repeat) all it rests on
    judged = judge(docs).withColumn(P + "row", F.monotonically_increasing_id())
    return judged.where(F.col(P + "kept") & (F.col(P + "row") >= 0)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", *(F.col(P + a).alias(b) for a, b in RESULTS.items()))


QUERIES = {"op2_quality_rules": op2_quality_rules}
