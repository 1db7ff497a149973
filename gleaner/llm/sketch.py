"""Document fingerprints: bottom-k sketches of shingle hashes (operator 11).

A text's shingles are its runs of ``shingle`` words (A-Z lower-cased; a shorter text is one
shingle, a text without words has none). A shingle's hash is the first 48 bits of the MD5 of
its words joined by one space, as 12 hex digits, so that order of strings is order of
numbers. A sketch is the ``k`` least distinct hashes, ascending. A sketch of fewer than ``k``
hashes is the whole set, and what is told from whole sets is exact.

Sketches merge: the sketch of a union is the ``k`` least hashes of both, so parts of a corpus
are sketched where they lie and merged afterwards (``merge``, ``merge_sketches``).

DataFrame functions only. Null and empty texts have the empty sketch; equal texts have equal
sketches; a very long text is sketched whole, in one task that holds its words and hashes
(about thirty times its bytes).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gleaner.llm.text import let, lower_ascii, words

#: Words of a shingle, hashes of a sketch, hex digits of a hash.
SHINGLE, K, DIGITS = 5, 256, 12
#: Bytes of text in one part of an order.
PART_BYTES = 32 << 20


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """The ``n``-word shingles of a text, in order."""

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (n - 1))
        return (
            F.when(F.size(w) == 0, F.array().cast("array<string>"))
            .when(F.size(w) <= n, F.array(F.array_join(w, " ")))
            .otherwise(F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " ")))
        )

    return let(words(lower_ascii(text)), runs)


def least(hashes: Column, k: int = K) -> Column:
    """The ``k`` least distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, n: int = SHINGLE, k: int = K) -> Column:
    """The bottom-``k`` sketch of a text."""
    return least(F.transform(shingles(text, n), lambda s: F.substring(F.md5(s.cast("binary")), 1, DIGITS)), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sketched sets."""
    return least(F.concat(a, b), k)


def _known_to(a: Column, b: Column, k: int) -> Column:
    """The hash up to which both sketches hold all there is; null if both are whole sets."""
    return F.least(*[F.when(F.size(s) >= k, F.get(s, F.lit(k - 1))) for s in (a, b)])


def _up_to(s: Column, end: Column) -> Column:
    return F.size(F.filter(s, lambda h: end.isNull() | (h <= end)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the union that both sets hold, 0 to 1; two empty sets are alike (1).

    Counted over the hashes that both sketches are known to cover, at least ``k`` unless
    both are whole sets.
    """

    def of(end: Column) -> Column:
        both = F.size(F.array_intersect(a, b))
        union = _up_to(a, end) + _up_to(b, end) - both
        return F.when(union == 0, 1.0).otherwise(both / union)

    return let(_known_to(a, b, k), of)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set that the second holds; an empty set is contained (1).

    Null where the second sketch ends before the first begins and so tells nothing.
    """

    def of(end: Column) -> Column:
        own = _up_to(a, end)
        share = F.when(own > 0, F.size(F.array_intersect(a, b)) / own)
        return F.when(F.size(a) == 0, 1.0).otherwise(share)

    return let(_known_to(a, b, k), of)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: (k - 1) hashes lie below the k-th."""
    last = F.conv(F.get(a, F.lit(k - 1)), 16, 10).cast("double")
    estimate = F.floor(F.lit(float((k - 1) << 4 * DIGITS)) / last)
    return F.when(F.size(a) < k, F.size(a)).otherwise(estimate).cast("long")


def fingerprint(a: Column) -> Column:
    """A sketch as one string, its hashes joined."""
    return F.array_join(a, "")


def merge_sketches(sketched: DataFrame, by: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch per group of rows: ``by`` and ``column``, the sketch of the group's union.

    Equal hashes of a group collapse before they shuffle, and a task passes on at most ``k`` hashes
    of a group, so a group of any size ends with ``k`` rows per task in its last step. Null
    keys are a group; groups of empty sketches have the empty sketch.
    """
    rows = sketched.select(*by, F.explode_outer(column).alias("__hash")).distinct()
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("__hash").asc_nulls_last())))
    kept = ranked.where(F.col("__rank") <= k).groupBy(*by)
    return kept.agg(F.sort_array(F.collect_list("__hash")).alias(column))


def _count_below(starts: list[int], key: Column) -> Column:
    """How many of the ascending ``starts`` are below ``key``, by binary search."""
    held = F.lit(starts)

    def step(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        below = (at["low"] < at["high"]) & (F.get(held, middle) < key)
        return F.struct(
            F.when(below, middle + 1).otherwise(at["low"]).alias("low"),
            F.when(below, at["high"]).otherwise(middle).alias("high"),
        )

    steps = F.sequence(F.lit(1), F.lit(len(starts).bit_length() + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(starts)).alias("high")), step, lambda at: at["low"])


def descending(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, WindowSpec]:
    """``docs`` in parts of consecutive keys, and a window that runs down each part.

    Adds ``__part`` and ``__guest``: the first rows of a part stand once more, as guests, at
    the end of the part before it (those of the first part at the end of the last), so that
    ``lead`` over the window finds the next row of the whole order, which ends where it
    began. Drop the guests afterwards. Rows of one key follow each other by ``text``. Rows
    without a key have no place in the order: their parts are negative.

    The cuts are approximate quantiles of the key, eight bytes for each ``PART_BYTES`` of
    text, so parts are alike in size whatever the keys are.
    """
    spark = docs.sparkSession
    held = docs.select(F.col(key).cast("long").alias("key"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).alias("bytes"))
    n, size, highest = held.agg(F.count("key"), F.sum("bytes"), F.max("key")).first()
    parts = max(4 * spark.sparkContext.defaultParallelism, math.ceil((size or 0) / PART_BYTES))
    starts = []
    if n:
        cuts = [i / parts for i in range(1, parts)]
        starts = held.agg(F.percentile_approx("key", cuts, max(10_000, 20 * parts))).first()[0]
        starts = sorted({*starts, highest})
    home = F.lit(len(starts) - 1) - _count_below(starts or [0], F.col(key).cast("long"))
    first = F.get(F.lit(starts[::-1] or [0]), F.col("__home")) == F.col(key)
    before = F.pmod(F.col("__home") - 1, F.lit(len(starts) or 1))
    own = F.struct(F.col("__home").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(before.alias("part"), F.lit(True).alias("guest"))
    placed = docs.withColumn("__home", F.when(F.col(key).isNull(), -1 - F.spark_partition_id()).otherwise(home))
    dealt = placed.withColumn("__at", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))))
    out = dealt.select(*docs.columns, F.col("__at.part").alias("__part"), F.col("__at.guest").alias("__guest"))
    return out, Window.partitionBy("__part").orderBy("__guest", F.col(key).desc(), text)


def edited_fingerprints(docs: DataFrame, n: int = SHINGLE, k: int = K) -> DataFrame:
    """Fingerprints of every row of ``docs`` (``doc_id, text``) and of its edited text.

    The edited text has its last third (floor(n_chars / 3) code points) replaced by the first
    as many of the next text by descending ``doc_id``; after the last comes the first. Adds
    the estimates a pair of sketches gives. Texts cross one exchange, whole, so that a part
    of the order lies in one task; the sketches of neighbours meet there too.

    Null texts are empty; rows without an id have an empty next text; rows of one id follow
    each other by text; a single row is its own next; an empty table gives an empty result;
    other columns are not read.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed, down = descending(texts, "doc_id", "text")
    known = F.col("doc_id").isNotNull()
    n_chars = F.length("text")
    cut = F.floor(n_chars / 3).cast("int")
    following = F.when(known, F.lead("text").over(down)).otherwise("")
    edited = F.concat(F.left("text", n_chars - F.col("__cut")), F.left(F.coalesce("__next", F.lit("")), F.col("__cut")))
    rows = (
        placed.withColumn("__cut", cut)
        .withColumn("__next", following)
        .withColumn("__edited", edited)
        .select(
            "doc_id", "text", "__part", "__guest",
            n_chars.cast("long").alias("n_chars"),
            F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
            sketch(F.col("text"), n, k).alias("sketch"),
            F.when(~F.col("__guest"), sketch(F.col("__edited"), n, k)).alias("edited_sketch"),
        )
        .withColumn("next_sketch", F.when(known, F.lead("sketch").over(down)))
        .where(~F.col("__guest"))
    )
    nothing = F.array().cast("array<string>")
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.coalesce("next_sketch", nothing)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(a).alias("fingerprint"),
        fingerprint(b).alias("edited_fingerprint"),
        resemblance(a, b, k).alias("near_edited"),
        resemblance(a, c, k).alias("near_next"),
        containment(a, b, k).alias("kept_in_edited"),
        distinct_shingles(a, k).alias("n_shingles"),
    )
