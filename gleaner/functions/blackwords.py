"""O-27 with words from a table: one pass over a text for all words (Aho–Corasick)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ensure_shipped

#: Bytes of words in one automaton; it takes some sixty times as much in a task.
SHARD_BYTES = 2 << 20


def usable_words(words: DataFrame, column: str = "word") -> DataFrame:
    """``word``: trimmed, lower-cased, distinct; nulls and blanks are no words."""
    word = F.lower(F.trim(F.col(column).cast("string")))
    return words.select(word.alias("word")).where("word is not null and word != ''").distinct()


def _finder(shared):
    """Does a lower-cased text hold one of the broadcast words; null for a null text."""

    @F.arrow_udf("boolean")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for w in shared.value:
            automaton.add_word(w)
        automaton.make_automaton()
        for texts in batches:
            found = (None if t is None else next(automaton.iter(t), None) is not None for t in texts.to_pylist())
            yield pa.array(found, pa.bool_())

    return find


def blocked_by(
    df: DataFrame, text: str, words: DataFrame, column: str = "word", into: str = "blocked", shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """``df`` with ``into``: is any of ``words`` (a table, any number) a substring of the lower-cased ``text``.

    The words are measured before they are gathered. Up to ``shard_bytes`` of them are one
    automaton, broadcast, and every text is read once, whatever the number of words. More
    are dealt by hash into shards of about that size, searched one after the other: the
    hashes (128 bits) of the texts that a shard hits are written, its broadcast is taken back,
    and the rows meet all hits in one join at the end.

    A null text gives null, an empty text or an empty table of words false; a very long
    text is searched to its first hit, in one task. All rows and columns stay.
    """
    spark = df.sparkSession
    ensure_shipped(spark)
    usable = usable_words(words, column).persist()
    try:
        size = usable.agg(F.sum(F.octet_length("word"))).first()[0] or 0
        n_shards = max(1, -(-size // shard_bytes))
        low = F.lower(F.col(text).cast("string"))
        gather = lambda rows: sorted(r["word"] for r in rows.collect())
        if not size:
            return df.withColumn(into, F.when(F.col(text).isNotNull(), F.lit(False)))
        if n_shards == 1:
            return df.withColumn(into, _finder(spark.sparkContext.broadcast(gather(usable)))(low))
        base, paths = f"{checkpoint_dir(spark)}/blackwords-{uuid.uuid4().hex}", []
        mark = [F.xxhash64(low).alias("__h"), F.xxhash64(F.lit("second"), low).alias("__h2")]
        for k in range(n_shards):
            held = gather(usable.where(F.pmod(F.xxhash64("word"), F.lit(n_shards)) == k))
            if not held:
                continue
            shared = spark.sparkContext.broadcast(held)
            hit = _finder(shared).asNondeterministic()(F.col("__low"))
            found = df.select(*mark, low.alias("__low")).withColumn("__hit", hit).where("__hit")
            paths.append(f"{base}/{k}")
            found.select("__h", "__h2").write.parquet(paths[-1])
            shared.destroy()
    finally:
        usable.unpersist()
    hits = spark.read.parquet(*paths).distinct().withColumn("__hit", F.lit(True))
    marked = df.withColumn("__h", mark[0]).withColumn("__h2", mark[1]).join(hits, ["__h", "__h2"], "left")
    verdict = F.when(F.col(text).isNotNull(), F.coalesce("__hit", F.lit(False)))
    return marked.withColumn(into, verdict).drop("__h", "__h2", "__hit")
