"""Corpus pipeline: toxicity, line dedup, near-duplicates, benchmark decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and works on every row its predecessor kept;
all but the last return the columns of ``documents``. ``run`` applies them to
``documents``, writing each result as Parquet in the shared checkpoint folder and reading
it back as the next stage's input, so a lost executor never costs an earlier stage.

Null and empty texts pass every filter: they hold no insult, passage or copy. Repeated
rows share one verdict. Empty tables give empty results. Extra columns stay; a stage
that adds columns of the same name (mixing) replaces them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.decontaminate import without_leaks
from gleaner.llm.linededup import near_lines, without_lines
from gleaner.llm.minhash import near_duplicates
from gleaner.llm.queries import mixed
from gleaner.llm.scratch import Scratch, ship
from gleaner.llm.toxicity import TERM, fit_toxicity
from gleaner.session import ensure_shipped, table

#: Score from which a document is toxic.
TOXIC = 0.5
#: Equal and nearly equal lines of which all but the first go.
REPEATS = 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not reject (operator 7).

    Without usable labels nothing is rejected, and texts without a term never are.
    """
    ensure_shipped(spark)
    score = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    if not score.learned:
        return docs
    empty = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(TERM)
    # scored in a column of its own: a condition cannot be split around a nondeterministic score
    scored = docs.withColumn("__score", score(F.col("text")))
    return scored.where(empty | (F.col("__score") < TOXIC)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later lines of each class of equal and nearly equal lines (operator 6).

    Whole copies (equal texts under different ids) count as the one of least id: they lose
    the lines it loses, so they are still copies where the next stage drops them. Rows
    without an id are judged on their own.
    """
    ensure_shipped(spark)
    texts = docs.withColumn("__h", F.xxhash64("text")).withColumn("__h2", F.xxhash64(F.lit("second"), "text"))
    copied = (
        texts.where("doc_id is not null and text is not null")
        .groupBy("__h", "__h2")
        .agg(F.min("doc_id").alias("__first"), F.max("doc_id").alias("__last"))
        .where("__first != __last")
        .drop("__last")
    )
    copied = ship(Scratch(spark, "copies").save(copied))
    first = F.when(F.col("doc_id").isNotNull(), F.coalesce("__first", "doc_id"))
    named = texts.join(copied, ["__h", "__h2"], "left").withColumn("__own", F.col("doc_id")).withColumn("doc_id", first)
    lines = near_lines(named.where("doc_id <=> __own"), min_repeats=REPEATS)
    return without_lines(named, lines).withColumn("doc_id", F.col("__own")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate component (operator 5)."""
    ensure_shipped(spark)
    found = near_duplicates(docs, shingle=5, percent=80)
    gone = Scratch(spark, "near").save(found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(ship(gone), docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 9)."""
    ensure_shipped(spark)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the raked weights, with how often each is drawn (operator 2)."""
    ensure_shipped(spark)
    return mixed(docs).where("n_copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Learned scores, edit distances and components have no SQL form; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
