"""Training rows for the two classifiers: a bounded, repeatable sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.text import fold, uniform

#: Documents whose crc32(doc_id as text) mod this is 0 are held out.
FOLDS = 5


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, seed: int) -> DataFrame:
    """``text, label`` (binary, int) of at most ``max_rows`` labelled ids outside the held-out fold.

    Ids are taken in the order of a repeatable random number, so the sample does not
    depend on partitioning. Null labels and ids are left out; an id with several labels
    counts with the largest, one with several texts with the least of them. The sampled ids are at most ``max_rows`` small rows, which
    is the proven bound of the broadcast.
    """
    ids = (
        labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("label"))
        .where("__id is not null and label is not null")
        .where(fold(F.col("__id"), FOLDS) != 0)
        .groupBy("__id")
        .agg(F.max("label").alias("label"))
        .orderBy(uniform(F.col("__id"), seed), "__id")
        .limit(max_rows)
    )
    rows = docs.select(F.col("doc_id").alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.join(F.broadcast(ids), "__id").groupBy("__id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
