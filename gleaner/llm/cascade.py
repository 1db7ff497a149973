"""Quality rules as a short-circuit cascade (operator 10, DataFrame functions only).

Every rule is a Column that is true for a document to reject. A documented sample
gives each rule a cost (seconds over the sample) and, jointly, which documents the
rules reject. Rules are then ordered greedily by documents rejected *among those no
earlier rule rejected* per second, and evaluated in that order as one CASE
expression, which stops at the first rule that rejects. The order changes the time
only: ``kept`` is the same for every order.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.text import BLANKS, let, words

SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    name: str
    rejects: Column


def repeat_words(w: Column) -> Column:
    """Words of ``w`` inside 3-word windows that occur twice or more in ``w``.

    Windows are compared by 64-bit hash within one document. Documents without a
    repeated window end at the linear distinct count; the others sort their windows.
    """
    n = F.size(w)
    hashes = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )
    )

    def covered(s: Column) -> Column:
        twin = F.filter(
            s,
            lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
        )
        spans = F.transform(twin, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
        return F.size(F.array_distinct(F.flatten(spans)))

    def count(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.sort_array(pairs), covered)
        )

    return let(hashes, count)


def base_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text`` and the base columns of every document (null text: no words)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    measured = docs.select(
        F.col(id_col).alias("id"),
        text.alias("text"),
        let(
            words(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")
            ),
        ).alias("m"),
        let(
            F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0),
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            ),
        ).alias("l"),
    )
    return measured.select(
        "id",
        "text",
        "m.n_words",
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        "l.n_lines",
        "l.n_dup_lines",
        "m.n_repeat_words",
    ).withColumn(
        "base_failed",
        (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    )


def _occurrences(chars: str) -> Column:
    return F.length("text") - F.length(F.translate("text", chars, ""))


def default_rules() -> list[Rule]:
    """Rules over ``base_metrics`` columns; thresholds in whole numbers so they are exact."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    n = F.col("n_words")
    return [
        Rule("symbols", 100 * F.col("n_symbols") > 25 * n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("duplicate_lines", 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        Rule("capitals", _occurrences(upper) > _occurrences(lower)),
        Rule("exclamations", 100 * _occurrences("!") > 50 * n),
        Rule("digits", 100 * _occurrences("0123456789") > 20 * F.col("word_chars")),
        Rule("lettered_words", 100 * F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*")) < 70 * n),
        Rule("sentence_ends", 200 * F.regexp_count("text", F.lit(r"[.!?:;]")) < n),
    ]


def order_rules(sample: DataFrame, rules: Sequence[Rule], floor: float = 1e-3) -> list[Rule]:
    """Rules by rejection per cost on ``sample`` (rows of ``base_metrics``, undecided ones).

    Cost: the faster of two runs over the sample, less a run without a rule, at least
    ``floor`` seconds. Rejections come from one grouped count per combination of
    verdicts, so the greedy choice counts only what earlier rules let through.
    """
    def seconds(c: Column) -> float:
        took = []
        for _ in range(2):
            t = time.perf_counter()
            sample.agg(F.sum(c.cast("int"))).collect()
            took.append(time.perf_counter() - t)
        return min(took)

    idle = seconds(F.length("text") >= 0)
    cost = {r.name: max(seconds(r.rejects) - idle, floor) for r in rules}
    verdicts = [F.coalesce(r.rejects, F.lit(False)).alias(r.name) for r in rules]
    # at most 2^rules rows, and never more than the sample has
    patterns = sample.select(*verdicts).groupBy(*[r.name for r in rules]).count().collect()
    left, chosen = list(rules), []
    while left:
        best = max(left, key=lambda r: sum(p["count"] for p in patterns if p[r.name]) / cost[r.name])
        chosen.append(best)
        left.remove(best)
        patterns = [p for p in patterns if not p[best.name]]
    return chosen


def cascade(
    docs: DataFrame,
    rules: Sequence[Rule] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = 2000,
    seed: int = 7,
) -> DataFrame:
    """Base metrics and ``kept`` of every document.

    ``kept`` is false where ``base_failed``, else true unless a rule rejects; a rule
    whose value is null does not reject. ``sample_rows`` bounds the expected size of
    the sample that orders the rules. Null and empty texts have no words and fail the
    base; repeated rows are judged one by one; an empty table gives an empty result;
    other columns of ``docs``, whatever their names, are not read.
    """
    rules = list(default_rules() if rules is None else rules)
    total = docs.count()
    fraction = min(1.0, sample_rows / total) if total else 1.0
    metrics = base_metrics(docs, id_col, text_col)
    sample = base_metrics(docs.sample(False, fraction, seed), id_col, text_col).where(~F.col("base_failed"))
    sample = sample.persist()
    try:
        ordered = order_rules(sample, rules)
    finally:
        sample.unpersist()
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for rule in ordered:
        verdict = verdict.when(rule.rejects, F.lit(False))
    return metrics.withColumn("kept", verdict.otherwise(F.lit(True))).withColumnRenamed("id", id_col)
