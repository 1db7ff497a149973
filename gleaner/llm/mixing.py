"""Mixing sources to target weights by iterative proportional fitting (operator 2).

DataFrame functions only. Documents are counted into cells (one per combination of
the dimensions, with its tokens); cell weights are raked to each dimension's target
shares in turn until no factor differs from 1 by more than ``tol``; each document is
then drawn by its cell's calibrated rate. A margin is a windowed sum over the cells of a
category (cells, not documents, meet in a task), several sweeps run in one job, and only one
convergence number per job reaches the driver. Only a text's words are counted, so a very
long one is as any other.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.scratch import Scratch
from gleaner.llm.text import uniform

#: Label of a null category.
UNKNOWN = "unknown"
#: Cells a task rakes at once; more cells mean more tasks.
CELLS_PER_TASK = 200_000
#: Sweeps of one job, between two written tables.
SWEEPS = 4


def flattened_shares(cells: DataFrame, dim: str, exponent: float) -> DataFrame:
    """Target shares proportional to a dimension's own token shares to ``exponent``."""
    own = cells.groupBy(dim).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    return own.select(dim, F.pow(F.col("tokens").cast("double"), F.lit(exponent)).alias("share"))


def fixed_shares(cells: DataFrame, dim: str, shares: Mapping[str, float]) -> DataFrame:
    """Target shares given as a mapping.

    A category with tokens that is not in the mapping keeps its present share of all
    tokens; the listed categories with tokens divide the rest in their proportions.
    """
    rows = [(str(k), float(v)) for k, v in shares.items()]
    given = F.broadcast(cells.sparkSession.createDataFrame(rows, f"{dim} string, given double"))
    own = cells.groupBy(dim).agg(F.sum("tokens").alias("tokens")).where("tokens > 0").join(given, dim, "left")
    listed, total = own.agg(F.sum(F.when(F.col("given").isNotNull(), F.col("tokens"))), F.sum("given")).first()
    # shares are scaled to 1 later, so the listed ones stay as given
    per_token = (total or 1.0) / listed if listed else 1.0
    return own.select(dim, F.coalesce("given", F.col("tokens") * F.lit(per_token)).alias("share"))


def _normalised(cells: DataFrame, dim: str, shares: DataFrame, scratch: Scratch) -> DataFrame:
    """Shares of the categories that have tokens, summing to 1; a written table, planned once."""
    present = cells.where("tokens > 0").select(dim).distinct()
    kept = scratch.save(shares.where("share > 0").join(present, dim, "left_semi"))
    total = kept.agg(F.sum("share")).first()[0]
    return kept.withColumn("share", F.col("share") / F.lit(total))


def rake(
    cells: DataFrame,
    targets: Mapping[str, DataFrame],
    scratch: Scratch,
    tol: float = 1e-10,
    max_sweeps: int = 100,
) -> DataFrame:
    """``cells`` (the dimensions, ``tokens``) with ``mass``, raked to the targets.

    ``mass`` sums to 1. A category without a target gets none; targets of categories
    without tokens are left out and the others scaled to 1. Zero cells stay zero, so
    targets that contradict each other end at ``max_sweeps`` on the last fit.
    """
    n = cells.count()
    # cells that one task rakes need no exchange before a window: a job's plan stays small on the driver
    tasks = max(1, math.ceil(n / CELLS_PER_TASK))
    now = cells.withColumn("mass", F.col("tokens").cast("double"))
    for d, t in targets.items():
        share = _normalised(cells, d, t, scratch).select(d, F.col("share").alias(f"s_{d}"))
        now = now.join(share, d, "left").fillna(0.0, [f"s_{d}"])
    now = scratch.save(now.coalesce(tasks))
    done = 0
    while n and done < max_sweeps:
        w = now.coalesce(tasks).withColumn("moved", F.lit(0.0))
        for _ in range(min(SWEEPS, max_sweeps - done)):
            w, done = w.withColumn("moved", F.lit(0.0)), done + 1
            for d in targets:
                margin = F.sum("mass").over(Window.partitionBy(d))
                w = w.withColumn("factor", F.when(margin > 0, F.col(f"s_{d}") / margin).otherwise(0.0))
                w = w.withColumn("moved", F.greatest("moved", F.abs(F.col("factor") - 1))).withColumn("mass", F.col("mass") * F.col("factor"))
        after = scratch.save(w.withColumn("moved", F.when(F.col("mass") > 0, F.col("moved")).otherwise(0.0)).drop("factor"))
        scratch.drop(now)
        now = after
        if (now.agg(F.max("moved")).first()[0] or 0.0) <= tol:
            break
    return now.select(*cells.columns, "mass")


def mix(
    docs: DataFrame,
    dims: Mapping[str, Column],
    targets: Mapping[str, float | Mapping[str, float]],
    tokens: Column,
    key: Column,
    rate: float = 1.0,
    seed: int = 11,
    **fit,
) -> DataFrame:
    """Every document with its cell weight and the copies drawn of it.

    Adds the dimension columns, ``n_tokens``, ``weight`` (calibrated mass of the cell
    over its own mass), and ``n_copies`` = floor(rate * weight + u), u a repeatable
    uniform number of ``key``: a document is drawn rate * weight times on average, so
    weights above 1 repeat documents instead of being cut off. ``targets`` maps each
    dimension to its shares or to an exponent that flattens its own shares. A category
    without a listed share keeps its present one, the listed ones are scaled to the rest.
    Null categories are the category ``unknown``; documents without tokens weigh as their
    cell does (0 in a cell without tokens); equal keys draw alike; an empty table
    gives an empty result; added columns replace those of the same name.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    kept = [c for c in docs.columns if c not in {*dims, "n_tokens", "weight", "n_copies"}]
    labelled = docs.select(
        *kept,
        *[F.coalesce(c.cast("string"), F.lit(UNKNOWN)).alias(d) for d, c in dims.items()],
        F.coalesce(tokens.cast("long"), F.lit(0)).alias("n_tokens"),
        uniform(key, seed).alias("__u"),
    )
    cells = scratch.save(labelled.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens")))
    shares = {
        d: fixed_shares(cells, d, t) if isinstance(t, Mapping) else flattened_shares(cells, d, t)
        for d, t in targets.items()
    }
    raked = rake(cells, shares, scratch, **fit)
    total = cells.agg(F.sum("tokens")).first()[0]
    weights = raked.select(
        *dims,
        F.when(F.col("tokens") > 0, F.col("mass") * F.lit(total) / F.col("tokens")).otherwise(0.0).alias("weight"),
    )
    # a written table: Spark knows its size and broadcasts it only below its threshold
    out = labelled.join(scratch.save(weights), list(dims), "left")
    return out.withColumn(
        "n_copies", F.floor(F.lit(rate) * F.col("weight") + F.col("__u")).cast("long")
    ).select(*kept, *dims, "n_tokens", "weight", "n_copies")
