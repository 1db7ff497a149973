"""Result sink and manifest (O-37 … O-41).

A run's results are written once under ``<root>/YYYY/MM/DD/<run id>`` with Spark's
writers; writing the run again replaces that folder, so a repeated run never doubles
records. The manifest is a table with one record per stored result; its path is the
folder the result is in and its ``id`` names the record there. Retiring, deleting and
skipping are joins against it, by result id: two runs of one URL are two results.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefmt import storage_partition
from ..functions.urls import page_identity
from ..operators.results import ENVELOPE_FIELDS

MANIFEST_SCHEMA = "id string, url string, local_path string, created_time timestamp, state int"


def run_folder(run_ts: Column, run_id: str, root: str = "results") -> Column:
    """Where a run's results are: ``<root>/YYYY/MM/DD/<run id>``."""
    return F.concat(storage_partition(run_ts, root)[3], F.lit(f"/{run_id}"))


def write_results(env: DataFrame, base_path: str, run_ts: dt.datetime, run_id: str, records: DataFrame | None = None,
                  root: str = "results", compress: bool = True, fmt: str = "json") -> str:
    """O-38: a run's envelopes, and the page records of its crawls when given, under its folder.

    ``json`` writes JSON lines (gzip when ``compress``); ``parquet`` keeps the VARIANT
    results as they are. Records go to ``…/crawl`` below it, where a crawl datum points.
    Returns the folder.
    """
    folder = f"{base_path.rstrip('/')}/{root}/{run_ts:%Y/%m/%d}/{run_id}"
    for df, name in ((env, "envelopes"), (records, "crawl")):
        if df is None:
            continue
        out = df
        if fmt == "json" and "results" in df.columns:
            out = out.withColumn("results", F.transform("results", lambda r: F.to_json(r)))
        w = out.write.mode("overwrite")
        if compress:
            w = w.option("compression", "gzip" if fmt == "json" else "zstd")
        (w.json if fmt == "json" else w.parquet)(f"{folder}/{name}")
    return folder


def collect_manifest(env: DataFrame, run_ts: Column, run_id: str, root: str = "results") -> DataFrame:
    """O-39: one manifest record per stored result that produced files
    (a ``get content`` or ``crawl`` datum carries ``extras.path``)."""
    has_files = F.exists("results", lambda r: F.variant_get(r, "$.extras.path", "string").isNotNull()
                         | F.try_variant_get(r, "$.extras.path", "array<string>").isNotNull())
    return env.where(has_files).select(
        "id", "url", run_folder(run_ts, run_id, root).alias("local_path"), run_ts.alias("created_time"),
        F.lit(0).alias("state"),
    )


def retire_content(manifest: DataFrame, remove: DataFrame, key: str = "id") -> DataFrame:
    """O-40: the files of the results in ``remove`` are gone: their records stay with
    ``local_path = ''`` and ``state = 1``. The results themselves are not touched."""
    gone = remove.select(key).distinct().withColumn("_gone", F.lit(True))
    m = manifest.join(gone, key, "left")
    return m.select(
        *[
            F.when(F.col("_gone"), F.lit(new)).otherwise(F.col(c)).alias(c) if (new := {"local_path": "", "state": 1}.get(c)) is not None else F.col(c)
            for c in manifest.columns
        ]
    )


def delete_results(results: DataFrame, manifest: DataFrame, remove: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Deleting a result deletes its manifest record with it: ``(results, manifest)`` without them."""
    gone = remove.select(key).distinct()
    return results.join(gone, key, "left_anti"), manifest.join(gone, key, "left_anti")


def skip_collected(pages: DataFrame, manifest: DataFrame, key: str = "url") -> DataFrame:
    """O-41: pages that have no live stored result yet (``state = 0``)."""
    live = manifest.where(F.col("state") == 0).select(key).distinct()
    return pages.join(live, key, "left_anti")


def manifest_of(pages: DataFrame, run_ts: Column, run_id: str, root: str = "results") -> DataFrame:
    """A manifest for stored pages of a run: one live record per page URL."""
    return pages.select(
        page_identity(F.col("url"), F.lit(run_id)).alias("id"), "url",
        run_folder(run_ts, run_id, root).alias("local_path"), run_ts.alias("created_time"), F.lit(0).alias("state"),
    )


__all__ = ["write_results", "run_folder", "collect_manifest", "retire_content", "delete_results", "skip_collected",
           "manifest_of", "ENVELOPE_FIELDS", "MANIFEST_SCHEMA"]
