"""Page sources (O-01 … O-03, O-43).

The page snapshot table stands in for the web: a URL is "fetched" by joining
it with the snapshot. A user-supplied loader (O-43) can replace the snapshot —
any callable ``DataFrame(url) -> DataFrame(url, html)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..functions.urls import valid_url
from ..session import ensure_shipped, table
from .charset import page_text

EMPTY_PAGE = "<html></html>"

PageLoader = Callable[[DataFrame], DataFrame]


def normalise_html(html: Column) -> Column:
    """O-01: missing or empty html → ``<html></html>``, otherwise stripped."""
    return F.when(html.isNull() | (html == ""), F.lit(EMPTY_PAGE)).otherwise(py_strip(html))


def read_pages(spark: SparkSession, sf_dir: str | None = None, path: str | None = None) -> DataFrame:
    """O-01: ``page_id, url, html`` with normalised html."""
    src = spark.read.parquet(path) if path else table(spark, sf_dir, "pages")
    return src.select("page_id", "url", normalise_html(F.col("html")).alias("html"))


def read_pages_from(df: DataFrame) -> DataFrame:
    """O-01 over any DataFrame with ``page_id, url, html``."""
    return df.select("page_id", "url", normalise_html(F.col("html")).alias("html"))


def read_byte_pages(df: DataFrame) -> DataFrame:
    """O-01 over ``page_id, url, content`` with pages as fetched bytes, each in its own
    character set (``charset``)."""
    ensure_shipped(df.sparkSession)
    return df.select("page_id", "url", normalise_html(page_text(F.col("content"))).alias("html"))


def read_page_files(spark: SparkSession, glob: str, encoding: str | None = None) -> DataFrame:
    """O-01 for a folder of HTML files: one page per file, the file URI as URL, the
    path hash as ``page_id``. Each file's character set is found from its bytes unless
    ``encoding`` names one for all. (Spark's file sources skip zero-length files; an empty
    ``html`` value in a page table becomes the empty document as usual.)"""
    files = spark.read.format("binaryFile").load(glob).select(
        F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), "content"
    )
    if encoding is None:
        return read_byte_pages(files)
    return read_pages_from(files.withColumn("html", F.decode("content", encoding)))


def valid_urls(df: DataFrame, col: str = "url") -> tuple[DataFrame, DataFrame]:
    """O-03: rows with a usable URL (scheme and network location), and the rejects."""
    ok = valid_url(F.col(col))
    return df.where(ok), df.where(~ok)


BROADCAST_FRONTIER_ROWS = 2_000_000


def resolve_pages(frontier: DataFrame, pages: DataFrame, loader: PageLoader | None = None,
                  broadcast_rows: int = BROADCAST_FRONTIER_ROWS) -> DataFrame:
    """O-02: fetch by URL. Every frontier row gets a page, of several snapshots of a URL the
    one with the least ``page_id``; a URL the source does not have gives the empty page (``found = false``), never an error.

    ``frontier`` needs a ``url`` column; the result keeps all its columns and
    adds ``html``, ``found`` (and the snapshot's ``page_id`` when it has one). The snapshot is never shuffled when the
    frontier's distinct URLs are few enough (checked) to broadcast: the pages
    are filtered by a broadcast semi-join and only the hits meet the frontier.
    """
    wanted = frontier.select("url").distinct()
    if loader:
        source = loader(wanted)
    else:
        snap = pages.select("url", "html", *(["page_id"] if "page_id" in pages.columns else []))
        if wanted.limit(broadcast_rows + 1).count() <= broadcast_rows:
            snap = snap.join(F.broadcast(wanted), "url", "left_semi")
        source = snap
    # several snapshots of a URL: the one of the least page id, then the least text
    keys = [c for c in ("page_id", "html") if c in source.columns]
    first = Window.partitionBy("url").orderBy(*keys)
    source = source.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn").withColumn("_found", F.lit(True))
    out = frontier.join(source, "url", "left")
    return out.withColumn("found", F.coalesce(F.col("_found"), F.lit(False))).withColumn(
        "html", F.coalesce(F.col("html"), F.lit(EMPTY_PAGE))
    ).drop("_found")
