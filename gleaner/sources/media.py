"""O-04 ``media_files``: files of referenced media and images.

The reference downloads each file and lists its name only when that worked. Here the
files are a snapshot read with Spark's ``binaryFile`` source and known by URL; a
reference matches the file of its URL or nothing, and an unmatched reference keeps a
null name as a failed download does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import file_name


def read_media(spark: SparkSession, glob: str, base_url: str | None = None, recursive: bool = True) -> DataFrame:
    """Media snapshot: ``path, url, file_name, length, content`` (one row per file).

    With ``base_url`` a file's URL is ``base_url`` followed by its path below the folder
    ``glob``; else it is the file's own URI.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(glob)
    url = F.col("path")
    if base_url is not None:
        root = glob.split("://", 1)[-1].rstrip("/") + "/"
        below = F.substring(F.col("path"), F.instr("path", root) + len(root), F.length("path"))
        url = F.concat(F.lit(base_url.rstrip("/") + "/"), below)
    return df.select("path", url.alias("url"), file_name(F.col("path")).alias("file_name"), "length", "content")


def media_files(refs: DataFrame, files: DataFrame, url_col: str = "file_url", with_content: bool = False) -> DataFrame:
    """Every reference with its file: ``...refs columns, stored_name, length`` (and ``content``).

    ``files`` needs ``url, length`` (and ``content``). References and files meet on URL with
    the length only; bytes, when asked for, are attached last and only for matched URLs.
    """
    known = files.groupBy(F.col("url").alias("_url")).agg(F.max("length").alias("length"))
    out = refs.join(known, refs[url_col] == known["_url"], "left")
    out = out.select(
        *[F.col(c) for c in refs.columns],
        F.when(F.col("_url").isNotNull(), file_name(F.col(url_col))).alias("stored_name"),
        "length",
    )
    if not with_content:
        return out
    asked = refs.select(F.col(url_col).alias("url")).distinct()
    found = files.select("url", "length", "content").join(asked, "url", "left_semi").dropDuplicates(["url", "length"])
    found = found.select(F.col("url").alias("_url"), F.col("length").alias("_length"), "content")
    return out.join(found, (out[url_col] == found["_url"]) & (out["length"] == found["_length"]), "left").drop("_url", "_length")
