"""Result assembly (O-31 … O-34): envelope, JSON export, clean view, task ids.

A datum is one operation's output, ``{content, media, images, extras}`` with
``extras.action`` / ``extras.target``; its ``content`` shape depends on the
operation, so datums travel as Spark VARIANT values, which lets the
operations of a run be unioned and gathered into one array per envelope.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import sort_by
from ..functions.timefmt import print_time

# fixed value: the JSON key of an envelope's content per operation is "content"
ENVELOPE_FIELDS = ("id", "task", "url", "start", "end", "results")


def datum(content: Column, action: str, target: str, media: Column | None = None,
          images: Column | None = None, extras: dict | None = None) -> Column:
    """One operation's datum as a VARIANT."""
    ex = [F.lit(action).alias("action"), F.lit(target).alias("target")]
    for k, v in (extras or {}).items():
        ex.append(v.alias(k))
    empty = F.array().cast("array<string>")
    st = F.struct(
        content.alias("content"),
        (media if media is not None else empty).alias("media"),
        (images if images is not None else empty).alias("images"),
        F.struct(*ex).alias("extras"),
    )
    return F.parse_json(F.to_json(st, {"ignoreNullFields": "false"}))


def assemble(datums: list[DataFrame], key: str = "spider_id") -> DataFrame:
    """O-31: datums ``(key, op_index, datum)`` of several operations → one row per key
    with ``results`` in request order."""
    allops = datums[0]
    for d in datums[1:]:
        allops = allops.unionByName(d)
    return allops.groupBy(key).agg(
        F.transform(
            sort_by(F.collect_list(F.struct("op_index", "datum")), "op_index"), lambda x: x["datum"]
        ).alias("results")
    )


def envelope(assembled: DataFrame, urls: DataFrame, task: Column, key: str = "spider_id",
             start: Column | None = None, end: Column | None = None) -> DataFrame:
    """O-31: ``{id, task, url, start, end, results}`` per key (``urls``: ``key, url, id``)."""
    start = start if start is not None else F.current_timestamp()
    end = end if end is not None else F.current_timestamp()
    out = assembled.join(urls, key)
    return out.select(
        key, "url", F.col("id"), task.alias("task"),
        print_time(start).alias("start"), print_time(end).alias("end"), "results",
    )


def results_json(env: DataFrame, pretty: bool = True) -> Column:
    """O-32: the envelope as (pretty) JSON text."""
    st = F.struct(*[F.col(c) for c in ENVELOPE_FIELDS])
    return F.to_json(st, {"pretty": "true"} if pretty else {})


def results_clean(env: DataFrame, crawled: DataFrame | None = None, key: str = "spider_id") -> DataFrame:
    """O-33: content only, envelope dropped — one row per item, ``key, op_index, item_index, item``.

    For a crawl datum the items are the ``content`` of each crawled page: those embedded
    in it, or, where the pages stayed rows, those of ``crawled`` (``plans.operations.
    crawl_records``) in the order of depth and page id. For others the items are those of
    the content (list elements, or map values), a string content is one item.
    """
    ops = env.select(key, F.posexplode("results").alias("op_index", "d"))
    action = F.variant_get("d", "$.extras.action", "string")
    content = F.variant_get("d", "$.content", "variant")
    as_list = F.try_variant_get(content, "$", "array<variant>")
    as_map = F.try_variant_get(content, "$", "map<string,variant>")
    pages = F.transform(F.map_values(as_map), lambda v: F.variant_get(v, "$.content", "variant"))
    items = (
        F.when(action == "crawl", pages)
        .when(as_list.isNotNull(), as_list)
        .when(as_map.isNotNull(), F.map_values(as_map))
        .otherwise(F.array(content))
    )
    apart = (action == "crawl") & F.try_variant_get(content, "$.pages", "bigint").isNotNull()
    inside = ops.where(~F.coalesce(apart, F.lit(False)))
    out = inside.select(key, "op_index", F.posexplode(items).alias("item_index", "item"))
    out = out.select(key, "op_index", "item_index", F.to_json("item").alias("item"))
    if crawled is None:
        return out
    order = Window.partitionBy(key).orderBy("depth", "page_id")
    pages = crawled.select(key, (F.row_number().over(order) - 1).alias("item_index"), F.to_json("content").alias("item"))
    rows = ops.where(apart).select(key, "op_index").join(pages, key)
    return out.unionByName(rows.select(key, "op_index", "item_index", "item"))


def assign_task_id(df: DataFrame, task_col: str = "task_id", prefix: str = "", run_id: str = "run",
                   key_cols=("spider_id",), existing: DataFrame | None = None) -> DataFrame:
    """O-34: a given task id is kept; otherwise ``prefix + uuid``, unique among ``existing``.

    The uuid is derived from the run id and the row key (repeatable, no two
    rows of a run share one); ids that clash with ``existing`` results are
    re-derived with a new salt until none does (each round a semi-join of the clashing).
    """
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols]

    def derived(salt: int) -> Column:
        h = F.sha2(F.concat_ws("\u0001", F.lit(run_id), F.lit(str(salt)), *keys), 256)
        uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                           F.substring(h, 17, 4), F.substring(h, 21, 12))
        return F.concat(F.lit(prefix), uuid)

    out = df.withColumn("_gen", F.col(task_col).isNull())
    out = out.withColumn(task_col, F.coalesce(F.col(task_col), derived(0)))
    if existing is None:
        return out.drop("_gen")
    taken = existing.select(F.col(task_col).alias("_taken")).distinct()
    for salt in itertools.count(1):
        clash = out.where("_gen").join(taken, F.col(task_col) == taken["_taken"], "left_semi")
        if clash.isEmpty():
            break
        bad = clash.select(*key_cols).withColumn("_redo", F.lit(True))
        out = out.join(bad, list(key_cols), "left").withColumn(
            task_col, F.when(F.col("_redo"), derived(salt)).otherwise(F.col(task_col))
        ).drop("_redo")
    return out.drop("_gen")
