"""O-31 multi-operation run: ``[{action, target}, …]`` for every spider at once.

Each operation is its own DataFrame over all spiders' start pages (or their
crawls), turned into a VARIANT datum tagged with ``op_index``; the datums are
unioned and gathered into one envelope per spider. Supported operations are
the collector's five: get page, get links, get article, get content and
crawl content.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import sort_by
from ..functions.urls import page_identity
from ..operators.article import extract_article
from ..operators.content import IMG_XPATH, ROOT_XPATH, collect_content
from ..operators.crawl import crawl, crawl_content
from ..operators.links import links_as_array, page_links
from ..operators.nodes import parse_nodes
from ..operators.results import assemble, assign_task_id, datum, envelope
from ..operators.select import as_selectors, parse_options
from ..session import checkpoint_dir
from ..sources.pages import normalise_html, resolve_pages

OPERATIONS = (("get", "page"), ("get", "links"), ("get", "article"), ("get", "content"), ("crawl", "content"))


def _ops(operations) -> list[tuple[str, str]]:
    out = []
    for op in operations:
        a, t = (op["action"], op["target"]) if isinstance(op, dict) else (op[0], op[1])
        if (a, t) not in OPERATIONS:
            raise ValueError(f"unknown operation {a}_{t}")
        out.append((a, t))
    return out


def start_pages(spiders: DataFrame, pages: DataFrame) -> DataFrame:
    """Each spider's start page (O-02: a missing page is the empty page), keyed ``page_id = spider_id``."""
    res = resolve_pages(spiders.select("spider_id", "url"), pages.select("url", "html"))
    return res.select(F.col("spider_id").alias("page_id"), "url", normalise_html(F.col("html")).alias("html"))


def crawl_records(spiders: DataFrame, pages: DataFrame, selectors=(), location: str = "results",
                  **content_options) -> DataFrame:
    """O-30d rows of a crawl-content operation: ``spider_id, page_id, page_key, url, depth, content,
    path``; the path is the folder ``write_results`` puts these rows in."""
    got = crawl(spiders, pages)
    rec = crawl_content(got, pages, selectors, **content_options)
    return rec.select(
        "spider_id", page_identity(F.col("url")).alias("page_id"), "page_key", "url", "depth", "content",
        F.lit(location.rstrip("/") + "/crawl").alias("path"),
    )


def _shared_options(ops, selectors) -> dict:
    """What a parse must provide for the page operations of a run: the union of their needs."""
    own = [s.xpath for s in as_selectors(selectors)]
    options = parse_options(["//a", IMG_XPATH, ROOT_XPATH, *own], content=False, extra_attrs={"href", "src", "alt"})
    tags = parse_options(own)["content_tags"]
    options["content_tags"] = tags
    # links and images look at all ancestors of anchors and images
    tags = options["path_tags"]
    options["path_tags"] = None if tags is None else {*tags, "a", "img"}
    return options


def _embedded_crawl(rec: DataFrame) -> DataFrame:
    """``{page_id: {content, url}}`` per spider (the reference's shape; gathers each crawl)."""
    per = rec.groupBy("spider_id").agg(
        sort_by(F.collect_list(F.struct("page_id", "url", "content")), "page_id").alias("e")
    )
    keys = F.transform("e", lambda x: x["page_id"])
    return per.select(
        "spider_id",
        F.map_from_arrays(keys, F.transform("e", lambda x: F.struct(x["content"].alias("content"),
                                                                 x["url"].alias("url")))).alias("pages"),
    )


def operate(spiders: DataFrame, pages: DataFrame, operations, plan: DataFrame, **kw) -> DataFrame:
    """O-31 with O-05: every spider runs with its own collector's configuration.

    ``plan`` is ``sources.config.spider_plan(...)``. Spiders are grouped by their
    distinct configuration (selectors, image switch, refine rules, black words);
    only the distinct configurations reach the driver, the spider → configuration
    mapping stays a DataFrame. Each group runs over its spiders (a semi-join) and
    the envelopes are unioned.
    A spider without a collector runs with no selectors.
    """
    from ..sources.config import selector_sets, spider_sets

    out = None
    membership = spider_sets(plan).select("spider_id", "set_id")
    for g in selector_sets(plan):
        members = spiders.join(membership.where(F.col("set_id") == g["set_id"]), "spider_id", "left_semi")
        env = run_operations(
            members, pages, operations, g["selectors"], get_image=g["get_image"],
            replace_rules=g["replace_rules"] or None, black_words=g["black_words"] or None, **kw,
        )
        out = env if out is None else out.unionByName(env)
    rest = spiders.join(membership, "spider_id", "left_anti")
    env = run_operations(rest, pages, operations, (), **kw)
    return env if out is None else out.unionByName(env)


def run_operations(
    spiders: DataFrame,
    pages: DataFrame,
    operations,
    selectors=(),
    task_id: str | None = None,
    run_id: str | None = None,
    task_prefix: str = "",
    location: str = "results",
    existing: DataFrame | None = None,
    started=None,
    ended=None,
    embed_crawl: bool = False,
    **content_options,
) -> DataFrame:
    """Envelopes ``spider_id, url, id, task, start, end, results ARRAY<VARIANT>``.

    ``run_id`` tells runs apart (generated when not given): result ids are identities of
    run, URL and spider, and task ids are derived from it and kept off the task ids of
    ``existing`` results. Every operation has one datum per spider, in request order,
    whatever its start page. ``started`` / ``ended`` are the run's time columns (default: now).

    A crawl's pages stay rows (``crawl_records``; the sink writes them as index
    records): by default the crawl datum carries ``{"pages": n}`` and their
    location, so no spider's whole crawl is ever gathered into one row. With
    ``embed_crawl=True`` the datum embeds ``{page_key: {content, url}}`` as the
    reference does — for crawls known to be small.
    """
    ops = _ops(operations)
    run_id = run_id or uuid.uuid4().hex
    checkpoint_dir(spiders.sparkSession)
    # every operation reads the start pages: resolve them once, lineage cut
    starts = start_pages(spiders, pages).checkpoint()
    spider = F.col("page_id").alias("spider_id")
    ids = starts.select(spider, "url", page_identity(F.col("url"), F.lit(run_id), F.col("page_id")).alias("id"))
    every = ids.select("spider_id")
    # one parse of the start pages, shared by links and content; the article is chosen in a parse of its own
    shared = None
    if sum((a, t) in (("get", "links"), ("get", "content")) for a, t in ops) > 1:
        shared = parse_nodes(starts, **_shared_options(ops, selectors)).persist(StorageLevel.MEMORY_AND_DISK)
    datums = []
    for i, (a, t) in enumerate(ops):
        if (a, t) == ("get", "page"):
            d = starts.select(F.col("page_id").alias("spider_id"), datum(F.col("html"), a, t).alias("datum"))
        elif (a, t) == ("get", "links"):
            arr = links_as_array(page_links(starts, nodes=shared))
            d = every.join(arr.withColumnRenamed("page_id", "spider_id"), "spider_id", "left")
            links = F.coalesce(F.col("links"), F.array().cast("array<struct<url:string,text:string>>"))
            d = d.select("spider_id", datum(links, a, t).alias("datum"))
        elif (a, t) == ("get", "article"):
            art = extract_article(starts)
            d = every.join(art.withColumnRenamed("page_id", "spider_id"), "spider_id", "left")
            d = d.select("spider_id", datum(F.struct("title", "content"), a, t).alias("datum"))
        elif (a, t) == ("get", "content"):
            rec = collect_content(starts, selectors, nodes=shared, **content_options)
            path = F.lit(location.rstrip("/") + "/envelopes")
            content = F.when(~F.col("blocked"), F.col("content"))
            rec = every.join(rec.withColumnRenamed("page_id", "spider_id"), "spider_id", "left")
            d = rec.select(
                "spider_id",
                datum(content, a, t, F.col("media"), F.col("images"),
                      {"uuid": page_identity(F.col("url")), "path": path, "blocked": F.col("blocked")}).alias("datum"),
            )
        else:  # crawl content
            rec = crawl_records(spiders, pages, selectors, location, **content_options)
            if embed_crawl:
                per = _embedded_crawl(rec)
                d = every.join(per, "spider_id", "left").select(
                    "spider_id",
                    datum(F.col("pages"), a, t, extras={"path": F.lit(location.rstrip("/") + "/crawl")}).alias("datum"),
                )
            else:
                per = rec.groupBy("spider_id").agg(F.count("*").alias("n"))
                d = every.join(per, "spider_id", "left").select(
                    "spider_id",
                    datum(F.struct(F.coalesce("n", F.lit(0)).alias("pages")), a, t,
                          extras={"path": F.lit(location.rstrip("/") + "/crawl")}).alias("datum"),
                )
        datums.append(d.withColumn("op_index", F.lit(i)))
    # written before the shared parse is let go
    assembled = assemble(datums).checkpoint()
    if shared is not None:
        shared.unpersist()
    taken = existing.select(F.col("task").alias("task_id")) if existing is not None else None
    tasks = assign_task_id(
        ids.withColumn("task_id", F.lit(task_id).cast("string")), "task_id", task_prefix, run_id, existing=taken
    )
    return envelope(assembled, tasks, F.col("task_id"), start=started, end=ended)
