"""Links (O-20 … O-26, O-30a).

``page_links`` (the flagship) per page: anchors selected by the link XPaths →
``href`` stripped, leading text stripped → key (strip, no trailing '/', no
fragment) → only '', http, https keys → one link per key (the first occurrence
with text, else the first) → resolved against the page URL → sorted by
(text, url).

Physical plan: one parse scan, one narrow filter, **one** exchange on
``page_id`` shared by the de-dup window and the ranking window (the hash
partitioning on ``page_id`` satisfies both), no join.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..functions.urls import complete_url, is_http, link_key
from .select import match_rows, nodes_for

DEFAULT_LINK_XPATHS = ("//a",)


def link_xpaths(xpaths) -> list[str]:
    """O-25: XPaths in order; an empty or missing list means every anchor."""
    xs = [x for x in (xpaths or []) if x is not None]
    return xs or list(DEFAULT_LINK_XPATHS)


def _groups(groups) -> list[tuple[str, list[str]]]:
    if isinstance(groups, dict):
        groups = list(groups.items())
    return [(g, link_xpaths(x)) for g, x in groups]


def link_nodes(pages: DataFrame, groups) -> DataFrame:
    xs = [x for _, xp in _groups(groups) for x in xp]
    return nodes_for(pages, xs, content=False, extra_attrs={"href"})


def link_info(nodes: DataFrame, groups=(("links", DEFAULT_LINK_XPATHS),), make_root: bool = False) -> DataFrame:
    """O-20: ``page_id, page_url, grp, sel, node_id, href, text`` for selected elements with an href."""
    groups = _groups(groups)
    flat, owner = [], []
    for g, xs in groups:
        for x in xs:
            flat.append(x)
            owner.append(g)
    rows = match_rows(nodes, flat).where(~F.col("is_string"))
    raw = F.col("attrs").getItem("href")
    href = py_strip(F.concat(F.lit("/"), raw) if make_root else raw)
    grp = F.lit(None).cast("string")
    for i, g in enumerate(owner):
        grp = F.when(F.col("sel") == i, F.lit(g)).otherwise(grp)
    return rows.where(raw.isNotNull() & (raw != "")).select(
        "page_id",
        F.col("url").alias("page_url"),
        grp.alias("grp"),
        "sel",
        "node_id",
        href.alias("href"),
        py_strip(F.coalesce(F.col("lead_text"), F.lit(""))).alias("text"),
    )


def dedup_links(info: DataFrame, carry=()) -> DataFrame:
    """O-22 … O-24 on link rows: key, scheme filter, first-with-text per key, resolve, rank.

    Links are resolved before the exchange, so only the narrow columns the two
    windows need cross it (no page URL or raw href per row, unless ``carry`` asks).
    """
    keyed = info.withColumn("key", link_key(F.col("href"))).where(is_http(F.col("key")))
    keyed = keyed.select(
        "page_id", "grp", "sel", "node_id", "key", "text", *carry,
        complete_url(F.col("page_url"), F.col("href")).alias("url"),
    ).repartition("page_id")
    first = Window.partitionBy("page_id", "grp", "key").orderBy((F.col("text") == "").asc(), "sel", "node_id")
    kept = keyed.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1)
    order = Window.partitionBy("page_id", "grp").orderBy("text", "url", "sel", "node_id")
    return kept.withColumn("link_rank", F.row_number().over(order).cast("long"))


def page_links(pages: DataFrame, xpaths: Sequence[str] | None = None, make_root: bool = False,
               nodes: DataFrame | None = None) -> DataFrame:
    """O-24 (flagship): ``page_id, link_rank, url, text`` — each page's sorted, de-duplicated links
    (``nodes``: an existing parse of ``pages`` to reuse)."""
    groups = [("links", link_xpaths(xpaths))]
    info = link_info(nodes if nodes is not None else link_nodes(pages, groups), groups, make_root)
    return dedup_links(info).select("page_id", "link_rank", "url", "text")


def grouped_links(pages: DataFrame, groups, make_root: bool = False, with_page_url: bool = False) -> DataFrame:
    """Links per named XPath group in one scan: ``page_id, grp, link_rank, url, text``
    (and ``page_url`` on request)."""
    groups = _groups(groups)
    info = link_info(link_nodes(pages, groups), groups, make_root)
    carry = ("page_url",) if with_page_url else ()
    return dedup_links(info, carry).select("page_id", *carry, "grp", "link_rank", "url", "text")


def explore_links(pages: DataFrame, explore: dict) -> DataFrame:
    """O-26: per rule (e.g. target / expand) the URLs found on each page, in link order."""
    return grouped_links(pages, explore).select(
        "page_id", F.col("grp").alias("rule"), "link_rank", "url"
    )


def links_as_array(links: DataFrame, keys: Iterable[str] = ("page_id",)) -> DataFrame:
    """Links folded back into the reference's list shape: ``ARRAY<STRUCT<url, text>>`` in rank order."""
    keys = list(keys)
    return links.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("link_rank", "url", "text"))),
            lambda s: F.struct(s["url"].alias("url"), s["text"].alias("text")),
        ).alias("links")
    )
