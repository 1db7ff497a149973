"""O-19 ``collect_content`` — per-page content record — with O-16 media, O-17
images, O-26 explore links, O-27 black words, O-28 refine and O-29 the image
switch.

Plan: one parse scan (pruned to what the selectors need) → one explode that
tags each match with its kind → **one** exchange on ``page_id`` → a window
keyed by ``(page_id, ancestor id)`` pairs every ``img`` with the html
containers above it (an equi-partition, so no pair that does not exist is ever
formed) → one aggregation per page; the record is then built with array
functions inside the page's row. No join, no second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, normalise_words, py_strip, refine_array
from ..functions.urls import complete_url, file_name, is_http, link_key, page_key
from .links import _groups
from .nodes import parse_nodes
from .select import Selector, as_selectors, content_value, match_rows, parse_options

IMG_XPATH = "//img"
ROOT_XPATH = "/*"  # one sentinel row per page, so pages without any match still get a record

_ITEM = "struct<kind:string,sel:int,ord:bigint,sub:bigint,node_key:int,value:string,text:string>"


def last_key_wins(selectors) -> list[Selector]:
    """O-05 detail: the selector map keeps the last selector of a duplicated key."""
    out: dict[str, Selector] = {}
    for s in as_selectors(selectors):
        out.pop(s.key, None)
        out[s.key] = s
    return list(out.values())


def _item(kind, sel, ord_, sub, node_key, value, text) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        sel.cast("int").alias("sel"),
        ord_.cast("long").alias("ord"),
        sub.cast("long").alias("sub"),
        node_key.cast("int").alias("node_key"),
        value.cast("string").alias("value"),
        text.cast("string").alias("text"),
    )


def content_items(
    pages: DataFrame,
    selectors,
    get_image: bool = True,
    explore=None,
    with_tail: bool = False,
    nodes: DataFrame | None = None,
) -> tuple[DataFrame, list[Selector], list[tuple[str, list[str]]]]:
    """Per page: ``page_id, url, items ARRAY<item>`` (values, media, images, links)."""
    sels = last_key_wins(selectors)
    groups = _groups(explore) if explore else []
    xps = [s.xpath for s in sels]
    link_xps = [x for _, xs in groups for x in xs]
    img_sel = len(xps) + len(link_xps)
    root_sel = img_sel + 1
    all_xps = xps + link_xps + ([IMG_XPATH] if get_image else [])
    opts_all = parse_options(all_xps, content=False, extra_attrs={"href", "src", "alt"})
    opts_content = parse_options([s.xpath for s in sels if s.data_type != "binary"], content=True)
    path_tags = opts_all["path_tags"]
    if get_image and path_tags is not None:
        path_tags = set(path_tags) | {"img"}
    if nodes is None:
        nodes = parse_nodes(
            pages, attrs=opts_all["attrs"], content_tags=opts_content["content_tags"], path_tags=path_tags,
            text_tags=opts_all["text_tags"], xpaths=opts_all["xpaths"], row_tags=opts_all["row_tags"],
        )
    rows = match_rows(
        nodes, all_xps + ([] if get_image else [IMG_XPATH]) + [ROOT_XPATH], with_ancestors=get_image
    )
    if not get_image:
        root_sel = img_sel + 1  # the img slot is present but never used

    sel, ordc, is_str = F.col("sel"), F.col("ord"), F.col("is_string")
    null_s, null_i, zero = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(0)
    cands = []
    for i, s in enumerate(sels):
        if s.data_type == "binary":
            ok = (sel == i) & is_str & (py_strip(F.col("value")) != "")
            cands.append(F.when(ok, _item("m", sel, ordc, zero, null_i, F.col("value"), null_s)))
        else:
            v = content_value(s.data_type, with_tail)
            cands.append(F.when(sel == i, _item("v", sel, ordc, zero, null_i, v, null_s)))
            if get_image and s.data_type == "html":
                ok = (sel == i) & ~is_str
                cands.append(
                    F.when(ok, _item("c", sel, ordc, zero, F.col("node_id"), null_s,
                                     F.coalesce(F.col("attrs").getItem("alt"), F.lit(""))))
                )
    for j in range(len(link_xps)):
        k = len(xps) + j
        href = F.col("attrs").getItem("href")
        ok = (sel == k) & ~is_str & href.isNotNull() & (href != "")
        cands.append(
            F.when(ok, _item("l", sel, ordc, zero, null_i, py_strip(href),
                             py_strip(F.coalesce(F.col("lead_text"), F.lit("")))))
        )
    cands.append(F.when(sel == root_sel, _item("p", sel, ordc, zero, null_i, null_s, null_s)))
    base = [F.filter(F.array(*cands), lambda x: x.isNotNull())]
    if get_image:
        src = F.col("attrs").getItem("src")
        img_rows = F.when(
            (sel == img_sel) & src.isNotNull(),
            F.transform(F.col("anc"), lambda a: _item("i", sel, ordc, zero, a, src, null_s)),
        ).otherwise(F.array().cast(f"array<{_ITEM}>"))
        base.append(img_rows)
    items = rows.select("page_id", "url", F.explode(F.concat(*base)).alias("it")).select("page_id", "url", "it.*")
    items = items.repartition("page_id")

    if get_image:
        # pair every img with the html containers above it: same (page, ancestor id) partition
        w = Window.partitionBy("page_id", "node_key")
        conts = F.collect_list(F.when(F.col("kind") == "c", F.struct("sel", "ord", "text"))).over(w)
        items = items.withColumn("_conts", F.when(F.col("kind") == "i", conts))
        me = F.struct(*[F.col(c) for c in ("kind", "sel", "ord", "sub", "node_key", "value", "text")])
        paired = F.when(
            F.col("kind") == "i",
            F.transform(
                "_conts",
                lambda c: F.struct(
                    F.lit("img").alias("kind"), c["sel"].alias("sel"), c["ord"].alias("ord"),
                    F.col("ord").alias("sub"), F.col("node_key").alias("node_key"),
                    F.col("value").alias("value"), c["text"].alias("text"),
                ),
            ),
        ).when(F.col("kind") == "c", F.array().cast(f"array<{_ITEM}>")).otherwise(F.array(me))
        items = items.select("page_id", "url", F.explode(paired).alias("it")).select("page_id", "url", "it.*")

    per_page = items.groupBy("page_id").agg(
        F.first("url").alias("url"),
        F.collect_list(F.struct("sel", "ord", "sub", "kind", "value", "text")).alias("items"),
    )
    return per_page, sels, groups


def _of_kind(kind: str, sel: int | None = None) -> Column:
    def pred(x):
        c = x["kind"] == kind
        return c & (x["sel"] == sel) if sel is not None else c

    return F.array_sort(F.filter("items", pred))


def _links_of(group_sels: list[int]) -> Column:
    """O-22 … O-24 inside a page row: key, scheme filter, first-with-text per key, resolve, sort."""
    raw = F.filter("items", lambda x: (x["kind"] == "l") & x["sel"].isin(*group_sels))
    keyed = F.transform(
        raw,
        lambda x: F.struct(
            link_key(x["value"]).alias("key"), (x["text"] == "").alias("no_text"), x["sel"].alias("sel"),
            x["ord"].alias("ord"), x["value"].alias("href"), x["text"].alias("text"),
        ),
    )
    return F.array_sort(F.filter(keyed, lambda x: is_http(x["key"])))


def collect_content(
    pages: DataFrame,
    selectors,
    get_image: bool = True,
    replace_rules=None,
    black_words=None,
    explore=None,
    with_tail: bool = False,
    nodes: DataFrame | None = None,
) -> DataFrame:
    """O-19 per page: ``page_id, url, page_key, content MAP<STRING, ARRAY<STRING>>,
    media ARRAY<STRUCT<file_name, description, file_url>>,
    images ARRAY<STRUCT<file_name, caption, file_url>>, blocked BOOLEAN``
    and, with ``explore`` rules, one ``ARRAY<STRING>`` column of URLs per rule.

    ``binary`` selectors feed ``media`` and are not content keys; every other
    key is present even when empty. A page whose raw values of any key contain a
    black word is ``blocked`` (the reference returns nothing for it); values are
    refined after that check.
    """
    per_page, sels, groups = content_items(pages, selectors, get_image, explore, with_tail, nodes)
    words = normalise_words(black_words)
    keys, vals, blocked = [], [], F.lit(False)
    for i, s in enumerate(sels):
        if s.data_type == "binary":
            continue
        values = F.transform(
            F.filter(_of_kind("v", i), lambda x: x["value"] != ""), lambda x: x["value"]
        )
        keys.append(F.lit(s.key))
        vals.append(values)
        if words:
            blocked = blocked | contains_any(F.array_join(values, " "), words)
    content = (
        F.map_from_arrays(F.array(*keys), F.array(*[refine_array(v, replace_rules) for v in vals]))
        if keys
        else F.create_map().cast("map<string,array<string>>")
    )
    media = F.transform(
        _of_kind("m"),
        lambda x: F.struct(
            file_name(x["value"]).alias("file_name"), F.lit("").alias("description"),
            complete_url(F.col("url"), py_strip(x["value"])).alias("file_url"),
        ),
    )
    images = F.transform(
        _of_kind("img"),
        lambda x: F.struct(
            file_name(x["value"]).alias("file_name"), x["text"].alias("caption"),
            complete_url(F.col("url"), py_strip(x["value"])).alias("file_url"),
        ),
    )
    out = per_page.select(
        "page_id", "url", "items",
        page_key(F.col("url")).alias("page_key"),
        content.alias("content"),
        media.alias("media"),
        images.alias("images"),
        blocked.alias("blocked"),
    )
    # explore rules: links per rule, de-duplicated and sorted inside the page row
    offset = len(sels)
    for g, xs in groups:
        own = list(range(offset, offset + len(xs)))
        offset += len(xs)
        col = f"_l_{g}"
        out = out.withColumn(col, _links_of(own))
        firsts = F.filter(
            F.col(col),
            lambda x, i: (i == 0) | (F.element_at(F.col(col), F.greatest(i, F.lit(1)))["key"] != x["key"]),
        )
        resolved = F.transform(
            firsts,
            lambda x: F.struct(x["text"].alias("text"), complete_url(F.col("url"), x["href"]).alias("url"),
                               x["sel"].alias("sel"), x["ord"].alias("ord")),
        )
        out = out.withColumn(g, F.transform(F.array_sort(resolved), lambda x: x["url"])).drop(col)
    return out.drop("items")
