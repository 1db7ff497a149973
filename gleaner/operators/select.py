"""Selection over the ``nodes`` table (O-08 … O-14, O-16, O-17, O-19).

All selectors of a request are evaluated in **one** scan of the nodes: every
node row gets the array of selectors it satisfies and is exploded on it. Only
selectors with a page-global position ``(…)[n]`` or a ``tbody`` fallback need
a window; those windows are keyed by ``page_id`` and share one exchange, and
run only on the (small) matched rows. Everything else is a narrow filter.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from .nodes import parse_nodes
from .xpath import XPath, branch_match, branch_parent_match, compile_xpath, global_keep

log = logging.getLogger(__name__)

DATA_TYPES = ("text", "html", "binary")


@dataclass(frozen=True)
class Selector:
    key: str
    xpath: str
    data_type: str = "html"  # O-13: a bare XPath means html


def as_selectors(spec) -> list[Selector]:
    """Selectors from ``{key: xpath | (xpath, data_type)}`` or ``[(key, xpath[, type])]``."""
    if isinstance(spec, dict):
        items = [(k, v) for k, v in spec.items()]
        out = []
        for k, v in items:
            if isinstance(v, str):
                out.append(Selector(k, v, "html"))
            else:
                out.append(Selector(k, v[0], v[1] if len(v) > 1 and v[1] else "html"))
        return out
    out = []
    for s in spec:
        if isinstance(s, Selector):
            out.append(s)
        else:
            out.append(Selector(s[0], s[1], s[2] if len(s) > 2 and s[2] else "html"))
    return out


def _compiled(xpaths: Iterable[str]) -> list[XPath | None]:
    out = []
    for x in xpaths:
        xp = compile_xpath(x)
        if xp is None:
            log.warning("selector %r yields no rows (invalid XPath)", x)
        out.append(xp)
    return out


def parse_options(xpaths: Iterable[str], content: bool = True, extra_attrs: Iterable[str] = (), extra_tags=()) -> dict:
    """Pruned ``parse_nodes`` options for a set of XPaths (and their tbody fallbacks):
    the attributes they name, ``text``/``markup`` for the tags they can return
    (when ``content``, or when a predicate reads ``.``), ``path`` for the tags a
    multi-step path can end on, the XPaths to evaluate in the parse, and the tags that need rows."""
    attrs, tags, path_tags, text_tags, structural = set(extra_attrs), set(extra_tags), set(), set(), set()
    row_tags: set = set(extra_tags)
    any_tag = any_path = any_text = any_row = False
    for top in _compiled(xpaths):
        if top is None:
            continue
        for xp in (top, top.fallback()):
            if xp is None:
                continue
            attrs |= xp.attr_names
            if xp.structural:
                structural.add(xp.source)
            if xp.row_tags is None:
                any_row = True
            else:
                row_tags |= xp.row_tags
            last = xp.last_tags
            if content or xp.needs_text:
                if last is None:
                    any_tag = True
                else:
                    tags |= last
            if xp.needs_path:
                if last is None:
                    any_path = True
                else:
                    path_tags |= last
            if xp.needs_texts:
                if last is None:
                    any_text = True
                else:
                    text_tags |= last
    return {
        "attrs": attrs,
        "content_tags": None if any_tag else tags,
        "path_tags": None if any_path else path_tags,
        "text_tags": None if any_text else text_tags,
        "xpaths": sorted(structural),
        "row_tags": None if any_row else row_tags,
    }


def nodes_for(pages: DataFrame, xpaths: Iterable[str], content: bool = True, extra_attrs=(), extra_tags=()) -> DataFrame:
    """O-07 with exactly the columns the given XPaths need."""
    return parse_nodes(pages, **parse_options(list(xpaths), content, extra_attrs, extra_tags))


def match_rows(nodes: DataFrame, xpaths: list[str], with_ancestors: bool = False) -> DataFrame:
    """Rows selected by each XPath (``sel`` = index into ``xpaths``).

    Columns: ``page_id, url, sel, node_id`` (the element, or the owner of a
    text node), ``ord`` (document order of the result), ``is_string``,
    ``value`` (string results), and the element's ``tag, attrs, end_id,
    lead_text, text, markup`` (+ ``anc``, the ancestor ids, on request).
    """
    entries = []
    for k, xp in enumerate(_compiled(xpaths)):
        if xp is None:
            continue
        entries.append((k, 0, xp))
        fb = xp.fallback()
        if fb is not None:
            entries.append((k, 1, fb))
    if not entries:
        return nodes.limit(0).select(*_empty_columns(with_ancestors))

    hit = lambda k, f, part, t: F.struct(
        F.lit(k).alias("sel"), F.lit(f).alias("fb"), F.lit(part).alias("part"), F.lit(t).alias("term")
    )
    hits, terms = [], {}
    for k, f, xp in entries:
        by_term: dict = {}
        for b in xp.branches:
            by_term.setdefault(b.terminal, []).append(b)
        terms[(k, f)] = list(by_term)
        for t, (term, bs) in enumerate(by_term.items()):
            # branches with the same result kind form one hit: a node matched twice counts once
            hits.append(F.when(reduce(lambda a, c: a | c, [branch_match(b) for b in bs]), hit(k, f, 0, t)))
            if term == ("text",):
                hits.append(F.when(reduce(lambda a, c: a | c, [branch_parent_match(b) for b in bs]), hit(k, f, 1, t)))
    anc = (
        [F.transform(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), lambda p: p["id"]).alias("anc")]
        if with_ancestors
        else []
    )
    rows = nodes.select(
        "page_id", "url", "node_id", "parent_id", "depth", "tag", "attrs", "end_id", "lead_text", "tail", "text", "markup",
        *anc,
        F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h"),
    )
    sel, fb, part, term_c = F.col("h.sel"), F.col("h.fb"), F.col("h.part"), F.col("h.term")

    value = F.lit(None).cast("string")
    is_string = F.lit(False)
    is_textnode = F.lit(False)
    for (k, f), ts in terms.items():
        for t, term in enumerate(ts):
            if term is None:
                continue
            this = (sel == k) & (fb == f) & (term_c == t)
            if term[0] == "attr":
                v = F.col("attrs").getItem(term[1])
            else:
                v = F.when(part == 1, F.col("tail")).otherwise(F.col("lead_text"))
                is_textnode = F.when(this, F.lit(True)).otherwise(is_textnode)
            value = F.when(this, v).otherwise(value)
            is_string = F.when(this, F.lit(True)).otherwise(is_string)
    owner = F.when(part == 1, F.col("parent_id")).otherwise(F.col("node_id"))
    # document order: an element at its start, the text after it behind everything it holds
    # (of elements that end together the inner one's text first)
    unit = 1 << 20
    after = (F.col("end_id").cast("long") * 2 + 1) * unit + (unit - 1 - F.least("depth", F.lit(unit - 1)))
    place = F.when(part == 1, after).otherwise(F.col("node_id").cast("long") * 2 * unit)
    rows = rows.select(
        "page_id", "url", sel.alias("sel"), fb.alias("fb"), owner.alias("node_id"), F.col("parent_id").alias("_parent"),
        place.alias("ord"),
        is_string.alias("is_string"), value.alias("value"), is_textnode.alias("_tn"),
        "tag", "attrs", "end_id", "lead_text", "tail", "text", "markup", *(["anc"] if with_ancestors else []),
    )
    positional = [(k, f, xp.global_pred) for k, f, xp in entries if xp.global_pred is not None]
    local = [(k, f, xp.local_pred) for k, f, xp in entries if xp.local_pred is not None]
    with_fallback = any(f == 1 for _, f, _ in entries)
    if positional or local or with_fallback:
        rows = rows.repartition("page_id")
    for preds, scope in ((local, ["page_id", "sel", "fb", "_parent"]), (positional, ["page_id", "sel", "fb"])):
        if not preds:
            continue
        whole = Window.partitionBy(*scope)
        rows = rows.withColumn("_rk", F.dense_rank().over(whole.orderBy("node_id")))
        rows = rows.withColumn("_cnt", F.max("_rk").over(whole))
        keep = F.lit(True)
        for k, f, pred in preds:
            this = (F.col("sel") == k) & (F.col("fb") == f)
            keep = F.when(this, global_keep(pred, F.col("_rk"), F.col("_cnt"))).otherwise(keep)
        rows = rows.where(keep).drop("_rk", "_cnt")
    # attribute results exist only where the attribute does; text nodes only when non-empty
    # (after positions: (//img)[1]/@src is the first img's src, if it has one)
    rows = rows.where(
        ~F.col("is_string") | (F.col("value").isNotNull() & (~F.col("_tn") | (F.length("value") > 0)))
    ).drop("_tn")
    if with_fallback:
        w = Window.partitionBy("page_id", "sel")
        has_primary = F.max(F.when(F.col("fb") == 0, 1).otherwise(0)).over(w)
        rows = rows.withColumn("_hp", has_primary).where((F.col("fb") == 0) | (F.col("_hp") == 0)).drop("_hp")
    return rows.drop("fb", "_parent")


def _empty_columns(with_ancestors: bool = False) -> list:
    anc = [F.array().cast("array<int>").alias("anc")] if with_ancestors else []
    return [
        "page_id", "url", F.lit(0).alias("sel"), "node_id", F.lit(0).cast("long").alias("ord"),
        F.lit(False).alias("is_string"), F.lit(None).cast("string").alias("value"),
        "tag", "attrs", "end_id", "lead_text", "tail", "text", "markup", *anc,
    ]


def content_value(data_type, with_tail: bool = False) -> Column:
    """O-10/O-11/O-12: value of a selected row for a data type (text/html).

    String results pass through unstripped; elements give their stripped
    subtree text (``text``) or stripped source markup (``html``). With
    ``with_tail`` the text after the element up to its next sibling is part of
    the value, as a serialiser that emits tails produces it.
    """
    dt = data_type if isinstance(data_type, Column) else F.lit(data_type)
    tail = F.coalesce(F.col("tail"), F.lit("")) if with_tail else F.lit("")
    return (
        F.when(F.col("is_string"), F.col("value"))
        .when(dt == "text", py_strip(F.concat(F.col("text"), tail)))
        .otherwise(py_strip(F.concat(F.col("markup"), tail)))
    )


def select_values(pages: DataFrame, xpath: str, data_type: str = "html", nodes: DataFrame | None = None,
                  with_tail: bool = False) -> DataFrame:
    """Values of one XPath on every page, empties dropped: ``page_id, ord, value``."""
    nodes = nodes if nodes is not None else nodes_for(pages, [xpath])
    rows = match_rows(nodes, [xpath])
    v = content_value(data_type, with_tail)
    return rows.select("page_id", "ord", v.alias("value")).where(F.col("value") != "")
