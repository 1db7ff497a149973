"""Crawl (O-30 … O-30f): depth-bounded two-kind traversal for many spiders at once.

Rules (D = crawl_depth; ``target`` and ``expand`` are tracked separately):

1. ``crawl_root`` puts the start URL in as a target at depth 0;
2. the start page's links enter at depth 1 (expand links only when D > 1);
3. a target at depth d: its target links enter at d+1 when d < D, its expand
   links when d < D-1;
4. an expand page at depth d: skipped when d >= D, else its target links enter
   at d+1 and its expand links too unless d+1 = D;
5. a URL enters once per kind, at its smallest depth.

Spark plan: spiders with the same rules and depth walk together. They are numbered, and a row
of the frontier or of the visited table stands for 64 of them: a walk (rule set, depth, word of
numbers), a kind, a URL, and a mask with a bit for each spider. The traversal is
level-synchronous: frontier ⋈ edges → depth rules → ``bit_or`` of the masks → without the bits
that the visited table has, gives the next level, so each spider enters a URL at its smallest
depth, and a URL that all reach costs a row per 64 spiders, not one each.

It touches only what a frontier asks for. At each level the (rule set, URL) pairs that may
still lead on and were not asked before are joined with the snapshot; only those pages are
parsed, each once, and only the rule sets that want a page are evaluated on it, in one walk
over its tree (rule sets are rows: neither the plan nor the driver grows with the number of
spiders). Every level is a written table in the shared checkpoint folder, so lost executors repeat at
most one level. Joins are plain equi-joins: a URL in many frontiers is a skewed key that
adaptive execution splits. The driver sees one row of observed counts per level, gathered by
the job that writes it; no job of its own asks whether the frontier is empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..functions.urls import complete_url, is_http, link_key, valid_url
from ..session import checkpoint_dir, ensure_shipped
from ..sources.pages import normalise_html, resolve_pages
from . import htmltree, structure
from .content import collect_content
from .links import link_xpaths
from .nodes import dealt, sliced
from .xpath import Unsupported

#: Rule sets evaluated on one page row; a page that more want comes in several rows.
RULES_PER_ROW = 500
RULE = "struct<rules_id:string,target_links:array<string>,expand_links:array<string>>"
_FOUND = "rules_id string, src_url string, kind string, sel int, node int, href string, text string"

#: A walk: spiders with one rule set and depth, 64 to a word.
WALK = ("rules_id", "crawl_depth", "word")
SPIDER_COLUMNS = ("spider_id", "url", "crawl_root", "target_links", "expand_links", "crawl_depth")


def spider_rules(spiders: DataFrame) -> DataFrame:
    """Spiders with the ``rules_id`` of their (target XPaths, expand XPaths): a hash, in
    which a null list is an empty one."""
    empty = F.array().cast("array<string>")
    both = F.struct(F.coalesce("target_links", empty).alias("t"), F.coalesce("expand_links", empty).alias("e"))
    return spiders.withColumn("rules_id", F.sha2(F.to_json(both), 256))


@lru_cache(maxsize=4096)
def _read(xpath: str) -> tuple | str:
    """The branches of a rule's XPath that select elements, or why it is not supported; none if invalid."""
    try:
        return tuple(b for b in structure.read(xpath) if b[3] is None)
    except Unsupported as exc:
        return f"{xpath!r}: {exc}"
    except (ValueError, IndexError):
        return ()


def page_finds(url: str, html: str, rules: list[dict]) -> Iterator[tuple]:
    """``rules_id, src_url, kind, sel, node, href, text`` of the links each rule finds on a page;
    kind ``rejected`` for an XPath that is valid but not supported. All rules go over one
    ``structure.Page``: what they have in common is walked once."""
    _, tree = htmltree.build(html)
    page = structure.Page(tree)
    links: dict[str, list | str] = {}
    for rule in rules:
        for kind in ("target", "expand"):
            for sel, xpath in enumerate(link_xpaths(rule[f"{kind}_links"])):
                if xpath not in links:
                    branches = _read(xpath)
                    links[xpath] = branches if isinstance(branches, str) else [
                        (n, tree.attrs[n]["href"], "".join(tree.lead[n]))
                        for n in sorted({n for b in branches for n in page.select(b)}) if tree.attrs[n].get("href")
                    ]
                got = links[xpath]
                if isinstance(got, str):
                    yield (rule["rules_id"], url, "rejected", sel, 0, xpath, got)
                    continue
                for node, href, text in got:
                    yield (rule["rules_id"], url, kind, sel, node, href, text)


def link_edges(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """O-30a: ``rules_id, src_url, kind, dst_url`` of the pages and rule sets in ``wanted``
    (``url, rules_id, target_links, expand_links``). A page is parsed once for all the
    rule sets that want it; pages nobody wants are not parsed, and a URL the snapshot
    lacks has no edges."""
    ensure_shipped(pages.sparkSession)
    rule = F.struct("rules_id", "target_links", "expand_links").cast(RULE)
    asked = wanted.select("url", rule.alias("rule")).distinct()
    nth = F.row_number().over(Window.partitionBy("url").orderBy("rule.rules_id"))
    chunk = F.floor((nth - 1) / RULES_PER_ROW)
    per_page = asked.withColumn("chunk", chunk).groupBy("url", "chunk").agg(F.collect_list("rule").alias("rules"))
    found = resolve_pages(per_page, pages).where("found").select("url", normalise_html(F.col("html")).alias("html"), "rules", F.xxhash64("url").alias("page_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _FOUND.split(", ")]
        types = [pa.int32() if c.endswith(" int") else pa.string() for c in _FOUND.split(", ")]
        rows: list[tuple] = []
        for b in sliced(batches):
            for url, html, rules in zip(*(b[c].to_pylist() for c in ("url", "html", "rules"))):
                for row in page_finds(url, html, rules):
                    rows.append(row)
                    if len(rows) >= 10_000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    links = dealt(found).select("url", "html", "rules").mapInArrow(run, _FOUND)
    href = py_strip(F.col("href"))
    refused = F.col("kind") == "rejected"
    keyed = links.withColumn("key", F.when(refused, F.col("href")).otherwise(link_key(href)))
    keyed = keyed.where(refused | is_http(F.col("key")))
    text = py_strip(F.coalesce("text", F.lit("")))
    first = Window.partitionBy("src_url", "rules_id", "kind", "key").orderBy((text == "").asc(), "sel", "node")
    kept = keyed.withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
    target = F.when(refused, F.col("href")).otherwise(complete_url(F.col("src_url"), href))
    return kept.select("rules_id", "src_url", "kind", target.alias("dst_url")).distinct()


def merge_frontier(candidates: DataFrame, visited: DataFrame | None) -> DataFrame:
    """O-30b: a (spider, kind, URL) enters once, at its smallest depth, valid URLs only (O-03);
    an expand link at exactly the depth limit never enters.

    Rows are masks of spiders: ``rules_id, crawl_depth, word, kind, url, depth, mask``, all
    ``candidates`` of one depth. What ``visited`` has of a key is taken out of the mask.
    """
    c = candidates.where(valid_url(F.col("url")))
    c = c.where(~((F.col("kind") == "expand") & (F.col("depth") == F.col("crawl_depth"))))
    new = c.groupBy(*WALK, "kind", "url").agg(F.min("depth").alias("depth"), F.bit_or("mask").alias("mask"))
    if visited is not None:
        seen = visited.groupBy(*WALK, "kind", "url").agg(F.bit_or("mask").alias("seen"))
        new = new.join(seen, [*WALK, "kind", "url"], "left").withColumn("mask", F.expr("mask & ~coalesce(seen, 0L)"))
    return new.where("mask != 0").select(*WALK, "kind", "url", "depth", "mask")


class _Crawl:
    """The tables of one crawl, in a folder of its own under the checkpoint folder."""

    def __init__(self, spark):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/gleaner-crawl-{uuid.uuid4().hex}"

    def add(self, name: str, level: int, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{name}/level={level}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self, name: str, like: DataFrame) -> DataFrame:
        """Every level of a table so far."""
        return self.spark.read.schema(like.schema).option("recursiveFileLookup", "true").parquet(f"{self.base}/{name}")


def walkers(spiders: DataFrame) -> DataFrame:
    """Spiders with their walk and their ``bit`` in its masks.

    Numbered within a rule set and depth. A spider id that stands with several starts or rules
    is a spider of each.
    """
    sp = spider_rules(spiders.select(*SPIDER_COLUMNS)).withColumn("crawl_depth", F.coalesce("crawl_depth", F.lit(1)))
    sp = sp.where(valid_url(F.col("url"))).dropDuplicates(["spider_id", "url", "rules_id", "crawl_depth"])
    number = F.row_number().over(Window.partitionBy("rules_id", "crawl_depth").orderBy("spider_id", "url")) - 1
    return sp.withColumn("word", F.floor(number / 64)).withColumn("bit", number % 64).withColumn("mask", F.expr("shiftleft(1L, bit)"))


def _entered(kind: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.bit_count("mask"))), F.lit(0)).alias(kind)


def crawl(spiders: DataFrame, pages: DataFrame, progress: Callable[[int, dict], None] | None = None) -> DataFrame:
    """O-30 / O-30c / O-30e: every spider's crawl, ``spider_id, kind, url, depth``.

    ``spiders``: ``spider_id, url, crawl_root, target_links, expand_links, crawl_depth``.
    ``pages``: the snapshot the crawl reads (``page_id, url, html``); a URL it does
    not hold is an empty page (O-02): no links, no error. ``progress`` is called after each
    level with its depth and the observed numbers of ``target`` and ``expand`` entries (O-30f).
    """
    run = _Crawl(spiders.sparkSession)
    sp = run.add("spiders", 0, walkers(spiders))
    rules = run.add("rules", 0, sp.select("rules_id", "target_links", "expand_links").dropDuplicates(["rules_id"]))
    limit = sp.agg(F.max("crawl_depth")).first()[0]

    def entry(who: DataFrame, kind: str) -> DataFrame:
        return who.groupBy(*WALK, F.lit(kind).alias("kind"), "url").agg(F.lit(0).alias("depth"), F.bit_or("mask").alias("mask"))

    def add(level: int, rows: DataFrame) -> tuple[DataFrame, dict]:
        entries = Observation()
        counted = rows.observe(entries, F.count(F.lit(1)).alias("rows"), _entered("target"), _entered("expand"))
        out, got = run.add("visited", level, counted), entries.get
        if progress:
            progress(level, {k: got[k] for k in ("target", "expand")})
        return out, got

    # rule 1: the root as a target at depth 0; rule 2 through a "start" row for each spider
    visited, _ = add(0, entry(sp.where(F.coalesce("crawl_root", F.lit(False))), "target"))
    frontier = entry(sp, "start").unionByName(visited)
    kind, lim, link = F.col("kind"), F.col("crawl_depth"), F.col("link")
    for level in range(1, (limit or 0) + 2):
        d = level - 1
        wanted = frontier.where((kind == "start") | (d < lim)).select("rules_id", "url").distinct()
        if level > 1:
            wanted = wanted.join(run.all("asked", asked), ["rules_id", "url"], "left_anti")
        asked = run.add("asked", level, wanted)
        found_edges = run.add("edges", level, link_edges(pages, asked.join(rules, "rules_id")))
        edges = run.all("edges", found_edges).select("rules_id", F.col("kind").alias("link"), F.col("src_url").alias("url"), "dst_url")
        from_start = (kind == "start") & ((link == "target") | ((link == "expand") & (lim != 1)))
        from_target = (kind == "target") & (d < lim) & ((link == "target") | ((link == "expand") & (d < lim - 1)))
        from_expand = (kind == "expand") & (d < lim) & ((link == "target") | ((link == "expand") & (d + 1 < lim)))
        found = frontier.join(edges, ["rules_id", "url"]).where(from_start | from_target | from_expand)
        found = found.select(*WALK, link.alias("kind"), F.col("dst_url").alias("url"), F.lit(level).alias("depth"), "mask")
        frontier, entries = add(level, merge_frontier(found, run.all("visited", visited)))
        if not entries["rows"]:
            break
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("bit_get", "mask", b) == 1)
    each = run.all("visited", visited).select(*WALK, F.explode(bits).alias("bit"), "kind", "url", "depth")
    named = each.join(sp.select(*WALK, "bit", "spider_id"), [*WALK, "bit"])
    return named.groupBy("spider_id", "kind", "url").agg(F.min("depth").cast("int").alias("depth"))


def crawl_stats(crawled: DataFrame) -> DataFrame:
    """O-30f: number of targets and expansions found, per spider, kind and depth."""
    return crawled.groupBy("spider_id", "kind", "depth").agg(F.count("*").alias("n"))


def crawl_content(crawled: DataFrame, pages: DataFrame, selectors, **content_options) -> DataFrame:
    """O-30d: content of every crawled target — ``spider_id, url, depth, page_key, content``.

    Each distinct target URL is resolved (O-02, missing → empty page) and
    collected once, however many spiders reached it, then joined back.
    """
    targets = crawled.where(F.col("kind") == "target")
    # pages the snapshot lacks have no id of their own: hash their URL
    resolved = resolve_pages(targets.select("url").distinct(), pages).select(
        F.coalesce("page_id", F.xxhash64("url")).alias("page_id"), "url", "html"
    )
    rec = collect_content(resolved, selectors, **content_options)
    rec = rec.where(~F.col("blocked")).select("url", "page_key", "content", "media", "images")
    return targets.join(rec, "url").select("spider_id", "url", "depth", "page_key", "content", "media", "images")
