"""O-30 crawl: levels, depths, rules per spider, and what is parsed."""

from __future__ import annotations

import random
from collections import Counter

from fixtures import EXPAND, TARGET
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.operators import crawl as crawl_module
from gleaner.operators.crawl import crawl, crawl_content, crawl_stats, link_edges, spider_rules

SPIDER_SCHEMA = (
    "spider_id bigint, url string, crawl_root boolean, target_links array<string>, "
    "expand_links array<string>, crawl_depth int"
)
PAGE_SCHEMA = "page_id bigint, url string, html string"


def url(i):
    return f"http://g.test/n{i}"


def shortest(targets, expands, root, limit, crawl_root):
    """Least depth of every (kind, page), by relaxing the stated rules until nothing changes.

    A page may be entered from a page of kind k at depth d: as a target if d < limit, as an
    expansion if one more level remains below it.
    """
    depth = {("target", root): 0} if crawl_root else {}

    def offers():
        for page in targets.get(root, ()):
            yield ("target", page), 1
        for page in expands.get(root, ()) if limit != 1 else ():
            yield ("expand", page), 1
        for (_, page), d in list(depth.items()):
            if d < limit:
                yield from ((("target", x), d + 1) for x in targets.get(page, ()))
            if d + 1 < limit:
                yield from ((("expand", x), d + 1) for x in expands.get(page, ()))

    while any(d < depth.get(key, d + 1) for key, d in offers()):
        for key, d in offers():
            depth[key] = min(d, depth.get(key, d))
    return {(kind, page, d) for (kind, page), d in depth.items()}


def web(spark, n, targets, expands):
    rows = []
    for i in range(n):
        links = [f'<a class="t" href="{x}">t</a>' for x in targets.get(url(i), ())]
        links += [f'<a class="e" href="{x}">e</a>' for x in expands.get(url(i), ())]
        rows.append((i, url(i), f"<p>{''.join(links)}</p>"))
    return spark.createDataFrame(rows, PAGE_SCHEMA)


pairs = lambda n, k: st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=k * n)
graphs = st.integers(3, 9).flatmap(
    lambda n: st.tuples(
        st.just(n), pairs(n, 3), pairs(n, 2),
        st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, 4), st.booleans()), min_size=1, max_size=4),
    )
)


@settings(max_examples=4, deadline=None)
@given(graphs)
def test_depths_are_the_shortest(spark, graph):
    n, target_links, expand_links, starts = graph
    targets, expands = ({url(a): sorted({url(y) for x, y in links if x == a}) for a in range(n)} for links in (target_links, expand_links))
    # every spider has rules of its own
    spiders = spark.createDataFrame(
        [(i, url(r), root, [f"//a[@class='t' and not(@x='{i}')]"], [f"//a[@class='e' and not(@x='{i}')]"], d) for i, (r, d, root) in enumerate(starts)],
        SPIDER_SCHEMA,
    )
    got = crawl(spiders, web(spark, n, targets, expands)).collect()
    for i, (r, d, root) in enumerate(starts):
        assert {(x.kind, x.url, x.depth) for x in got if x.spider_id == i} == shortest(targets, expands, url(r), d, root)


def spiders(spark, depth, crawl_root=False):
    return spark.createDataFrame([(1, "http://blog.test/", crawl_root, [TARGET], [EXPAND], depth)], SPIDER_SCHEMA)


def test_html_crawl_depths(spark, pages):
    d1 = crawl(spiders(spark, 1), pages).collect()
    assert sorted(r.url for r in d1 if r.kind == "target") == [
        "http://blog.test/posts/first", "http://blog.test/posts/second", "http://blog.test/posts/third"
    ]
    assert [r for r in d1 if r.kind == "expand"] == []
    d2 = crawl(spiders(spark, 2), pages).collect()
    targets = sorted((r.url, r.depth) for r in d2 if r.kind == "target")
    assert len(targets) == 5
    assert ("http://blog.test/posts/fourth", 2) in targets and ("http://blog.test/posts/fifth", 2) in targets
    assert [(r.url, r.depth) for r in d2 if r.kind == "expand"] == [("http://blog.test/page/2", 1)]
    root = crawl(spiders(spark, 1, crawl_root=True), pages).collect()
    assert ("target", "http://blog.test/", 0) in {(r.kind, r.url, r.depth) for r in root}
    d0 = crawl(spiders(spark, 0), pages).collect()
    assert len([r for r in d0 if r.kind == "target"]) == 3


def test_crawl_content_and_stats(spark, pages):
    got = crawl(spiders(spark, 2), pages)
    stats = {(r.kind, r.depth): r.n for r in crawl_stats(got).collect()}
    assert stats == {("target", 1): 3, ("target", 2): 2, ("expand", 1): 1}
    rec = crawl_content(got, pages, {"title": ("//title", "text")}).collect()
    titles = {r.url: r.content["title"] for r in rec}
    assert titles["http://blog.test/posts/first"] == ["First post"]
    assert titles["http://blog.test/posts/fourth"] == []  # not in the snapshot: empty page
    assert len(rec) == 5 and all(r.page_key.endswith("-blog.test") for r in rec)


def test_missing_and_empty_rule_lists_are_the_same(spark, pages):
    both = spark.createDataFrame(
        [(1, "http://blog.test/", False, [TARGET], None, 2), (2, "http://blog.test/", False, [TARGET], [], 2)], SPIDER_SCHEMA
    )
    assert spider_rules(both).select("rules_id").distinct().count() == 1
    rows = [tuple(r) for r in crawl(both, pages).collect()]
    assert len(rows) == len(set(rows)) and {r[1:] for r in rows if r[0] == 1} == {r[1:] for r in rows if r[0] == 2}


def test_pages_nobody_reaches_are_not_parsed(spark, pages, monkeypatch):
    asked = []
    real = crawl_module.link_edges

    def watched(snapshot, wanted):
        asked.extend(r.url for r in wanted.select("url").collect())
        return real(snapshot, wanted)

    monkeypatch.setattr(crawl_module, "link_edges", watched)
    crawl(spiders(spark, 1), pages).collect()
    assert asked == ["http://blog.test/"]


def test_many_rule_sets_on_one_page(spark, monkeypatch):
    monkeypatch.setattr(crawl_module, "RULES_PER_ROW", 7)
    page = spark.createDataFrame([(1, url(1), "".join(f'<a id="k{i}" href="/{i}">x</a>' for i in range(60)))], PAGE_SCHEMA)
    many = spark.createDataFrame([(i, url(1), False, [f"//a[@id='k{i}']"], ["//b"], 1) for i in range(60)], SPIDER_SCHEMA)
    wanted = spider_rules(many)
    edges = link_edges(page, wanted).join(wanted.select("rules_id", "spider_id"), "rules_id").collect()
    assert {(r.spider_id, r.dst_url) for r in edges} == {(i, f"http://g.test/{i}") for i in range(60)}


def test_unsupported_rules_are_rejected_and_seen(spark, pages):
    sp = spark.createDataFrame([(1, "http://blog.test/", False, ["//a[1 + 1]"], ["//["], 1)], SPIDER_SCHEMA)
    edges = link_edges(pages, spider_rules(sp)).collect()
    assert [(r.kind, r.dst_url) for r in edges] == [("rejected", "//a[1 + 1]")]
    assert crawl(sp, pages).count() == 0


def test_spiders_with_the_same_rules_walk_together(spark):
    """Hundreds of spiders, three rule sets, different starts and depths, against a walk per spider."""
    rng = random.Random(4)
    out = {i: rng.sample(range(40), 3) for i in range(40)}
    pages = spark.createDataFrame(
        [(i, url(i), "".join(f'<a class="{"te"[k % 2]}" href="{url(k)}">{k}</a>' for k in ks)) for i, ks in out.items()], PAGE_SCHEMA
    )
    kinds = [(["//a[@class='t']"], ["//a[@class='e']"]), (["//a"], ["//b"]), (["//b"], ["//a"])]
    rows = [(i, url(rng.randrange(40)), i % 5 == 0, *kinds[i % 3], rng.choice([1, 2, 3])) for i in range(300)]
    levels = []
    got = crawl(spark.createDataFrame(rows, SPIDER_SCHEMA), pages, lambda level, n: levels.append((level, n))).collect()
    want = {}
    for i, start, root, t, e, limit in rows:
        links = {
            "target": {k: [x for x in ks if t == ["//a"] or (t != ["//b"] and x % 2 == 0)] for k, ks in out.items()},
            "expand": {k: [x for x in ks if e == ["//a"] or (e != ["//b"] and x % 2 == 1)] for k, ks in out.items()},
        }
        first = next(k for k in out if url(k) == start)
        here, depth = {("start", first)}, 0
        seen = {("target", first): 0} if root else {}
        here |= set(seen)
        while here:
            depth, new = depth + 1, set()
            for kind, k in here:
                d = depth - 1
                if kind != "start" and d >= limit:
                    continue
                new |= {("target", x) for x in links["target"][k]}
                more = {"start": limit > 1, "target": d < limit - 1, "expand": d + 1 < limit}[kind]
                new |= {("expand", x) for x in links["expand"][k]} if more and depth != limit else set()
            here = new - set(seen)
            seen |= dict.fromkeys(here, depth)
        want |= {(i, kind, url(k)): d for (kind, k), d in seen.items()}
    assert {(r.spider_id, r.kind, r.url): r.depth for r in got} == want and len(got) == len(want)
    # what each level observed is what the result holds
    counts = Counter((r.depth, r.kind) for r in got)
    assert {(level, k): n for level, row in levels for k, n in row.items() if n} == dict(counts)
