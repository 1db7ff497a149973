"""Structural XPaths: against fixed results, and against a walk by the definitions of the axes."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from test_xpath_bruteforce import documents

from gleaner.operators import htmltree, structure
from gleaner.operators.select import match_rows, nodes_for, select_values
from gleaner.sources.pages import read_pages_from

PAGE = (
    "<div id='a'><h2>One</h2><p>first <b>bold</b> rest</p><p class='n'>second</p></div>"
    "<div id='b'><p>third</p><div id='c'><h2>Two</h2><a href='/x'>link x</a><a href='/y'>y</a></div></div>"
    "<ul><li>1</li><li class='k'>2</li><li>3</li></ul>"
)


def pages(spark, *html):
    return read_pages_from(spark.createDataFrame([(i, "http://t/", h) for i, h in enumerate(html)], "page_id bigint, url string, html string"))


def values(spark, xpath):
    return [r["value"] for r in select_values(pages(spark, PAGE), xpath, "text").orderBy("ord").collect()]


def test_fixed_results(spark):
    cases = {
        "//div[h2]/@id": ["a", "c"],
        "//div[.//h2]/@id": ["a", "b", "c"],
        "//div[not(h2)]/@id": ["b"],
        "//h2/..//@href": ["/x", "/y"],
        "//h2/following-sibling::p": ["first bold rest", "second"],
        "//p[preceding-sibling::h2][2]": ["second"],
        "(//div)[2]/p": ["third"],
        "(//div)[2]//a[2]/@href": ["/y"],
        "//div[contains(text(), 'x')]/a": [],
        "//a[contains(text(), 'x')]/../h2": ["Two"],
        "//p[b = 'bold']/text()": ["first ", " rest"],
        "//li[@class='k']/preceding-sibling::li": ["1"],
        "//li[count(following-sibling::li) >= 1]": ["1", "2"],
        "//a[@href='/y' and ../h2 = 'Two']": ["y"],
        "//b/ancestor::div/@id": ["a"],
        "//b/following::h2": ["Two"],
        "//h2[preceding::b]": ["Two"],
        "//div[h2]/p[last()] | //li[2]": ["second", "2"],
        "//*[self::h2 or self::b]": ["One", "bold", "Two"],
        "//ul/li[position() > 1][1]/text()": ["2"],
        "//p[normalize-space(b) = 'bold']/b": ["bold"],
        "//div[p[b]]/h2": ["One"],
        "//div[//ul]/h2": ["One", "Two"],
        "//li[. > 1]": ["2", "3"],
        "descendant::li[starts-with(., '3')]": ["3"],
    }
    for xpath, want in cases.items():
        assert values(spark, xpath) == want, xpath


def test_plain_and_structural_selectors_in_one_parse(spark):
    xps = ["//p", "//div[h2]", "//li/..", "//h2/following-sibling::p"]
    rows = match_rows(nodes_for(pages(spark, PAGE, "<p>x</p>"), xps), xps)
    got = {(r["page_id"], r["sel"]): r["count"] for r in rows.groupBy("page_id", "sel").count().collect()}
    assert got == {(0, 0): 3, (0, 1): 2, (0, 2): 1, (0, 3): 2, (1, 0): 1}
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_common_beginnings_are_walked_once(monkeypatch):
    page = structure.Page(htmltree.build(PAGE)[1])
    steps = []
    step = structure.Page.step
    monkeypatch.setattr(structure.Page, "step", lambda self, s, here: steps.append(s) or step(self, s, here))
    for k in range(1000):
        page.select(structure.read(f"//div[@id='b']//a[@href='/{k}']")[0])
    assert len(steps) == 1001
    assert page.select(structure.read("//div[@id='b']//a[@href='/x']")[0]) == page.valued("href")["/x"]


def test_deep_nesting_takes_linear_time():
    tree = htmltree.build("<i>" * 100_000 + "<a href='/x'>y</a>")[1]
    page = structure.Page(tree)
    assert len(page.select(structure.read("//i[.//a]")[0])) == 100_000
    assert len(page.select(structure.read("//i//i[i or a]//a")[0])) == 1
    assert len(page.select(structure.read("//a/ancestor::i/i")[0])) == 99_999


AXES = ["child", "descendant", "descendant-or-self", "parent", "ancestor", "ancestor-or-self", "self",
        "following-sibling", "preceding-sibling", "following", "preceding"]
TESTS = ["div", "span", "a", "em", "*"]


@st.composite
def steps(draw, depth=0):
    out = []
    for _ in range(draw(st.integers(1, 3 if depth == 0 else 2))):
        pred = draw(st.sampled_from(["none", "none", "number", "last", "attr", "value", "path", "not path"]))
        own = draw(steps(depth + 1)) if "path" in pred and depth < 2 else draw(st.integers(1, 2))
        out.append((draw(st.sampled_from(AXES)), draw(st.sampled_from(TESTS)), pred if depth < 2 or "path" not in pred else "none", own))
    return out


def shown(path):
    parts = []
    for axis, test, pred, own in path:
        text = {"none": "", "number": f"[{own}]", "last": "[last()]", "attr": "[@class]", "value": "[@class='x']"}.get(pred)
        if text is None:
            text = f"[{shown(own)}]" if pred == "path" else f"[not({shown(own)})]"
        parts.append(f"{axis}::{test}{text}")
    return "/".join(parts)


def walked(t, path, n):
    """Elements of a relative path from ``n`` (-1: the document), one context element at a time."""
    size = len(t.tag)

    def inside(k, m):
        return m == -1 or m < k <= t.end[m]

    lists = {
        "child": lambda n: [k for k in range(size) if (t.parent[k] if t.parent[k] >= 0 else -1) == n],
        "descendant": lambda n: [k for k in range(size) if inside(k, n)],
        "descendant-or-self": lambda n: [k for k in range(size) if k == n or inside(k, n)],
        "parent": lambda n: [t.parent[n]] if n >= 0 and t.parent[n] >= 0 else [],
        "ancestor": lambda n: [k for k in range(size - 1, -1, -1) if n >= 0 and inside(n, k)],
        "ancestor-or-self": lambda n: [k for k in range(size - 1, -1, -1) if n >= 0 and (k == n or inside(n, k))],
        "self": lambda n: [n] if n >= 0 else [],
        "following-sibling": lambda n: [k for k in range(size) if n >= 0 and t.parent[k] == t.parent[n] and k > n],
        "preceding-sibling": lambda n: [k for k in range(size - 1, -1, -1) if n >= 0 and t.parent[k] == t.parent[n] and k < n],
        "following": lambda n: [k for k in range(size) if n >= 0 and k > t.end[n]],
        "preceding": lambda n: [k for k in range(size - 1, -1, -1) if n >= 0 and k < n and not inside(n, k)],
    }
    here = [n]
    for axis, test, pred, own in path:
        out = set()
        for m in here:
            found = [k for k in lists[axis](m) if test in ("*", t.tag[k])]
            for at, k in enumerate(found, 1):
                cls = t.attrs[k].get("class")
                ok = {"none": True, "number": at == own, "last": at == len(found), "attr": cls is not None, "value": cls == "x"}.get(pred)
                if ok is None:
                    ok = bool(walked(t, own, k)) == (pred == "path")
                if ok:
                    out.add(k)
        here = sorted(out)
    return here


@settings(max_examples=400, deadline=None)
@given(documents(), st.lists(steps(), min_size=1, max_size=6))
def test_joins_match_the_walk(doc, paths):
    tree = htmltree.build(f"<html><body>{doc}</body></html>")[1]
    page = structure.Page(tree)
    for path in paths:
        (read,) = structure.read(shown(path))
        assert page.select(read) == walked(tree, path, -1), shown(path)
