"""XPath compiler vs a brute-force evaluator over the parsed tree (random documents and paths)."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.operators import htmltree
from gleaner.operators.select import match_rows, nodes_for
from gleaner.sources.pages import read_pages_from

TAGS = ["div", "span", "a", "em"]
CLASSES = ["x", "y"]


@st.composite
def documents(draw, depth=0):
    n = draw(st.integers(0, 3 if depth < 3 else 0))
    parts = []
    for _ in range(n):
        tag = draw(st.sampled_from(TAGS))
        cls = draw(st.sampled_from([None] + CLASSES))
        attr = f' class="{cls}"' if cls else ""
        parts.append(f"<{tag}{attr}>t{draw(documents(depth + 1))}</{tag}>")
    return "".join(parts)


@st.composite
def xpaths(draw):
    steps = []
    for _ in range(draw(st.integers(1, 3))):
        axis = draw(st.sampled_from(["/", "//"]))
        tag = draw(st.sampled_from(TAGS + ["*"]))
        pred = draw(st.sampled_from(["", "[1]", "[2]", "[last()]", "[@class='x']", "[@class]", "[not(@class)]"]))
        steps.append(axis + tag + pred)
    path = "/html/body" + "".join(steps) if draw(st.booleans()) else "".join(steps)
    if draw(st.booleans()):
        return f"({path})[{draw(st.integers(1, 3))}]"
    if draw(st.booleans()):
        return path + " | //em"
    return path


def evaluate(b, xpath):
    """Node ids selected by ``xpath`` (the generated grammar only), by walking the tree."""
    kids = {i: [] for i in range(len(b.tag))}
    for i, p in enumerate(b.parent):
        if p >= 0:
            kids[p].append(i)

    def desc(i):
        out = []
        for k in kids[i]:
            out.append(k)
            out.extend(desc(k))
        return out

    def step_sel(ctx, axis, tag, pred):
        out = set()
        for c in ctx:
            parents = [c] if axis == "/" else ([c] + (desc(c) if c >= 0 else list(range(len(b.tag)))))
            for par in parents:
                cand = [k for k in (kids[par] if par >= 0 else [0]) if tag == "*" or b.tag[k] == tag]
                for pos, k in enumerate(cand, start=1):
                    cls = b.attrs[k].get("class")
                    ok = {
                        "": True, "[1]": pos == 1, "[2]": pos == 2, "[last()]": pos == len(cand),
                        "[@class='x']": cls == "x", "[@class]": cls is not None, "[not(@class)]": cls is None,
                    }[pred]
                    if ok:
                        out.add(k)
        return out

    import re

    def path_sel(path):
        ctx = {-1}
        for axis, tag, pred in re.findall(r"(//|/)([a-z*]+)(\[[^\]]*\])?", path):
            ctx = step_sel(ctx, axis, tag, pred or "")
        return ctx

    m = re.fullmatch(r"\((.*)\)\[(\d+)\]", xpath)
    if m:
        got = sorted(path_sel(m.group(1)))
        n = int(m.group(2))
        return set(got[n - 1 : n])
    out = set()
    for part in xpath.split(" | "):
        out |= path_sel(part)
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(documents(), min_size=1, max_size=4), st.lists(xpaths(), min_size=1, max_size=20))
def test_xpath_matches_brute_force(spark, docs, xps):
    html = [f"<html><body>{d}</body></html>" for d in docs]
    pages = read_pages_from(spark.createDataFrame(
        [(i, "http://t/", h) for i, h in enumerate(html)], "page_id bigint, url string, html string"))
    rows = match_rows(nodes_for(pages, xps, content=False), xps).select("page_id", "sel", "node_id").collect()
    got = {}
    for r in rows:
        got.setdefault((r.page_id, r.sel), set()).add(r.node_id)
    for i, h in enumerate(html):
        _, b = htmltree.build(h)
        for k, xp in enumerate(xps):
            assert got.get((i, k), set()) == evaluate(b, xp), (h, xp)
