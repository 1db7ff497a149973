"""O-20 … O-26 links, O-16/O-17/O-19/O-27/O-28/O-29 content record."""

from __future__ import annotations

from fixtures import EXPAND, LIST0_LINKS, TARGET
from pyspark.sql import functions as F

from gleaner.operators.content import collect_content
from gleaner.operators.links import explore_links, page_links


def test_page_links_fixture(pages):
    got = page_links(pages.where("page_id = 0")).orderBy("link_rank").collect()
    assert [(r.text, r.url) for r in got] == LIST0_LINKS
    assert [r.link_rank for r in got] == list(range(1, len(LIST0_LINKS) + 1))


def test_page_links_all_pages_and_bad_pages(pages):
    got = page_links(pages).groupBy("page_id").count().collect()
    counts = {r.page_id: r["count"] for r in got}
    assert counts[0] == len(LIST0_LINKS)
    assert 5 not in counts and 6 not in counts and 7 not in counts  # null, empty, plain text pages: no links


def test_multi_xpath_and_default(spark, pages):
    both = page_links(pages.where("page_id = 0"), [TARGET, EXPAND]).collect()
    assert sorted(r.text for r in both) == ["First post", "Older posts", "Second post", "Third post"]
    assert page_links(pages.where("page_id = 0"), []).count() == len(LIST0_LINKS)


def test_make_root(spark):
    from gleaner.sources.pages import read_pages_from

    p = read_pages_from(spark.createDataFrame([(1, "http://h.test/a/b", '<a href="x/y">t</a>')],
                                              "page_id bigint, url string, html string"))
    assert [r.url for r in page_links(p).collect()] == ["http://h.test/a/x/y"]
    assert [r.url for r in page_links(p, make_root=True).collect()] == ["http://h.test/x/y"]


def test_explore_links(pages):
    got = explore_links(pages.where("page_id = 0"), {"target": [TARGET], "expand": [EXPAND]}).collect()
    by = {}
    for r in got:
        by.setdefault(r.rule, []).append(r.url)
    assert len(by["target"]) == 3 and len(by["expand"]) == 1


SELECTORS = {
    "title": ("(//h2/a)[1]", "text"),
    "body": ("//div[@class='post-body']", "html"),
    "extra": ("(//img)[1]/@src", "binary"),
    "none": ("//table", "text"),
}


def record(pages, ids, **kw):
    rec = collect_content(pages.where(F.col("page_id").isin(*ids)), SELECTORS, **kw)
    return {r.page_id: r for r in rec.collect()}


def test_content_images_media(pages):
    rec = record(pages, [2, 3, 4])
    assert set(rec[2].content.keys()) == {"title", "body", "none"}  # binary key is not content
    assert rec[2].content["none"] == []
    assert rec[2].content["title"] == ["First post"]
    imgs = [(i.file_name, i.caption) for p in (2, 3, 4) for i in rec[p].images]
    assert imgs == [("one.jpg", "Body one"), ("two.png", "")]
    assert [m.file_name for m in rec[2].media] == ["one.jpg"]
    assert rec[2].media[0].file_url == "http://blog.test/media/one.jpg?size=2"
    assert rec[2].media[0].description == ""
    assert rec[4].media == [] and rec[4].images == []
    assert not any(rec[p].blocked for p in rec)


def test_content_options(pages):
    assert all(r.images == [] for r in record(pages, [2, 3], get_image=False).values())
    blocked = collect_content(pages.where("page_id = 0"), {"post": ("//div[@class='post-body']", "text")},
                              black_words="wrote in, telegram").first()
    assert blocked.blocked
    plain = record(pages, [2])[2].content["body"][0]
    refined = record(pages, [2], replace_rules=[r"<img[^>]*>"])[2].content["body"][0]
    assert "<img" in plain and "<img" not in refined and ' class="' not in refined


def test_duplicate_key_last_wins_and_every_page(pages):
    rec = collect_content(pages, [("k", "//title", "text"), ("k", "//h2", "text")]).collect()
    assert len(rec) == pages.count()  # pages without any match still have a record
    by = {r.page_id: r.content["k"] for r in rec}
    assert by[2] == ["First post"] and by[5] == []


def test_article(spark):
    from gleaner.operators.article import extract_article
    from gleaner.sources.pages import read_pages_from

    html = (
        "<html><head><title> The title </title></head><body>"
        "<div class='sidebar'><p>Links, links, links, and more links here, many of them.</p></div>"
        "<div id='story'><p>The main text of the story, long enough to count, with commas, many.</p>"
        "<p>A second paragraph of the story that also counts as a paragraph.</p></div>"
        "<div class='comment'><p>A comment that is long enough to be a paragraph too.</p></div></body></html>"
    )
    pages = read_pages_from(spark.createDataFrame([(1, "http://a/", html), (2, "http://b/", "<p>short</p>")],
                                                  "page_id bigint, url string, html string"))
    got = {r.page_id: r for r in extract_article(pages).collect()}
    assert got[1].title == "The title"
    assert got[1].content.startswith("<html><body><div><div id='story'>") and "comment" not in got[1].content
    assert got[2].content == "<html><body><div><p>short</p></div></body></html>"  # no block: the (implied) body


def plain_article(html):
    """The stated rules read element by element: all descendants and ancestors of every one."""
    from gleaner.operators import htmltree
    from gleaner.operators.article import CONTAINERS, MIN_PARAGRAPH, PARAGRAPHS

    source, t = htmltree.build(html)
    text = htmltree.doc_text(t)
    size = [e - s for s, e in zip(t.t0, t.t1)]
    found = []
    for i, tag in enumerate(t.tag):
        if tag not in CONTAINERS:
            continue
        inside = [j for j in range(i + 1, t.end[i] + 1)]
        link = sum(size[j] for j in inside if t.tag[j] == "a")
        direct = [len(text[t.t0[j] : t.t1[j]].strip()) for j in inside if t.parent[j] == i and t.tag[j] in PARAGRAPHS]
        score = sum(x for x in direct if x >= MIN_PARAGRAPH) * max(1 - link / size[i], 0.0) if size[i] else 0.0
        if score > 0 or tag == "body":
            found.append((-score, tag != "body", i))
    titles = [text[t.t0[i] : t.t1[i]].strip() for i, tag in enumerate(t.tag) if tag == "title"]
    best = min(found)[2] if found else None
    return (titles or [""])[0], None if best is None else source[t.s0[best] : t.s1[best]]


def test_article_block_equals_the_plain_rules():
    import random

    from gleaner.operators.article import best_block

    rng = random.Random(5)
    words = "some plain words that fill a paragraph until it is long enough to count".split()

    def markup(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(["div", "section", "p", "p", "a", "blockquote", "pre", "td", "title", "span"])
            inner = markup(depth - 1) if depth and rng.random() < 0.6 else " ".join(rng.choices(words, k=rng.randint(0, 9)))
            out.append(f"<{tag}>{inner}</{tag}>")
        return "".join(out)

    for _ in range(300):
        html = markup(4)
        assert best_block(html) == plain_article(html)
    # ties: the body, then the first; empty and null pages
    p = f"<p>{' '.join(words)}</p>"
    assert best_block(f"<body><div id=a>{p}</div><div id=b>{p}</div></body>")[1].startswith("<div id=a>")
    assert best_block(f"<body>{p}<div>{p}</div></body>")[1].startswith("<body>")
    assert best_block("") == best_block(None) == ("", None)
    deep = "<div>" * 20_000 + p
    assert best_block(deep)[1].startswith("<div>")


def test_article_moves_no_html(spark):
    from gleaner.operators.article import extract_article

    before = spark.conf.get("spark.gleaner.parsePartitions", "0")
    spark.conf.set("spark.gleaner.parsePartitions", "0")
    try:
        df = extract_article(spark.range(3).selectExpr("id page_id", "'u' url", "'<p>x' html"))
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.gleaner.parsePartitions", before)
