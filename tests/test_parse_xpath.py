"""O-07 parser, O-08/O-09 XPath selection, O-10…O-13 values."""

from __future__ import annotations

import pyarrow as pa
import pytest
from fixtures import A0, A1, LIST0

from gleaner.operators import htmltree, structure
from gleaner.operators.select import match_rows, nodes_for, select_values
from gleaner.operators.xpath import Unsupported, compile_xpath
from gleaner.sources.pages import read_pages_from


def tree(html):
    src, b = htmltree.build(html)
    return src, b


def children(b, i):
    return [j for j, p in enumerate(b.parent) if p == i]


@pytest.mark.parametrize("bad", ["", None, "Loose words", "<body>", "   ", 42])
def test_bad_html_parses(bad):
    src, b = tree(bad)
    assert b.tag[0] == "html"
    if bad == "Loose words":
        assert b.tag == ["html", "body", "p"]
        assert htmltree.doc_text(b) == "Loose words"


def test_implied_end_tags():
    _, b = tree("<ul><li>a<li>b</ul><p>x<div>y</div><table><tr><td>1<td>2</table>")
    lis = [i for i, t in enumerate(b.tag) if t == "li"]
    assert len(lis) == 2 and b.parent[lis[0]] == b.parent[lis[1]]
    p = b.tag.index("p")
    div = b.tag.index("div")
    assert b.parent[div] == b.parent[p]  # a block start tag closes the open <p>
    tds = [i for i, t in enumerate(b.tag) if t == "td"]
    assert len(tds) == 2 and b.parent[tds[0]] == b.parent[tds[1]]


def test_script_is_raw_text_and_entities_decoded():
    src, b = tree('<head><script>var t="</p><b>";</script><title>A &amp; B</title></head><a href="/x?a=1&amp;b=2">t</a>')
    assert "p" not in b.tag and "b" not in b.tag
    t = b.tag.index("title")
    assert "".join(b.lead[t]) == "A & B"
    a = b.tag.index("a")
    assert b.attrs[a]["href"] == "/x?a=1&b=2"
    assert src[b.s0[a] : b.s1[a]] == '<a href="/x?a=1&amp;b=2">t</a>'


def test_ranges_and_positions():
    _, b = tree("<div><p>a</p><span>b</span><p>c</p></div>")
    div = b.tag.index("div")
    kids = children(b, div)
    assert [b.tag[k] for k in kids] == ["p", "span", "p"]
    assert [b.sib[k] for k in kids] == [1, 1, 2]
    assert [b.pos[k] for k in kids] == [1, 2, 3]
    assert b.end[div] == kids[-1]


@pytest.mark.parametrize(
    "xp", ["//li[", "", "//a[", "//a[@x=]", "nothing(//a)", "//a/@", "!", None]
)
def test_invalid_xpath_compiles_to_none(xp):
    assert compile_xpath(xp) is None


def one(spark, html, xpath, data_type="text", url="http://blog.test/"):
    pages = read_pages_from(spark.createDataFrame([(1, url, html)], "page_id bigint, url string, html string"))
    rows = select_values(pages, xpath, data_type).orderBy("ord").collect()
    return [r.value for r in rows]


def test_select_cases(spark):
    assert one(spark, LIST0, "(//h2/a)[1]") == ["First post"]
    assert len(one(spark, LIST0, "//div[@id='main']/article[@class='post']")) == 3
    assert one(spark, LIST0, "//div[@id='main']/tbody/article[@class='post']") == one(
        spark, LIST0, "//div[@id='main']/article[@class='post']"
    )
    assert one(spark, A0, "(//img)[1]/@src") == ["/media/one.jpg?size=2"]
    assert one(spark, LIST0, "//footer/a[2]/@href") == ["/posts/second/"]
    assert one(spark, LIST0, "//header/*[3]/@href") == ["/tags/x"]
    assert one(spark, LIST0, '//a[@rel="next"]') == ["Older posts"]
    assert one(spark, LIST0, "//a[@rel]") == ["Older posts"]
    assert one(spark, LIST0, "//li[") == []
    assert one(spark, LIST0, "/html/body/div/article/div/h2/a") == ["First post", "Second post", "Third post"]
    assert one(spark, LIST0, "/body") == []


def test_html_and_text_values(spark):
    html = one(spark, A0, "//div[@class='post-body']", "html")
    assert len(html) == 1 and html[0].startswith('<div class="post-body" alt="Body one">') and html[0].endswith("</div>")
    text = one(spark, A0, "//div[@class='post-body']", "text")
    assert text == ["Text of the first post, long enough to count as a paragraph.More text, with a comma, and another."]
    # text() gives the text nodes of the element, leading text and tails of children
    assert one(spark, A1, "//div[@class='post-body']/p/text()") == [
        "Second body text, again long enough for a paragraph.",
        " attached.",
    ]
    # empty values are dropped for text/html, string results pass unstripped
    assert one(spark, "<p> </p><p>x</p><a href=' y '>", "//p") == ["x"]
    assert one(spark, "<p> </p><p>x</p><a href=' y '>", "//a/@href") == [" y "]


def test_one_scan_for_many_selectors(spark):
    pages = read_pages_from(spark.createDataFrame([(1, "http://b/", LIST0)], "page_id bigint, url string, html string"))
    xps = ["//article", "(//h2/a)[2]", "//nav/a/@href", "//div[@id='main']/tbody/article"]
    rows = match_rows(nodes_for(pages, xps), xps)
    counts = {r["sel"]: r["count"] for r in rows.groupBy("sel").count().collect()}
    assert counts == {0: 3, 1: 1, 2: 1, 3: 3}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_richer_predicates_and_unions(spark):
    assert one(spark, A0, "//div[contains(@class, 'post-bo')]/@alt") == ["Body one"]
    assert one(spark, LIST0, "//a[text()='Older posts']/@href") == ["/page/2"]
    assert one(spark, LIST0, "//footer/a[last()]/@href") == ["/tags/x/"]
    assert one(spark, LIST0, "//header/a[position() <= 2]/@href") == ["/", "/about/"]
    assert one(spark, LIST0, "//a[starts-with(@href, 'mailto:')]") == ["Mail"]
    assert one(spark, LIST0, "//a[@href!='/' and contains(@href, 'about')]/@href") == ["/about/", "  /about  "]
    assert one(spark, LIST0, "//nav/a[not(@rel='prev') or @id]") == ["Older posts"]
    assert one(spark, LIST0, "//h2/a | //nav/a") == ["First post", "Second post", "Third post", "Older posts"]
    assert one(spark, LIST0, "(//h2/a | //nav/a)[last()]") == ["Older posts"]
    assert one(spark, LIST0, "(//h2/a)[position() > 1]") == ["Second post", "Third post"]
    assert one(spark, LIST0, "//p[normalize-space(.)='Another intro.']") == ["Another intro."]
    assert one(spark, LIST0, "//div[@id='main']/article[2]//a/@href") == ["/posts/second"]
    assert one(spark, LIST0, "//footer/a[string-length(@href) > 15]/@href") == [
        "/posts/first#comments", "mailto:me@blog.test", "javascript:void(0)", "https://other.test/x"
    ]
    # a position picks the element before its attribute is read
    assert one(spark, "<img><img src='x'>", "(//img)[1]/@src") == []
    assert one(spark, "<img><img src='x'>", "(//img[@src])[1]/@src") == ["x"]
    for unsupported in ["//a/@*", "//a[1 + 1]", "//a[$x]", "//comment()", "//a/namespace::b", "count(//a)", "//a[sum(b) = 1]"]:
        with pytest.raises(Unsupported):
            compile_xpath(unsupported)


def test_results_below_and_late_positions(spark):
    page = "<div><p class='a'>one<b id='i'>two</b>three</p><p>x</p><p class='a' id='k'>four</p></div><p class='a'>five</p>"
    assert one(spark, page, "//p//text()") == ["one", "two", "three", "x", "four", "five"]
    assert one(spark, page, "//text()") == ["one", "two", "three", "x", "four", "five"]
    assert one(spark, page, "//@id") == ["i", "k"]
    assert one(spark, page, "//p//@id") == ["i", "k"]
    assert one(spark, page, "//p[@class='a'][2]") == ["four"]
    assert one(spark, page, "//p[@class='a'][last()]") == ["four", "five"]
    assert one(spark, page, "//p[@class='a'][2]/@id") == ["k"]
    assert one(spark, page, ".//b") == ["two"] and one(spark, page, "./html/body/p") == ["five"]
    # text after elements that end together: the inner one's first
    assert one(spark, "<div><p>a<b>b<i>c</i>d</b>e</p>f</div>", "//div//text()") == list("abcdef")


SUPPORTED = ["//p", "//div/p", "//p[@class='a']", "//p[2]", "//*[@id]", "(//p)[2]", "//p[@class='a'][2]", "//p[last()]",
             "//p[text()='x']", "//b | //p[@id]", "//p[contains(., 'o')]", "/html/body/*", "//p[not(@class) or @id='k']",
             "//p[string-length(@class) = 1 and position() > 1]", "//p[normalize-space(.)='four']"]


def test_tree_and_column_evaluation_agree(spark):
    page = "<div><p class='a'>one<b id='i'>two</b>three</p><p>x</p><p class='a' id='k'>four</p></div><p class='a'>five</p>"
    pages = read_pages_from(spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string"))
    got = {}
    for r in match_rows(nodes_for(pages, SUPPORTED), SUPPORTED).collect():
        got.setdefault(r["sel"], set()).add(r["node_id"])
    tree = structure.Page(htmltree.build(page)[1])
    for k, xp in enumerate(SUPPORTED):
        assert {n for b in structure.read(xp) for n in tree.select(b)} == got.get(k, set()), xp


def test_deep_nesting_is_parsed_in_bounded_batches():
    from gleaner.operators import nodes

    html = "<b>" * 3000 + "x"
    batch = pa.RecordBatch.from_pylist([{"page_id": 1, "url": "u", "html": html}])
    sizes = [len(b["path"].flatten()) for b in nodes._convert([batch], frozenset(), frozenset(), None)]
    assert len(sizes) > 10 and max(sizes) <= nodes.FLUSH_PATH + 3100


def test_hundred_thousand_nested_tags(spark):
    deep = spark.createDataFrame([(1, "u", "<i>" * 100_000 + "<a href='/x'>y</a>")], "page_id bigint, url string, html string")
    assert one_count(deep, "//a") == 1


def one_count(pages, xpath):
    return match_rows(nodes_for(pages, [xpath], content=False), [xpath]).count()


def test_with_tail(spark):
    from gleaner.sources.pages import read_pages_from

    pages = read_pages_from(spark.createDataFrame([(1, "http://b/", "<p><b>bold</b> tail <i>x</i></p>")],
                                                  "page_id bigint, url string, html string"))
    plain = [r.value for r in select_values(pages, "//b", "text").collect()]
    tailed = [r.value for r in select_values(pages, "//b", "text", with_tail=True).collect()]
    html = [r.value for r in select_values(pages, "//b", "html", with_tail=True).collect()]
    assert plain == ["bold"] and tailed == ["bold tail"] and html == ["<b>bold</b> tail"]


def test_parse_partitions_are_asked_for(spark):
    from gleaner.operators.nodes import dealt

    df = spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id bigint, url string, html string").coalesce(1)
    assert dealt(df, 0) is df  # parsed where it is read
    assert dealt(df, 5).rdd.getNumPartitions() == 5


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_SOUP = st.lists(
    st.sampled_from([
        "<p>", "</p>", "<b>", "</b>", "<div class='x'>", "</div>", "<ul>", "<li>", "</li>", "</ul>", "<br>",
        "<table>", "<tr>", "<td>", "</table>", "<script>if(a<b){}</script>", "<!-- c -->", "text", " ", "&amp;",
        "<a href='/x'>", "</a>", "<html>", "<body>", "</body>", "<head>", "<title>t</title>", "</html>", "<img src=i>",
        "<", ">", "</nope>", "<option>", "<dd>", "<dt>", "\n",
    ]),
    max_size=40,
).map("".join)


@settings(max_examples=300, deadline=None)
@given(_SOUP)
def test_parser_invariants_on_tag_soup(html):
    src, b = htmltree.build(html)
    text = htmltree.doc_text(b)
    n = len(b.tag)
    assert n >= 1 and b.tag[0] == "html" and b.parent[0] == -1
    for i in range(n):
        p = b.parent[i]
        if i:
            assert 0 <= p < i and b.end[p] >= b.end[i]  # pre-order, parent spans child
        assert i <= b.end[i] < n
        assert 0 <= b.s0[i] <= b.s1[i] <= len(src)
        assert 0 <= b.t0[i] <= b.t1[i] <= len(text)
        if i and p >= 0:
            assert b.s0[p] <= b.s0[i] and b.t0[p] <= b.t0[i] <= b.t1[i] <= b.t1[p]
        assert 1 <= b.sib[i] <= b.nsib[i] and 1 <= b.pos[i] <= b.npos[i]
    # every text chunk is counted once, in document order
    assert sum(len("".join(x)) for x in b.lead) + sum(len("".join(x)) for x in b.tail) == len(text)


def test_text_predicates_see_all_direct_text_nodes(spark):
    page = "<nav><a href='/n'><img src='i.png'>Next</a><a href='/p'>Prev <b>!</b> page</a></nav>"
    assert one(spark, page, "//a[text()='Next']/@href") == ["/n"]  # text after a child element
    assert one(spark, page, "//a[text()=' page']/@href") == ["/p"]  # any of the text nodes
    assert one(spark, page, "//a[starts-with(text(), 'Prev')]/@href") == ["/p"]  # first text node
    assert one(spark, page, "//a[contains(text(), 'page')]/@href") == []  # only the first counts
    assert one(spark, page, "//b[not(text())]") == []


def test_rows_only_for_what_the_xpaths_can_select(spark):
    df = spark.createDataFrame(
        [(1, "u", "<nav><ul><li><a href='/x'>x</a><li>y</ul></nav><p>text</p>")], "page_id long, url string, html string"
    )
    tags = lambda xps: sorted(r.tag for r in nodes_for(df, xps).collect())
    assert tags(["//nav/ul/li/a", "/*"]) == ["a", "html"]
    assert tags(["//li[a]"]) == ["html", "li"]  # evaluated in the parse: the marked elements
    whole = ["a", "body", "html", "li", "li", "nav", "p", "ul"]
    assert tags(["//nav/*"]) == tags(["//a/text()"]) == tags(["//a", "/html/*"]) == whole


def test_strip_is_pythons(spark):
    from pyspark.sql import functions as F

    from gleaner.functions.text import WS_CHARS, py_strip

    given = [f"{w}a{w}b{w}{w}" for w in WS_CHARS] + [WS_CHARS, "", "​x​", "ä\n", "\r\n x \n\n", None]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g string")
    got = {r.i: r.s for r in df.select("i", py_strip(F.col("g")).alias("s")).collect()}
    assert got == {i: g if g is None else g.strip() for i, g in enumerate(given)}


def test_an_input_batch_is_taken_in_slices():
    import pyarrow as pa

    from gleaner.operators import nodes

    batch = pa.record_batch([list(range(1000)), ["u"] * 1000, ["<p>x"] * 1000], ["page_id", "url", "html"])
    parts = list(nodes.sliced([batch]))
    assert max(p.num_rows for p in parts) <= nodes.SLICE and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


def test_arrow_batches_are_bounded_where_the_session_names_no_size(spark):
    from pyspark.sql import functions as F

    from gleaner.session import BATCHES, ensure_shipped

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    own = spark.newSession()
    for key in BATCHES:
        own.conf.unset(key)
    ensure_shipped(own)
    for width, rows in ((20_000, 1500), (10, 5000)):
        pages = own.range(0, rows, numPartitions=1).select(F.repeat(F.lit("x"), width).alias("html"))
        got = pages.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in got) == rows
        assert max(r["n"] for r in got) <= 1024 and max(r["size"] for r in got) < 2 << 20
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    ensure_shipped(own)
    assert own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "300"
