"""Column functions against plain Python: URLs (O-03, O-18, O-21 … O-23, O-35), O-06/O-06a,
O-27/O-28, O-36/O-37."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import re
from urllib.parse import urljoin

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import blackwords, ranges, text, timefmt, urls


def evaluate(spark, rows, schema, *cols):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*cols).collect()]


SEGS = ["a", "b", "c.d", ".", "..", "x y", "%41"]
relative_refs = st.builds(
    lambda kind, segs, q, f: (
        {"rel": "", "abs": "/", "net": "//other.test/", "q": "", "f": ""}[kind]
        + ("/".join(segs) if kind in ("rel", "abs", "net") else "")
        + (("?" + q) if q else "")
        + (("#" + f) if f else "")
    ),
    st.sampled_from(["rel", "abs", "net", "q", "f"]),
    st.lists(st.sampled_from(SEGS), min_size=0, max_size=5),
    st.sampled_from(["", "k=v", "x"]),
    st.sampled_from(["", "top", "s"]),
)
bases = st.sampled_from(
    ["http://h.test/p/q/r?x=1#y", "https://h.test/", "http://h.test", "http://h.test/a/b/", "http://h.test:8080/a"]
)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(bases, relative_refs), min_size=1, max_size=40))
def test_url_join_matches_urljoin(spark, cases):
    got = evaluate(spark, cases, "b string, r string", urls.complete_url(F.col("b"), F.col("r")))
    for (b, r), (g,) in zip(cases, got):
        if "//" in r.split("?")[0].split("#")[0][2:]:
            continue  # Python 3 collapses empty segments inside merged paths; RFC 3986 keeps them
        assert g == urljoin(b, r), (b, r)


def test_complete_url_examples(spark):
    cases = [
        ("http://docs.test", "guide/start", "http://docs.test/guide/start"),
        ("http://docs.test/a/b", "mailto:x@y", "mailto:x@y"),
        ("http://docs.test/a/b", "HTTPS://O.com/Z", "HTTPS://O.com/Z"),
        ("http://docs.test/a/b", "", "http://docs.test/a/b"),
        ("http://docs.test/a/b", "../../../g", "http://docs.test/g"),
    ]
    got = evaluate(spark, [c[:2] for c in cases], "b string, r string", urls.complete_url(F.col("b"), F.col("r")))
    assert [g[0] for g in got] == [c[2] for c in cases]


href_text = st.text(alphabet=" /#?:ahtp.x0", max_size=12)


def py_scheme(u):
    m = re.match(r"^([A-Za-z][A-Za-z0-9+.\-]*):", u)
    if not m:
        return ""
    rest = u[m.end():]
    return "" if rest and rest.isdigit() else m.group(1).lower()


@settings(max_examples=40, deadline=None)
@given(st.lists(href_text, min_size=1, max_size=60))
def test_link_key_and_scheme(spark, hrefs):
    got = evaluate(
        spark, [(h,) for h in hrefs], "h string",
        urls.link_key(F.col("h")), urls.is_http(urls.link_key(F.col("h"))), urls.scheme(F.col("h")),
    )
    for h, (k, ok, s) in zip(hrefs, got):
        key = h.strip().rstrip("/").split("#", 1)[0]
        assert k == key
        assert ok == (py_scheme(key) in ("", "http", "https"))
        assert s == py_scheme(h)


def test_valid_file_name_page_key(spark):
    rows = [("http://a.test/x/y.jpg?s=1",), ("a.test/x",), ("mailto:me",), ("http://a.test/dir/",)]
    got = evaluate(spark, rows, "u string", urls.valid_url(F.col("u")), urls.file_name(F.col("u")),
                   urls.page_key(F.col("u")))
    assert [g[0] for g in got] == [True, False, False, True]
    assert [g[1] for g in got] == ["y.jpg", "x", "mailto:me", ""]
    import hashlib

    assert got[0][2] == hashlib.sha256(rows[0][0].encode()).hexdigest()[:8] + "-a.test"
    assert got[1][2] == hashlib.sha256(rows[1][0].encode()).hexdigest()[:8]


def test_interval_to_list(spark):
    cases = {"5": [5], "2-4": [2, 3, 4], "4-2": [], "1-9-3": [1, 2, 3], " 7 , 1 - 2 ": [7, 1, 2], "0-0,3": [0, 3]}
    got = evaluate(spark, [(s,) for s in cases], "s string", ranges.interval_to_list(F.col("s")))
    assert [list(g[0]) for g in got] == list(cases.values())


def generated(spark, template, *lists):
    df = spark.createDataFrame([(template, list(lists))], "template string, elements array<array<string>>")
    return [r.url for r in ranges.generate_urls(df).orderBy("url_rank").collect()]


def test_generate_urls(spark):
    assert generated(spark, "u/{0}/{1}", ["1-2"], ["x", "y"]) == ["u/1/x", "u/1/y", "u/2/x", "u/2/y"]
    assert generated(spark, "u/{1}-{0}", ["p"], ["3-4"]) == ["u/3-p", "u/4-p"]
    assert generated(spark, "{0}{0}", ["7"]) == ["77"]
    assert generated(spark, "u/{0}", ["4-1"]) == []
    assert generated(spark, "u/{}/{}?q={{z}}", ["1-2"], ["a"]) == ["u/1/a?q={z}", "u/2/a?q={z}"]


def test_generate_urls_takes_values_as_they_are(spark):
    assert generated(spark, "u/{0}/{1}", ["{1}"], ["z"]) == ["u/{1}/z"]
    assert generated(spark, "u/{0}", ["en-us", "1-2", "a-1"]) == ["u/en-us", "u/1", "u/2", "u/a-1"]
    assert generated(spark, "u/{3}", ["v"]) == ["u/{3}"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=4), min_size=1, max_size=3))
def test_generated_urls_are_the_whole_product(spark, lists):
    got = generated(spark, "/".join(["{}"] * len(lists)), *[[str(v) for v in x] for x in lists])
    assert len(got) == math.prod(len(x) for x in lists)
    assert got[0] == "/".join(str(x[0]) for x in lists) and got[-1] == "/".join(str(x[-1]) for x in lists)


def test_generated_urls_by_rank(spark):
    rows = [
        (1, "{0}-{1}-{2}", [["1-7"], ["a", "b", "3-5"], ["x", "y"]]),
        (2, "{1}{0}", [["1-3"], ["q"]]),
        (3, "none", []),
        (4, "null", None),
        (5, "{0}", [["1"], None]),
        (6, "{0}", [[], ["1"]]),
    ]
    df = spark.createDataFrame(rows, "id int, template string, elements array<array<string>>")
    lists = {1: [map(str, range(1, 8)), ["a", "b", "3", "4", "5"], ["x", "y"]], 2: [["1", "2", "3"], ["q"]], 3: [], 4: []}
    want = {(i, k, rows[i - 1][1].format(*v)) for i, x in lists.items() for k, v in enumerate(itertools.product(*x))}
    for size in (1, 3, 1 << 14):
        out = ranges.generate_urls(df, range_urls=size)
        assert out.columns == ["id", "template", "elements", "url_rank", "url"]
        got = [(r["id"], r["url_rank"], r["url"]) for r in out.collect()]
        assert len(got) == len(want) and set(got) == want


def test_one_large_product_is_equal_work_for_all_tasks(spark):
    df = spark.createDataFrame([("{0}/{1}/{2}", [["1-100"]] * 3)], "template string, elements array<array<string>>")
    out = ranges.generate_urls(df, range_urls=1000)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 10**6 and len(sizes) == 8 and max(sizes) <= 1.1 * min(sizes)
    last = out.where("url_rank = 999999 or url_rank = 10203").orderBy("url_rank").collect()
    assert [r["url"] for r in last] == ["2/3/4", "100/100/100"]


def test_refine(spark):
    rules = ["<aside .*?>", "[0-9]+ comments"]
    cases = {
        "": "",
        "\n  plain \n": "plain",
        '<aside id="q">kept</aside>': "kept</aside>",
        "12 Comments and 3 comments": " and ",
        '<p class="x" id=\'y\'>a</p>': "<p id='y'>a</p>",
        "<h1>gone</h1><p>stays</p>": "<p>stays</p>",
        '<a href="/l">link</a> text': "link text",
        "<script>\nlet x\n</script>after": "after",
    }
    got = evaluate(spark, [(v,) for v in cases], "v string", text.refine(F.col("v"), rules))
    assert [g[0] for g in got] == list(cases.values())
    same = evaluate(spark, [(v,) for v in cases], "v string", text.refine(F.col("v"), None))
    assert [g[0] for g in same] == list(cases)


def test_black_words(spark):
    rows = [("A SAMPLE of it",), ("some advert",), ("nothing",), (None,)]
    got = evaluate(spark, rows, "t string", text.contains_any(F.col("t"), "sample, advert"))
    assert [g[0] for g in got] == [True, True, False, None]
    assert text.normalise_words(" A, ,b ") == ["a", "b"]


@settings(max_examples=8, deadline=None)
@given(
    st.lists(st.one_of(st.none(), st.text("aAbBé ", max_size=12)), max_size=12),
    st.lists(st.one_of(st.none(), st.text("aAbBé ", max_size=4)), max_size=8),
    st.sampled_from([1, 8, 1 << 20]),
)
def test_black_words_of_a_table(spark, texts, words, shard_bytes):
    rows = [(k, t, "mine") for k, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "id int, t string, word string")
    listed = {w.strip(" ").lower() for w in words if w and w.strip(" ")}
    want = [(k, None if t is None else any(w in t.lower() for w in listed), "mine") for k, t, _ in rows]
    given_words = spark.createDataFrame([(w, 1) for w in words], "word string, id int")
    got = blackwords.blocked_by(df, "t", given_words, shard_bytes=shard_bytes)
    assert got.columns == ["id", "t", "word", "blocked"]
    assert sorted((r["id"], r["blocked"], r["word"]) for r in got.collect()) == sorted(want, key=lambda x: x[0])


def test_print_time_and_partition(spark):
    ts = dt.datetime(2024, 1, 2, 15, 4, 5)
    got = evaluate(spark, [(ts,)], "t timestamp", timefmt.print_time(F.col("t")), *timefmt.storage_partition(F.col("t")))
    assert got[0] == (ts.strftime("%Y/%m/%d %H:%I:%S"), 2024, 1, 2, "results/2024/01/02")


def test_print_time_any_and_valid_url_split(spark):
    from gleaner.sources.pages import valid_urls

    df = spark.createDataFrame([("2024-01-02 15:04:05", dt.datetime(2024, 1, 2, 15, 4, 5), 7)],
                               "s string, t timestamp, n int")
    row = df.select(
        timefmt.print_time_any(F.col("s"), "string").alias("s"),
        timefmt.print_time_any(F.col("t"), "timestamp").alias("t"),
        timefmt.print_time_any(F.col("n"), "int").alias("n"),
    ).first()
    assert (row.s, row.t, row.n) == ("2024-01-02 15:04:05", "2024/01/02 15:03:05", "")
    urls_df = spark.createDataFrame([("http://a.test/x",), ("/x",), ("mailto:a@b",), (None,)], "url string")
    ok, rejected = valid_urls(urls_df)
    assert [r.url for r in ok.collect()] == ["http://a.test/x"]
    assert sorted(str(r.url) for r in rejected.collect()) == ["/x", "None", "mailto:a@b"]


def test_charset_of_a_page():
    from gleaner.sources.charset import decode_page

    text = "<p>Grüße, façade – €</p>"
    western = text.replace(" – €", "")
    assert decode_page(text.encode()) == decode_page(b"\xef\xbb\xbf" + text.encode()) == text
    for name in ("utf-16", "utf-32"):
        assert decode_page(text.encode(name)) == text  # written with a mark
    # a mark wins over a declaration, a declaration over what the bytes look like
    assert decode_page(b"\xfe\xff" + f"<meta charset=utf-8>{text}".encode("utf-16-be")) == f"<meta charset=utf-8>{text}"
    for head, name in [
        ('<meta charset="koi8-r">', "koi8-r"),
        ("<META http-equiv=Content-Type content='text/html; charset=Shift_JIS'>", "shift_jis"),
        ("<?xml version='1.0' encoding='iso-8859-5'?>", "iso-8859-5"),
    ]:
        page = head + ("Привет" if name != "shift_jis" else "日本語")
        assert decode_page(page.encode(name)) == page
    # ISO-8859-1 means windows-1252; what is not declared and not UTF-8 is that too
    assert decode_page(f"<meta charset=iso-8859-1>{text}".encode("cp1252")) == f"<meta charset=iso-8859-1>{text}"
    assert decode_page(western.encode("latin-1")) == western and decode_page(text.encode("cp1252")) == text
    # not a character set of pages, in a comment, or too late: not a declaration
    for head in ("<meta charset=rot13>", "<meta charset=no-such>", "<!-- <meta charset=koi8-r> -->", " " * 1024 + "<meta charset=koi8-r>"):
        assert decode_page((head + text).encode()) == head + text
    assert decode_page(b"") == "" and decode_page(b"<meta charset=utf-8>\xff") == "<meta charset=utf-8>�"


def test_byte_pages_with_nulls(spark):
    from gleaner.sources.pages import read_byte_pages

    rows = [(1, "a", " <p>é</p>\n".encode("latin-1")), (2, None, None), (None, "c", b""), (4, "d", b"\xef\xbb\xbfx"), (4, "d", b"\xef\xbb\xbfx")]
    got = read_byte_pages(spark.createDataFrame(rows, "page_id bigint, url string, content binary")).collect()
    empty = "<html></html>"
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(
        map(str, [(1, "a", "<p>é</p>"), (2, None, empty), (None, "c", empty), (4, "d", "x"), (4, "d", "x")])
    )
