"""O-02, O-04, O-05, O-31 … O-34, O-38 … O-43."""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import tempfile

import pytest
from fixtures import EXPAND, TARGET
from pyspark.sql import functions as F

from gleaner.operators.content import collect_content
from gleaner.operators.results import assign_task_id, results_clean, results_json
from gleaner.plans.operations import crawl_records, run_operations
from gleaner.sources import config
from gleaner.sources.media import media_files, read_media
from gleaner.sources.pages import read_pages_from, resolve_pages
from gleaner.sources.store import (
    collect_manifest,
    delete_results,
    manifest_of,
    retire_content,
    skip_collected,
    write_results,
)

SPIDERS = (
    "spider_id bigint, url string, crawl_root boolean, target_links array<string>, "
    "expand_links array<string>, crawl_depth int"
)


def spiders(spark):
    return spark.createDataFrame([(7, "http://blog.test/", False, [TARGET], [EXPAND], 1)], SPIDERS)


def test_operate_two_operations(spark, pages):
    ops = [{"action": "get", "target": "content"}, {"action": "get", "target": "links"}]
    env = run_operations(spiders(spark), pages, ops, {"title": ("(//h2/a)[1]", "text")}, task_id="T1")
    row = env.first()
    assert row.task == "T1" and row.url == "http://blog.test/" and len(row.results) == 2
    doc = json.loads(env.select(results_json(env).alias("j")).first().j)
    assert set(doc) == {"id", "task", "url", "start", "end", "results"}
    assert [r["extras"]["action"] + "_" + r["extras"]["target"] for r in doc["results"]] == ["get_content", "get_links"]
    assert doc["results"][0]["content"] == {"title": ["First post"]}
    assert doc["results"][0]["extras"]["uuid"].endswith("-blog.test")
    assert len(doc["results"][1]["content"]) == 9
    assert re.match(r"\d{4}/\d\d/\d\d \d\d:\d\d:\d\d$", doc["start"])
    clean = results_clean(env).collect()
    assert len([c for c in clean if c.op_index == 1]) == 9  # the links
    assert len([c for c in clean if c.op_index == 0]) == 1  # the content map's one value list


def test_operate_all_operations(spark, pages):
    ops = [{"action": a, "target": t} for a, t in
           [("get", "page"), ("get", "links"), ("get", "article"), ("get", "content"), ("crawl", "content")]]
    env = run_operations(spiders(spark), pages, ops, {"t": ("//title", "text")}, embed_crawl=True)
    doc = json.loads(env.select(results_json(env, pretty=False).alias("j")).first().j)
    page, links, art, content, crawled = [r["content"] for r in doc["results"]]
    assert page.startswith("<!DOCTYPE html>")
    assert art["title"] == "Posts, page one" and art["content"].startswith("<html>")
    assert content == {"t": ["Posts, page one"]}
    assert sorted(v["url"] for v in crawled.values()) == [
        "http://blog.test/posts/first", "http://blog.test/posts/second", "http://blog.test/posts/third"
    ]
    assert re.match(r"[0-9a-f]{8}-[0-9a-f]{4}-", doc["task"])
    # default: the crawl's pages stay rows, the datum counts them
    env = run_operations(spiders(spark), pages, ops[-1:], {"t": ("//title", "text")})
    doc = json.loads(env.select(results_json(env, pretty=False).alias("j")).first().j)
    assert doc["results"][0]["content"] == {"pages": 3}
    rows = crawl_records(spiders(spark), pages, {"t": ("//title", "text")}).collect()
    assert sorted(r.content["t"][0] for r in rows) == ["First post", "Second post", "Third post"]


def test_task_ids(spark):
    df = spark.createDataFrame([(1, "given"), (2, None), (3, None)], "spider_id bigint, task_id string")
    out = {r.spider_id: r.task_id for r in assign_task_id(df, prefix="p-").collect()}
    assert out[1] == "given" and out[2].startswith("p-") and out[2] != out[3]
    taken = spark.createDataFrame([(out[2],)], "task_id string")
    again = {r.spider_id: r.task_id for r in assign_task_id(df, prefix="p-", existing=taken).collect()}
    assert again[2] != out[2] and again[3] == out[3] and again[1] == "given"
    for _ in range(6):  # however many rounds it takes
        taken = taken.union(spark.createDataFrame([(again[2],)], "task_id string"))
        again = {r.spider_id: r.task_id for r in assign_task_id(df, prefix="p-", existing=taken).collect()}
    assert again[2] not in {r.task_id for r in taken.collect()}


def test_runs_differ_and_every_operation_has_a_datum(spark, pages):
    sp = spark.createDataFrame([(1, "http://blog.test/", False, [TARGET], None, 1), (2, "http://blog.test/none", False, [TARGET], [], 1)], SPIDERS)
    ops = [(a, t) for a, t in [("get", "page"), ("get", "links"), ("get", "article"), ("get", "content"), ("crawl", "content")]]
    first, second = (run_operations(sp, pages, ops, {"t": ("//title", "text")}) for _ in range(2))
    assert {len(r.results) for r in first.collect()} == {5}
    assert {r.id for r in first.collect()}.isdisjoint({r.id for r in second.collect()})
    assert {r.task for r in first.collect()}.isdisjoint({r.task for r in second.collect()})


def test_store_manifest_retire_skip(spark, pages):
    base = tempfile.mkdtemp(prefix="gleaner-store-")
    ops = [{"action": "get", "target": "content"}, {"action": "crawl", "target": "content"}]
    sels = {"t": ("//title", "text")}
    env = run_operations(spiders(spark), pages, ops, sels, run_id="r1")
    ts = F.lit("2024-01-02 03:04:05").cast("timestamp")
    rec = crawl_records(spiders(spark), pages, sels)
    for _ in range(2):  # a repeated run replaces itself
        write_results(env, base, dt.datetime(2024, 1, 2, 3, 4, 5), "r1", records=rec)
    (m,) = collect_manifest(env, ts, "r1").collect()
    assert m.state == 0 and m.local_path == "results/2024/01/02/r1"
    assert spark.read.json(f"{base}/{m.local_path}/envelopes").count() == 1
    assert spark.read.json(f"{base}/{m.local_path}/crawl").count() == 3
    assert any(f.endswith(".gz") for _, _, fs in os.walk(base) for f in fs)
    clean = results_clean(env, rec).where("op_index = 1").collect()
    assert [json.loads(c.item)["t"] for c in sorted(clean, key=lambda c: c.item)] == [["First post"], ["Second post"], ["Third post"]]
    links_only = run_operations(spiders(spark), pages, [{"action": "get", "target": "links"}])
    assert collect_manifest(links_only, ts, "r2").count() == 0  # no files, no record
    man = manifest_of(pages, ts, "r1").unionByName(manifest_of(pages, ts, "r2")).persist()
    first = man.where("local_path like '%r1'")
    of_page = first.where("url = 'http://blog.test/posts/first'")
    m2 = retire_content(man, of_page)
    assert [(g.id, g.local_path) for g in m2.where("state = 1").collect()] == [(of_page.first().id, "")]
    results, records = delete_results(man.select("id"), man, of_page)
    assert results.count() == records.count() == man.count() - 1
    assert skip_collected(pages, retire_content(first, of_page)).count() == 1  # the retired one is collectable again


def test_stream_goes_on_where_it_ended(spark, pages):
    from gleaner.streaming.collect import collect_stream

    src = tempfile.mkdtemp(prefix="gleaner-again-src-")
    sink = tempfile.mkdtemp(prefix="gleaner-again-") + "/sink"
    for name, part in (("1", pages.where("page_id < 4")), ("2", pages)):
        part.write.parquet(f"{src}/{name}")
        q, _ = collect_stream(spark, src + "/*", {"t": ("//title", "text")}, sink_path=sink)
        q.awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(sink).collect()) == sorted(r.url for r in pages.collect())


def test_article_has_a_row_for_every_page(spark):
    from gleaner.operators.article import extract_article

    text = "words enough to be a paragraph of its own"
    html = ["<html></html>", "<head><title>t</title></head>", None,
            f"<nav><p><a href='/'>{text}</a></p></nav><div><p>{text}</p><script>no()</script><form>f</form></div>"]
    got = {r.page_id: r for r in extract_article(read_pages_from(spark.createDataFrame(
        [(i, "u", h) for i, h in enumerate(html)], "page_id bigint, url string, html string"))).collect()}
    assert len(got) == 4 and got[1].title == "t"
    assert got[3].content == f"<html><body><div><div><p>{text}</p></div></div></body></html>"


def test_resolve_pages_and_loader(spark, pages):
    frontier = spark.createDataFrame([("http://blog.test/",), ("http://blog.test/missing",)], "url string")
    got = {r.url: (r.found, r.html) for r in resolve_pages(frontier, pages).collect()}
    assert got["http://blog.test/missing"] == (False, "<html></html>") and got["http://blog.test/"][0]

    def loader(urls):  # O-43: any DataFrame(url) -> DataFrame(url, html)
        return urls.select("url", F.concat(F.lit("<p>"), F.col("url"), F.lit("</p>")).alias("html"))

    got = {r.url: r.html for r in resolve_pages(frontier, pages, loader).collect()}
    assert got["http://blog.test/missing"] == "<p>http://blog.test/missing</p>"


def test_media_files(spark):
    folder = tempfile.mkdtemp(prefix="gleaner-media-")
    os.makedirs(os.path.join(folder, "img"))
    with open(os.path.join(folder, "img", "one.jpg"), "wb") as f:
        f.write(b"\xff\xd8jpeg")
    refs = spark.createDataFrame(
        [("http://blog.test/media/img/one.jpg",), ("http://other.test/media/img/one.jpg",), ("http://blog.test/gone.png",)], "file_url string"
    )
    files = read_media(spark, folder, "http://blog.test/media")
    got = {r.file_url: r for r in media_files(refs, files, with_content=True).collect()}
    one = got["http://blog.test/media/img/one.jpg"]
    assert one.stored_name == "one.jpg" and bytes(one.content) == b"\xff\xd8jpeg"
    # the same name elsewhere is another file
    assert {r.stored_name for u, r in got.items() if u != one.file_url} == {None}


def test_spider_plan(spark):
    sc = spark.createDataFrame([(1, 20), (1, 10), (2, 20)], config.SPIDER_COLLECTORS)
    cols = spark.createDataFrame([(10, "a", True, [], []), (20, "b", False, ["x"], ["w"])], config.COLLECTORS)
    cs = spark.createDataFrame([(10, 1), (10, 2), (20, 3)], config.COLLECTOR_SELECTORS)
    sels = spark.createDataFrame(
        [(1, "k", "//p", "text"), (2, "k", "//h1", None), (3, "z", "//a", "html")], config.SELECTORS
    )
    plan = {(r.spider_id, r.key): (r.collector_id, r.xpath, r.data_type)
            for r in config.spider_plan(sc, cols, cs, sels).collect()}
    assert plan == {(1, "k"): (10, "//h1", "html"), (2, "z"): (20, "//a", "html")}
    every = config.spider_plan(sc, cols, cs, sels, all_collectors=True).count()
    assert every == 3
    sets = config.selector_sets(config.spider_plan(sc, cols, cs, sels))
    assert len(sets) == 2 and {tuple(s["selectors"]) for s in sets} == {(("k", "//h1", "html"),), (("z", "//a", "html"),)}
    members = config.spider_sets(config.spider_plan(sc, cols, cs, sels)).groupBy("set_id").count().collect()
    assert sorted(r["count"] for r in members) == [1, 1]


def test_stream_equals_batch(spark, pages):
    from gleaner.streaming.collect import collect_stream

    src = tempfile.mkdtemp(prefix="gleaner-stream-src-")
    pages.where("page_id < 5").write.mode("overwrite").parquet(f"{src}/a")
    pages.write.mode("overwrite").parquet(f"{src}/b")  # the same pages again: each URL once
    sels = {"t": ("//title", "text"), "h": ("//h2", "text")}
    q, sink = collect_stream(spark, src + "/*", sels)
    q.awaitTermination()
    streamed = sorted((r.url, sorted(r.content.items())) for r in spark.read.parquet(sink).collect())
    batch = sorted((r.url, sorted(r.content.items())) for r in collect_content(pages, sels).collect())
    assert streamed == batch


def test_operate_with_plan(spark, pages):
    from gleaner.plans.operations import operate

    sp = spark.createDataFrame(
        [(1, "http://blog.test/posts/first", False, [TARGET], [EXPAND], 1),
         (2, "http://blog.test/posts/second", False, [TARGET], [EXPAND], 1),
         (3, "http://blog.test/posts/third", False, [TARGET], [EXPAND], 1)], SPIDERS)
    sc = spark.createDataFrame([(1, 10), (2, 20)], config.SPIDER_COLLECTORS)
    cols = spark.createDataFrame([(10, "a", True, [], []), (20, "b", False, ["<img[^>]*>"], ["second"])],
                                 config.COLLECTORS)
    cs = spark.createDataFrame([(10, 1), (20, 2)], config.COLLECTOR_SELECTORS)
    sels = spark.createDataFrame([(1, "title", "//title", "text"), (2, "body", "//div[@class='post-body']", "html")],
                                 config.SELECTORS)
    plan = config.spider_plan(sc, cols, cs, sels)
    env = operate(sp, pages, [{"action": "get", "target": "content"}], plan)
    docs = {r.spider_id: json.loads(r.j) for r in env.select("spider_id", results_json(env, False).alias("j")).collect()}
    assert docs[1]["results"][0]["content"] == {"title": ["First post"]}
    assert docs[2]["results"][0]["content"] is None and docs[2]["results"][0]["extras"]["blocked"]
    assert docs[3]["results"][0]["content"] == {}  # no collector: no selectors


def test_read_page_files(spark):
    from gleaner.operators.links import page_links
    from gleaner.sources.pages import read_page_files

    folder = tempfile.mkdtemp(prefix="gleaner-html-")
    for name, html in [("a.html", '<a href="b.html">B</a>'), ("b.html", "  <p>plain</p>  "), ("c.html", "")]:
        with open(os.path.join(folder, name), "w") as f:
            f.write(html)
    p = read_page_files(spark, folder + "/*.html")
    got = {r.url.rsplit("/", 1)[-1]: r.html for r in p.collect()}
    assert got == {"a.html": '<a href="b.html">B</a>', "b.html": "<p>plain</p>"}  # empty files are not listed
    links = page_links(p).collect()
    assert [(r.text, r.url.rsplit("/", 1)[-1]) for r in links] == [("B", "b.html")]


def test_stream_with_event_time_across_batches(spark, pages):
    import datetime as dt

    from gleaner.streaming.collect import collect_stream

    src = tempfile.mkdtemp(prefix="gleaner-stream-ts-")
    t0 = dt.datetime(2024, 1, 2, 3, 0, 0)
    first = pages.where("page_id < 5").withColumn("fetched", F.lit(t0))
    again = pages.withColumn("fetched", F.lit(t0 + dt.timedelta(minutes=5)))
    first.write.parquet(f"{src}/1")
    again.write.parquet(f"{src}/2")
    sels = {"t": ("//title", "text")}
    q, sink = collect_stream(
        spark, src + "/*", sels, schema="page_id bigint, url string, html string, fetched timestamp",
        event_time="fetched", watermark="1 hour", max_files=1,
    )
    q.awaitTermination()
    got = spark.read.parquet(sink)
    assert got.select("epoch").distinct().count() >= 2  # more than one micro-batch
    assert got.count() == pages.count() and got.select("url").distinct().count() == pages.count()


def test_stream_state_knows_what_the_sink_holds(spark):
    from gleaner.streaming.collect import collect_stream

    schema = "page_id bigint, url string, html string"
    src = tempfile.mkdtemp(prefix="gleaner-state-src-")
    sink = tempfile.mkdtemp(prefix="gleaner-state-") + "/sink"

    def arrive(name, rows, **options):
        spark.createDataFrame(rows, schema).write.parquet(f"{src}/{name}")
        q, _ = collect_stream(spark, src + "/*", {"t": ("//title", "text")}, sink_path=sink, **options)
        q.awaitTermination()
        return sorted((r.epoch, r.url or "", r.page_id, r.content["t"]) for r in spark.read.parquet(sink).collect())

    page = "<title>{}</title>".format
    # ties: the least page id, then the least text; rows without a URL are one
    rows = [(3, "http://a/", page("3")), (1, "http://a/", page("z")), (1, "http://a/", page("b")),
            (2, "http://b/", None), (7, None, page("n")), (8, None, page("m"))]
    first = arrive("1", rows)
    assert first == [(0, "", 7, ["n"]), (0, "http://a/", 1, ["b"]), (0, "http://b/", 2, [])]
    more = arrive("2", [*rows, (0, "http://a/", page("0")), (9, "http://c/", page("c"))])
    assert more == [*first, (1, "http://c/", 9, ["c"])]  # restarted on its own checkpoint
    # another checkpoint reads all arrivals again, and begins with what the sink holds
    other = arrive("3", [(5, "http://d/", page("d"))], checkpoint_location=sink + "/_other")
    assert [x[1:] for x in other if x not in more] == [("http://d/", 5, ["d"])] and len(other) == len(more) + 1


@pytest.mark.parametrize("folder", [True, False])
def test_stream_reads_a_table_of_part_files_or_one_file(spark, folder):
    from gleaner.registry import QUERIES

    sf = tempfile.mkdtemp(prefix="gleaner-stream-sf-")
    rows = [(i, f"http://h{i}.test/", f"<title>t{i}</title><article><h1>x</h1></article>") for i in range(1, 7)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    if folder:
        table.repartition(3).write.parquet(f"{sf}/pages.parquet")
    else:
        table.toPandas().to_parquet(f"{sf}/pages.parquet")
    got = QUERIES["collect_stream"](spark, sf)
    assert {r.joined for r in got.where("key = 'title'").collect()} == {f"t{i}" for i in range(1, 7)}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, QUERIES["collect_content"](spark, sf).collect()))
