"""

    python tools/measure.py [sf_dir]

Parse throughput at local[1] and local[4], crawl time for depth 1–3, and the
shuffle bytes of ``page_links`` read from Spark's event log (written to a
scratch folder; the UI stays off). Prints one JSON object.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def session(cores: int, eventlog: str | None = None, **conf):
    from pyspark.sql import SparkSession

    b = (
        SparkSession.builder.master(f"local[{cores}]").appName(f"gleaner-measure-{cores}")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", str(2 * cores))
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    )
    if eventlog:
        b = (b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", eventlog)
             .config("spark.eventLog.compress", "false"))
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def timed(fn, repeat=2):
    best = None
    for _ in range(repeat):
        t0 = time.perf_counter()
        fn()
        dt = time.perf_counter() - t0
        best = dt if best is None else min(best, dt)
    return best


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from gleaner import registry as R
    from gleaner.operators.crawl import crawl
    from gleaner.operators.links import page_links
    from gleaner.operators.nodes import parse_nodes
    from gleaner.sources.pages import read_pages, read_pages_from

    out = {"sf_dir": sf}
    for cores in (1, 4):
        scratch = tempfile.mkdtemp(prefix="gleaner-eventlog-")
        spark = session(cores, scratch)
        pages = read_pages(spark, sf)
        n = pages.count()
        parse = timed(lambda: parse_nodes(pages, attrs={"href"}, content_tags=set(), path_tags=set())
                      .write.format("noop").mode("overwrite").save())
        out[f"parse_nodes_pages_per_sec_local{cores}"] = round(n / parse, 1)
        links = timed(lambda: page_links(pages).write.format("noop").mode("overwrite").save())
        out[f"page_links_sec_local{cores}"] = round(links, 3)
        if cores == 4:
            from gleaner.session import checkpoint_dir

            checkpoint_dir(spark)
            web = read_pages_from(R.linked_web(spark, sf)).checkpoint()
            for d in (1, 2, 3):
                sp = R._spiders(spark, sf, d, False)  # a spider from every page
                out[f"crawl_all_spiders_sec_depth{d}"] = round(timed(lambda: crawl(sp, web).count(), 1), 3)
        spark.stop()
        # shuffle bytes of the page_links jobs, from the event log
        written = 0
        for f in glob.glob(os.path.join(scratch, "**", "*"), recursive=True):
            if os.path.isdir(f):
                continue
            with open(f) as fh:
                for line in fh:
                    ev = json.loads(line)
                    if ev.get("Event") == "SparkListenerTaskEnd":
                        m = (ev.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                        written += m.get("Shuffle Bytes Written", 0)
        out[f"shuffle_bytes_written_all_jobs_local{cores}"] = written
    # page_links alone over an input that already has enough splits (as at scale): the
    # only exchange left is the one carrying link rows, keyed by page_id
    split_dir = tempfile.mkdtemp(prefix="gleaner-split-") + "/pages"
    spark = session(4)
    spark.read.parquet(f"{sf}/pages.parquet").repartition(8, "page_id").write.parquet(split_dir)
    spark.stop()
    scratch = tempfile.mkdtemp(prefix="gleaner-eventlog-")
    spark = session(4, scratch, spark_sql_files_maxPartitionBytes="1m", spark_sql_files_openCostInBytes="0")
    pages = read_pages(spark, path=split_dir)
    out["page_links_input_partitions"] = pages.rdd.getNumPartitions()
    n_links = page_links(pages).count()
    html_bytes = pages.selectExpr("sum(length(html)) AS n").first()["n"]
    spark.stop()
    written = 0
    for f in glob.glob(os.path.join(scratch, "**", "*"), recursive=True):
        if not os.path.isdir(f):
            for line in open(f):
                ev = json.loads(line)
                if ev.get("Event") == "SparkListenerTaskEnd":
                    m = (ev.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                    written += m.get("Shuffle Bytes Written", 0)
    out["page_links_rows"] = n_links
    out["page_links_shuffle_bytes"] = written
    out["html_chars"] = html_bytes
    print(json.dumps(out))


if __name__ == "__main__":
    main()
