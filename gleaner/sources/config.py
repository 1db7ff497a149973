"""Configuration tables (O-05, O-44) and the spider plan.

The collector's configuration — selectors, collectors, spiders and the two
link tables — is user data kept in tables. It is small, so joins against it
are broadcast, but only after its size has been checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SELECTORS = "selector_id bigint, key string, xpath string, data_type string"
COLLECTORS = (
    "collector_id bigint, name string, get_image boolean, "
    "replace_rules array<string>, black_words array<string>"
)
COLLECTOR_SELECTORS = "collector_id bigint, selector_id bigint"
SPIDERS = (
    "spider_id bigint, url string, name string, crawl_root boolean, "
    "target_links array<string>, expand_links array<string>, crawl_depth int"
)
SPIDER_COLLECTORS = "spider_id bigint, collector_id bigint"

BROADCAST_MAX_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``broadcast(df)`` when it has at most ``max_rows`` rows (checked), else ``df`` as is."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def spider_plan(
    spider_collectors: DataFrame,
    collectors: DataFrame,
    collector_selectors: DataFrame,
    selectors: DataFrame,
    all_collectors: bool = False,
) -> DataFrame:
    """O-05: per spider its collector (the first by id, or all with ``all_collectors``)
    and that collector's selectors; a repeated key keeps the later selector.

    Columns: ``spider_id, collector_id, get_image, replace_rules, black_words,
    key, xpath, data_type`` (a missing data type means ``html``, O-13).
    """
    sc = spider_collectors
    if not all_collectors:
        first = Window.partitionBy("spider_id").orderBy("collector_id")
        sc = sc.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1).drop("_rn")
    plan = (
        sc.join(broadcast_if_small(collectors), "collector_id")
        .join(broadcast_if_small(collector_selectors), "collector_id")
        .join(broadcast_if_small(selectors), "selector_id")
    )
    later = Window.partitionBy("spider_id", "collector_id", "key").orderBy(F.col("selector_id").desc())
    plan = plan.withColumn("_rn", F.row_number().over(later)).where(F.col("_rn") == 1)
    return plan.select(
        "spider_id", "collector_id",
        F.coalesce("get_image", F.lit(True)).alias("get_image"),
        "replace_rules", "black_words", "key", "xpath",
        F.coalesce(F.nullif(F.col("data_type"), F.lit("")), F.lit("html")).alias("data_type"),
    )


def spider_sets(plan: DataFrame) -> DataFrame:
    """``spider_id, set_id``: each spider's configuration (selectors, image switch,
    refine rules, black words) identified by a hash of it — computed in Spark."""
    per = plan.groupBy("spider_id", "get_image", "replace_rules", "black_words").agg(
        F.array_sort(F.collect_list(F.struct("key", "xpath", "data_type"))).alias("sels")
    )
    conf = F.to_json(F.struct("sels", "get_image", "replace_rules", "black_words"))
    return per.select("spider_id", F.sha2(conf, 256).alias("set_id"), "sels", "get_image", "replace_rules",
                      "black_words")


def selector_sets(plan: DataFrame) -> list[dict]:
    """The distinct configurations of a plan (configuration-sized: no spider lists)."""
    sets = spider_sets(plan).dropDuplicates(["set_id"]).drop("spider_id")
    out = []
    for r in sets.collect():
        out.append(
            {
                "set_id": r["set_id"],
                "selectors": [(s["key"], s["xpath"], s["data_type"]) for s in r["sels"]],
                "get_image": r["get_image"],
                "replace_rules": list(r["replace_rules"] or []),
                "black_words": list(r["black_words"] or []),
            }
        )
    return out
