"""URL filters by temporal list join (operator 3).

Dated list entries (add, remove) become validity intervals; an as-of join evaluates
every capture against the entries active on its fetch date. Entries name a host, a
domain (the host or any host below it) or a URL prefix at a path boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.scratch import Scratch

#: End of an interval that no removal ends.
OPEN_END = "9999-12-31"
#: Bytes of intervals up to which every task gets them all.
BROADCAST_BYTES = 32 << 20


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``list_name, key, valid_from, valid_to`` from dated entries.

    ``entries`` has ``list_name, kind (host | domain | prefix), pattern, action (add |
    remove), entry_date``. Of the entries of one list and pattern on one date a removal
    wins; adding what is listed or removing what is not changes nothing. Rows with a
    null or unknown field are ignored, other columns are not read. One row per key and
    date is left before the window, so its largest partition has as many rows as the
    lists have dates, however often an entry is repeated.
    """
    pattern = F.lower(F.trim(F.col("pattern").cast("string")))
    e = entries.select(
        F.col("list_name").cast("string").alias("list_name"),
        F.concat(
            F.lower("kind"),
            F.lit(":"),
            F.regexp_replace(F.regexp_replace(pattern, r"^[a-z][a-z0-9+.-]*://", ""), r"/+$", ""),
        ).alias("key"),
        (F.lower("action") == "add").alias("listed"),
        F.col("entry_date").cast("date").alias("day"),
    ).where(
        F.lower("kind").isin("host", "domain", "prefix")
        & F.lower("action").isin("add", "remove")
        & F.col("list_name").isNotNull()
        & F.col("key").isNotNull()
        & F.col("day").isNotNull()
    )
    daily = e.groupBy("list_name", "key", "day").agg(F.min("listed").alias("listed"))
    w = Window.partitionBy("list_name", "key").orderBy("day")
    changes = daily.withColumn("before", F.lag("listed").over(w)).where(
        ~F.col("listed").eqNullSafe(F.col("before")) & (F.col("listed") | F.col("before").isNotNull())
    )
    spans = changes.withColumn("until", F.lead("day").over(w)).where("listed")
    return spans.select(
        "list_name", "key", F.col("day").alias("valid_from"), F.coalesce("until", F.lit(OPEN_END).cast("date")).alias("valid_to")
    )


def url_keys(url: Column) -> Column:
    """Every key a URL can be listed under: its host, its domains, its path prefixes."""
    low = F.lower(F.trim(url))
    rest = F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^?#]*)", 1)
    host = F.regexp_extract(rest, r"^([^/:]*)", 1)
    path = F.regexp_replace(F.regexp_replace(rest, r"^[^/]*", ""), r"/+$", "")
    labels, steps = F.split(host, r"\."), F.split(path, "/")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda i: F.concat(F.lit("prefix:"), host, F.array_join(F.slice(steps, F.lit(1), i), "/")),
    )
    return F.when(
        F.length(host) > 0,
        F.array_distinct(F.concat(F.array(F.concat(F.lit("host:"), host)), domains, prefixes)),
    )


def filter_captures(
    captures: DataFrame,
    entries: DataFrame,
    url_col: str = "url",
    fetched_col: str = "fetched_on",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``captures`` with ``lists`` (sorted names active at fetch time) and ``blocked``.

    Each distinct (URL, date) is judged once. Intervals are split at year ends and
    joined by (key, year) with the date test as residual, so a capture meets at most
    the intervals one key has within one year (under 184 per list). The intervals are
    written first and measured: up to ``broadcast_bytes`` they meet the keys where these
    are made, and only hits shuffle; beyond, both sides shuffle by (key, year), where a hot
    host's rows stay an ordinary join key that adaptive execution can split. Captures with a
    null URL, a URL without a host or a null date match nothing; repeated rows all stay;
    empty inputs are fine; columns named ``lists`` or ``blocked`` are replaced; a very
    long URL has one key for each of its path steps.
    """
    spark = captures.sparkSession
    scratch = Scratch(spark, "urllists")
    kept = [c for c in captures.columns if c not in ("lists", "blocked")]
    seen = captures.select(
        F.col(url_col).cast("string").alias("__url"), F.col(fetched_col).cast("date").alias("__day")
    ).where("__url is not null and __day is not null")
    # a number of partitions of our own: keys are many times their URLs, which adaptive
    # execution would gather into one task by the size of the URLs
    seen = seen.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "__url", "__day").distinct()
    asked = seen.select("__url", "__day", F.year("__day").alias("year"), F.explode(url_keys(F.col("__url"))).alias("key"))
    years = captures.agg(F.min(F.year(F.col(fetched_col).cast("date"))), F.max(F.year(F.col(fetched_col).cast("date")))).first()
    first, last = years if years[0] is not None else (1, 0)
    start = F.greatest(F.year("valid_from"), F.lit(first))
    end = F.least(F.year("valid_to"), F.lit(last))
    yearly = validity_intervals(entries).where(start <= end).select(
        "list_name", "key", "valid_from", "valid_to", F.explode(F.sequence(start, end)).alias("year")
    )
    yearly = scratch.save(yearly)
    size = yearly.agg(F.sum(F.octet_length("list_name") + F.octet_length("key") + 64)).first()[0] or 0
    yearly = F.broadcast(yearly) if size <= broadcast_bytes else yearly
    hits = asked.join(yearly, ["key", "year"]).where("__day >= valid_from and __day < valid_to")
    verdicts = hits.groupBy("__url", "__day").agg(F.sort_array(F.collect_set("list_name")).alias("lists"))
    out = captures.select(
        *kept, F.col(url_col).cast("string").alias("__url"), F.col(fetched_col).cast("date").alias("__day")
    ).join(verdicts, ["__url", "__day"], "left")
    lists = F.coalesce("lists", F.array().cast("array<string>"))
    return out.select(*kept, lists.alias("lists"), (F.size(lists) > 0).alias("blocked"))
