"""O-06 ``generate_urls`` and O-06a ``interval_to_list``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_to_list(s: Column) -> Column:
    """'1-4' → [1,2,3,4]; comma-separated parts; only the first and last number of
    a part count ('1-3-7' → 1..7); '5' → [5]; a reversed part ('4-1') → []."""

    def part(p):
        bits = F.split(F.trim(p), "-")
        lo = F.trim(F.element_at(bits, 1)).cast("int")
        hi = F.trim(F.element_at(bits, -1)).cast("int")
        return F.when(hi < lo, F.array().cast("array<int>")).otherwise(F.sequence(lo, hi))

    return F.flatten(F.transform(F.split(s, ","), part))


#: Comma-separated parts of numbers joined by '-', with at least one '-'.
INTERVALS = r"^(?=.*-)\s*[0-9]+\s*(-\s*[0-9]+\s*)*(,\s*[0-9]+\s*(-\s*[0-9]+\s*)*)*$"


def expand_values(values: Column) -> Column:
    """One element list of ``generate_urls``: values made of numbers, ``-`` and ``,`` are
    intervals, everything else is taken literally."""
    return F.flatten(
        F.transform(
            values,
            lambda v: F.when(
                v.rlike(INTERVALS), F.transform(interval_to_list(v), lambda n: n.cast("string"))
            ).otherwise(F.array(v)),
        )
    )


_OPEN, _CLOSE = "\u0001", "\u0002"  # stand-ins for escaped braces while the template is cut


def template_parts(t: Column) -> Column:
    """A ``str.format`` template cut once into literals and placeholders:
    ``array<struct<literal, index>>``, each literal followed by the value of that index
    (null after the last). ``{}`` are numbered in order, ``{{`` and ``}}`` are literal."""
    protected = F.replace(F.replace(t, F.lit("{{"), F.lit(_OPEN)), F.lit("}}"), F.lit(_CLOSE))
    literals = F.split(protected, r"\{[0-9]*\}")
    marks = F.regexp_extract_all(protected, F.lit(r"\{([0-9]*)\}"), F.lit(1))

    def plain(x):
        return F.replace(F.replace(x, F.lit(_OPEN), F.lit("{")), F.lit(_CLOSE), F.lit("}"))

    def number(i):
        mark = F.get(marks, i)
        before = F.size(F.filter(F.slice(marks, F.lit(1), i), lambda m: m == ""))
        return F.when(mark == "", before).otherwise(mark.try_cast("int"))

    return F.transform(literals, lambda x, i: F.struct(plain(x).alias("literal"), number(i).alias("index")))


#: URLs made from one row of a range.
RANGE_URLS = 1 << 12


def generate_urls(
    df: DataFrame, template: str = "template", elements: str = "elements", range_urls: int = RANGE_URLS
) -> DataFrame:
    """O-06: every row's template × cartesian product of its element lists.

    Adds ``url_rank`` (0-based position in product order, last list varying fastest) and
    ``url``; ``{i}`` (or the i-th ``{}``) in the template is the i-th value, as in
    ``str.format``. Values are placed into the cut template, so braces inside a value stay
    as they are; a placeholder without a list stays as text. A value with a ``-`` that is
    no interval of numbers (``en-us``) is taken literally. A row without lists gives its
    template alone, a row with an empty list nothing; a product beyond 64 bits raises.

    A rank is a number in a mixed radix whose digits are the places in the lists, so each
    URL follows from its rank alone. The ranks of every row are cut into ranges of
    ``range_urls``, which are dealt evenly over the tasks: a product of any size is
    equal work for all, no row holds it, and no job asks how many lists there are.
    """
    lists = F.coalesce(F.transform(F.col(elements), expand_values), F.array().cast("array<array<string>>"))
    sizes = F.transform("_lists", lambda x: F.coalesce(F.size(x), F.lit(0)).cast("long"))

    def product(numbers):
        return F.aggregate(numbers, F.lit(1).cast("long"), lambda a, n: a * n)

    def divided(a, b):
        return F.call_function("div", a, b)

    def once(rows, name, value):
        """A column made once a row: behind an explode, the optimizer does not repeat it where it is used."""
        return rows.withColumn(name, F.explode(F.array(value)))

    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = F.lit(range_urls).cast("long")
    counted = once(once(df, "_lists", lists), "_total", product(sizes)).drop("_lists").where("_total > 0")
    ranges = counted.withColumn("_range", F.explode(F.sequence(F.lit(0).cast("long"), divided(F.col("_total") - 1, step))))
    ends = F.least(F.col("_total"), (F.col("_range") + 1) * step) - 1
    worth = F.transform("_sizes", lambda _, i: product(F.slice("_sizes", i + 2, F.size("_sizes"))))
    # the lists are made again behind the exchange, which carries intervals, not their values
    dealt = once(once(ranges.repartition(spread), "_lists", lists), "_sizes", sizes)
    rows = once(once(dealt, "_worth", worth), "_parts", template_parts(F.col(template)))

    def value(rank, index):
        digit = divided(rank, F.get("_worth", index)) % F.get("_sizes", index)
        return F.get(F.get("_lists", index), digit.cast("int"))

    def placed(rank, p):
        text = F.coalesce(value(rank, p["index"]), F.concat(F.lit("{"), p["index"].cast("string"), F.lit("}")))
        return F.concat(p["literal"], F.when(p["index"].isNull(), F.lit("")).otherwise(text))

    def url(rank):
        text = F.array_join(F.transform("_parts", lambda p: placed(rank, p)), "")
        return F.struct(rank.alias("url_rank"), text.alias("url"))

    # a range's URLs are made in one array, so its lists are not copied for each of them
    urls = F.transform(F.sequence(F.col("_range") * step, ends), url)
    return rows.select(*df.columns, F.inline(urls))
