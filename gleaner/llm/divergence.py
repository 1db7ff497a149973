"""Source divergence audit by a frequent-pattern tree of term rows (operator 12).

How far do the sources of a language differ in their terms? Every (language, source) group
gives each kept term a smoothed share p, scaled to integers; two groups differ by the sum
of f(p, q) = floor((p - q)^2 / (p + q)) over all V kept terms. Most counts are zero, and a
zero count has the same share p0 for all terms of a group, so

    sum = V f(p0, q0)
        + sum over the terms of the one   of f(p, q0) - f(p0, q0)
        + sum over the terms of the other of f(p0, q) - f(p0, q0)
        + sum over the terms of both      of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

The first three need a group's histogram of counts. The last goes over a tree: a term is a
row of its nonzero (source, count) entries in source order; equal rows collapse to one with
a multiplicity; rows are inserted into a prefix tree, whose nodes hold the multiplicity of
all terms below, and each node is corrected once against each of its ancestors, all nodes
of a depth step at a time. Rows are range-partitioned and sorted, so equal prefixes lie
together, and a task builds the tree of a bounded run of rows at a time; cut anywhere, the
sums add up to the same.

All arithmetic is in integers: shares of at most 10^9 + 1, in 64 bits, their products of
counts in decimals of 38 digits.

Null text, language and source read as ''. Texts without terms (empty, any length) count as
rows of their group; a repeated row counts as often as it stands; ties in value are ranked
by term or source; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.scratch import Scratch
from gleaner.llm.text import pieces

#: Documents of its language that a kept term is in, at least.
MIN_DOCS = 10
#: Ranks of the ``term`` part.
TOP = 10
SCALE = 1_000_000_000
#: Entries a task gathers before it passes them on.
HELD = 400_000
#: Rows of one tree, and the cells (rows by entries of the longest) it is cut at.
TREE_ROWS, TREE_CELLS = 4096, 1_000_000
#: Terms are runs of letters A-Z and characters beyond ASCII: other bytes become spaces.
LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order, A-Z lower-cased."""
    return text.translate(LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n`` (occurrences), ``docs`` (documents that hold it).

    A task sums before it shuffles, ``HELD`` entries at a time. The term '' stands for the
    group itself, so groups without terms are there too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, rows = defaultdict(lambda: (Counter(), Counter())), 0, Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (occurrences, documents) in seen.items():
                found = [b"", *documents]
                n = [0, *map(occurrences.__getitem__, documents)]
                d = [rows[lang, source], *documents.values()]
                for at in range(0, len(found), 10_000):
                    part = slice(at, at + 10_000)
                    size = len(found[part])
                    yield pa.record_batch(
                        [pa.array([lang] * size), pa.array([source] * size), pa.array(found[part], pa.binary()).cast(pa.string()),
                         pa.array(n[part], pa.int64()), pa.array(d[part], pa.int64())],
                        ["lang", "source", "term", "n", "docs"],
                    )
            seen.clear()
            rows.clear()

        for b in pieces(batches):
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
                occurrences, documents = seen[lang, source]
                rows[lang, source] += 1
                found, before = terms(text), len(documents)
                occurrences.update(found)
                documents.update(set(found))
                held += len(documents) - before
                if held >= HELD:
                    yield from out()
                    held = 0
        yield from out()

    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    read = docs.select(plain("lang").alias("lang"), plain("source").alias("source"), plain("text").cast("binary").alias("text"))
    counted = read.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), exactly."""
    over = f"cast({SCALE} as decimal(10, 0)) * cast({n} + 2 as decimal(20, 0))"
    return F.expr(f"1 + ({over}) div cast({total} + 2 * {kept} as decimal(20, 0))")


def f(p: np.ndarray | int, q: np.ndarray | int) -> np.ndarray | int:
    """floor((p - q)^2 / (p + q)) of 64-bit integers."""
    return (p - q) * (p - q) // (p + q)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` or a little more."""
    held: list = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def tree_part(times: np.ndarray, starts: np.ndarray, node: np.ndarray, p: np.ndarray, p0: np.ndarray, source: np.ndarray):
    """``own, ancestor, value``: corrections of the tree of some sorted rows, by source number.

    Row k's entries lie from ``starts[k]`` to ``starts[k + 1]``; entries of equal ``node`` numbers are
    equal. A row shares the nodes of the one before as far as their entries are equal.
    """
    lengths = np.diff(starts)
    at = np.arange(lengths.max(initial=0))
    here = at < lengths[:, None]
    table = np.full(here.shape, -1)
    table[here] = node
    new = np.ones(here.shape, bool)
    new[1:] = np.cumsum(table[1:] != table[:-1], 1) > 0
    new &= here
    # each entry's node in the tree: its own if new, else that of the row before
    number = np.zeros(here.shape, np.int64)
    number[new] = np.arange(new.sum())
    number = np.maximum.accumulate(number, 0)
    parent = np.full(here.shape, -1)
    parent[:, 1:] = number[:, :-1]
    below = np.zeros(new.sum(), np.int64)
    np.add.at(below, number[here], np.repeat(times, lengths))
    of = new[here]
    p, p0, source, parent = p[of], p0[of], source[of], parent[new]
    # all nodes against their parents, then against the parents of those, up to the roots
    nodes, up = np.arange(len(p)), parent
    while len(nodes := nodes[up >= 0]):
        up = up[up >= 0]
        x, x0, y, y0 = p[nodes], p0[nodes], p[up], p0[up]
        yield source[nodes], source[up], below[nodes] * (f(x, y) - f(x, y0) - f(x0, y) + f(x0, y0))
        up = parent[up]


def tree_sums(rows: DataFrame) -> DataFrame:
    """``lang, a, b, value``: parts of the corrections of terms that both sources hold.

    ``rows`` holds ``lang``, ``row`` (entries ``source, n, p, p0`` in source order) and
    ``times``, each row once, sorted in its partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, TREE_ROWS):
            lang, entries = b["lang"].dictionary_encode(), b["row"].flatten()
            starts = np.concatenate([[0], np.cumsum(pc.list_value_length(b["row"]).to_numpy())])
            name = entries.field("source").dictionary_encode()
            width = len(name.dictionary)
            # a source of one language is not that of another
            source = name.indices.to_numpy() + np.repeat(lang.indices.to_numpy(), np.diff(starts)).astype(np.int64) * width
            count, p, p0 = (entries.field(c).to_numpy() for c in ("n", "p", "p0"))
            node = np.unique(np.stack([source, count]), axis=1, return_inverse=True)[1].ravel()
            times, sums, first = b["times"].to_numpy(), [], 0
            while first < b.num_rows:
                last = first + max(1, np.searchsorted(np.maximum.accumulate(np.diff(starts)[first:]) * np.arange(1, b.num_rows - first + 1), TREE_CELLS))
                part = slice(starts[first], starts[last])
                sums += tree_part(times[first:last], starts[first : last + 1] - starts[first], node[part], p[part], p0[part], source[part])
                first = last
            if sums:
                own, other, value = (np.concatenate(c) for c in zip(*sums))
                size = width * len(lang.dictionary)
                pair, to = np.unique(own * size + other, return_inverse=True)
                total = np.zeros(len(pair), np.int64)
                np.add.at(total, to, value)
                a, other = pair // size, pair % size
                names = [name.dictionary.take(pa.array(x % width)) for x in (a, other)]
                yield pa.record_batch([lang.dictionary.take(pa.array(a // width)), *names, pa.array(total)], ["lang", "a", "b", "value"])

    return rows.mapInArrow(run, "lang string, a string, b string, value long")


def own_sums(groups: DataFrame) -> DataFrame:
    """``lang, a, b, all, own``: V f(p0, q0), and what the terms of ``a`` add where ``b`` counts zero.

    ``groups`` holds ``lang, source, kept, p0``, ``counts`` (structs ``p, terms``, one per
    distinct count) and ``others`` (structs ``source, p0`` of the language's sources). A group of N
    occurrences has at most sqrt(2N) distinct counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            lang, source, kept, p0 = (b[c][0].as_py() for c in ("lang", "source", "kept", "p0"))
            counts, others = b["counts"].flatten(), b["others"].flatten()
            p, times = counts.field("p").to_numpy(), counts.field("terms").to_numpy()
            names, q0 = others.field("source"), others.field("p0").to_numpy()
            base = f(np.int64(p0), q0)
            own = np.zeros(len(q0), np.int64)
            for at in range(0, len(p), 4096):
                part = slice(at, at + 4096)
                for k in range(len(q0)):
                    own[k] += (times[part] * (f(p[part], q0[k]) - base[k])).sum()
            size = len(q0)
            yield pa.record_batch(
                [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), names, pa.array(kept * base), pa.array(own)],
                ["lang", "a", "b", "all", "own"],
            )

    return groups.mapInArrow(run, "lang string, a string, b string, all long, own long")


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every (language, source) group of ``docs``.

    Part ``pair`` ranks the other sources of the language by divergence, part ``term`` the ``top``
    terms that set the group apart from its language as a whole (shares above the language's).
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = scratch.save(term_counts(docs))
    # a term's row holds an entry per source that has it
    kept = scratch.save(
        counts.where("term != ''")
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"), F.collect_list(F.struct("source", "n")).alias("row"))
        .where(F.col("docs") >= min_docs)
        .select("lang", "term", "n_lang", "row")
    )
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n_lang").alias("total_lang"))
    entries = kept.select("lang", "term", "n_lang", F.inline("row"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = scratch.save(
        counts.where("term = ''")
        .select("lang", "source")
        .join(totals, ["lang", "source"], "left")
        .join(vocabulary, "lang", "left")
        .fillna(0, ["total", "kept", "total_lang"])
        # without kept terms no share is used
        .withColumn("p0", F.when(F.col("kept") > 0, share("0", "total", "greatest(kept, 1)")).otherwise(1))
    )
    known = entries.join(groups, ["lang", "source"])
    shared = scratch.save(
        known.select(
            "lang", "term", "source", "n", "p0",
            share("n", "total", "kept").alias("p"),
            share("n_lang", "total_lang", "kept").alias("q"),
        )
    )
    apart = _ranked(
        shared.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    ).where(F.col("rank") <= top)

    entry = F.struct("source", "n", "p", "p0")
    rows = shared.groupBy("lang", "term").agg(F.array_sort(F.collect_list(entry)).alias("row"))
    rows = rows.where(F.size("row") > 1).groupBy("lang", "row").agg(F.count("*").alias("times"))
    both = tree_sums(rows.repartitionByRange("lang", "row").sortWithinPartitions("lang", "row"))

    histogram = shared.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    histogram = histogram.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "terms")).alias("counts"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "p0")).alias("others"))
    none = F.array().cast("array<struct<p:bigint,terms:bigint>>")
    wide = groups.join(histogram, ["lang", "source"], "left").join(others, "lang")
    own = scratch.save(
        own_sums(wide.select("lang", "source", "kept", "p0", F.coalesce("counts", none).alias("counts"), "others")).where("a != b")
    )
    both = scratch.save(both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    sums = (
        own.select("lang", "a", "b", (F.col("all") + F.col("own")).alias("value"))
        .unionByName(own.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("own").alias("value")))
        .unionByName(both)
        .unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    )
    pairs = _ranked(
        sums.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))
    )

    def part(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")

    return part(pairs, "pair").unionByName(part(apart, "term"))
