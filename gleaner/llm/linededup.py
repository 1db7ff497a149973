"""Near-duplicate lines by a segment-partition edit join (operator 6).

A line of n characters is cut into ``limit + 1`` even segments. If two lines are within
``limit`` edits, one segment of the shorter occurs whole in the longer, close to its own
place. Each line is indexed under its segments (length, number, content) and probes,
for every length within ``limit`` below its own, the few substrings that can match
(the multi-match-aware windows of segment partitioning). Lines that meet are verified
by banded bit-parallel edit distance.

Index entries and probes are hashed in tasks and sorted into hash ranges ("slices").
Each carries a 64-bit profile of its line, the numbers of characters of 16 kinds; as one
edit moves two of them by one, lines whose profiles differ by more than twice the limit
cannot be within it. Only lines that meet with close profiles leave a slice. A key of many
lines (templates) is told by a sample beforehand: its index entries and its probes are cut
into blocks, and every pair of blocks is a group of its own. Equal lines are one class: they are told by two
64-bit hashes, counted with partial aggregation, and join once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.editdistance import within
from gleaner.llm.lm import edges, pack_hashes, unpack_hashes
from gleaner.llm.scratch import Scratch, ship
from gleaner.llm.text import pieces

#: White space trimmed from both ends of a line; the line feed separates lines.
EDGES = " \t\x0b\x0c\r"
#: Seed under which xxHash64 of a line equals Spark's ``xxhash64`` of it.
SPARK_SEED = 42
#: Pairs that a task holds before it writes them out.
PAIR_ROWS = 500_000


def parts(n: int, limit: int) -> list[tuple[int, int]]:
    """Start and length of the even segments of ``n`` characters; longer ones are last."""
    base, longer = divmod(n, limit + 1)
    out, at = [], 0
    for k in range(limit + 1):
        size = base + (k >= limit + 1 - longer)
        out.append((at, size))
        at += size
    return out


def probe_places(own: int, indexed: int, limit: int) -> list[tuple[int, int, int]]:
    """``number, start, length`` of the substrings a line of ``own`` characters probes for lines of ``indexed``."""
    shift = own - indexed
    out = []
    for k, (at, size) in enumerate(parts(indexed, limit)):
        low = max(at - k, at + shift - (limit - k), 0)
        high = min(at + k, at + shift + (limit - k), own - size)
        out += [(k, p, size) for p in range(low, high + 1)]
    return out


def profile(line: str) -> int:
    """Characters of each of 16 kinds, modulo 16, four bits each."""
    kinds = np.bincount(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) & 15, minlength=16)
    return int(np.bitwise_or.reduce((kinds.astype(np.uint64) & np.uint64(15)) << SHIFTS))


SHIFTS = np.arange(0, 64, 4, dtype=np.uint64)


def close(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Which profiles of ``a`` (rows) and ``b`` (columns) allow ``limit`` edits."""
    x, y = (((p[:, None] >> SHIFTS) & np.uint64(15)).astype(np.int8) for p in (a, b))
    apart = np.abs(x[:, None, :] - y[None, :, :])
    return np.minimum(apart, 16 - apart).sum(2, dtype=np.int16) <= 2 * limit


class Plans(dict):
    """Line length to its substrings ``start, end, seed``: index entries first, then probes."""

    def __init__(self, limit: int, min_chars: int):
        super().__init__()
        self.limit, self.min_chars = limit, min_chars

    def __missing__(self, n: int) -> tuple[list, int]:
        # the seed carries (indexed length, segment number), so one hash is the whole key
        seed = lambda length, k: length * (self.limit + 1) + k
        index = [(a, a + s, seed(n, k)) for k, (a, s) in enumerate(parts(n, self.limit))]
        probes = [
            (p, p + s, seed(m, k))
            for m in range(max(self.min_chars, n - self.limit), n + 1)
            for k, p, s in probe_places(n, m, self.limit)
        ]
        if len(self) > 100_000:
            self.clear()
        plan = self[n] = (index + [x for x in probes if x not in index], len(index))
        return plan


class Hot(NamedTuple):
    """Keys of many lines, ascending: the number of their first group, and into how many
    blocks their index entries and probes are cut. A pair of blocks is a group."""

    keys: np.ndarray
    first: np.ndarray
    index_blocks: np.ndarray
    probe_blocks: np.ndarray


def hot_keys(docs: DataFrame, limit: int, min_chars: int, slices: int, block_entries: int, sample: int) -> Hot:
    """Keys of more than ``block_entries`` entries and probes, by one distinct line in ``sample``.

    The estimate decides only how keys are cut, not what is compared. Driver and tasks hold
    32 bytes for each of the keys, of which there are at most 12 per ``block_entries`` lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, hashed = Plans(limit, min_chars), xxhash.xxh3_64_intdigest
        for b in pieces(batches, 2000):
            keys, own = [], []
            for line in b["line"].to_pylist():
                plan, n_index = plans[len(line)]
                keys += [hashed(line[a:e], seed) for a, e, seed in plan]
                own += [k < n_index for k in range(len(plan))]
            key = pa.array(np.array(keys, np.uint64).view(np.int64), pa.int64())
            yield pa.record_batch([key, pa.array(np.array(own, np.int32), pa.int32())], ["key", "own"])

    lines = line_rows(docs).select("line").where(F.length("line") >= min_chars)
    lines = lines.where(F.pmod(F.xxhash64(F.lit("sample"), "line"), F.lit(sample)) == 0).distinct()
    counts = lines.mapInArrow(run, "key long, own int").groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.sum("own").alias("own"))
    found = counts.where(F.col("all") * sample > block_entries).where("own > 0").collect()
    found.sort(key=lambda r: r["key"] % (1 << 64))
    blocks = lambda c: np.array([-(-r[c] * sample // block_entries) for r in found], np.int64)
    i, j = blocks("own"), blocks("all")
    return Hot(np.array([r["key"] for r in found], np.int64).view(np.uint64), slices + np.cumsum(i * j) - i * j, i, j)


def entries(docs: DataFrame, limit: int, min_chars: int, slices: int, buffer_lines: int, hot: Hot) -> DataFrame:
    """``slice, keys, lines, profiles, indexed`` of the entries and probes of every buffer of distinct lines.

    Slices from ``slices`` on are pairs of blocks of a ``hot`` key.
    """
    names = ["slice", "keys", "lines", "profiles", "indexed"]
    kind = pa.schema([("slice", pa.int32()), *((n, pa.binary()) for n in names[1:])])
    cuts_at = edges(slices)

    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def deal(keys: list, lines: list, profiles: list, counts: list, indexed: list) -> Iterator[pa.RecordBatch]:
        key = np.array(keys, np.uint64)
        line, shape = (np.repeat(np.array(x, np.uint64), counts) for x in (lines, profiles))
        first = np.repeat(np.cumsum(counts) - counts, counts)
        is_index = np.arange(len(key)) - first < np.repeat(indexed, counts)
        order = np.argsort(key)
        key, line, shape, is_index = key[order], line[order], shape[order], is_index[order]

        def row(k: int, at) -> dict:
            cols = pack_hashes(key[at]), line[at].tobytes(), shape[at].tobytes(), np.packbits(is_index[at]).tobytes()
            return dict(zip(names, (k, *cols)))

        hot = shared.value
        begins, ends = np.searchsorted(key, hot.keys, "left"), np.searchsorted(key, hot.keys, "right")
        for k in np.flatnonzero(begins < ends).tolist():
            at = np.arange(begins[k], ends[k])
            n_i, n_j, group = int(hot.index_blocks[k]), int(hot.probe_blocks[k]), int(hot.first[k])
            block_i, block_j = line[at] % np.uint64(n_i), (line[at] >> np.uint64(32)) % np.uint64(n_j)
            own = is_index[at].copy()
            for i in range(n_i):
                rows = []
                for j in range(n_j):
                    # an index entry is a probe too: its key's index entries of other blocks are met by it
                    a, b = at[own & (block_i == i)], at[block_j == j]
                    if len(a) or len(b):
                        rows.append(row(group + i * n_j + j, np.r_[a, b]) | {"indexed": np.packbits(np.arange(len(a) + len(b)) < len(a)).tobytes()})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)
        if (begins < ends).any():
            place = np.minimum(np.searchsorted(hot.keys, key), len(hot.keys) - 1)
            cold = hot.keys[place] != key
            key, line, shape, is_index = key[cold], line[cold], shape[cold], is_index[cold]
        cuts = np.r_[np.searchsorted(key, cuts_at), len(key)]
        rows = [row(k, slice(i, j)) for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if i < j]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = Plans(limit, min_chars)
        hashed, line_hash = xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest
        seen, keys, lines, profiles, counts, indexed = set(), [], [], [], [], []
        for b in pieces(batches):
            for text in b["text"].to_pylist():
                for line in (text or "").split("\n"):
                    line = line.strip(EDGES)
                    if len(line) < min_chars:
                        continue
                    h = line_hash(line, SPARK_SEED)
                    if h in seen:
                        continue
                    seen.add(h)
                    plan, n_index = plans[len(line)]
                    keys += [hashed(line[a:e], seed) for a, e, seed in plan]
                    lines.append(h)
                    profiles.append(profile(line))
                    counts.append(len(plan))
                    indexed.append(n_index)
                if len(lines) >= buffer_lines:
                    yield from deal(keys, lines, profiles, counts, indexed)
                    seen, keys, lines, profiles, counts, indexed = set(), [], [], [], [], []
        if lines:
            yield from deal(keys, lines, profiles, counts, indexed)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        run, "slice int, keys binary, lines binary, profiles binary, indexed binary"
    )


def met(group: pd.DataFrame, limit: int, slices: int) -> Iterator[pd.DataFrame]:
    """Pairs of lines of a slice of which one probes what the other is indexed under, profiles close.

    In a group of a hot key (``slices`` or more) index entries meet the probes only, as
    each is a probe in one of the groups too.
    """
    hot = group["slice"].iloc[0] >= slices
    key = np.concatenate([unpack_hashes(x) for x in group["keys"]])
    line, shape = (np.concatenate([np.frombuffer(x, np.uint64) for x in group[c]]) for c in ("lines", "profiles"))
    sizes = [len(x) // 8 for x in group["lines"]]
    is_index = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(group["indexed"], sizes)])
    order = np.lexsort((1 - is_index, line, key))
    key, line, shape, is_index = key[order], line[order], shape[order], is_index[order]
    # an entry both indexed and probing counts as indexed: index entries probe their own length
    single = np.r_[True, (key[1:] != key[:-1]) | (line[1:] != line[:-1]) | (hot & (is_index[1:] != is_index[:-1]))]
    key, line, shape, is_index = key[single], line[single], shape[single], is_index[single]
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[begins[1:], len(key)]
    several = (ends - begins > 1) & (np.add.reduceat(is_index, begins) > 0)
    u, v, n = [], [], 0

    def pairs() -> pd.DataFrame:
        p = np.unique(np.stack([np.concatenate(u), np.concatenate(v)]), axis=1).astype(np.uint64).view(np.int64)
        return pd.DataFrame({"u": p[0], "v": p[1]})

    for i, j in zip(begins[several], ends[several]):
        own = i + np.flatnonzero(is_index[i:j])
        rest = i + np.flatnonzero(is_index[i:j] == 0) if hot else np.arange(i, j)
        for at in range(0, len(own), 64):
            for to in range(0, len(rest), 4096):
                block, others = own[at : at + 64], rest[to : to + 4096]
                x, y = np.nonzero(close(shape[block], shape[others], limit))
                a, b = line[block[x]], line[others[y]]
                u.append(np.minimum(a, b)[a != b])
                v.append(np.maximum(a, b)[a != b])
                n += len(u[-1])
                if n >= PAIR_ROWS:
                    yield pairs()
                    u, v, n = [], [], 0
    if n:
        yield pairs()


def verified(pairs: DataFrame, texts: DataFrame, limit: int) -> DataFrame:
    """Pairs within ``limit`` edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2000):
            if b.num_rows:
                keep = pa.array(within(b["tu"].to_pylist(), b["tv"].to_pylist(), limit) <= limit)
                yield pa.record_batch([b["u"].filter(keep), b["v"].filter(keep)], ["u", "v"])

    of = lambda c: texts.select(F.col("h").alias(c), F.col("line").alias("t" + c))
    return pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long")


def line_rows(docs: DataFrame) -> DataFrame:
    """``id, line_no, line`` of every line, trimmed."""
    lines = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).alias("line_no", "raw"),
    )
    return lines.select("id", "line_no", F.btrim("raw", F.lit(EDGES)).alias("line"))


def near_lines(
    docs: DataFrame,
    limit: int = 2,
    min_chars: int = 20,
    min_repeats: int = 2,
    slice_bytes: int = 24 << 20,
    buffer_lines: int = 20_000,
    block_entries: int = 32_000,
    hot_sample: int = 16,
) -> DataFrame:
    """``doc_id, line_no, n_chars, class_doc, class_line, n_copies, n_links, kept`` of every line.

    Lines are split at line feeds and trimmed of ASCII white space. ``class_doc`` and
    ``class_line`` name the first of the equal lines, ``n_copies`` counts them and
    ``n_links`` counts the different texts within ``limit`` edits. Every line that is not
    empty has its class; lines of ``limit + 1`` characters or more are joined, as shorter
    ones would link to anything. A line of at least ``min_chars`` characters is removed
    (``kept`` false) if it is not the first of its class, or if a linked text starts
    earlier, provided that class and linked texts have ``min_repeats`` lines in all.
    Shorter lines are counted and linked but kept: they are no passages. Null
    and empty texts are one empty line. Null ids come first. Rows of one id are one
    document: its line is not a repeat of itself. Empty tables give an empty result; other
    columns are not read.
    """
    joined = limit + 1
    min_chars = max(min_chars, joined)
    scratch = Scratch(docs.sparkSession, "linededup")
    rows = scratch.save(
        line_rows(docs).select(
            "id",
            "line_no",
            F.length("line").alias("n"),
            F.xxhash64("line").alias("h"),
            F.xxhash64(F.lit("second"), "line").alias("h2"),
        )
    )
    where = F.struct("id", "line_no")
    classes = scratch.save(
        rows.where(F.col("n") > 0).groupBy("h", "h2").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("copies"))
    )
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, math.ceil(n_bytes / slice_bytes))
    hot = hot_keys(docs, limit, joined, slices, block_entries, hot_sample)
    dealt = entries(docs, limit, joined, slices, buffer_lines, hot)

    def slice_pairs(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from met(pd.concat(list(groups)), limit, slices)

    pairs = scratch.save(dealt.groupBy("slice").applyInPandas(slice_pairs, "u long, v long").distinct())
    ends = pairs.select(F.col("u").alias("h")).union(pairs.select(F.col("v").alias("h"))).distinct()
    texts = scratch.save(
        line_rows(docs)
        .where(F.length("line") >= joined)
        .select(F.xxhash64("line").alias("h"), "line")
        .join(ship(ends), "h", "left_semi")
        .dropDuplicates(["h"])
    )
    links = scratch.save(verified(pairs, texts, limit))
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    other = classes.select(F.col("h").alias("v"), F.col("first").alias("before"), F.col("copies").alias("more"))
    linked = both.join(other, "v").groupBy(F.col("u").alias("h")).agg(
        F.count(F.lit(1)).alias("links"), F.min("before").alias("before"), F.sum("more").alias("more")
    )
    judged = classes.join(linked, "h", "left")
    out = rows.join(judged, ["h", "h2"], "left")
    total = F.col("copies") + F.coalesce("more", F.lit(0))
    again = (where != F.col("first")) | F.coalesce(F.col("before") < F.col("first"), F.lit(False))
    return out.select(
        F.col("id").alias("doc_id"),
        "line_no",
        F.col("n").alias("n_chars"),
        F.coalesce("first.id", "id").alias("class_doc"),
        F.coalesce("first.line_no", "line_no").alias("class_line"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
        (~F.coalesce((F.col("n") >= min_chars) & F.col("first").isNotNull() & (total >= min_repeats) & again, F.lit(False))).alias("kept"),
    )


def without_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``docs`` with the lines that are not ``kept`` cut from their texts.

    Texts that lose no line stay as they are; a text that loses all its words goes with
    its row. Columns keep their order; ``n_chars``, if there is one, is counted anew.
    """
    gone = lines.where(~F.col("kept") & F.col("doc_id").isNotNull())
    per_doc = gone.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line_no").alias("__gone"))
    # as many rows as lines that go, each of a few bytes: broadcast only if proven under 64 MB
    per_doc = F.broadcast(per_doc) if gone.limit(2_000_001).count() <= 2_000_000 else per_doc
    joined = docs.join(per_doc, docs["doc_id"].cast("long") == F.col("__id"), "left")
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("__gone"), i))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    cut = joined.withColumn("text", text).where(F.col("__gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)
