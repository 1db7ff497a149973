"""Benchmark decontamination with a BM25 inverted index and block-max WAND (operator 9).

Test items are indexed with BM25 weights, scaled so that an item scores 1 against
itself. Every training passage is a query: a window of words, half-overlapping, wide
enough to hold any item of its index whole. Block-max WAND returns every item that
scores at least ``min_score``, and each is verified by the word shingles that its
question and its answer share with the passage.

Index weights are computed by Spark over all items. Items are indexed by length class,
as windows follow the class; beyond ``index_bytes`` of item text they are dealt into
shards. A shard is gathered, broadcast, searched for in every text and taken back before
the next, so driver and executors hold one shard at a time.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.scratch import Scratch, ship
from gleaner.llm.text import words

PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&-_=+/\\"
#: Item lengths in words: class k holds items of less than CLASS_BASE ** (k + 1) words.
CLASS_BASE = 4
BLOCK = 4
SHINGLE = 5
#: Windows of a text that are bounded at once, and cells of window and block at most.
WINDOWS, CELLS = 256, 1 << 16
EPS = 1e-9
HITS = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"


class Index:
    """Postings in rows sorted by term and item, cut into blocks of BLOCK consecutive items.

    ``block_*`` has a row for each term and block that meet: the block, the largest weight
    and where its postings begin and end. Rows of term t are ``ptr[t]`` to ``ptr[t + 1]``.
    """

    def __init__(self, numbers: dict[bytes, int], postings: dict[int, list], texts: dict[int, list], window: int):
        self.window, self.stride = window, window // 2
        self.item_ids = sorted(texts)
        rows = sorted((numbers[t], k, w) for k, i in enumerate(self.item_ids) for t, w in postings[i])
        term, self.items, self.weights = (np.array(x) for x in zip(*rows))
        block = self.items // BLOCK
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])])
        self.block_no = block[first]
        self.block_max = np.maximum.reduceat(self.weights, first)
        self.block_lo, self.block_hi = first, np.r_[first[1:], len(rows)]
        self.ptr = np.searchsorted(term[first], np.arange(len(numbers) + 1))
        self.n_blocks = -(-len(self.item_ids) // BLOCK)
        #: The largest weight of each term; the last slot stands for unknown words.
        self.most = np.zeros(len(numbers) + 1)
        np.maximum.at(self.most, term[first], self.block_max)
        self.parts = {i: split_item(t) for i, t in texts.items()}


class Shard:
    """Items of one broadcast: a vocabulary, and an index for each length class."""

    def __init__(self, items: list):
        vocabulary = sorted({p["term"].encode() for r in items for p in r["postings"]})
        self.numbers = {t: k for k, t in enumerate(vocabulary)}
        self.indexes = []
        for cls in sorted({r["cls"] for r in items}):
            own = [r for r in items if r["cls"] == cls]
            postings = {r["item_id"]: [(p["term"].encode(), p["w"]) for p in r["postings"]] for r in own}
            texts = {r["item_id"]: [(t["word"].encode(), t["ends"]) for t in r["tokens"]] for r in own}
            self.indexes.append(Index(self.numbers, postings, texts, 2 * CLASS_BASE ** (cls + 1)))


def split_item(tokens: list[tuple[bytes, bool]]) -> tuple[set, set]:
    """Shingles of an item's question (all but the last sentence) and of its answer (the last).

    A one-sentence item is all question.
    """
    ends = [k + 1 for k, (_, end) in enumerate(tokens[:-1]) if end]
    cut = ends[-1] if ends else len(tokens)
    plain = [w for w, _ in tokens]
    return shingles(plain[:cut]), shingles(plain[cut:])


def shingles(w: Sequence[bytes]) -> set:
    """Distinct runs of SHINGLE words; a shorter sequence is one run."""
    if not w:
        return set()
    n = min(SHINGLE, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def block_max_wand(index: Index, terms: np.ndarray, least: float) -> list[tuple[int, float]]:
    """Every (item, score) with score >= ``least`` for a query of distinct ``terms``.

    Blocks whose maxima add up to less are skipped whole; within a live block, document-
    at-a-time WAND picks pivots by the terms' block maxima.
    """
    least -= EPS
    rows = spread(index.ptr[terms], index.ptr[terms + 1] - index.ptr[terms])
    blocks = index.block_no[rows]
    bounds = np.bincount(blocks, weights=index.block_max[rows], minlength=index.n_blocks)
    found = []
    for block in np.flatnonzero(bounds >= least):
        live = rows[blocks == block]
        cursors = [
            [index.items[a:b].tolist(), index.weights[a:b].tolist(), most, 0]
            for a, b, most in zip(index.block_lo[live], index.block_hi[live], index.block_max[live])
        ]
        found += _wand(cursors, least)
    return [(index.item_ids[i], score) for i, score in found]


def _wand(cursors: list, least: float) -> list[tuple[int, float]]:
    """WAND over cursors ``[items, weights, largest weight, position]``."""
    found = []
    while cursors:
        cursors.sort(key=lambda c: c[0][c[3]])
        bound, pivot = 0.0, None
        for c in cursors:
            bound += c[2]
            if bound >= least:
                pivot = c[0][c[3]]
                break
        if pivot is None:
            break
        if cursors[0][0][cursors[0][3]] == pivot:
            score = sum(c[1][c[3]] for c in cursors if c[0][c[3]] == pivot)
            if score >= least:
                found.append((pivot, score))
            to = pivot + 1
        else:
            to = pivot
        for c in cursors:
            if c[0][c[3]] >= to:
                break
            c[3] = bisect.bisect_left(c[0], to, c[3])
        cursors = [c for c in cursors if c[3] < len(c[0])]
    return found


def term_numbers(texts: pa.Array, vocabulary: pa.Array) -> list[np.ndarray]:
    """Of each text (bytes) the term numbers of its words, bare punctuation left out: -1 for words the index lacks."""
    kind = pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()
    # the ASCII kernels read strings as bytes
    plain = pa.Array.from_buffers(kind, len(texts), texts.buffers(), offset=texts.offset)
    split = pc.ascii_split_whitespace(plain)
    bare = pc.ascii_trim(split.flatten(), characters=PUNCTUATION)
    ids = pc.fill_null(pc.index_in(bare, value_set=vocabulary.cast(kind)), -1).to_numpy(zero_copy_only=False)
    real = pc.binary_length(bare).to_numpy(zero_copy_only=False) > 0
    ends = np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))
    return np.split(ids[real], np.r_[0, np.cumsum(real)][ends][:-1])


def bare_words(text: bytes) -> list[bytes]:
    """The words that ``term_numbers`` numbers."""
    strip = PUNCTUATION.encode()
    return [x for x in (w.strip(strip) for w in text.split()) if x]


def search(shard: Shard, text: pa.Scalar, ids: np.ndarray, min_score: float, min_overlap: float) -> list[dict]:
    """Verified items of a lower-cased text with its term numbers, each with its best passage."""
    w = None
    best: dict[int, dict] = {}
    for index in shard.indexes if len(ids) else ():
        # a window's terms cannot score more than their largest weights together
        sums = np.concatenate([[0.0], np.cumsum(index.most[ids])])
        starts = np.arange(0, max(1, len(ids) - index.stride), index.stride)
        ends = np.minimum(starts + index.window, len(ids))
        asked = np.flatnonzero(sums[ends] - sums[starts] >= min_score - EPS)
        at_once = max(1, min(WINDOWS, CELLS // index.n_blocks))
        for at in range(0, len(asked), at_once):
            some = asked[at : at + at_once]
            for k, terms in live_windows(index, ids, starts[some], ends[some], min_score):
                found = block_max_wand(index, terms, min_score)
                if found:
                    w = bare_words(text.as_py()) if w is None else w
                    passage = w[starts[some[k]] : ends[some[k]]]
                    for hit in verified(index, found, passage, min_overlap):
                        if hit["item_id"] not in best or hit["score"] > best[hit["item_id"]]["score"]:
                            best[hit["item_id"]] = hit
    return [best[i] for i in sorted(best)]


def spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``lo[i]`` to ``lo[i] + n[i]``, one range behind the other."""
    return np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)


def live_windows(
    index: Index, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: float
) -> Iterator[tuple[int, np.ndarray]]:
    """Of some windows of a text those with a block whose maxima reach ``least``, and their distinct terms.

    The block bounds of all the windows are summed at once, a cell for each window and block.
    """
    least -= EPS
    n, v = ends - starts, len(index.most)
    term, window = ids[spread(starts, n)], np.repeat(np.arange(len(starts)), n)
    window, term = np.divmod(np.unique((window * v + term)[term >= 0]), v)
    enough = np.bincount(window, weights=index.most[term], minlength=len(starts)) >= least
    window, term = window[enough[window]], term[enough[window]]
    lo, n = index.ptr[term], index.ptr[term + 1] - index.ptr[term]
    rows = spread(lo, n)
    cells = np.repeat(window, n) * index.n_blocks + index.block_no[rows]
    bounds = np.bincount(cells, weights=index.block_max[rows], minlength=1)
    for k in np.unique(np.flatnonzero(bounds >= least) // index.n_blocks):
        yield int(k), term[window == k]


def verified(index: Index, found: list[tuple[int, float]], passage: list[bytes], min_overlap: float) -> Iterator[dict]:
    """The retrieved items whose question and answer shingles the passage holds enough of."""
    grams: dict[int, set] = {}
    for item, score in found:
        shared = []
        for part in index.parts[item]:
            n = len(next(iter(part))) if part else SHINGLE
            if n not in grams:
                grams[n] = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
            shared.append(len(part & grams[n]))
        question, answer = index.parts[item]
        if sum(shared) >= min_overlap * (len(question) + len(answer)):
            yield {
                "item_id": item,
                "score": score,
                "question_overlap": shared[0] / len(question) if question else None,
                "answer_overlap": shared[1] / len(answer) if answer else None,
            }


def weighted_postings(items: DataFrame, index_bytes: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``cls, shard, item_id, tokens, postings`` of every item that has words, with BM25 weights.

    Weights are over all items, and each item's sum to 1. An ``item_id`` given twice is
    one item of its distinct texts' words; null ids and texts without words are left out.
    """
    strip = lambda w: F.regexp_replace(w, r"^[.,;:!?\"'()\[\]{}<>|*#$%&\-_=+/\\]+|[.,;:!?\"'()\[\]{}<>|*#$%&\-_=+/\\]+$", "")
    given = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    merged = given.where("item_id is not null and text is not null").groupBy("item_id").agg(
        F.array_join(F.sort_array(F.collect_set("text")), "\n").alias("text")
    )
    # a word's sentence ends if it carries a full stop or stands before a line break
    marked = F.regexp_replace(F.lower("text"), r"[\x20\x09\x0B\x0C\x0D]*\n", ".\n")
    raw = F.filter(
        F.transform(words(marked), lambda w: F.struct(strip(w).alias("word"), w.rlike(r"[.!?][\"')\]]*$").alias("ends"))),
        lambda t: F.length(t["word"]) > 0,
    )
    tokens = merged.select("item_id", F.octet_length("text").alias("size"), raw.alias("tokens")).where(F.size("tokens") > 0)
    totals = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("len"), F.sum("size").alias("bytes")).first()
    n, avg_len, n_shards = totals["n"], totals["len"] or 1.0, max(1, -(-(totals["bytes"] or 0) // index_bytes))
    tf = tokens.select("item_id", F.size("tokens").alias("len"), F.explode("tokens.word").alias("term"))
    tf = tf.groupBy("item_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (
        F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / avg_len))
    )
    scored = tf.join(df, "term").select("item_id", "term", weight.alias("w"))
    per_item = scored.groupBy("item_id").agg(
        F.sum("w").alias("self"), F.collect_list(F.struct("term", "w")).alias("postings")
    )
    share = F.transform("postings", lambda p: F.struct(p["term"].alias("term"), (p["w"] / F.col("self")).alias("w")))
    return tokens.join(per_item, "item_id").select(
        F.floor(F.log(float(CLASS_BASE), F.size("tokens") + F.lit(0.5))).cast("int").alias("cls"),
        F.pmod(F.xxhash64("item_id"), F.lit(n_shards)).alias("shard"),
        "item_id",
        "tokens",
        share.alias("postings"),
    )


def shards(items: DataFrame, index_bytes: int = 32 << 20) -> Iterator[Shard]:
    """Indexes from at most about ``index_bytes`` of item text each, one gathered at a time."""
    weighted = weighted_postings(items, index_bytes).persist()
    try:
        for (shard,) in sorted(weighted.select("shard").distinct().collect()):
            yield Shard(weighted.where(F.col("shard") == shard).collect())
    finally:
        weighted.unpersist()


def leaks(
    docs: DataFrame,
    items: DataFrame,
    keep: list[str],
    min_score: float = 0.5,
    min_overlap: float = 0.5,
    index_bytes: int = 32 << 20,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``hits`` of every row with a verified item in ``text``.

    ``hits`` is ``array<struct<item_id, score, ...>>``; a row stands once for each shard that
    hits it. ``min_score`` is the retrieved share of an item's own score, ``min_overlap`` the
    share of its question and answer shingles that one passage must hold. Null and empty
    texts, and a benchmark without words, have no hits; a very long text is searched whole,
    a window at a time, in the task that reads it.

    Shards are searched one after the other: one is gathered, broadcast, its hits are
    written, and it is taken back from the executors before the next.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    content = F.lower(F.col("text").cast("string")).cast("binary")
    held = docs.select(*keep, content.alias("__content"))
    found = held.where(F.lit(False)).select(*keep, F.lit(None).cast(HITS).alias("hits"))
    for shard in shards(items, index_bytes):
        shared = spark.sparkContext.broadcast(shard)
        # nondeterministic: the filter on the hits must not run the search a second time
        search_of = _finder(shared, min_score, min_overlap).asNondeterministic()
        hits = held.select(*keep, search_of("__content").alias("hits")).where(F.size("hits") > 0)
        found = found.unionByName(scratch.save(hits))
        shared.destroy()
    return found


def _finder(shared, min_score: float, min_overlap: float):
    """The search of one broadcast shard as an Arrow UDF over texts."""

    @F.arrow_udf(HITS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        numbers = [(k, pa.float64()) for k in ("score", "question_overlap", "answer_overlap")]
        found_type = pa.list_(pa.struct([("item_id", pa.int64()), *numbers]))
        vocabulary = pa.array([t.decode() for t in shared.value.numbers], pa.string())
        for texts in batches:
            hits = []
            for at in range(0, len(texts), 256):
                some = texts.slice(at, 256)
                for x, ids in zip(some, term_numbers(some, vocabulary)):
                    hits.append(search(shared.value, x, ids, min_score, min_overlap) if len(ids) else [])
            yield pa.array(hits, found_type)

    return find


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` of every verified hit.

    One row per document row and item; documents without hits have none. Repeated rows
    each get theirs; null ids stay null; empty tables give an empty result; other columns
    are not read.
    """
    found = leaks(docs, items, ["doc_id"], **options)
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text holds an item.

    Rows go by their text (128 bits of hash), so null ids and repeated rows are judged like any
    others; null texts stay; columns stay as they are; empty tables give all rows back.
    """
    text = F.col("text").cast("string")
    mark = [F.xxhash64(text).alias("__h"), F.xxhash64(F.lit("second"), text).alias("__h2")]
    found = leaks(docs.select("text", *mark), items, ["__h", "__h2"], **options)
    gone = ship(Scratch(docs.sparkSession, "leaks").save(found.select("__h", "__h2").distinct()))
    marked = docs.withColumn("__h", mark[0]).withColumn("__h2", mark[1])
    return marked.join(gone, ["__h", "__h2"], "left_anti").select(*docs.columns)
