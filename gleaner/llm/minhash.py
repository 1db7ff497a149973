"""Near-duplicate documents by MinHash banding, verification and star contraction (operator 5).

1. One pass hashes each document's shingles: set size, digest of the whole set and many
   universal-hash minima. Documents of one set are one class; its least id stands for it.
2. Bands of minima name buckets. In each bucket the least id is the pivot, and only
   (pivot, member) pairs are candidates, so a bucket of n members costs n - 1.
3. Candidates whose signatures are far below the threshold go; the others are compared
   on the full shingle sets of their texts.
4. Links are contracted by alternating large-star and small-star.
5. A bucket whose members ended in one component is closed: no further comparison can
   change it. In the open ones a pivot may have hidden a link. A document can only link
   to another component if enough of its shingles occur there, so those whose shingles
   are mostly their own component's are proven done. The others are compared across
   components in blocks: families that share buckets are cut into blocks of BLOCK_DOCS,
   and a task multiplies the incidence matrices of two blocks and emits links only, so a
   large family around the threshold makes no pair rows. Then components are contracted
   again.

A pair at the threshold shares no bucket with probability (1 - t^rows)^bands: 3e-6 for
32 bands of 5 at 0.8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.components import star_forest
from gleaner.llm.scratch import Scratch, ship
from gleaner.llm.text import byte_words, pieces

CACHE_WORDS = 100_000
#: Standard errors that a signature's estimate may fall short of the threshold.
SLACK = 5.0
#: Documents of a block of a family, and shingles of a slab of its incidence matrix.
BLOCK_DOCS, SLAB = 256, 16_384


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: bytes, size: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``size`` words."""
    w = byte_words(text)
    if not w:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, len(w) if n < size else size, np.uint64)
    for k in range(n):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(w) - n + 1 + k])
    return np.unique(h)


def shingle_set(text: bytes, size: int) -> set:
    """The shingles themselves; a shorter text is one shingle."""
    w = byte_words(text)
    n = min(size, len(w))
    return set(zip(*[w[k:] for k in range(n)])) if n == size else ({tuple(w)} if w else set())


class Minima:
    """Signatures of ``count`` minima under h(x) = (a x + b) >> 32, a universal family on 32-bit keys."""

    def __init__(self, count: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**64, count, np.uint64, endpoint=False) | np.uint64(1)
        self.b = rng.integers(0, 2**64, count, np.uint64, endpoint=False)

    def __call__(self, hashes: np.ndarray) -> bytes:
        """The low 16 bits of each minimum; minima themselves crowd near zero, their low bits do not."""
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        keys = hashes >> np.uint64(32)
        for i in range(0, len(keys), 1024):
            x = self.a[:, None] * keys[None, i : i + 1024]
            x += self.b[:, None]
            np.minimum(least, x.min(1), out=least)
        return (least >> np.uint64(32)).astype(np.uint16).tobytes()


def sketch(docs: DataFrame, shingle: int, count: int, seed: int) -> DataFrame:
    """``id, n, digest, sig`` of every document; no digest and signature for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, minima = WordHashes(), Minima(count, seed)
        for b in pieces(batches):
            sets = [shingle_hashes(t, shingle, known) for t in b["text"].to_pylist()]
            yield pa.record_batch(
                [
                    b["id"],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([minima(s) if len(s) else None for s in sets], pa.binary()),
                ],
                ["id", "n", "digest", "sig"],
            )

    return _texts(docs).mapInArrow(run, "id long, n long, digest binary, sig binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def _similar_signatures(pairs: DataFrame, sigs: DataFrame, threshold: float, count: int) -> DataFrame:
    """Pairs whose signatures agree in enough places."""
    least = count * (threshold - SLACK * (threshold * (1 - threshold) / count) ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint16).reshape(-1, count) for c in ("su", "sv"))
                keep = pa.array((x == y).sum(1) >= least)
                yield pa.record_batch([b["u"].filter(keep), b["v"].filter(keep)], ["u", "v"])

    of = lambda c: sigs.select(F.col("id").alias(c), F.col("sig").alias("s" + c))
    return pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def _linked(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs with 100 * |intersection| >= percent * |union| on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, set()
        for b in pieces(batches):
            keep = []
            for v, tv, tu in zip(b["v"].to_pylist(), b["tv"].to_pylist(), b["tu"].to_pylist()):
                if v != last:
                    last, mine = v, shingle_set(tv, shingle)
                other = shingle_set(tu, shingle)
                both = len(mine & other)
                keep.append(100 * both >= percent * (len(mine) + len(other) - both) > 0)
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([b["u"].filter(keep), b["v"].filter(keep)], ["u", "v"])

    ends = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()
    # written: both sides of the joins are then plain exchanges, whose hot keys can be split
    involved = scratch.save(texts.join(ship(ends), "id", "left_semi").dropDuplicates(["id"]))
    of = lambda c: involved.select(F.col("id").alias(c), F.col("text").alias("t" + c))
    # by u first: the join on v, whose pivots may be hot, is last and can be split
    return pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long")


def _may_link(open_docs: DataFrame, texts: DataFrame, shingle: int, percent: int, scratch: Scratch, rounds: int = 2) -> DataFrame:
    """The ``id`` of ``open_docs`` (id, root) that may yet link to another component.

    Similarity of ``percent`` needs as large a share of a document's shingles in the other
    one. Shingles found in one component only do not count; each round counts anew among
    the documents that are left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in pieces(batches, 64):
            sets = [shingle_hashes(t, shingle, known).view(np.int64) for t in b["text"].to_pylist()]
            n = np.array([len(h) for h in sets])
            ids, roots = (b[c].to_numpy() for c in ("id", "root"))
            columns = [np.concatenate(sets), np.repeat(ids, n), np.repeat(roots, n), np.repeat(n, n)]
            yield pa.record_batch([pa.array(c) for c in columns], ["h", "id", "root", "n"])

    found = texts.join(ship(open_docs), "id").dropDuplicates(["id"]).select("id", "root", "text")
    left = scratch.save(found.mapInArrow(run, "h long, id long, root long, n long"))
    for _ in range(rounds):
        several = left.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("h")
        able = (
            left.join(several, "h", "left_semi")
            .groupBy("id", "n")
            .agg(F.count(F.lit(1)).alias("shared"))
            .where(F.col("shared") * 100 >= F.col("n") * percent)
        )
        able = scratch.save(able.select("id"))
        left = left.join(ship(able), "id", "left_semi")
    return able


def common_shingles(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``left`` with every one of ``right``."""
    out = np.zeros((len(left), len(right)), np.float32)
    known = np.intersect1d(np.concatenate(left), np.concatenate(right))
    for at in range(0, len(known), SLAB):
        slab = known[at : at + SLAB]

        def incidence(sets):
            m = np.zeros((len(sets), len(slab)), np.float32)
            for row, s in zip(m, sets):
                place = np.searchsorted(slab, s)
                place[place == len(slab)] = 0
                row[place[slab[place] == s]] = 1
            return m

        out += incidence(left) @ incidence(right).T
    return out.astype(np.int64)


def _links_in_blocks(members: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links ``u, v`` across the roots of a family, by 64-bit shingle hashes; ``members`` has ``id, root, family``."""
    sizes = members.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = members.join(sizes, "family").select("id", "root", "family", block.alias("block"), "blocks")
    own = texts.join(ship(members.select("id")), "id", "left_semi").dropDuplicates(["id"])
    rows = dealt.join(own, "id").select(
        "id", "root", "family", "block", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        known = WordHashes()
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        sides = [group[group["block"] == b] for b in (i, j)]
        if not len(sides[0]) or not len(sides[1]):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        sets = [[shingle_hashes(t, shingle, known) for t in side["text"]] for side in sides]
        both = common_shingles(*sets)
        n = [np.array([len(x) for x in side]) for side in sets]
        ids, roots = ([side[c].to_numpy(np.int64) for side in sides] for c in ("id", "root"))
        union = n[0][:, None] + n[1][None, :] - both
        hit = (100 * both >= percent * union) & (roots[0][:, None] != roots[1][None, :])
        a, b = (ids[0][hit.nonzero()[0]], ids[1][hit.nonzero()[1]])
        return pd.DataFrame({"u": np.maximum(a, b), "v": np.minimum(a, b)})

    return rows.groupBy("family", "i", "j").applyInPandas(run, "u long, v long").distinct()


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 5,
    seed: int = 1,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Words are those of the lower-cased (A-Z) text; a text shorter than a shingle is one
    shingle. Null and empty texts, and texts of white space, have no shingles and link
    with nothing. Rows of one id are one document: they share its component. A null id
    links with nothing, has a null component and is kept. Empty tables give an empty
    result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    count = bands * rows
    texts = _texts(docs)
    all_docs = scratch.save(sketch(docs, shingle, count, seed))
    real = all_docs.where("id is not null and digest is not null")
    classes = scratch.save(real.groupBy("digest").agg(F.min("id").alias("rep")))
    reps = classes.select(F.col("rep").alias("id")).distinct()
    sigs = scratch.save(real.join(ship(reps), "id", "left_semi").select("id", "sig").dropDuplicates(["id"]))
    banded = sigs.select(
        "id",
        F.explode(
            F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 2 * rows * k + 1, 2 * rows)) for k in range(bands)])
        ).alias("bucket"),
    )
    shared = banded.groupBy("bucket").agg(F.min("id").alias("v"), F.max("id").alias("most")).where("v < most")
    members = scratch.save(banded.join(shared.select("bucket", "v"), "bucket").select("bucket", "id", "v"))
    tested = scratch.save(members.where("id > v").select(F.col("id").alias("u"), "v").distinct())

    def link(pairs: DataFrame) -> DataFrame:
        near = scratch.save(_similar_signatures(pairs, sigs, percent / 100, count))
        return scratch.save(_linked(near, involved_texts, shingle, percent, scratch))

    # the representatives' texts: rows of one id that have another set do not stand for it
    involved_texts = texts.where("id is not null")
    forest = star_forest(link(tested), scratch)

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(forest.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").withColumn(
            "root", F.coalesce("root", "id")
        )

    named = scratch.save(labelled(members).select("bucket", "id", "root"))

    def still_open(rows: DataFrame) -> DataFrame:
        mixed = rows.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
        return scratch.save(rows.join(mixed.select("bucket"), "bucket", "left_semi"))

    rest = still_open(named)
    if rest.limit(1).count():
        able = _may_link(rest.select("id", "root").distinct(), involved_texts, shingle, percent, scratch)
        rest = still_open(rest.join(ship(able), "id", "left_semi"))
        least = rest.groupBy("bucket").agg(F.min("id").alias("v"))
        meet = rest.join(least, "bucket").where("id > v").select(F.col("id").alias("u"), "v").distinct()
        family = star_forest(meet, scratch).select(F.col("u").alias("id"), F.col("v").alias("family"))
        members = rest.select("id", "root").distinct().join(family, "id", "left")
        members = scratch.save(members.withColumn("family", F.coalesce("family", "id")))
        across = scratch.save(_links_in_blocks(members, involved_texts, shingle, percent))
        more = link(across.join(tested, ["u", "v"], "left_anti"))
        forest = star_forest(forest.unionByName(more), scratch)
    roots = labelled(classes.select("digest", F.col("rep").alias("id"))).select("digest", "root")
    out = all_docs.drop("sig").join(roots, "digest", "left")
    component = F.coalesce("root", "id")
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
