"""Language-model scores by deleted interpolation (operator 1).

P(w | h) = sum_n l_n(b) f_n: maximum-likelihood estimates of each order, and a uniform
one, mixed by weights that depend on the bucket b = floor(log2(1 + count)) of the
longest context's count. The weights are learned by expectation-maximisation on a
deleted fold of the training documents, whose counts are taken out of the estimates.

How the counts meet the tokens, without a row for every token:

1. Tasks encode documents into blocks: numbered tokens and the block's word hashes,
   one row per block of about ``block_tokens`` tokens. Deleted documents have blocks of
   their own.
2. Each block sorts its distinct grams by 64-bit hash and sends them, cut into hash
   ranges ("slices"), with its own training counts.
3. A slice adds up the counts of all blocks and answers each with the corpus counts in
   the order it asked, so answers carry no hashes.
4. The deleted blocks yield the held-out counts for EM; then every block scores its
   documents from the answers.

Slices grow in number with the corpus, so a slice's share stays the same size; a gram
of any frequency is one entry per block in its slice.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.scratch import Scratch
from gleaner.llm.text import byte_words, fold, pieces

#: Documents whose crc32(doc_id as text) mod FOLDS is HELD_OUT are never learned from.
FOLDS, HELD_OUT = 7, 2
#: One training document in DELETED is set aside for the mixture weights.
DELETED = 20
#: The end token; no word can hold a blank.
END = b" "
BUCKETS = 64
ROLL = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pack(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, by byte plane, deflated."""
    x = np.ascontiguousarray(x, np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zlib.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view(np.uint64).ravel()


def pack_hashes(x: np.ndarray) -> bytes:
    """Ascending hashes as differences in as few bytes as the largest needs."""
    gaps = np.diff(x, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : data[0]] = raw
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


class Numbers(dict):
    """Word to its number within a block."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Builder:
    """Documents of one block in the making."""

    def __init__(self, deleted: bool):
        self.deleted = deleted
        self.numbers, self.tokens, self.ids, self.lengths, self.held = Numbers(), [], [], [], []
        self.size = 0

    def add(self, doc_id: int | None, held_out: bool, text: bytes) -> None:
        w = byte_words(text)
        w.append(END)
        self.tokens.append(np.fromiter(map(self.numbers.__getitem__, w), np.int64, len(w)))
        self.ids.append(doc_id)
        self.held.append(held_out)
        self.lengths.append(len(w))
        self.size += len(w)

    def row(self, block: str) -> dict:
        tokens = np.concatenate(self.tokens)
        # frequent words get small numbers, which deflate well
        order = np.argsort(-np.bincount(tokens, minlength=len(self.numbers)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.numbers), np.uint64, len(self.numbers))
        return {
            "block": block,
            "deleted": self.deleted,
            "n_tokens": self.size,
            "ids": np.array([0 if i is None else i for i in self.ids], np.int64).tobytes(),
            "no_id": [i is None for i in self.ids],
            "held": self.held,
            "lengths": self.lengths,
            "words": hashes[order].tobytes(),
            "tokens": pack(rank[tokens]),
        }


BLOCKS = "block string, deleted boolean, n_tokens long, ids binary, no_id array<boolean>, held array<boolean>, lengths array<long>, words binary, tokens binary"
BLOCK_TYPE = pa.schema(
    [("block", pa.string()), ("deleted", pa.bool_()), ("n_tokens", pa.int64()), ("ids", pa.binary()),
     ("no_id", pa.list_(pa.bool_())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("tokens", pa.binary())]
)


def encode(docs: DataFrame, block_tokens: int) -> DataFrame:
    """Documents as block rows (step 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks = {d: Builder(d) for d in (False, True)}
        task, count = None, 0

        def flush(deleted: bool) -> pa.RecordBatch:
            nonlocal count
            count += 1
            full, open_blocks[deleted] = open_blocks[deleted], Builder(deleted)
            return pa.RecordBatch.from_pylist([full.row(f"{task}-{count}")], schema=BLOCK_TYPE)

        for b in pieces(batches):
            columns = [b[c].to_pylist() for c in ("id", "held", "deleted", "part")]
            for doc_id, held, deleted, part, text in zip(*columns, b["text"].to_pylist()):
                task = part
                open_blocks[deleted].add(doc_id, held, text)
                if open_blocks[deleted].size >= block_tokens:
                    yield flush(deleted)
        for deleted in (False, True):
            if open_blocks[deleted].size:
                yield flush(deleted)

    key = F.col("doc_id").cast("long")
    held = fold(key, FOLDS) == HELD_OUT
    given = docs.select(
        key.alias("id"),
        held.alias("held"),
        (~held & (F.pmod(F.xxhash64(key), F.lit(DELETED)) == 0)).alias("deleted"),
        F.spark_partition_id().alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    return given.mapInArrow(run, BLOCKS)


class Grams:
    """The grams of a block, level by level: distinct sorted hashes and each token's place among them."""

    def __init__(self, row: dict, order: int):
        words = np.frombuffer(row["words"], np.uint64)
        tokens = unpack(row["tokens"]).astype(np.int64)
        self.lengths = np.array(row["lengths"], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.held = np.array(row["held"], bool)
        self.train = np.repeat(~self.held, self.lengths)
        by_hash = np.argsort(words)
        place = np.empty(len(words), np.int64)
        place[by_hash] = np.arange(len(words))
        self.levels = [(words[by_hash], place[tokens])]
        end = padding = np.array([xxhash.xxh3_64_intdigest(END)], np.uint64)
        h = level = words[tokens]
        for _ in range(1, order):
            # a history that reaches before the document is made of ends
            before = np.r_[padding, level[:-1]]
            before[self.starts] = padding[0]
            level, padding = mix(before * ROLL + h), mix(padding * ROLL + end)
            self.levels.append(np.unique(level, return_inverse=True))

    def train_counts(self, n: int) -> np.ndarray:
        hashes, place = self.levels[n]
        return np.bincount(place[self.train], minlength=len(hashes))


def edges(slices: int) -> np.ndarray:
    """Lower ends of equal hash ranges."""
    return np.array([(k << 64) // slices for k in range(slices)], np.uint64)


def asked(blocks: DataFrame, order: int, slices: list[int]) -> DataFrame:
    """``level, slice, block, deleted, hashes, counts`` of every block (step 2)."""
    names = ["level", "slice", "block", "deleted", "hashes", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                grams = Grams(row, order)
                for n in range(order):
                    hashes, counts = grams.levels[n][0], grams.train_counts(n)
                    cuts = np.r_[np.searchsorted(hashes, edges(slices[n])), len(hashes)]
                    out = [
                        (n, k, row["block"], row["deleted"], pack_hashes(hashes[i:j]), pack(counts[i:j]))
                        for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                        if i < j
                    ]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=ASKED_TYPE)

    return blocks.select("block", "deleted", "held", "lengths", "words", "tokens").mapInArrow(
        run, "level int, slice int, block string, deleted boolean, hashes binary, counts binary"
    )


ASKED_TYPE = pa.schema(
    [("level", pa.int32()), ("slice", pa.int32()), ("block", pa.string()), ("deleted", pa.bool_()), ("hashes", pa.binary()), ("counts", pa.binary())]
)
ANSWER = "level int, slice int, block string, deleted boolean, counts binary, out_counts binary, distinct long, total long, out_total long"


def answer(group: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts for every block that asked in a slice, and the slice's totals (step 3)."""
    hashes = [unpack_hashes(x) for x in group["hashes"]]
    known, place = np.unique(np.concatenate(hashes), return_inverse=True)
    counts = np.concatenate([unpack(x) for x in group["counts"]]).astype(np.int64)
    sizes = [len(h) for h in hashes]
    del hashes
    total = np.bincount(place, weights=counts, minlength=len(known)).astype(np.int64)
    out = np.repeat(group["deleted"].to_numpy(bool), sizes)
    out_total = np.bincount(place[out], weights=counts[out], minlength=len(known)).astype(np.int64)
    cuts = np.cumsum([0, *sizes])
    level, part = int(group["level"].iloc[0]), int(group["slice"].iloc[0])
    rows = [
        (level, part, b, d, pack(total[place[i:j]]), pack(out_total[place[i:j]]) if d else None, None, None, None)
        for b, d, i, j in zip(group["block"], group["deleted"], cuts[:-1], cuts[1:])
    ]
    rows.append((level, part, None, None, None, None, int((total > 0).sum()), int(total.sum()), int(out_total.sum())))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")])


class Counted:
    """A block's grams with the corpus counts of every token, by level, and of its contexts."""

    def __init__(self, block: pd.DataFrame, replies: pd.DataFrame, order: int, documents: int, column: str = "counts"):
        self.grams = Grams(block.iloc[0].to_dict(), order)
        replies = replies.sort_values(["level", "slice"])
        self.counts, self.contexts = [], []
        for n in range(order):
            per_gram = np.concatenate([unpack(x) for x in replies.loc[replies["level"] == n, column]]).astype(np.int64)
            self.counts.append(per_gram[self.grams.levels[n][1]])
        for n in range(1, order):
            before = np.r_[documents, self.counts[n - 1][:-1]]
            before[self.grams.starts] = documents
            self.contexts.append(before)


def estimates(counts: list, contexts: list, total: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token, and its estimates: uniform, then every order."""
    f = [np.full(len(counts[0]), 1 / (distinct + 1)), counts[0] / max(total, 1)]
    for c, h in zip(counts[1:], contexts):
        f.append(np.divide(c, h, out=np.zeros(len(c)), where=h > 0))
    longest = contexts[-1] if contexts else np.zeros(len(counts[0]))
    return np.floor(np.log2(1.0 + longest)).astype(np.int64), np.stack(f)


def learn_weights(held_out: DataFrame, order: int, rounds: int, tol: float) -> np.ndarray:
    """Mixture weights by bucket, by expectation-maximisation on ``bucket, n, f0 .. f<order>``.

    Each component of a bucket gets half a pseudo-count, so no weight is zero and a
    bucket without held-out tokens has equal weights.
    """
    parts = order + 1
    weights = np.full((BUCKETS, parts), 1 / parts)
    before = -math.inf
    for _ in range(rounds):
        terms = []
        for k in range(parts):
            by_bucket = F.array(*[F.lit(float(x)) for x in weights[:, k]])
            terms.append(F.element_at(by_bucket, F.col("bucket") + 1) * F.col(f"f{k}"))
        p = sum(terms[1:], terms[0])
        rows = (
            held_out.groupBy("bucket")
            .agg(*[F.sum(F.col("n") * t / p).alias(f"e{k}") for k, t in enumerate(terms)], F.sum(F.col("n") * F.log(p)).alias("ll"))
            .collect()
        )
        expected = np.full((BUCKETS, parts), 0.5)
        for r in rows:
            expected[r["bucket"]] += [r[f"e{k}"] for k in range(parts)]
        weights = expected / expected.sum(1, keepdims=True)
        now = sum(r["ll"] for r in rows)
        if now - before <= tol * abs(now):
            break
        before = now
    return weights


def lm_scores(
    docs: DataFrame,
    order: int = 2,
    block_tokens: int = 2_000_000,
    slice_tokens: int = 1_500_000,
    rounds: int = 30,
    tol: float = 1e-5,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Tokens are the words of the lower-cased (A-Z) text and one end; null and empty texts
    have the end alone. ``base_score`` adds log10((c + 1) / (N + V + 1)) and ``score``
    log10 P(w | h). Grams are told apart by 64-bit hash. A document's history begins with
    ends, and a null id counts as the text '' for its fold. Repeated rows are counted and
    scored one by one; with no training document every count is 0; an empty table gives
    an empty result; other columns are not read. Lost executors repeat tasks: blocks and
    answers are written tables.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    blocks = scratch.save(encode(docs, block_tokens))
    total_tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    slices = [max(1, math.ceil(total_tokens / slice_tokens / (4 if n == 0 else 1))) for n in range(order)]
    answers = scratch.save(asked(blocks, order, slices).groupBy("level", "slice").applyInPandas(answer, ANSWER))
    documents, deleted_documents = (
        blocks.select("deleted", F.explode("held").alias("held"))
        .agg(F.count(F.when(~F.col("held"), 1)), F.count(F.when(F.col("deleted"), 1)))
        .first()
    )
    totals = answers.where("block is null and level = 0").agg(F.sum("distinct"), F.sum("total"), F.sum("out_total")).first()
    distinct, total, out_total = (x or 0 for x in totals)
    replies = answers.where("block is not null").select("level", "slice", "block", "deleted", "counts", "out_counts")

    def held_out_rows(key, block: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        every = Counted(block, replies, order, documents)
        out = Counted(block, replies, order, deleted_documents, "out_counts")
        kept = [a - b for a, b in zip(every.counts, out.counts)]
        contexts = [a - b for a, b in zip(every.contexts, out.contexts)]
        bucket, f = estimates(kept, contexts, total - out_total, distinct)
        frame = pd.DataFrame({"bucket": bucket.astype(np.int32)} | {f"f{k}": x for k, x in enumerate(f)})
        return frame.groupby(list(frame.columns), as_index=False).size().rename(columns={"size": "n"})

    columns = ["block", "deleted", "held", "lengths", "words", "tokens"]
    schema = ", ".join(["bucket int", *[f"f{k} double" for k in range(order + 1)], "n long"])
    held_out = scratch.save(
        blocks.where("deleted").select(columns).groupBy("block")
        .cogroup(replies.where("deleted").groupBy("block"))
        .applyInPandas(held_out_rows, schema)
    )
    weights = learn_weights(held_out, order, rounds, tol)

    def score(key, block: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        c = Counted(block, replies, order, documents)
        bucket, f = estimates(c.counts, c.contexts, total, distinct)
        p = (weights[bucket].T * f).sum(0)
        by_doc = lambda x: np.add.reduceat(x, c.grams.starts)
        ids = np.frombuffer(block["ids"].iloc[0], np.int64)
        return pd.DataFrame(
            {
                "doc_id": pd.arrays.IntegerArray(ids.copy(), np.array(block["no_id"].iloc[0], bool)),
                "held_out": c.grams.held,
                "n_tokens": c.grams.lengths,
                "n_known": by_doc((c.counts[0] > 0).astype(np.int64)),
                "train_tokens": np.full(len(ids), total),
                "base_score": by_doc(np.log10((c.counts[0] + 1) / (total + distinct + 1))),
                "score": by_doc(np.log10(p)),
            }
        )

    return (
        blocks.select("ids", "no_id", *columns).groupBy("block")
        .cogroup(replies.drop("out_counts").groupBy("block"))
        .applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
