"""Quality classifier on supervised subword embeddings (operator 8).

Words, their character n-grams and word bigrams are hashed to learned vectors; a
document is the average of its vectors, and a softmax layer on the average gives the
class. Training is stochastic gradient descent in numpy over a bounded sample
(``max_rows``). As averaging and the output layer are linear, scoring projects every
learned vector on the output once and averages those numbers: the same softmax,
without carrying vectors. The model is broadcast; its size is ``2^bits`` rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.labelled import FOLDS, training_rows
from gleaner.llm.text import fold, pieces

NGRAMS = (3, 4)
#: Words a task remembers before it starts its table anew.
CACHE_WORDS = 200_000
#: Texts whose words are looked up together.
TEXTS = 64


def subwords(word: bytes, mask: int) -> list[int]:
    """Buckets of a word and of its character n-grams, word ends marked."""
    marked = "<" + word.decode("utf-8", "replace") + ">"
    out = [zlib.crc32(word) & mask]
    for n in NGRAMS:
        out += [zlib.crc32(marked[i : i + n].encode()) & mask for i in range(len(marked) - n + 1)]
    return out


#: What a byte does to a CRC-32.
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1)


def subwords_alike(words: list[bytes], mask: int) -> np.ndarray:
    """``subwords`` of ASCII words of one length, a row each: a byte is a character, and an n-gram's
    checksum is the one of its first bytes gone on with."""
    plain = np.frombuffer(b"".join([b"<%b>" % x for x in words]), np.uint8).reshape(len(words), -1)
    out = [np.array([zlib.crc32(x) for x in words], np.uint32)[:, None]]
    crc = np.full(plain.shape, 0xFFFFFFFF, np.uint32)
    for n in range(1, min(max(NGRAMS), plain.shape[1]) + 1):
        crc = crc[:, : plain.shape[1] - n + 1]
        crc = CRC[(crc ^ plain[:, n - 1 :]) & 255] ^ (crc >> 8)
        if n in NGRAMS:
            out.append(~crc)
    return np.hstack(out) & np.uint32(mask)


def pair(a: bytes, b: bytes, mask: int) -> int:
    """Bucket of a word bigram; a word said twice in a row is one and the same bigram."""
    return zlib.crc32(b" =" if a == b else a + b" " + b) & mask


def features(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    mask = (1 << bits) - 1
    w = text.split()
    found: list[int] = []
    known: dict[bytes, list[int]] = {}
    for x in w:
        got = known.get(x)
        if got is None:
            got = known[x] = subwords(x, mask)
        found += got
    found += [pair(a, b, mask) for a, b in zip(w, w[1:])]
    ids, counts = np.unique(np.array(found, np.int32), return_counts=True)
    return ids, counts.astype(np.float32)


class Classifier(NamedTuple):
    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray


def train(
    rows: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    bits: int = 17,
    dim: int = 8,
    epochs: int = 6,
    rate: float = 0.5,
    seed: int = 3,
) -> Classifier:
    """Fit vectors and output layer; the step shrinks linearly to zero.

    Rows without features (empty texts) train the bias alone; with no rows, or one
    label, the bias answers the label's share.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    output = np.zeros((dim, 2), np.float32)
    labels = np.asarray(labels, int)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = np.log(np.array([1 - share, share]))
    if len(labels) == 0 or labels.min() == labels.max():
        return Classifier(vectors, output, bias)
    total, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, counts = rows[k]
            step = rate * (1 - done / total)
            done += 1
            mean = counts @ vectors[ids] / counts.sum() if len(ids) else np.zeros(dim, np.float32)
            z = mean @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = output @ p
            output -= step * np.outer(mean, p)
            bias -= 0.05 * step * p
            if len(ids):
                # the gradient of an average reaches every vector by its share; scaled up as in
                # common practice for averaged embeddings, where the shares would make steps tiny
                vectors[ids] -= (step * np.minimum(counts, 50) / counts.sum() * SCALE)[:, None] * back[None, :].astype(np.float32)
    return Classifier(vectors, output, bias)


#: Factor on the step of vectors, whose gradient carries each feature's share of the document.
SCALE = 100.0


class Projected(dict):
    """Word to (summed projection, features, checksum of the word and a space), remembered."""

    def __init__(self, margin: np.ndarray, bits: int):
        super().__init__()
        self.margin, self.mask = margin, (1 << bits) - 1

    def learn(self, texts: list[list[bytes]]) -> None:
        """Make all words of ``texts`` known; ASCII words of one length are summed together."""
        words = set().union(*texts)
        new = [x for x in words if x not in self]
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = list(words)
        ascii: dict[int, list] = {}
        for x in new:
            if x.isascii():
                ascii.setdefault(len(x), []).append(x)
            else:
                self.keep([x], np.array([subwords(x, self.mask)]))
        for alike in ascii.values():
            self.keep(alike, subwords_alike(alike, self.mask))

    def keep(self, words: list[bytes], ids: np.ndarray) -> None:
        for x, s in zip(words, self.margin[ids].sum(axis=1).tolist()):
            self[x] = (s, ids.shape[1], zlib.crc32(x + b" "))


def score_words(w: list[bytes], projected: Projected, bias: float) -> float:
    """Probability of label 1 of a text's words, all known: softmax of two classes is a sigmoid of their margin."""
    total, n = 0.0, 0
    if w:
        sums, sizes, begun = zip(*map(projected.__getitem__, w))
        total, n = reduce(add, sums, total), sum(sizes)
    if len(w) > 1:
        # the bigrams' buckets as in ``pair``, each checksum going on from its first word's
        same, crc32 = zlib.crc32(b" ="), zlib.crc32
        pairs = [same if a == b else crc32(b, c) for a, b, c in zip(w, w[1:], begun)]
        total += float(projected.margin[np.array(pairs, np.uint32) & projected.mask].sum())
        n += len(pairs)
    z = bias + (total / n if n else 0.0)
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def collect_features(sample: DataFrame, bits: int):
    """Features and labels of the bounded sample, in id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            got = [features(x, bits) for x in b["text"].to_pylist()]
            yield pa.record_batch(
                [
                    b["__id"].cast(pa.int64()),
                    b["label"],
                    pa.array([i.tobytes() for i, _ in got], pa.binary()),
                    pa.array([c.tobytes() for _, c in got], pa.binary()),
                ],
                ["id", "label", "ids", "counts"],
            )

    got = sorted(sample.mapInArrow(run, "id long, label int, ids binary, counts binary").collect())
    rows = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in got]
    return rows, np.array([r["label"] for r in got], int)


def quality(
    docs: DataFrame, labels: DataFrame, max_rows: int = 4_000, bits: int = 17, threshold: float = 0.3, seed: int = 3, **fit
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Learns from at most ``max_rows`` labelled documents outside the held-out fold; only
    ``text`` enters a score. Null and empty texts score by the bias; equal texts score
    alike; repeated rows each get a row; an empty table gives an empty result and no
    labels the neutral 0.5; other columns are not read.
    """
    spark = docs.sparkSession
    rows, y = collect_features(training_rows(docs, labels, "quality", max_rows, seed), bits)
    model = train(rows, y, bits=bits, seed=seed, **fit)
    margin = (model.vectors @ (model.output[:, 1] - model.output[:, 0])).astype(np.float32)
    shared = spark.sparkContext.broadcast((margin, float(model.bias[1] - model.bias[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin, bias = shared.value
        projected = Projected(margin, bits)
        for b in pieces(batches):
            scores = []
            for at in range(0, b.num_rows, TEXTS):
                texts = [x.split() for x in b["text"].slice(at, TEXTS).to_pylist()]
                projected.learn(texts)
                scores += [score_words(w, projected, bias) for w in texts]
            yield pa.record_batch([b["doc_id"], b["held_out"], pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    given = docs.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    id_type = given.schema["doc_id"].dataType.simpleString()
    scored = given.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
