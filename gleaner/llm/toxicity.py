"""Toxicity by a factorization machine over hashed terms (operator 7).

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) over the terms a
document holds. The pairwise part learns that two terms together mean more, or less,
than their sum. The linear part is learned first, with a shrinkage that rare terms hardly
overcome; the factors learn what it leaves. Learning runs in numpy on a bounded sample
(``max_rows``); the model, whose size ``2^bits * (rank + 1)`` floats bounds, is broadcast,
and every document is scored in one pass without a shuffle. A very long text is scored
whole, by the distinct terms it holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.labelled import FOLDS, training_rows
from gleaner.llm.text import byte_words, fold, pieces

PUNCTUATION = b".,;:!?\"'()[]{}<>|*#$%&-_=+/\\"
#: Matches texts that hold a term: any character but white space and punctuation.
TERM = "[^" + r"\x20\x09-\x0D" + "".join(f"\\x{c:02X}" for c in PUNCTUATION) + "]"
#: Words a task remembers before it starts its table anew.
CACHE_WORDS = 200_000


class Machine(NamedTuple):
    """Weights by hash bucket; ``known`` marks buckets that have any."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    known: np.ndarray


class Buckets(dict):
    """Word to hash bucket, remembered; -1 for buckets outside ``known``."""

    def __init__(self, bits: int, known: np.ndarray | None = None):
        super().__init__()
        self.mask, self.known = (1 << bits) - 1, known

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        term = word.strip(PUNCTUATION)
        b = zlib.crc32(term) & self.mask if term else -1
        if b >= 0 and self.known is not None and not self.known[b]:
            b = -1
        self[word] = b
        return b

    def terms(self, text: bytes) -> np.ndarray:
        """Distinct buckets of a text, ascending."""
        found = set(map(self.__getitem__, set(byte_words(text))))
        found.discard(-1)
        return np.fromiter(sorted(found), np.int32, len(found))


def _raw(machine: Machine, terms: np.ndarray) -> tuple[float, np.ndarray]:
    """Logit of a document and the factors of its terms."""
    v = machine.factors[terms]
    s = v.sum(0)
    return machine.bias + machine.linear[terms].sum() + 0.5 * ((s * s).sum() - (v * v).sum()), v


def _linear(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, size: int, l1: float, epochs: int, rng) -> tuple[float, np.ndarray]:
    """Bias and term weights by follow-the-regularized-leader steps.

    A term's evidence is the sum of its rows' errors; only what exceeds ``l1`` of it counts, and
    steps shorten as it is seen. So the shrinkage of a term depends on its frequency: a term
    of many alike rows soon stands for them, a term of one row can hardly remember it.
    """
    evidence, seen, w, bias = np.zeros(size), np.zeros(size), np.zeros(size), 0.0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            t = rows[k]
            own = w[t]
            err = (1 / (1 + np.exp(-np.clip(bias + own.sum(), -30, 30))) - labels[k]) * weights[k]
            bias -= 0.02 * err
            before = seen[t]
            seen[t] = after = before + err * err
            evidence[t] = z = evidence[t] + err - (np.sqrt(after) - np.sqrt(before)) * own
            w[t] = -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / (2 + np.sqrt(after))
    return bias, w


def _pairs(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, start: Machine, rank: int, shrink: float, rate: float, epochs: int, rng) -> Machine:
    """Factors of all terms by Adagrad steps on the errors that the linear part leaves."""
    size = len(start.linear)
    factors = rng.normal(0, 0.01, (size, rank))
    seen = np.full((size, rank), 1e-2)
    m = start._replace(factors=factors)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            t = rows[k]
            z, v = _raw(m, t)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[k]) * weights[k]
            if abs(err) < 0.01 or not len(t):
                continue
            g = err * (v.sum(0) - v) + shrink * v
            seen[t] += g * g
            factors[t] = v - rate * g / np.sqrt(seen[t])
    return m


def _loss(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    p = np.clip(scores, 1e-6, 1 - 1e-6)
    return float((weights * -np.log(np.where(labels > 0, p, 1 - p))).sum())


def _shift(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray, clean: float) -> float:
    """What to add to the logits for the least loss, rows without the label counting ``clean`` times.

    The loss is convex in the shift, so its slope's zero is found by halving.
    """
    z = np.log(np.clip(scores, 1e-9, 1 - 1e-9) / np.clip(1 - scores, 1e-9, 1))
    cost = weights * np.where(labels > 0, 1.0, clean)
    low, high = -5.0, 5.0
    for _ in range(40):
        middle = (low + high) / 2
        slope = (cost * (1 / (1 + np.exp(-(z + middle))) - labels)).sum()
        low, high = (low, middle) if slope > 0 else (middle, high)
    return (low + high) / 2


def train(
    rows: list[np.ndarray],
    labels: np.ndarray,
    bits: int = 18,
    rank: int = 4,
    l1: float = 15.0,
    epochs: int = 6,
    pair_epochs: int = 12,
    shrink: float = 2e-4,
    rate: float = 0.09,
    clean: float = 2.0,
    seed: int = 5,
) -> Machine:
    """Fit a machine on presence features; both labels weigh alike in total.

    Every bucket of the sample has a weight and factors; ``2^bits`` bounds the model. The
    linear part is learned first, the factors on what it leaves. A first fit on three
    quarters of the rows tells, on the fourth, how far to trust the pairs (a scale of
    0 to 1 by its loss) and where the scores part (a shift of the bias, in which a row without
    the label weighs ``clean`` times); the fit on all rows
    takes both over. Without rows, or with one label only, the machine answers the label's share.
    """
    size = 1 << bits
    labels = np.asarray(labels, float)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    known = np.zeros(size, bool)
    none = Machine(float(np.log(share / (1 - share))), np.zeros(size, np.float32), np.zeros((size, rank), np.float32), known)
    if len(labels) == 0 or labels.min() == labels.max():
        return none
    weights = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))

    def fit(idx: np.ndarray) -> Machine:
        rng = np.random.default_rng(seed)
        some = [rows[k] for k in idx]
        bias, linear = _linear(some, labels[idx], weights[idx], size, l1, epochs, rng)
        return _pairs(some, labels[idx], weights[idx], Machine(bias, linear, none.factors, known), rank, shrink, rate, pair_epochs, rng)

    fourth = np.random.default_rng(seed).permutation(len(rows)) % 4 == 0
    scale, shift = 1.0, 0.0
    for side in (fourth, ~fourth):
        if labels[side].min(initial=1) == labels[side].max(initial=0) or side.sum() < 2:
            break
    else:
        machine = fit(np.flatnonzero(~fourth))
        tried = [rows[k] for k in np.flatnonzero(fourth)]
        y, cost = labels[fourth], weights[fourth]
        scored = {s: score_terms(machine._replace(factors=machine.factors * np.sqrt(s)), tried) for s in (0.0, 0.1, 0.3, 1.0)}
        scale = min(scored, key=lambda s: _loss(scored[s], y, cost))
        shift = _shift(scored[scale], y, cost, clean)
    machine = fit(np.arange(len(rows)))
    known[np.concatenate(rows)] = True
    return Machine(machine.bias + shift, machine.linear.astype(np.float32), (machine.factors * np.sqrt(scale)).astype(np.float32), known)


def score_terms(machine: Machine, rows: list[np.ndarray]) -> np.ndarray:
    """Scores of many documents at once."""
    if not rows:
        return np.empty(0)
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64)
    ends = np.cumsum(lengths)

    def summed(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0, dtype=float)])
        return total[ends] - total[ends - lengths]

    v = machine.factors[flat]
    z = machine.bias + summed(machine.linear[flat]) + 0.5 * (summed(v) ** 2 - summed(v * v)).sum(1)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def collect_terms(sample: DataFrame, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed terms and labels of the bounded sample, in id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(bits)
        for b in pieces(batches):
            terms = [buckets.terms(x).tobytes() for x in b["text"].to_pylist()]
            yield pa.record_batch([b["__id"].cast(pa.int64()), b["label"], pa.array(terms, pa.binary())], ["id", "label", "terms"])

    got = sorted(sample.mapInArrow(run, "id long, label int, terms binary").collect())
    return [np.frombuffer(r["terms"], np.int32) for r in got], np.array([r["label"] for r in got], float)


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, bits: int = 18, seed: int = 5, **fit) -> Callable[[Column], Column]:
    """Learn from labelled ``docs``; returns the score as a function of a text column.

    At most ``max_rows`` labelled documents outside the held-out fold are learned from,
    and only text enters a score. All their terms are learned (``train``). Without labels
    the score is the neutral 0.5. The function's ``learned`` tells whether any term has a
    weight; if not, all scores are alike and tell nothing.
    """
    rows, y = collect_terms(training_rows(docs, labels, "toxic", max_rows, seed), bits)
    machine = train(rows, y, bits=bits, seed=seed, **fit)
    model = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets = Buckets(bits, model.value.known)
        for texts in batches:
            parts = (texts.slice(at, 256).to_pylist() for at in range(0, len(texts), 256))
            scores = [score_terms(model.value, [buckets.terms(x) for x in part]) for part in parts]
            yield pa.array(np.concatenate([np.empty(0), *scores]), pa.float64())

    # nondeterministic: a filter on the score must not compute it a second time
    scored = score.asNondeterministic()

    def of(text: Column) -> Column:
        return scored(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))

    of.learned = bool(machine.known.any())
    return of


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Null and empty texts score by the bias; equal texts score alike; repeated rows each
    get a row; an empty table gives an empty result; other columns are not read.
    """
    score = fit_toxicity(docs, labels, **options)
    held_out = fold(F.col("doc_id"), FOLDS) == 0
    scored = docs.select("doc_id", held_out.alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
