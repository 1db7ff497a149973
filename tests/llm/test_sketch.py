"""Fingerprints against plain sets."""

import hashlib
import random

from conftest import SCHEMA, frame, sentence

from gleaner.llm import sketch as S
from pyspark.sql import functions as F


def hashes(text, n=5):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    runs = [w] if 0 < len(w) <= n else [w[i : i + n] for i in range(len(w) - n + 1)]
    return {hashlib.md5(b" ".join(r)).hexdigest()[:12] for r in runs}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, following):
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def test_whole_sets_are_exact(spark, odd_docs):
    got = S.edited_fingerprints(odd_docs, k=100_000).collect()
    assert len(got) == odd_docs.count()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd_docs.collect() if r["doc_id"] is not None), key=lambda r: (-r[0], r[1]))
    nexts = {rows[i][0]: rows[(i + 1) % len(rows)][1] for i in range(len(rows))}
    texts = dict(rows)
    for r in got:
        text, following = texts.get(r["doc_id"], ""), nexts.get(r["doc_id"], "")
        if r["doc_id"] == 3:  # stands twice: the first is followed by the second
            following = None
        assert r["n_chars"] == len(text)
        assert r["fingerprint"] == "".join(sorted(hashes(text)))
        assert r["n_shingles"] == len(hashes(text))
        if following is not None:
            other = edited(text, following)
            assert r["edited_sha256"] == hashlib.sha256(other.encode()).hexdigest()
            assert r["edited_fingerprint"] == "".join(sorted(hashes(other)))
            assert r["near_edited"] == jaccard(hashes(text), hashes(other))
            assert r["near_next"] == jaccard(hashes(text), hashes(following))
    twice = sorted((r["edited_sha256"], r["near_next"]) for r in got if r["doc_id"] == 3)
    wanted = [edited(texts[3], texts[3]), edited(texts[3], texts[2])]
    assert [x for x, _ in twice] == sorted(hashlib.sha256(t.encode()).hexdigest() for t in wanted)


def test_order_over_many_parts(spark):
    rng = random.Random(7)
    ids = rng.sample(range(10**12), 300) + list(range(300))  # far apart and close together
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(7)
    placed, down = S.descending(docs, "doc_id", "text")
    got = placed.withColumn("next", F.lead("text").over(down)).where("not __guest").collect()
    ids.sort(reverse=True)
    assert {r["doc_id"]: r["next"] for r in got} == {a: f"text {b}" for a, b in zip(ids, ids[1:] + ids[:1])}
    assert len({r["__part"] for r in got}) > 20 and len(got) == 600


def test_estimates(spark):
    rng = random.Random(8)
    a = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    docs = spark.createDataFrame([(1, " ".join(a), " ".join(a[:4500] + a[:1500])), (2, " ".join(a[:3000]), " ".join(a))], "doc_id long, a string, b string")
    x, y = F.col("x"), F.col("y")
    got = docs.select("*", S.sketch(F.col("a")).alias("x"), S.sketch(F.col("b")).alias("y")).select(
        "*", S.resemblance(x, y).alias("r"), S.containment(x, y).alias("c"), S.distinct_shingles(x).alias("n"), S.merge(x, y).alias("m")
    )
    for r in got.collect():
        p, q = hashes(r["a"]), hashes(r["b"])
        assert r["x"] == sorted(p)[:256] and r["m"] == sorted(p | q)[:256]
        assert abs(r["r"] - jaccard(p, q)) < 0.12 and abs(r["c"] - len(p & q) / len(p)) < 0.12
        assert abs(r["n"] / len(p) - 1) < 0.25


def test_merged_sketches_of_groups(spark):
    rng = random.Random(9)
    rows = [(i, sentence(rng, rng.randint(0, 60)), None if i % 4 == 3 else f"g{i % 4 % 2}") for i in range(80)] + [(80, "", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = S.merge_sketches(docs.withColumn("s", S.sketch(F.col("text"), k=40)), ["source"], "s", k=40).collect()
    for r in got:
        whole = set().union(*(hashes(t) for _, t, g in rows if g == r["source"]))
        assert r["s"] == sorted(whole)[:40]
    assert len(got) == 4


def test_empty_table(spark, no_docs):
    assert S.edited_fingerprints(no_docs).collect() == []


def test_only_nulls(spark):
    docs = spark.createDataFrame([(None,) * 10] * 2, SCHEMA)
    got = S.edited_fingerprints(docs).collect()
    assert [(r["n_chars"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in got] == [(0, "", 1.0, 1.0)] * 2


def test_equal_texts(spark):
    got = S.edited_fingerprints(frame(spark, ["a b c d e f g"] * 3)).collect()
    assert len({r["fingerprint"] for r in got}) == 1 and {r["near_next"] for r in got} == {1.0}
