"""Source divergence against plain sums over all terms."""

import random
import re
from collections import Counter, defaultdict

from conftest import SCHEMA

from gleaner.llm.divergence import source_divergence, term_counts, tree_sums

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs=10, top=10):
    counts, documents, groups = defaultdict(Counter), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        groups.add((lang, source))
        counts[lang, source].update(found)
        documents.update((lang, t) for t in set(found))
    out = set()
    for lang in {g for g, _ in groups}:
        kept = [t for (g, t), n in documents.items() if g == lang and n >= min_docs]
        of = {s: {t: counts[lang, s][t] for t in kept} for g, s in groups if g == lang}
        whole = {t: sum(c[t] for c in of.values()) for t in kept}

        def shares(c):
            return {t: 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()}

        p, q = {s: shares(c) for s, c in of.items()}, shares(whole)

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        for s in of:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in of if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, items, last in (("pair", pair, len(pair)), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:last]
                out |= {(lang, s, part, item, v, k) for k, (v, item) in enumerate(ranked, 1)}
    return out


def corpus(n=400):
    rng = random.Random(3)
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", "z", None])
        first = sum(map(ord, source or "x")) % 7
        text = " ".join(rng.choice([f"w{chr(97 + int(rng.paretovariate(0.8)) % 26)}", "Ünd", "THE", f"t{'xyzuvwq'[first]}"]) for _ in range(rng.randint(0, 40)))
        rows.append((text, lang, source))
    rows += [(None, "en", "empty"), ("", "en", "blank"), ("... 123", "fr", "only"), ("one", "fr", "lone")] + rows[:5]
    # a term's rows of very different length, one very long text
    rows += [("common " * 3000, "en", f"s{k:02d}") for k in range(30)] + [("common rare", "en", f"s{k:02d}") for k in range(0, 30, 2)]
    return rows


def documents(spark, rows):
    return spark.createDataFrame([(i, t, g, s, 0, "x", 1, 0.5, 1, True) for i, (t, g, s) in enumerate(rows)], SCHEMA).repartition(4)


def test_against_plain_sums(spark):
    rows = corpus()
    got = [tuple(r) for r in source_divergence(documents(spark, rows)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain(rows)


def test_other_thresholds(spark):
    rows = corpus(120)
    assert {tuple(r) for r in source_divergence(documents(spark, rows), min_docs=2, top=3).collect()} == plain(rows, 2, 3)


def test_nothing_kept_and_nothing_at_all(spark, no_docs):
    rows = [("one two", "en", "a"), ("three", "en", "b"), (None, None, None)]
    assert {tuple(r) for r in source_divergence(documents(spark, rows)).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert source_divergence(no_docs).collect() == []


def test_counts_pass_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr("gleaner.llm.divergence.HELD", 5)
    got = {tuple(r) for r in term_counts(documents(spark, corpus(50))).collect()}
    monkeypatch.undo()
    assert got == {tuple(r) for r in term_counts(documents(spark, corpus(50))).collect()}


def test_tree_cut_anywhere_sums_up_alike(spark, monkeypatch):
    rng = random.Random(5)
    p0 = {s: rng.randrange(1, 10**6) for s in "abcdef"}
    rows = []
    for lang in ("en", "de"):
        for _ in range(200):
            row = [(s, n := rng.randrange(1, 4), p0[s] * (n + 2), p0[s]) for s in "abcdef" if rng.random() < 0.6]
            if row:
                rows.append((lang, row, rng.randrange(1, 50)))
    wanted = Counter()
    for lang, row, times in rows:
        for i, (a, _, p, x) in enumerate(row):
            for b, _, q, y in row[:i]:
                f = [(u - v) ** 2 // (u + v) for u, v in ((p, q), (p, y), (x, q), (x, y))]
                wanted[lang, a, b] += times * (f[0] - f[1] - f[2] + f[3])
    frame = spark.createDataFrame(rows, "lang string, row array<struct<source:string,n:long,p:long,p0:long>>, times long")
    for parts, bound in ((1, 1_000_000), (3, 50), (5, 1)):
        monkeypatch.setattr("gleaner.llm.divergence.TREE_CELLS", bound)
        got = Counter()
        for r in tree_sums(frame.repartition(parts).sortWithinPartitions("lang", "row")).collect():
            got[r["lang"], r["a"], r["b"]] += r["value"]
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in wanted.items() if v}
