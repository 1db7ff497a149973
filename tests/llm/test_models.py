"""Operators 1, 2, 7, 8, 9 and 10: exact parts by brute force, learned parts on held-out rows."""

import math
import random
import zlib
from collections import Counter


import duckdb
import numpy as np
from conftest import frame, sentence
from pyspark.sql import functions as F

from gleaner.llm import lm as lm_module
from gleaner.llm import mixing
from gleaner.llm.cascade import Rule, cascade, default_rules, order_rules
from gleaner.llm.decontaminate import Shard, block_max_wand, contaminated, weighted_postings, without_leaks
from gleaner.llm.labelled import training_rows
from gleaner.llm.lm import lm_scores, pack, pack_hashes, unpack, unpack_hashes
from gleaner.llm.mixing import mix
from gleaner.llm.quality import quality
from gleaner.llm.queries import ORACLES, QUERIES, mixed
from gleaner.llm.toxicity import Buckets, Machine, score_terms, toxicity, train


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for top in (1, 200, 2**20, 2**63):
        x = rng.integers(0, top, 500, np.uint64)
        assert (unpack(pack(x)) == x).all()
        assert (unpack_hashes(pack_hashes(np.sort(x))) == np.sort(x)).all()
    assert len(unpack(pack(np.empty(0, np.uint64)))) == 0


def brute_lm(texts, order):
    """Base scores, and the model's by the documented formula with weights learned in plain Python."""
    tokens = {i: (t or "").encode().lower().split() + [b" "] for i, t in enumerate(texts)}
    train_ids = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train_ids for w in tokens[i])
    n, v = sum(c.values()), len(c)
    return {i: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t) for i, t in tokens.items()}, n, c, tokens


def test_lm_scores(spark, monkeypatch):
    rng = random.Random(3)
    follow = {k: rng.sample(range(80), 4) for k in range(80)}

    def chain(n):
        k, out = rng.randrange(80), []
        for _ in range(n):
            out.append(f"v{k}")
            k = rng.choice(follow[k])
        return " ".join(out)

    texts = [chain(60) for _ in range(150)]
    base, n, c, tokens = brute_lm(texts, 2)
    learned = {}
    real = lm_module.learn_weights
    monkeypatch.setattr(lm_module, "learn_weights", lambda *a: learned.setdefault("w", real(*a)))
    # small blocks and slices: counts cross every border
    got = {r["doc_id"]: r for r in lm_scores(frame(spark, texts), block_tokens=500, slice_tokens=700).collect()}
    for i, t in tokens.items():
        assert abs(got[i]["base_score"] - base[i]) < 1e-6
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
    pairs = Counter(p for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for p in zip([b" ", *t], t))
    weights = learned["w"]
    assert np.allclose(weights.sum(1), 1)
    for i, t in tokens.items():
        total = 0.0
        for h, w in zip([b" ", *t], t):
            f = [1 / (len(c) + 1), c[w] / n, pairs[h, w] / c[h] if c[h] else 0.0]
            total += math.log10(sum(a * b for a, b in zip(weights[int(math.log2(1 + c[h]))], f)))
        assert abs(got[i]["score"] - total) < 1e-6
    held = [r for r in got.values() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 20 * len(held)


def test_trigram_model_beats_bigram_on_its_own_text(spark):
    texts = ["a b c a b d", "x b e x b f"] * 60
    score = lambda order: sum(r["score"] for r in lm_scores(frame(spark, texts), order=order).collect())
    assert score(3) > score(2) > score(1)


def test_mixture_meets_its_marginals(spark):
    rng = random.Random(7)
    rows = [(i, "hot" if rng.random() < 0.4 else f"s{rng.randrange(5)}", rng.choice(["en", "de", None]), 10) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, weight int")
    out = mix(
        docs,
        {"source": F.col("source"), "lang": F.col("lang")},
        {"source": 0.5, "lang": {"en": 0.7, "de": 0.2, "unknown": 0.1, "absent": 0.5}},
        F.lit(10),
        F.col("doc_id"),
    ).persist()
    got = {r["lang"]: r["w"] for r in out.groupBy("lang").agg((F.sum("weight") / 4000).alias("w")).collect()}
    assert all(abs(got[k] - v) < 1e-6 for k, v in {"en": 0.7, "de": 0.2, "unknown": 0.1}.items())
    own = Counter(r[1] for r in rows)
    norm = sum(math.sqrt(x) for x in own.values())
    got = {r["source"]: r["w"] for r in out.groupBy("source").agg((F.sum("weight") / 4000).alias("w")).collect()}
    assert all(abs(got[k] - math.sqrt(x) / norm) < 1e-6 for k, x in own.items())
    copies = out.agg(F.sum("n_copies")).first()[0]
    assert abs(copies - 4000) < 250
    assert out.where("n_copies > 0 and n_copies > weight + 1").count() == 0


def test_raking_without_exchanges_as_cells_fit_a_task(spark, monkeypatch):
    rows = [(i, f"s{i * i % 7}", ["en", "de", None][i % 5 % 3], 1 + i % 4) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n long")
    plans, save = [], mixing.Scratch.save

    def saved(self, df, *by):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df, *by)

    monkeypatch.setattr(mixing.Scratch, "save", saved)

    def mixed_by(cells_per_task):
        monkeypatch.setattr(mixing, "CELLS_PER_TASK", cells_per_task)
        plans.clear()
        targets = {"source": 0.5, "lang": {"en": 0.6, "de": 0.3, "unknown": 0.1}}
        out = mix(docs, {"source": F.col("source"), "lang": F.col("lang")}, targets, F.col("n"), F.col("doc_id"))
        weights = {r["doc_id"]: r["weight"] for r in out.collect()}
        return weights, [p for p in plans if "Window" in p]

    one, whole = mixed_by(mixing.CELLS_PER_TASK)
    many, dealt = mixed_by(3)
    assert whole and not any("Exchange" in p for p in whole)
    assert dealt and all("Exchange" in p for p in dealt)
    assert len(one) == 900 and all(abs(one[k] - many[k]) < 1e-9 for k in one)


def test_languages_without_a_target_keep_their_share(spark):
    langs = ["en"] * 500 + ["de"] * 200 + [None] * 200 + ["it"] * 100
    rows = [(i, f"s{i % 3}", x, "ten words " * 5) for i, x in enumerate(langs)]
    out = mixed(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")).persist()
    got = {r["lang"]: r["w"] for r in out.groupBy("lang").agg((F.sum("weight") / 1000).alias("w")).collect()}
    want = {"unknown": 0.2, "it": 0.1, "en": 0.7 * 0.62 / 0.76, "de": 0.7 * 0.14 / 0.76}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-6 for k, v in want.items())
    drawn = {r["lang"]: r["n"] for r in out.groupBy("lang").agg(F.sum("n_copies").alias("n")).collect()}
    assert drawn["unknown"] > 150 and drawn["it"] > 70


def test_mixing_equals_its_sql_with_null_and_unlisted_categories(spark, tmp_path):
    rng = random.Random(21)
    rows = [
        (i, None if i % 50 == 0 else sentence(rng, rng.randint(1, 60)) + rng.choice(["", " a | b", " !!", " x=1"]),
         rng.choice(["en", "en", "de", "fr", "it", None, "es"]), rng.choice(["a", "b", "c", None]), 0)
        for i in range(600)
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(ORACLES["op2_mixing"])
    got = QUERIES["op2_mixing"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert min(r["weight"] for r in got if r["lang"] in ("it", "unknown") and r["n_tokens"]) > 0


def test_machine_learns_what_terms_mean_together():
    rng = random.Random(5)
    docs = []
    for _ in range(1200):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w = sentence(rng, 12, 40).split() + ["vile"] * insult + ["folk"] * group
        rng.shuffle(w)
        docs.append((" ".join(w), int(insult == group)))  # no single term tells
    buckets = Buckets(14)
    terms = [buckets.terms(t.encode()) for t, _ in docs]
    y = np.array([x for _, x in docs])
    machine = train(terms[:900], y[:900], bits=14, pair_epochs=60, shrink=1e-4)
    got = score_terms(machine, terms[900:]) >= 0.5
    assert (got == y[900:]).mean() > 0.95


def test_machine_learns_pairs_of_neutral_terms_in_a_large_vocabulary():
    rng = random.Random(5)
    docs = []
    for _ in range(8000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w = sentence(rng, 12, 8000).split() + ["vile"] * insult + ["folk"] * group
        docs.append((" ".join(w), int(insult == group)))  # no single term tells
    buckets = Buckets(18)
    terms = [buckets.terms(t.encode()) for t, _ in docs]
    y = np.array([x for _, x in docs])
    machine = train(terms[:6000], y[:6000])
    assert machine.known[np.concatenate(terms[:6000])].all()
    got = score_terms(machine, terms[6000:]) >= 0.5
    assert (got == y[6000:]).mean() > 0.95


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    for out, label, least in ((toxicity(docs, labels), "toxic", 0.9), (quality(docs, labels), "quality", 0.95)):
        rows = out.where("held_out").join(labels, "doc_id").collect()
        assert rows and all(0 <= r["score"] <= 1 for r in rows)
        assert sum(r["predicted"] == r[label] for r in rows) / len(rows) >= least
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out.limit(50).collect())


def test_held_out_toxic_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity(docs, labels).where("held_out").join(labels.where("toxic is not null"), "doc_id").collect()
    toxic, clean = ([r["score"] for r in rows if r["toxic"] == k] for k in (1, 0))
    # about one in ten toxic labels is of a text without any word that others share
    assert sum(s >= 0.5 for s in toxic) / len(toxic) >= 0.85
    assert sum(s < 0.5 for s in clean) / len(clean) >= 0.95
    assert sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / len(toxic) / len(clean) >= 0.97


def test_scores_are_the_plain_formula():
    rng = np.random.default_rng(3)
    machine = Machine(0.3, rng.normal(size=32).astype(np.float32), rng.normal(size=(32, 3)).astype(np.float32), np.ones(32, bool))
    rows = [np.sort(rng.choice(32, n, False)).astype(np.int32) for n in (0, 1, 2, 5, 20)]
    for t, got in zip(rows, score_terms(machine, rows)):
        z = machine.bias + sum(float(machine.linear[i]) for i in t)
        z += sum(float(machine.factors[i].astype(float) @ machine.factors[j].astype(float)) for i in t for j in t if i < j)
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-6


def test_an_id_is_learned_from_once(spark):
    docs = frame(spark, ["t"] * 200).unionByName(spark.createDataFrame([(7, f"u{i}") for i in range(500)], "doc_id long, text string"), True)
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, toxic int")
    rows = training_rows(docs, labels, "toxic", 150, 1).collect()
    assert len(rows) == len({r["__id"] for r in rows}) == 150


def test_training_sample_is_bounded(spark):
    docs = frame(spark, ["t"] * 200)
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, toxic int")
    rows = training_rows(docs, labels, "toxic", 30, 1).collect()
    assert len(rows) == 30 and all(zlib.crc32(str(r["__id"]).encode()) % 5 for r in rows)


def test_wand_returns_all_above_the_threshold(spark):
    rng = random.Random(9)
    items = spark.createDataFrame([(i * 3, sentence(rng, rng.randint(16, 60), 120)) for i in range(90)], "item_id long, text string")
    rows = weighted_postings(items, 1 << 20).collect()
    shard = Shard(rows)
    for _ in range(120):
        query = [w.encode() for w in sentence(rng, 60, 140).split()]
        terms = np.unique([shard.numbers[w] for w in query if w in shard.numbers])
        for index in shard.indexes:
            for least in (0.3, 0.5, 0.7):
                want = {}
                for r in rows:
                    if r["item_id"] in index.parts:
                        s = sum(p["w"] for p in r["postings"] if p["term"].encode() in set(query))
                        if s >= least:
                            want[r["item_id"]] = s
                got = dict(block_max_wand(index, terms, least))
                assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_planted_items_are_found_and_others_are_not(spark):
    rng = random.Random(10)
    texts = [". ".join(sentence(rng, 12, 3000) for _ in range(rng.choice([2, 3]))) for _ in range(40)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs, want = [], set()
    for i in range(120):
        w = [[x] for x in sentence(rng, rng.randint(5, 300), 3000).split()]
        for k in rng.sample(range(40), rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))].append(texts[k].upper() if k % 2 else texts[k])
            want.add((i, k))
        docs.append(" ".join(x for parts in w for x in parts))
    for options in ({}, {"index_bytes": 2000}):
        got = contaminated(frame(spark, docs), items, **options).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
        left = without_leaks(frame(spark, docs), items, **options)
        assert {r["doc_id"] for r in left.collect()} == set(range(len(docs))) - {i for i, _ in want}


def test_shards_are_broadcast_one_at_a_time(spark, monkeypatch):
    rng = random.Random(12)
    items = spark.createDataFrame([(i, sentence(rng, 30, 3000)) for i in range(40)], "item_id long, text string")
    live, most, share = set(), [], spark.sparkContext.broadcast

    def counted(value):
        b = share(value)
        if isinstance(value, Shard):
            live.add(id(b))
            most.append(len(live))
            end = b.destroy
            monkeypatch.setattr(b, "destroy", lambda: (live.discard(id(b)), end()))
        return b

    monkeypatch.setattr(spark.sparkContext, "broadcast", counted)
    contaminated(frame(spark, ["some text"]), items, index_bytes=2000).count()
    assert len(most) > 2 and set(most) == {1} and not live


def test_cascade_verdict_does_not_depend_on_the_order(spark):
    rng = random.Random(11)
    texts = [sentence(rng, 60) + "." for _ in range(30)] + ["A! " * 80, "### " * 90, sentence(rng, 60).upper(), "x 1234567 " * 60]
    docs = frame(spark, texts)
    rules = default_rules()
    keep = lambda r: {x["doc_id"]: x["kept"] for x in cascade(docs, r).collect()}
    assert keep(rules) == keep(rules[::-1])


def test_cascade_prefers_rejection_per_cost(spark):
    sample = spark.range(1000).select(F.col("id"), F.lit("text").alias("text")).persist()
    rules = [Rule("none", F.lit(False)), Rule("few", F.col("id") < 10), Rule("most", F.col("id") >= 10), Rule("all_but", F.col("id") >= 11)]
    names = [r.name for r in order_rules(sample, rules, floor=10.0)]
    # once the most selective has run, what it let through counts, not a rule's own share
    assert names[:2] == ["most", "few"]


def test_subwords_of_alike_words():
    from gleaner.llm.quality import Projected, pair, score_words, subwords, subwords_alike

    mask = (1 << 17) - 1
    for words in ([b"a", b"~"], [b"to", b"\x00\x01"], [b"their", b"quick", b"<<>>="]):
        assert subwords_alike(words, mask).tolist() == [subwords(x, mask) for x in words]
    margin = np.random.default_rng(1).normal(size=mask + 1).astype(np.float32)
    texts = [t.encode().split() for t in ("a to to their straße", "", "x", "é é \u4e2d\u6587 quick to")]
    known = Projected(margin, 17)
    known.learn(texts)
    for w in texts:
        total, n = 0.0, 0
        for x in w:
            ids = subwords(x, mask)
            total, n = total + float(margin[ids].sum()), n + len(ids)
        ids = [pair(a, b, mask) for a, b in zip(w, w[1:])]
        total, n = total + float(margin[ids].sum()) if ids else total, n + len(ids)
        assert score_words(w, known, 0.5) == 1 / (1 + np.exp(-(0.5 + (total / n if n else 0.0))))


def test_term_numbers_are_those_of_the_bare_words():
    import pyarrow as pa

    from gleaner.llm.decontaminate import bare_words, term_numbers

    terms = [b"a", b"b-c", "é".encode()]
    texts = [None, b"", b" .. ", b"a, (b-c) \xe9 x\x1ca", "\té\u00a0 \"é\"\n\x0b a\x0c".encode(), b"...a...", b"a\x00"]
    vocabulary = pa.array([t.decode() for t in terms], pa.string())
    for kind in (pa.binary(), pa.large_binary()):
        got = term_numbers(pa.array([b"a a", *texts], kind).slice(1), vocabulary)
        want = [[terms.index(w) if w in terms else -1 for w in bare_words(x or b"")] for x in texts]
        assert [g.tolist() for g in got] == want


def test_live_windows_are_those_with_a_live_block():
    from gleaner.llm.decontaminate import Index, block_max_wand, live_windows

    rng = np.random.default_rng(4)
    postings = {i: [(b"%d" % t, float(rng.uniform(0.1, 0.4))) for t in rng.choice(40, 6, False)] for i in range(30)}
    index = Index({b"%d" % t: t for t in range(40)}, postings, {i: [(b"x", False)] for i in postings}, 8)
    ids = rng.integers(-1, 40, 400).astype(np.int32)
    starts = np.arange(0, 392, 4)
    live = dict(live_windows(index, ids, starts, starts + 8, 0.9))
    hits = 0
    for k, s in enumerate(starts):
        terms = np.unique(ids[s : s + 8])
        terms = terms[terms >= 0]
        found = block_max_wand(index, terms, 0.9)
        hits += len(found)
        assert k not in live or live[k].tolist() == terms.tolist()
        assert not found or k in live
    assert hits and len(live) < len(starts)
