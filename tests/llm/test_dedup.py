"""Operators 4, 5 and 6 against brute force."""

import hashlib
import random

import numpy as np
import pytest
from conftest import frame, sentence

from gleaner.llm import linededup, minhash
from gleaner.llm.bwt import shared_windows
from gleaner.llm.components import star_forest
from gleaner.llm.editdistance import within
from gleaner.llm.exactdedup import remove_repeats
from gleaner.llm.linededup import near_lines, parts, probe_places
from gleaner.llm.minhash import near_duplicates
from gleaner.llm.scratch import Scratch
from gleaner.llm.segments import segments


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def changed(rng, text, times, letters="abé"):
    out = list(text)
    for _ in range(times):
        at = rng.randrange(len(out) + 1)
        how = rng.random()
        if how < 0.4 and at < len(out):
            out[at] = rng.choice(letters)
        elif how < 0.7:
            out.insert(at, rng.choice(letters))
        elif len(out) > 6 and at < len(out):
            out.pop(at)
    return "".join(out)


def test_banded_distance():
    rng = random.Random(1)
    for limit in (1, 2, 5):
        a = ["".join(rng.choice("abé") for _ in range(rng.randint(limit, 14))) for _ in range(800)]
        b = [x for x in (changed(rng, x, rng.randint(0, limit + 2)) for x in a)]
        pairs = [(x, y) for x, y in zip(a, b) if len(y) >= limit]
        got = within(*map(list, zip(*pairs)), limit)
        assert got.tolist() == [min(edits(x, y), limit + 1) for x, y in pairs]


def test_segments_meet_for_every_pair_within_the_limit():
    rng = random.Random(2)
    for _ in range(600):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(6, 20)))
        b = changed(rng, a, rng.randint(0, 2), "ab")
        short, long = sorted((a, b), key=len)
        if edits(a, b) <= 2:
            own = {(k, short[p : p + n]) for k, (p, n) in enumerate(parts(len(short), 2))}
            assert own & {(k, long[p : p + n]) for k, p, n in probe_places(len(long), len(short), 2)}


def near_copies(rng):
    lines = [sentence(rng, 8) for _ in range(25)]
    lines += [changed(rng, rng.choice(lines), rng.randint(1, 4)) for _ in range(60)]
    return ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6))) for _ in range(60)]


def test_near_lines_against_brute_force(spark):
    texts = near_copies(random.Random(3))
    got = {
        (r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"], r["n_copies"], r["n_links"], r["kept"])
        for r in near_lines(frame(spark, texts), slice_bytes=2000, buffer_lines=20).collect()
    }
    at = [((i, k), line) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n"))]
    for place, line in at:
        own = [p for p, x in at if x == line]
        others = {x for _, x in at if x != line and edits(x, line) <= 2}
        first = min(own)
        earlier = any(p < first for p, x in at if x in others)
        assert got[place] == (*first, len(own), len(others), place == first and not earlier), (place, line)


def test_lines_of_one_template_are_compared_in_blocks(spark):
    rng = random.Random(31)
    texts = ["\n".join(f"{rng.choice('ab')}{rng.randrange(100):02d} the very same template {rng.randrange(1000):03d}" for _ in range(20)) for _ in range(15)]
    docs = frame(spark, texts)
    plan = {"slice_bytes": 1 << 20, "buffer_lines": 50, "block_entries": 40, "hot_sample": 1}
    hot = linededup.hot_keys(docs, 2, 20, 1, 40, 1)
    assert len(hot.keys) and hot.index_blocks.max() > 3
    # no group of the template's key holds more than a few blocks
    dealt = linededup.entries(docs, 2, 20, 1, 10_000, hot).collect()
    sizes = {}
    for r in dealt:
        sizes[r["slice"]] = sizes.get(r["slice"], 0) + len(r["lines"]) // 8
    assert max(n for k, n in sizes.items() if k) < 160 < sum(len(set(t.split("\n"))) for t in texts)
    rows = lambda **o: sorted(tuple(r) for r in near_lines(docs, **o).collect())
    got = rows(**plan)
    assert got == rows() and sum(r[6] for r in got) > 0
    lines = [x for t in texts for x in t.split("\n")]
    for r in got[::15]:
        mine = texts[r[0]].split("\n")[r[1]]
        assert r[6] == len({x for x in lines if x != mine and edits(x, mine) <= 2})


def test_short_lines_are_counted_and_linked(spark):
    rng = random.Random(32)
    texts = ["\n".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(9))) for _ in range(5)) for _ in range(60)]
    texts += ["a line of nineteen.", "a line of nineteen.", "a line of nineteen.\nand more"]
    at = [((i, k), line) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n"))]
    got = {(r["doc_id"], r["line_no"]): tuple(r)[3:] for r in near_lines(frame(spark, texts), slice_bytes=500, buffer_lines=20).collect()}
    for place, line in at:
        own = [p for p, x in at if x == line] if line else [place]
        others = {x for _, x in at if x != line and min(len(x), len(line)) > 2 and edits(x, line) <= 2}
        assert got[place] == (*min(own), len(own), len(others), True), (place, line)


def test_near_lines_keep_small_classes(spark):
    same = "a line that is long enough to count"
    got = near_lines(frame(spark, [same] * 5 + ["another line, quite unlike the first"]), min_repeats=6)
    assert all(r["kept"] for r in got.collect())


def brute_repeats(texts, length):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passages(rng):
    shared = [sentence(rng, 45) for _ in range(4)] + ["x" * 400, "ab" * 150, "né " * 90]
    texts = []
    for _ in range(40):
        parts_ = [sentence(rng, rng.randint(0, 40)) for _ in range(3)]
        for s in rng.sample(shared, rng.randint(0, 3)):
            cut = rng.randrange(len(s) // 2)
            parts_.insert(rng.randrange(len(parts_)), s[cut:])
        texts.append(" ".join(parts_))
    return texts + texts[:5] + [None, "", "short"]


def test_repeats_against_brute_force(spark):
    texts = passages(random.Random(5))
    docs = frame(spark, texts)
    want = brute_repeats(texts, 100)
    # small buffers, slices, groups and shards: repeats cross every border
    for options in ({}, {"buffer_bytes": 700, "slice_bytes": 3000, "group_segments": 20, "shard_bytes": 500}):
        got = {r["doc_id"]: tuple(r)[1:] for r in remove_repeats(docs, **options).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_lengths_that_are_not_searched_raise(spark):
    docs = spark.createDataFrame([(1, "a" * 300)], "doc_id long, text string")
    for length in (99, 101, 30, 0):
        with pytest.raises(ValueError, match="length"):
            remove_repeats(docs, length=length)
    with pytest.raises(ValueError, match="multiple"):
        shared_windows([b"abcabc", b"abcabc"], 3, 100)


def test_merged_shards_find_every_shared_window():
    rng = random.Random(6)
    base = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(6)]
    strings = [rng.choice(base)[rng.randrange(20) :] + bytes([rng.choice(b"ab")]) for _ in range(30)]
    for shard in (1, 100, 10_000):
        s, o, k = shared_windows(strings, 20, shard)
        got = {}
        for string, offset, interval in zip(s.tolist(), o.tolist(), k.tolist()):
            got.setdefault(interval, set()).add((string, offset))
        want = {}
        for i, x in enumerate(strings):
            for p in range(len(x) - 19):
                want.setdefault(x[p : p + 20], set()).add((i, p))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def families(rng, n=4, size=30):
    """Families of texts around the threshold, whose links run through other members than the pivot."""
    texts = []
    for _ in range(n):
        base = sentence(rng, 60).split()
        for _ in range(size):
            w = list(rng.choice([base, texts[-1].split() if texts else base]))
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return texts


def test_near_duplicates_against_brute_force(spark):
    for size in (2, 5):
        texts = families(random.Random(size)) + ["A b", "a B", None, "", "one"]
        got = {r["doc_id"]: r for r in near_duplicates(frame(spark, texts), shingle=size).collect()}
        want = brute_components(texts, size, 80)
        assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == want
        assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(texts)))


def test_links_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 8)
    texts = families(random.Random(21), n=2, size=25)
    docs = minhash._texts(frame(spark, texts))
    members = spark.createDataFrame([(i, i, i % 2) for i in range(len(texts))], "id long, root long, family long")
    got = {tuple(r) for r in minhash._links_in_blocks(members, docs, 2, 80).collect()}
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    want = {
        (i, j) for i in range(len(texts)) for j in range(i)
        if i % 2 == j % 2 and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    }
    assert got == want and want


def test_minimizers_spread_over_all_slices():
    text = " ".join(sentence(random.Random(k), 50) for k in range(40)).encode()
    keys, starts, counts = segments(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]), 100)
    assert 0.3 < (keys < np.uint64(2**63)).mean() < 0.7
    # every window belongs to one segment
    assert counts.sum() == len(text) - 99 and (starts[1:] == (starts + counts)[:-1]).all()


def test_star_forest(spark):
    rng = random.Random(8)
    chain = [(i + 1, i) for i in range(0, 40)]
    star = [(i, 100) for i in range(101, 160)]
    loose = [(max(a, b), min(a, b)) for a, b in ((rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)) if a != b]
    edges = chain + star + loose
    got = dict(tuple(r) for r in star_forest(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect())
    root = {}

    def find(i):
        while root.get(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    nodes = {i for e in edges for i in e}
    assert got == {i: find(i) for i in nodes if find(i) != i}
