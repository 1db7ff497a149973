"""Token alignment against whole-text encoding and plain interval arithmetic."""

import hashlib
import random
import tracemalloc
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
from conftest import frame
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from gleaner.llm import alignment as A


@pytest.fixture(scope="module")
def plain():
    first = Tokenizer.from_file(f"{A.TOKENIZERS}/{A.BYTE_BPE}")
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=f"{A.TOKENIZERS}/{A.PIECE_BPE}")
    a_bytes, b_bytes = A.vocabularies()

    def groups(text):
        """Pairs of id lists between common ends, by the definition."""
        if not text:
            return []
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        whole = (" " + text).encode()
        if b"".join(a_bytes[k] for k in a) != whole or b"".join(b_bytes[k] for k in b) != whole:
            return []
        sides = []
        for ids, sizes in ((a, a_bytes), (b, b_bytes)):
            end, ends = 0, []
            for k in ids:
                end += len(sizes[k])
                ends.append((end, k))
            sides.append(ends)
        common = sorted({e for e, _ in sides[0]} & {e for e, _ in sides[1]})
        out = [([], []) for _ in common]
        for side, ends in enumerate(sides):
            for end, k in ends:
                out[bisect_left(common, end)][side].append(k)
        return out

    return groups


def brute(texts, groups):
    rows = {i: groups(t) for i, t in texts}
    count = Counter((a[-1], b[-1]) for found in rows.values() for a, b in found)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    out = {}
    for i, found in rows.items():
        links = [(a[-1], b[-1]) for a, b in found]
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
        out[i] = (
            sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), len(links),
            sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
            hashlib.sha256(shown.encode()).hexdigest() if found else "",
            sum(len(a) * len(b) for a, b in found),
        )
    return out


def some_texts():
    rng = random.Random(6)
    odd = [chr(c) for c in range(0x21, 0x600)] + list("日本語😀▁\x1c\x85\xa0 　\r\t") + ["<|endoftext|>", "<s>", "<unk>", "<0x41>"]
    texts = ["".join(rng.choice(odd) if rng.random() < 0.3 else rng.choice("abc  \n.'s1") for _ in range(rng.randrange(80))) for _ in range(150)]
    return texts + [" ", "  ", "\n", " a", "a ", "a  b", "don't", "x" * 1500 + " y", "a;\r\n b", "<|endoftext|> plain", "a▁b", ("word " * 4000).strip()]


def test_against_whole_texts(spark, odd_texts, plain):
    texts = [*odd_texts, *some_texts()]
    docs = frame(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 3"))
    wanted = brute([*enumerate(texts), (-3, texts[3])], plain)
    got = A.token_alignment(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert tuple(r)[1:] == wanted[r["doc_id"]], texts[r["doc_id"]]
    assert sum(r["n_a"] == 0 for r in got) > 2 and wanted[0] == (0, 0, 0, 0, 0, 0, "", 0)


def test_groups_and_links_are_whole(spark, odd_docs, plain):
    for r in A.align(odd_docs).collect():
        groups = [[list(map(int, ids.split(","))) for ids in g.split("|")] for g in r["groups"].split(";") if g]
        assert (r["n_a"], r["n_b"], r["n_groups"]) == (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups))
        links = memoryview(r["links"]).cast("q").tolist()
        assert [divmod(x, 32_000) for x in links] == [(a[-1], b[-1]) for a, b in groups]


def test_forgotten_chunks(monkeypatch, plain):
    files = []
    for name in (A.BYTE_BPE, A.PIECE_BPE):
        with open(f"{A.TOKENIZERS}/{name}", "rb") as f:
            files.append(f.read())
    monkeypatch.setattr(A, "CACHE_CHUNKS", 20)
    aligner, texts = A.Aligner(tuple(files)), some_texts()
    for at in range(0, len(texts), 10):
        part = texts[at : at + 10]
        for text, shown in zip(part, aligner.texts(part)[4]):
            wanted = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain(text))
            assert shown.decode() == wanted, text
        assert len(aligner.known[0]) <= 20


def test_common_ends_without_an_object_per_token():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 100_000):
        a, b = (np.append(np.unique(rng.integers(1, 2 * n + 1, n)), 2 * n + 1)[: n + 1] if n else np.zeros(0, np.int64) for _ in "ab")
        tracemalloc.start()
        i, j = A.common_ends(a, b)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        common = sorted({*a.tolist()} & {*b.tolist()})
        assert a[i - 1].tolist() == b[j - 1].tolist() == common
        assert peak < 60 * n + 10_000


def test_written_groups():
    rng = random.Random(4)
    groups = [([rng.randrange(50_257) for _ in range(rng.randrange(1, 4))], [rng.randrange(32_000) for _ in range(rng.randrange(1, 4))]) for _ in range(500)]
    groups += [([0], [0]), ([50_256, 9, 10], [99, 100, 31_999])]
    a, b = (np.array([k for g in groups for k in g[side]], np.int32) for side in (0, 1))
    i, j = (np.cumsum([len(g[side]) for g in groups]) for side in (0, 1))
    shown, ends = A.written(a, b, i, j, 50_257)
    wanted = [",".join(map(str, x)) + "|" + ",".join(map(str, y)) + ";" for x, y in groups]
    assert bytes(shown).decode() == "".join(wanted)
    assert ends.tolist() == np.cumsum([len(w) for w in wanted]).tolist()


def test_linked_pairs_are_suffixes(spark, odd_docs):
    a, b = A.vocabularies()
    counts = A.link_counts(A.align(odd_docs)).collect()
    assert 0 < len(counts) <= A.pair_bound(a, b) <= sum(map(len, a)) + sum(map(len, b))
    for r in counts:
        x, y = divmod(r["pair"], len(b))
        assert a[x].endswith(b[y]) or b[y].endswith(a[x])


def test_empty_table(spark, no_docs):
    assert A.token_alignment(no_docs).collect() == []
