"""Cross-tokenizer alignment by intersecting cumulative token ends (operator 13).

A text is encoded by two tokenizers, A (byte-level BPE, given a space in front) and B (pieces,
which adds the space itself). The byte lengths of either id list add up to its tokens' ends in
the text; a dictionary (an array with a place for every byte) maps each end of A to the index
of its token. B's ends that it holds slice the two id lists into groups that cover the same bytes.
Within a slice every A token and B token with the same end are linked: those at the slice's
end (one pair, since a token covers a byte at least).

How often an id pair is linked in the whole corpus tells its worth. Two linked tokens end at
the same byte, so the bytes of the one are a suffix of the other's: the pairs that can occur
at all are at most the bytes of both vocabularies together (``pair_bound``, half a million for
the given ones), whatever the corpus. That is the proven bound of the one table that is
gathered and broadcast. Texts are encoded once; their links stay in a written table.

Texts are cut into chunks where a space follows other text. Neither tokenizer has a token
across such a place (checked), so a text's ids are those of its chunks, and a task encodes a
chunk it knows only once. A batch's texts are aligned together, end to end.

Null and empty texts have no tokens, nor have texts that either tokenizer does not give back
byte for byte. Special tokens' strings inside texts are plain text. Equal and repeated rows
each get a row. A very long text is held whole by one task (some hundred times its bytes at
worst). An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.scratch import Scratch
from gleaner.llm.text import pieces

#: Folder of the public tokenizers' vocabulary files, on the driver.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The byte-level tokenizer's rule for the words that it merges within (a fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as Unicode has it, and the cuts where a space begins some.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CUT = re.compile(f"(?<=[^{SPACE}])(?= )")
UNCUT = re.compile(f"[{SPACE}] ")
#: Chunks a task remembers, and the characters of the longest one of them.
CACHE_CHUNKS, CACHE_CHARS = 200_000, 64


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others, in order, for the characters from 256 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBpe:
    """Tokenizer A from the bytes of its JSON file.

    Where the file's merges are in the order of ids, words are merged by rank (the same ids,
    faster); other files, and chunks so long that this would be slow, go to the file's own library.
    """

    def __init__(self, file: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work out
        self.tokenizer = Tokenizer.from_str(file.decode())
        self.tokenizer.encode_special_tokens = True
        self.bytes = self.token_bytes(file)
        parts, self.fast = json.loads(file), None
        ids, merges = parts["model"]["vocab"], parts["model"]["merges"]
        merged = [ids.get(m.replace(" ", "") if isinstance(m, str) else "".join(m)) for m in merges]
        splits = parts["pre_tokenizer"]
        if parts["normalizer"] is None and splits["type"] == "ByteLevel" and splits["use_regex"] and not splits["add_prefix_space"] \
                and merged == list(range(256, 256 + len(merges))):
            ranks = {self.bytes[k]: k for k in [*range(256), *merged]}
            self.fast = tiktoken.Encoding("merges", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def token_bytes(file: bytes) -> list[bytes]:
        to_byte = byte_of_character()
        parts = json.loads(file)
        vocabulary = parts["model"]["vocab"] | {t["content"]: t["id"] for t in parts["added_tokens"]}
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            out[k] = bytes(map(to_byte.__getitem__, token))
        return out

    def ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks, each a space and what follows."""
        short = self.fast and max(map(len, chunks), default=0) <= 1000
        if short:
            return [self.fast.encode_ordinary(c) for c in chunks]
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]


class PieceBpe:
    """Tokenizer B from the bytes of its model file."""

    def __init__(self, file: bytes):
        from sentencepiece import SentencePieceProcessor

        self.tokenizer = SentencePieceProcessor(model_proto=file)
        self.bytes = [self.piece_bytes(self.tokenizer, k) for k in range(self.tokenizer.get_piece_size())]
        #: The tokens of the space that is added and of a line feed.
        self.lead = self.tokenizer.encode("\n")
        across = [t for t in self.bytes if re.search(f"[^{SPACE}] |.\n|\n.", t.decode(errors="replace"))]
        if across or b"".join(self.bytes[k] for k in self.lead) != b" \n":
            raise ValueError(f"tokens across white space: {across}")

    @staticmethod
    def piece_bytes(tokenizer, k: int) -> bytes:
        piece = tokenizer.id_to_piece(k)
        if tokenizer.is_byte(k):
            return bytes([int(piece[1:-1], 16)])
        return piece.replace("▁", " ").encode()

    def ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks as they stand inside a text: after a line feed, no space is added."""
        return [ids[len(self.lead) :] for ids in self.tokenizer.encode(["\n" + c for c in chunks], num_threads=1)]


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """At most so many id pairs can end together: one side is a suffix of the other."""

    def suffixes(of: list[bytes], among: list[bytes]) -> int:
        known: dict[bytes, int] = {}
        for t in among:
            known[t] = known.get(t, 0) + 1
        return sum(known.get(t[k:], 0) for t in of for k in range(len(t)))

    return suffixes(a, b) + suffixes(b, a)


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many A and B tokens there are up to each common end; either side's ends ascend.

    The dictionary from A's ends to its tokens is an array with a place for every byte.
    """
    a_at = np.zeros(max(a_ends[-1:].max(initial=0), b_ends[-1:].max(initial=0)) + 1, np.int32)
    a_at[a_ends] = np.arange(1, len(a_ends) + 1, dtype=np.int32)
    i = a_at[b_ends]
    j = np.flatnonzero(i) + 1
    return i[j - 1].astype(np.int64), j


@cache
def decimals(n: int) -> pa.Array:
    """``0,`` ``0|`` ``0;`` ``1,`` and so on below ``n``: an id as it stands in a group."""
    return pa.array([f"{k}{mark}" for k in range(n) for mark in ",|;"], pa.large_binary())


def written(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, width: int) -> tuple[memoryview, np.ndarray]:
    """The groups as ``a1,a2|b1;a3|b2;`` and where each group ends in that; ``i``, ``j`` as by ``common_ends``.

    All ids are below ``width``.
    """
    in_i, in_j = np.diff(i, prepend=0), np.diff(j, prepend=0)
    shown = np.empty(len(a) + len(b), np.int64)
    # a group's A tokens stand after the B tokens of the groups before, its B tokens after its A tokens
    shown[np.arange(len(a)) + np.repeat(j - in_j, in_i)] = a
    shown[np.arange(len(b)) + np.repeat(i, in_j)] = b
    shown *= 3
    shown[i + j - in_j - 1] += 1
    shown[i + j - 1] += 2
    # strings of an array lie end to end
    _, ends, text = decimals(width).take(pa.array(shown)).buffers()
    return memoryview(text or b""), np.frombuffer(ends, np.int64, len(shown) + 1)[i + j]


class Aligner:
    """Alignments of texts, a batch at a time; short chunks are remembered."""

    def __init__(self, files: tuple[bytes, bytes]):
        self.sides = ByteBpe(files[0]), PieceBpe(files[1])
        self.sizes = [np.fromiter(map(len, t.bytes), np.int64) for t in self.sides]
        #: 32-bit ids of each chunk, without its first space, on either side.
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        #: Chunks that a side does not give back byte for byte.
        self.odd: set[str] = set()

    def learn(self, chunks: list[str]) -> None:
        spaced = [" " + c for c in chunks]
        whole = "".join(spaced).encode()
        for tokenizer, known in zip(self.sides, self.known):
            ids = tokenizer.ids(spaced)
            joined = b"".join(map(tokenizer.bytes.__getitem__, chain.from_iterable(ids)))
            if joined != whole:
                self.odd.update(c for c, some in zip(chunks, ids) if b"".join(map(tokenizer.bytes.__getitem__, some)) != b" " + c.encode())
            known.update((c, array("i", some).tobytes()) for c, some in zip(chunks, ids))

    def forget(self, chunks: list[str]) -> None:
        """Drop the long ones of ``chunks``, and everything once there are too many."""
        for c in chunks:
            if len(c) > CACHE_CHARS:
                for known in self.known:
                    del known[c]
                self.odd.discard(c)
        if len(self.known[0]) > CACHE_CHUNKS:
            for known in (*self.known, self.odd):
                known.clear()

    def packed(self, text: str, chunks: list[str]) -> tuple[bytes, bytes]:
        """Packed ids of both sides; empty if either does not give the text back."""
        ids = tuple(b"".join(map(known.__getitem__, chunks)) for known in self.known)
        if self.odd and not self.odd.isdisjoint(chunks):
            whole = b" " + text.encode()
            if any(b"".join(map(t.bytes.__getitem__, array("i", p))) != whole for t, p in zip(self.sides, ids)):
                return b"", b""
        return ids

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], list[bytes]]:
        """``n_a, n_b, n_groups, n_pairs, groups, links`` of all texts."""
        # a cut before every space, unless one stands among white space
        cut = [[c[1:] for c in CUT.split(" " + t)] if UNCUT.search(" " + t) else t.split(" ") if t else [] for t in texts]
        new = [c for c in dict.fromkeys(chain.from_iterable(cut)) if c not in self.known[0]]
        self.learn(new)
        packed = list(zip(*map(self.packed, texts, cut)))
        self.forget(new)
        ids = [np.frombuffer(b"".join(p), np.int32) for p in packed]
        n_a, n_b = (np.fromiter((len(x) // 4 for x in p), np.int64, len(p)) for p in packed)
        i, j = common_ends(*(np.cumsum(size[k]) for size, k in zip(self.sizes, ids)))
        # slices of all texts: a text's last tokens end together
        last = np.searchsorted(i, np.cumsum(n_a), "right")
        n_groups = np.diff(last, prepend=0)
        pairs = np.concatenate([[0], np.cumsum(np.diff(i, prepend=0) * np.diff(j, prepend=0))])
        n_pairs = np.diff(pairs[last], prepend=0)
        shown, ends = written(*ids, i, j, max(map(len, self.sizes)))
        ends = np.concatenate([[0], ends])
        # a token covers a byte at least, so one pair of a slice ends together: its last tokens
        links = ids[0][i - 1].astype(np.int64) * len(self.sizes[1]) + ids[1][j - 1]
        first = last - n_groups
        return (
            n_a, n_b, n_groups, n_pairs,
            [bytes(shown[ends[x] : ends[y] - 1]) if y > x else b"" for x, y in zip(first, last)],
            [links[x:y].tobytes() for x, y in zip(first, last)],
        )


def align(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Every row of ``docs`` (``doc_id, text``) with its alignment.

    ``doc_id, n_a, n_b`` (tokens), ``n_groups``, ``n_pairs`` (token pairs of a group, summed), ``groups``
    (``a1,a2|b1;a3|b2`` in text order) and its ``groups_sha256``, ``links`` (binary: 64-bit numbers,
    A id * B's vocabulary + B id, in text order). The two files are read on the driver and
    sent to the tasks (two megabytes).
    """

    def read(name: str) -> bytes:
        with open(f"{folder}/{name}", "rb") as f:
            return f.read()

    files = docs.sparkSession.sparkContext.broadcast((read(BYTE_BPE), read(PIECE_BPE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(files.value)
        for batch in pieces(batches):
            *counts, groups, links = aligner.texts([t or "" for t in batch["text"].to_pylist()])
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
            strings = [pa.array(groups, pa.binary()).cast(pa.string()), pa.array(digests, pa.string()), pa.array(links, pa.binary())]
            yield pa.record_batch(
                [batch["doc_id"], *(pa.array(c, pa.int64()) for c in counts), *strings],
                ["doc_id", "n_a", "n_b", "n_groups", "n_pairs", "groups", "groups_sha256", "links"],
            )

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_pairs long, groups string, groups_sha256 string, links binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def link_counts(alignments: DataFrame) -> DataFrame:
    """``pair, n``: how many links of the whole corpus hold each id pair.

    Every task counts a batch's links before they shuffle, so a pair that all texts hold
    costs one row per batch, and Spark sums those once more per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, n = np.unique(np.frombuffer(b"".join(b["links"].to_pylist()), np.int64), return_counts=True)
            yield pa.record_batch([pa.array(found), pa.array(n.astype(np.int64))], ["pair", "n"])

    counted = alignments.select("links").mapInArrow(run, "pair long, n long")
    return counted.groupBy("pair").agg(F.sum("n").alias("n"))


def vocabularies(folder: str = TOKENIZERS) -> tuple[list[bytes], list[bytes]]:
    """Token bytes by id of both tokenizers."""
    with open(f"{folder}/{BYTE_BPE}", "rb") as a, open(f"{folder}/{PIECE_BPE}", "rb") as b:
        return ByteBpe.token_bytes(a.read()), PieceBpe(b.read()).bytes


def worth(alignments: DataFrame, counts: DataFrame, width: int, bound: int) -> DataFrame:
    """``alignments`` with ``n_links``, ``n_best`` and ``count_sum``.

    ``n_best`` counts the links whose pair is the most frequent of its B id (ties included),
    ``count_sum`` adds up the counts of all links. ``width`` is B's vocabulary; ``counts`` has at most
    ``bound`` rows, 17 bytes each when broadcast.
    """
    spark: SparkSession = alignments.sparkSession
    got = counts.orderBy("pair").toArrow()
    if got.num_rows > bound:
        raise ValueError(f"{got.num_rows} linked pairs, but the vocabularies allow {bound}")
    pairs, n = (got[c].to_numpy() for c in ("pair", "n"))
    highest = np.zeros(width, np.int64)
    np.maximum.at(highest, pairs % width, n)
    known = spark.sparkContext.broadcast((pairs, n, n == highest[pairs % width]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for b in pieces(batches):
            links = b["links"].to_pylist()
            ends = np.cumsum([0, *(len(x) // 8 for x in links)])
            at = np.searchsorted(pairs, np.frombuffer(b"".join(links), np.int64))
            best_to, sum_to = (np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)]) for x in (best, n))
            new = [np.diff(ends), np.diff(best_to[ends]), np.diff(sum_to[ends])]
            kept = [c for c in b.schema.names if c != "links"]
            yield pa.record_batch([*(b[c] for c in kept), *map(pa.array, new)], [*kept, "n_links", "n_best", "count_sum"])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in alignments.schema if f.name != "links"]
    return alignments.mapInArrow(run, ", ".join([*kept, "n_links long, n_best long, count_sum long"]))


def token_alignment(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Every row of ``docs`` with its counts and the worth of its links.

    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_pairs``.
    """
    a, b = vocabularies(folder)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_pairs", "groups_sha256", "links"]
    found = Scratch(docs.sparkSession, "alignment").save(align(docs, folder).select(*columns))
    out = worth(found, link_counts(found), len(b), pair_bound(a, b))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_pairs")
