"""Repeated passages by merged shard transforms (operator 4).

Removes every byte of a window of ``length`` bytes that also starts earlier, in a
smaller id or earlier in the same document; windows are judged on the input.

1. Windows are dealt out by minimizer (``segments``): equal windows meet in one hash
   range, and neighbouring windows travel as one segment. A buffer of documents keeps
   the first of equal segments; its later ones are repeats at once.
2. A hash range ("slice") keeps the first of equal segments of all buffers. What is left
   to compare are distinct segments of one minimizer.
3. Those are gathered with their bytes into groups by minimizer. A group cuts them into
   shards, sorts each, and merges the shards' Burrows-Wheeler transforms by interleave
   refinement up to ``length`` symbols (``bwt``): every interval of equal windows
   yields its later ones.
4. Repeats are united per document and cut out.

Slices and groups grow in number with the corpus and keep their size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.bwt import STEP, shared_windows
from gleaner.llm.lm import edges, pack, pack_hashes, unpack, unpack_hashes
from gleaner.llm.scratch import Scratch
from gleaner.llm.segments import MER, segments
from gleaner.llm.text import pieces as text_pieces

#: Rows (id and a few numbers) that may be broadcast: under 64 MB.
BROADCAST_BYTES = 64 << 20
PARTS = ["keys", "digests", "docs", "starts", "counts"]
DEALT = "slice int, " + ", ".join(f"{p} binary" for p in PARTS)
FOUND = "doc long, start long, count int, key long"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def _runs(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjoining ranges of window starts of one document, joined."""
    order = np.lexsort((start, doc))
    doc, start, count = doc[order], start[order], count[order]
    if not len(doc):
        return doc, start, count
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + count[:-1])]
    first = np.flatnonzero(new)
    end = np.maximum.reduceat(start + count, first)
    return doc[first], start[first], end - start[first]


def _later(same: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by ``same``, document and start; of each equal ``same``, mark what is after its first."""
    order = np.lexsort((start, doc, *same[::-1]))
    if not len(order):
        return order, np.empty(0, bool)
    new = np.r_[True, np.zeros(len(order) - 1, bool)]
    for x in same:
        s = x[order]
        new[1:] |= s[1:] != s[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    d, p = doc[order], start[order]
    # rows of one id with one text are the same place, not a repeat
    return order, (d != d[head]) | (p != p[head])


def dealt(texts: DataFrame, length: int, slices: int, buffer_bytes: int) -> DataFrame:
    """Segments of every document by slice; a negative slice holds repeats found in a buffer (step 1)."""
    cuts_at = edges(slices)

    def cut(doc: int, text: bytes) -> Iterator[tuple[int, int, bytes]]:
        step = buffer_bytes
        for at in range(0, max(1, len(text) - length + 1), step):
            yield doc, at, text[at : at + step + length - 1]

    def resolve(pieces: list[tuple[int, int, bytes]], number: int) -> pa.RecordBatch:
        text = b"".join(t for _, _, t in pieces)
        ends = np.cumsum([len(t) for _, _, t in pieces])
        begins = np.r_[0, ends[:-1]]
        key, at, count = segments(np.frombuffer(text, np.uint8), begins, ends, length)
        digest = np.fromiter(
            (xxhash.xxh3_64_intdigest(text[a : a + n + length - 1]) for a, n in zip(at.tolist(), count.tolist())),
            np.uint64,
            len(at),
        )
        piece = np.searchsorted(ends, at, side="right")
        doc = np.array([d for d, _, _ in pieces], np.int64)[piece]
        start = at - begins[piece] + np.array([o for _, o, _ in pieces], np.int64)[piece]
        order, later = _later((key, digest), doc, start)
        kept = order[~later]
        key, digest, count_kept = key[kept], digest[kept], count[kept]
        cuts = np.r_[np.searchsorted(key, cuts_at), len(key)]
        rows = [
            (k, pack_hashes(key[i:j]), digest[i:j].tobytes(), doc[kept[i:j]].tobytes(), pack(start[kept[i:j]]), pack(count_kept[i:j]))
            for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            if i < j
        ]
        gone = order[later]
        if len(gone):
            d, s, c = _runs(doc[gone], start[gone], count[gone])
            rows.append((-1 - number, b"", b"", d.tobytes(), pack(s), pack(c)))
        return pa.RecordBatch.from_pylist([dict(zip(["slice", *PARTS], r)) for r in rows], schema=DEALT_TYPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, size, number = [], 0, 0
        for b in text_pieces(batches):
            for doc, text in zip(b["doc"].to_pylist(), b["text"].to_pylist()):
                if len(text) < length:
                    continue
                for piece in cut(doc, text):
                    pieces.append(piece)
                    size += len(piece[2])
                    if size >= buffer_bytes:
                        yield resolve(pieces, number)
                        pieces, size, number = [], 0, (number + 1) % slices
        if pieces:
            yield resolve(pieces, number)

    return texts.where("doc is not null").mapInArrow(run, DEALT)


DEALT_TYPE = pa.schema([("slice", pa.int32())] + [(p, pa.binary()) for p in PARTS])


def settled(group: pd.DataFrame) -> pd.DataFrame:
    """Repeats (no key) and the segments still to compare (with key) of one slice (step 2)."""
    doc = np.concatenate([np.frombuffer(x, np.int64) for x in group["docs"]])
    start = np.concatenate([unpack(x) for x in group["starts"]]).astype(np.int64)
    count = np.concatenate([unpack(x) for x in group["counts"]]).astype(np.int64)
    if group["slice"].iloc[0] < 0:
        return _rows(doc, start, count, None)
    key = np.concatenate([unpack_hashes(x) for x in group["keys"]])
    digest = np.concatenate([np.frombuffer(x, np.uint64) for x in group["digests"]])
    order, later = _later((key, digest), doc, start)
    gone, left = order[later], order[~later]
    # rows of one id and one text stand for the same place: keep one of them
    k, d = key[left], digest[left]
    single = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])][: len(left)]
    left, k = left[single], k[single]
    number = np.cumsum(np.r_[True, k[1:] != k[:-1]][: len(k)]) - 1
    open_ = left[np.bincount(number)[number] > 1] if len(k) else left
    return pd.concat(
        [_rows(*_runs(doc[gone], start[gone], count[gone]), None), _rows(doc[open_], start[open_], count[open_], key[open_])]
    )


def _rows(doc, start, count, key) -> pd.DataFrame:
    keys = pd.array([None] * len(doc), "Int64") if key is None else pd.array(key.view(np.int64), "Int64")
    return pd.DataFrame({"doc": doc, "start": start, "count": count.astype(np.int32), "key": keys})


def merged(group: pd.DataFrame, length: int, shard_bytes: int) -> pd.DataFrame:
    """Repeats among the distinct segments of a group of minimizers (step 3)."""
    group = group.sort_values(["key", "doc", "start"])
    string, offset, interval = shared_windows(group["bytes"].tolist(), length, shard_bytes)
    doc = group["doc"].to_numpy(np.int64)[string]
    start = group["start"].to_numpy(np.int64)[string] + offset
    order, later = _later((interval,), doc, start)
    gone = order[later]
    return _rows(*_runs(doc[gone], start[gone], np.ones(len(gone), np.int64)), None).drop(columns="key")


def _with_bytes(texts: DataFrame, wanted: DataFrame, length: int, groups: int) -> DataFrame:
    """The wanted segments with their bytes and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_pieces(batches):
            out = [
                {"doc": doc, "start": s["start"], "key": s["key"], "bytes": text[s["start"] : s["start"] + s["count"] + length - 1]}
                for doc, text, segs in zip(*(b[c].to_pylist() for c in ("doc", "text", "segs")))
                for s in segs
            ]
            yield pa.RecordBatch.from_pylist(
                out, schema=pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("key", pa.int64()), ("bytes", pa.binary())])
            )

    found = texts.join(wanted, "doc").mapInArrow(run, "doc long, start long, key long, bytes binary")
    return found.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(groups)))


def _cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    """Bytes, bytes removed, maximal removed runs and the hash of the rest."""
    digest, at, removed, runs = hashlib.sha256(), 0, 0, 0
    for s, e in spans:
        e = min(e, len(text))
        if s >= e:
            continue
        digest.update(text[at:s])
        removed += e - s
        runs += 1
        at = e
    digest.update(text[at:])
    return len(text), removed, runs, digest.hexdigest()


def repeated_spans(
    docs: DataFrame,
    length: int = 100,
    buffer_bytes: int = 2 << 20,
    slice_bytes: int = 16 << 20,
    group_segments: int = 16_000,
    shard_bytes: int = 128 << 10,
) -> DataFrame:
    """``doc, starts, ends``: the bytes of each document to remove, as disjoint runs."""
    if length % STEP or length < MER:
        raise ValueError(f"length {length}: even numbers from {MER} on are searched")
    scratch = Scratch(docs.sparkSession, "exactdedup")
    texts = _texts(docs)
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, math.ceil(n_bytes / slice_bytes))
    found = scratch.save(dealt(texts, length, slices, buffer_bytes).groupBy("slice").applyInPandas(settled, FOUND))
    to_compare = found.where("key is not null")
    n = to_compare.count()
    wanted = to_compare.groupBy("doc").agg(F.collect_list(F.struct("key", "start", "count")).alias("segs"))
    wanted = F.broadcast(wanted) if n * 32 <= BROADCAST_BYTES else wanted
    groups = max(1, math.ceil(n / group_segments))
    more = (
        _with_bytes(texts, wanted, length, groups)
        .groupBy("part")
        .applyInPandas(lambda g: merged(g, length, shard_bytes), "doc long, start long, count int")
    )
    gone = found.where("key is null").select("doc", "start", "count").unionByName(more)
    per_doc = gone.groupBy("doc").agg(F.collect_list(F.struct("start", "count")).alias("runs"))

    @F.arrow_udf("array<struct<s:long,e:long>>")
    def united(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        for runs in batches:
            out = []
            for r in runs.to_pylist():
                spans = []
                for x in sorted((x["start"], x["start"] + x["count"] + length - 1) for x in r):
                    if spans and x[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x[1])
                    else:
                        spans.append(list(x))
                out.append([{"s": s, "e": e} for s, e in spans])
            yield pa.array(out, kind)

    return scratch.save(per_doc.select("doc", united("runs").alias("spans")))


def remove_repeats(docs: DataFrame, length: int = 100, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs``.

    Texts are UTF-8 bytes; null and empty texts have no bytes. Rows with a null id are
    kept whole and not compared. Rows of one id are one document and should hold one
    text; runs found in one are cut from all. Empty tables give an empty result; other
    columns are not read. An odd ``length``, or one under the minimizer's, raises.
    """
    spans = repeated_spans(docs, length, **options)
    total = spans.agg(F.count(F.lit(1)) * 24 + F.sum(16 * F.size("spans"))).first()[0] or 0
    spans = F.broadcast(spans) if total <= BROADCAST_BYTES else spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_pieces(batches):
            cuts = [
                _cut(text, [(x["s"], x["e"]) for x in s or ()])
                for text, s in zip(b["text"].to_pylist(), b["spans"].to_pylist())
            ]
            columns = list(zip(*cuts)) or [(), (), (), ()]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.record_batch(
                [b["doc"], *[pa.array(c, t) for c, t in zip(columns, types)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    joined = _texts(docs).join(spans, "doc", "left").select("doc", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
