"""O-07 ``parse_nodes``: pages → one row per element.

This is the only place where Python touches page data. It runs as a
``mapInArrow`` job, so pages stream through the workers in Arrow batches and
the node rows come back as Arrow columns (no per-row serialisation). All later
work — XPath selection, links, content, crawl — is plain Spark over this table.

The wide, optional columns are built only where a caller needs them, because
Python output cannot be pruned by Catalyst after the fact:

* ``attrs``      — only the attribute names asked for (``None`` = all);
* ``text`` / ``markup`` — subtree text and source slice, only for tags in
  ``content_tags`` (``None`` = every element, empty = none);
* ``path``       — ancestor-or-self chain used by compiled XPath predicates,
  only for tags in ``path_tags`` (``None`` = every element, empty = none);
* ``texts``      — an element's direct text nodes (for ``text()`` predicates),
  only for tags in ``text_tags``.

Rows too: with ``row_tags`` only elements of these tags, root elements and marked ones have a row.

Output batches are flushed every ``FLUSH_ROWS`` rows, ``FLUSH_CHARS`` characters or
``FLUSH_PATH`` path entries, also inside a page, whatever the size of the input batch:
memory is bounded by one page's tree and one such batch. Pages are taken ``SLICE`` at a time from
an input batch, which stays in Arrow. ``src_start``/``src_end`` and
``text_len`` (characters of the subtree's text) are there for every element, so a caller
can choose elements by size and cut markup from the page later.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ensure_shipped
from . import htmltree, structure

ATTRS_T = T.MapType(T.StringType(), T.StringType())
PATH_T = T.ArrayType(
    T.StructType(
        [
            T.StructField("tag", T.StringType()),
            T.StructField("attrs", ATTRS_T),
            T.StructField("sib", T.IntegerType()),
            T.StructField("pos", T.IntegerType()),
            T.StructField("nsib", T.IntegerType()),
            T.StructField("npos", T.IntegerType()),
            T.StructField("id", T.IntegerType()),
        ]
    )
)

NODES_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("node_id", T.IntegerType()),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("end_id", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", ATTRS_T),
        T.StructField("sib", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("nsib", T.IntegerType()),
        T.StructField("npos", T.IntegerType()),
        T.StructField("lead_text", T.StringType()),
        T.StructField("tail", T.StringType()),
        T.StructField("src_start", T.IntegerType()),
        T.StructField("src_end", T.IntegerType()),
        T.StructField("text_len", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("markup", T.StringType()),
        T.StructField("texts", T.ArrayType(T.StringType())),
        T.StructField("path", PATH_T),
        T.StructField("marks", T.ArrayType(T.StringType())),
    ]
)

_MAP = pa.map_(pa.string(), pa.string())
_PATH_STRUCT = pa.struct(
    [("tag", pa.string()), ("attrs", _MAP), ("sib", pa.int32()), ("pos", pa.int32()),
     ("nsib", pa.int32()), ("npos", pa.int32()), ("id", pa.int32())]
)


def _wanted(tags: frozenset | None, tag: str) -> bool:
    return tags is None or tag in tags


# output batches are flushed at this many node rows or characters of text/markup, so a
# batch of large pages never turns into one huge Arrow batch
FLUSH_ROWS = 8192
FLUSH_CHARS = 4 << 20
FLUSH_PATH = 200_000
#: Rows of an input batch that are Python objects at a time.
SLICE = 64


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``SLICE`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _marks(tree, xpaths) -> dict[int, list[str]]:
    """Marks by element: of each XPath branch that selects it, ``^`` after those that select its
    parent where text nodes are the result (the element's tail is one of them)."""
    out: dict[int, list[str]] = {}
    page = structure.Page(tree) if xpaths else None
    for xpath in xpaths:
        for k, path in enumerate(structure.read(xpath)):
            mark = structure.mark(xpath, k)
            for n in page.select(path):
                out.setdefault(n, []).append(mark)
                for kid in tree.kids[n] if path[3] == ("text",) else ():
                    out.setdefault(kid, []).append(f"{mark}^")
    return out


class _Batch:
    """Node rows of several pages, built as flat Arrow columns."""

    def __init__(self):
        self.out = {f.name: [] for f in NODES_SCHEMA.fields}
        self.p_off, self.p_tag, self.p_sib, self.p_pos, self.p_id = [0], [], [], [], []
        self.p_nsib, self.p_npos = [], []
        self.p_aoff, self.p_akey, self.p_aval = [0], [], []
        self.rows = 0
        self.chars = 0

    @property
    def full(self) -> bool:
        return self.rows >= FLUSH_ROWS or self.chars >= FLUSH_CHARS or len(self.p_tag) >= FLUSH_PATH

    def add_page(self, page_id, url, html, attrs, content_tags, path_tags, text_tags=frozenset(), xpaths=(), row_tags=None):
        """Add a page's rows; yields whenever the batch is full, for the caller to take it."""
        src, b = htmltree.build(html)
        text = htmltree.doc_text(b) if content_tags is None or content_tags else ""
        n = len(b.tag)
        marks = _marks(b, xpaths)
        kept = [d if attrs is None else {k: v for k, v in d.items() if k in attrs} for d in b.attrs]
        depth = [0] * n
        out = self.out
        for i in range(n):
            par = b.parent[i]
            depth[i] = 1 if par < 0 else depth[par] + 1
            tag = b.tag[i]
            if par >= 0 and i not in marks and not _wanted(row_tags, tag):
                continue
            out["page_id"].append(page_id)
            out["url"].append(url)
            out["node_id"].append(i)
            out["parent_id"].append(None if par < 0 else par)
            out["end_id"].append(b.end[i])
            out["depth"].append(depth[i])
            out["tag"].append(tag)
            out["attrs"].append(list(kept[i].items()))
            out["sib"].append(b.sib[i])
            out["pos"].append(b.pos[i])
            out["nsib"].append(b.nsib[i])
            out["npos"].append(b.npos[i])
            lead, tail = "".join(b.lead[i]), "".join(b.tail[i])
            out["lead_text"].append(lead)
            out["tail"].append(tail)
            out["src_start"].append(b.s0[i])
            out["src_end"].append(b.s1[i])
            out["text_len"].append(b.t1[i] - b.t0[i])
            self.chars += len(lead) + len(tail)
            if _wanted(content_tags, tag):
                t, m = text[b.t0[i] : b.t1[i]], src[b.s0[i] : b.s1[i]]
                out["text"].append(t)
                out["markup"].append(m)
                self.chars += len(t) + len(m)
            else:
                out["text"].append(None)
                out["markup"].append(None)
            if text_tags is None or tag in text_tags:
                nodes_txt = [lead] if lead else []
                nodes_txt.extend(t for t in ("".join(b.tail[k]) for k in b.kids[i]) if t)
                out["texts"].append(nodes_txt)
            else:
                out["texts"].append(None)
            out["marks"].append(marks.get(i))
            if _wanted(path_tags, tag):
                chain = []
                j = i
                while j >= 0:
                    chain.append(j)
                    j = b.parent[j]
                for j in reversed(chain):
                    self.p_tag.append(b.tag[j])
                    self.p_sib.append(b.sib[j])
                    self.p_pos.append(b.pos[j])
                    self.p_nsib.append(b.nsib[j])
                    self.p_npos.append(b.npos[j])
                    self.p_id.append(j)
                    for k, v in kept[j].items():
                        self.p_akey.append(k)
                        self.p_aval.append(v)
                    self.p_aoff.append(len(self.p_akey))
            self.p_off.append(len(self.p_tag))
            self.rows += 1
            if self.full:
                yield
                out = self.out

    def take(self) -> pa.RecordBatch:
        """The rows so far as Arrow; the batch starts anew."""
        out = self.arrow()
        self.__init__()
        return out

    def arrow(self) -> pa.RecordBatch:
        i32 = pa.int32()
        path_struct = pa.StructArray.from_arrays(
            [
                pa.array(self.p_tag, pa.string()),
                pa.MapArray.from_arrays(
                    pa.array(self.p_aoff, i32), pa.array(self.p_akey, pa.string()), pa.array(self.p_aval, pa.string())
                ),
                pa.array(self.p_sib, i32),
                pa.array(self.p_pos, i32),
                pa.array(self.p_nsib, i32),
                pa.array(self.p_npos, i32),
                pa.array(self.p_id, i32),
            ],
            fields=list(_PATH_STRUCT),
        )
        arrays = []
        for f in NODES_SCHEMA.fields:
            if f.name == "path":
                arrays.append(pa.ListArray.from_arrays(pa.array(self.p_off, i32), path_struct))
            elif f.name == "attrs":
                arrays.append(pa.array(self.out["attrs"], _MAP))
            elif f.name in ("texts", "marks"):
                arrays.append(pa.array(self.out[f.name], pa.list_(pa.string())))
            elif f.name == "page_id":
                arrays.append(pa.array(self.out[f.name], pa.int64()))
            elif isinstance(f.dataType, T.IntegerType):
                arrays.append(pa.array(self.out[f.name], i32))
            else:
                arrays.append(pa.array(self.out[f.name], pa.string()))
        return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in NODES_SCHEMA.fields])


def _convert(batches: Iterable[pa.RecordBatch], attrs, content_tags, path_tags,
             text_tags=frozenset(), xpaths=(), row_tags=None) -> Iterator[pa.RecordBatch]:
    acc = _Batch()
    for batch in sliced(batches):
        cols = batch.to_pydict()
        for page_id, url, html in zip(cols["page_id"], cols["url"], cols["html"]):
            for _ in acc.add_page(page_id, url, html, attrs, content_tags, path_tags, text_tags, xpaths, row_tags):
                yield acc.take()
    if acc.rows:
        yield acc.take()


#: Spark setting with the number of tasks a parse is dealt over; unset or 0, pages are
#: parsed where they are read. For inputs of fewer splits than cores (one small file).
PARSE_PARTITIONS = "spark.gleaner.parsePartitions"


def dealt(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """``pages`` over the asked number of tasks, by page id; as they are if none is asked for."""
    n = partitions if partitions is not None else int(pages.sparkSession.conf.get(PARSE_PARTITIONS, "0"))
    return pages.repartition(n, "page_id") if n > 0 else pages


def parse_nodes(
    pages: DataFrame,
    attrs: Iterable[str] | None = None,
    content_tags: Iterable[str] | None = None,
    path_tags: Iterable[str] | None = None,
    partitions: int | None = None,
    text_tags: Iterable[str] | None = (),
    xpaths: Iterable[str] = (),
    row_tags: Iterable[str] | None = None,
) -> DataFrame:
    """Element rows of every page (``page_id, url, html`` in); ``texts`` (an element's
    direct text nodes) only for ``text_tags`` (``None`` = every element); ``marks`` names the
    ``xpaths`` (those evaluated here, see ``structure``) that select the element. ``row_tags`` are the
    tags that have rows (``None`` = every element), besides root and marked elements. ``partitions``
    overrides the setting PARSE_PARTITIONS."""
    a = None if attrs is None else frozenset(attrs)
    c = None if content_tags is None else frozenset(content_tags)
    p = None if path_tags is None else frozenset(path_tags)
    t = None if text_tags is None else frozenset(text_tags)
    x = tuple(xpaths)
    r = None if row_tags is None else frozenset(row_tags)
    ensure_shipped(pages.sparkSession)
    src = dealt(pages.select("page_id", "url", "html"), partitions)
    return src.mapInArrow(lambda it: _convert(it, a, c, p, t, x, r), NODES_SCHEMA)
