"""O-15 ``extract_article``: ``{title, content}`` — page title and main readable body.

Blocks are judged by shallow text features alone: a container's score is the text of
the paragraphs directly inside it, times the share of its text that is not link text.
The best container wins (the body, then the first in document order on a tie); a page
without a paragraph of ``MIN_PARAGRAPH`` characters gives its body, one without a body the
empty document. Every page has a row.

The block is chosen where the page is parsed: elements come in document order, so one pass
from the last to the first adds every element's link text to its parent when the element's
own is complete. A page yields one row with its title and the winner's markup; no HTML and
no element crosses an exchange. Elements that are no reading matter are cut from the markup
by Columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..session import ensure_shipped
from . import htmltree
from .nodes import FLUSH_CHARS, FLUSH_ROWS, dealt, sliced

#: Tags that can hold the article.
CONTAINERS = frozenset({"article", "main", "section", "div", "td", "blockquote", "body"})
PARAGRAPHS = frozenset({"p", "pre", "blockquote"})
MIN_PARAGRAPH = 25
#: Elements cut from the article: code, widgets and controls.
UNREADABLE = ("script", "style", "noscript", "iframe", "object", "form", "button", "select", "textarea")
UNREADABLE_VOID = ("input", "embed")
ARTICLE_OPEN, ARTICLE_CLOSE = "<html><body><div>", "</div></body></html>"

BEST = "page_id long, url string, title string, block string"
BEST_TYPE = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("url", "title", "block"))])


def readable(markup: Column) -> Column:
    """Markup without scripts, forms and the like."""
    for tag in UNREADABLE:
        markup = F.regexp_replace(markup, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    return F.regexp_replace(markup, rf"(?is)<({'|'.join(UNREADABLE_VOID)})\b[^>]*>", "")


def best_block(html: str | None) -> tuple[str, str | None]:
    """Title of a page and the source of its best block, None without any."""
    source, tree = htmltree.build(html)
    text = htmltree.doc_text(tree)
    title, best, block = "", None, None
    paragraphs, links = [0] * len(tree.tag), [0] * len(tree.tag)
    for i in range(len(tree.tag) - 1, -1, -1):
        tag, parent, size = tree.tag[i], tree.parent[i], tree.t1[i] - tree.t0[i]
        if tag == "title":
            title = text[tree.t0[i] : tree.t1[i]].strip()
        if parent >= 0:
            links[parent] += links[i] + (size if tag == "a" else 0)
            if tag in PARAGRAPHS:
                length = len(text[tree.t0[i] : tree.t1[i]].strip())
                paragraphs[parent] += length if length >= MIN_PARAGRAPH else 0
        if tag in CONTAINERS:
            score = paragraphs[i] * max(1 - links[i] / size, 0.0) if size else 0.0
            # an equal one that stands earlier wins, but not over the body
            rank = (score, tag == "body")
            if (score > 0 or tag == "body") and (best is None or rank >= best):
                best, block = rank, i
    return title, None if block is None else source[tree.s0[block] : tree.s1[block]]


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, chars = [], 0
    for batch in sliced(batches):
        for page_id, url, html in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html"))):
            title, block = best_block(html)
            rows.append({"page_id": page_id, "url": url, "title": title, "block": block})
            chars += len(title) + len(block or "")
            if len(rows) >= FLUSH_ROWS or chars >= FLUSH_CHARS:
                yield pa.RecordBatch.from_pylist(rows, schema=BEST_TYPE)
                rows, chars = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=BEST_TYPE)


def extract_article(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """``page_id, url, title, content`` for every page; ``partitions`` as in ``parse_nodes``."""
    ensure_shipped(pages.sparkSession)
    best = dealt(pages.select("page_id", "url", "html"), partitions).mapInArrow(_best, BEST)
    body = F.coalesce(py_strip(readable(F.col("block"))), F.lit(""))
    return best.select(
        "page_id", "url", "title", F.concat(F.lit(ARTICLE_OPEN), body, F.lit(ARTICLE_CLOSE)).alias("content")
    )
