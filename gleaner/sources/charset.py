"""Pages as fetched: bytes whose character set is found where they are read.

In this order: a byte order mark, the declaration in the first ``DECLARED_WITHIN`` bytes
(``<meta charset=…>``, ``<meta … content="…charset=…">`` or an XML declaration), UTF-8 if
the bytes are valid UTF-8, else windows-1252. Bytes that the character set does not have
become U+FFFD; no page is dropped. Null bytes give null, which ``normalise_html`` turns into
the empty document as usual.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DECLARED_WITHIN = 1024
# longer marks first: UTF-32's begins with UTF-16's
MARKS = (
    (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"),
    (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"),
)
DECLARATION = re.compile(rb"""<(?:meta\b[^>]*?\bcharset|\?xml\b[^>]*?\bencoding)\s*=\s*["']?\s*([\w.:-]+)""", re.I)
COMMENT = re.compile(rb"<!--.*?(?:-->|$)", re.S)
# fixed values: names of the character sets that pages may declare (WHATWG Encoding)
DECLARABLE = re.compile(
    r"utf-?8|us-ascii|ascii|(?:iso[-_]?8859[-_]?|latin-?)\d{1,2}|(?:windows-|cp)\d{3,4}|ibm866|koi8-[ru]"
    r"|gbk|gb2312|gb18030|big5(?:-hkscs)?|euc-(?:jp|kr)|iso-2022-jp|shift[-_]jis|macintosh"
)
#: Declared as these, pages are read as windows-1252, which holds all their characters.
WESTERN = frozenset({"us-ascii", "ascii", "iso-8859-1", "iso8859-1", "iso_8859-1", "iso88591", "latin1", "latin-1"})
WINDOWS = "windows-1252"


def declared(raw: bytes) -> str | None:
    """The character set a page declares, None without one that can be read."""
    for label in DECLARATION.findall(COMMENT.sub(b"", raw[:DECLARED_WITHIN])):
        name = label.decode("ascii", "replace").lower()
        if name.startswith(("utf-16", "utf-32")):
            return "utf-8"  # a declaration in bytes of one could not have been read
        if name in WESTERN:
            return WINDOWS
        if DECLARABLE.fullmatch(name):
            try:
                codecs.lookup(name)
            except LookupError:
                continue
            return name
    return None


def decode_page(raw: bytes) -> str:
    """The text of a page's bytes."""
    for mark, name in MARKS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    name = declared(raw)
    if name:
        return raw.decode(name, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode(WINDOWS, "replace")


@F.arrow_udf(StringType())
def _decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for raw in batches:
        yield pa.array([None if x is None else decode_page(x) for x in raw.to_pylist()], pa.string())


def page_text(content: Column) -> Column:
    """Text of a column of page bytes."""
    return _decoded(content)
