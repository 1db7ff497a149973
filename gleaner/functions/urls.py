"""URL Column functions (O-03, O-18, O-21, O-22, O-23, O-35): pure Catalyst
expressions, no UDF, so they stay inside whole-stage code generation
(the dot-segment fold is one ``aggregate`` over the path segments)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip

# A scheme is letters/digits/+.- before the first ':' — unless what follows is a
# port-like run of digits ("host:8080"), as Python's urlsplit decides.
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def scheme(url: Column) -> Column:
    """Lower-case scheme of a URL, '' when it has none."""
    s = F.regexp_extract(url, _SCHEME, 1)
    rest = F.substring(url, F.length(s) + 2, 1 << 30)
    port_like = rest.rlike(r"^[0-9]+$")
    return F.when((s != "") & ~port_like, F.lower(s)).otherwise(F.lit(""))


def netloc(url: Column) -> Column:
    """Network location (``//host:port`` part), '' when absent."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def valid_url(url: Column) -> Column:
    """O-03: usable only with a scheme and a network location."""
    return F.coalesce((scheme(url) != "") & (netloc(url) != ""), F.lit(False))


def _remove_dot_segments(path: Column) -> Column:
    """RFC 3986 dot-segment removal for an absolute path ('/…'), one fold per row:
    the state carries the kept segments and whether the last segment was '.'/'..'
    (which leaves a trailing '/')."""
    segs = F.slice(F.split(path, "/"), 2, 1 << 30)
    init = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("dot"))

    def step(acc, s):
        parts = acc["parts"]
        dropped = F.when(F.size(parts) > 0, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
        kept = F.when(s == "..", dropped).when(s == ".", parts).otherwise(F.concat(parts, F.array(s)))
        return F.struct(kept.alias("parts"), s.isin(".", "..").alias("dot"))

    def finish(acc):
        parts = F.when(acc["dot"], F.concat(acc["parts"], F.array(F.lit("")))).otherwise(acc["parts"])
        return F.concat(F.lit("/"), F.array_join(parts, "/"))

    return F.aggregate(segs, init, step, finish)


def url_join(base: Column, ref: Column) -> Column:
    """O-21 resolution core: ``urljoin(base, ref)`` for a relative ``ref``."""
    b_scheme = F.regexp_extract(base, _URL, 1)
    b_has_auth = F.regexp_extract(base, _URL, 2) != ""
    b_auth = F.regexp_extract(base, _URL, 3)
    b_path = F.regexp_extract(base, _URL, 4)
    b_query = F.regexp_extract(base, _URL, 5)
    origin = F.concat(b_scheme, F.lit(":"), F.when(b_has_auth, F.concat(F.lit("//"), b_auth)).otherwise(F.lit("")))
    r_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    r_rest = F.substring(ref, F.length(r_path) + 1, 1 << 30)
    r_query = F.regexp_extract(ref, r"^[^?#]*(\?[^#]*)?", 1)
    r_frag = F.regexp_extract(ref, r"^[^#]*(#.*)?$", 1)
    b_dir = F.regexp_extract(b_path, r"^(.*/)", 1)
    b_dir = F.when((b_dir == "") & b_has_auth, F.lit("/")).otherwise(b_dir)
    merged = _remove_dot_segments(
        F.when(F.substring(r_path, 1, 1) == "/", r_path).otherwise(F.concat(b_dir, r_path))
    )
    return (
        F.when(base.isNull() | (b_scheme == ""), ref)
        .when(ref == "", base)
        .when(F.substring(ref, 1, 2) == "//", F.concat(b_scheme, F.lit(":"), ref))
        .when(
            r_path == "",
            F.concat(origin, b_path, F.when(r_query != "", r_query).otherwise(b_query), r_frag),
        )
        .otherwise(F.concat(origin, merged, r_rest))
    )


def complete_url(base: Column, url: Column) -> Column:
    """O-21 ``resolve_links``: URLs with a scheme are kept, others joined to the page URL."""
    return F.when(scheme(url) != "", url).otherwise(url_join(base, url))


def link_key(href: Column) -> Column:
    """O-22: strip → drop trailing '/' → cut at the first '#'."""
    return F.split_part(F.regexp_replace(py_strip(href), "/+$", ""), F.lit("#"), F.lit(1))


def is_http(key: Column) -> Column:
    """O-23: key scheme is '', http or https."""
    return scheme(key).isin("", "http", "https")


def file_name(url: Column) -> Column:
    """O-18: text after the last '/', before the first '?'."""
    return F.split_part(F.element_at(F.split(url, "/"), -1), F.lit("?"), F.lit(1))


def page_identity(url: Column, *more: Column) -> Column:
    """Identity of a page (or, with ``more``, of a result of it): the full SHA-256 of the
    URL and the further parts, then the network location. Paths, records and joins use it."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (url, *more)]
    h = F.sha2(parts[0] if not more else F.concat_ws("\u0001", *parts), 256)
    loc = netloc(parts[0])
    return F.when(loc != "", F.concat_ws("-", h, loc)).otherwise(h)


def page_key(url: Column) -> Column:
    """O-35: ``<8 hex>-<netloc>`` or 8 hex without netloc; deterministic from the URL. A short
    form for display only: two URLs of a host may share it (see ``page_identity``)."""
    h = F.substring(F.sha2(F.coalesce(url, F.lit("")), 256), 1, 8)
    loc = netloc(F.coalesce(url, F.lit("")))
    return F.when(loc != "", F.concat_ws("-", h, loc)).otherwise(h)
