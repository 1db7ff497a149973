"""O-08 / O-09: XPath compiled into Spark Column predicates.

Supported::

    /step  //step                 child and descendant axes
    tag  *                        name tests
    [predicate] …                 any number per step, where a predicate is
        @a  @a='v'  @a!="v"  text()='v'  .='v'  (string comparisons, also < <= > >=)
        contains(x, 'v')  starts-with(x, 'v')  normalize-space(x)  string-length(x)
        not(…)  … and …  … or …  ( … )
        n  position()…  last()    position among same-tag siblings (``*``: among
                                  elements) as a step's first predicate; as the last
                                  predicate of a path, among the siblings left so far
    (path)[n] (path)[last()] …    position among the page's matches, document order
    path | path                   union (one selector, document order, no repeats)
    …/@name  …/text()             attribute or text-node results
    …//@name  …//text()           the same of the element and everything below it
    ./step  .//step               as from the document

``text()`` inside a predicate is the element's direct text nodes: a comparison
holds when any of them matches, string functions see the first (XPath 1.0's
conversions of a node set); ``.`` is the whole text. Both only on a path's last
step. A syntax error compiles to ``None``: the selector yields no rows, as the
reference's invalid XPath does, and the caller logs a warning. A valid XPath outside
this subset (other axes, functions, relative paths in predicates) is evaluated on the
tree where the page is parsed (``structure``), and its rows carry its mark; what is not
supported there either raises ``Unsupported``: it must not look like a page without matches.

A location path s1..sn matches a node when a fold over its ancestors leaves
bit n-1 set (in ``exact`` for a child step, ``any`` for a descendant step) and
the node itself passes step n. The fold's state (exact, any) starts at (1, 1):
bit i of the new ``exact`` is set when the element satisfies step i and bit i-1
was set in the previous ``exact`` (child axis) or ``any`` (descendant axis);
``any |= exact``. The fold is an ``aggregate`` over the row's ``path`` array,
so selection is a row-local filter: no join, no shuffle.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import WS_CLASS, py_strip

log = logging.getLogger(__name__)


class Unsupported(ValueError):
    pass


@dataclass(frozen=True)
class Step:
    axis: str  # "child" | "desc"
    tag: str | None  # None = any element
    preds: tuple  # predicate ASTs, in order


@dataclass(frozen=True)
class Path:
    steps: tuple
    terminal: tuple | None  # ("attr", name) | ("text",) | None
    late: tuple | None = None  # position predicate after filtering ones, on the last step
    mark: str | None = None  # of a path evaluated where the page is parsed (structure.py)


@dataclass(frozen=True)
class XPath:
    source: str
    branches: tuple  # Path, …  (a union has several)
    global_pred: tuple | None  # predicate AST of (…)[pred]

    @property
    def local_pred(self):
        """The position predicate among the siblings that passed the last step's filters."""
        return self.branches[0].late

    # -- what a parse must provide -----------------------------------------------
    @property
    def attr_names(self) -> set:
        names = set()
        for b in self.branches:
            for s in b.steps:
                for p in s.preds:
                    names |= _attrs_in(p)
            if b.terminal and b.terminal[0] == "attr":
                names.add(b.terminal[1])
        return names

    @property
    def last_tags(self):
        """Tags a selected row can have (``None`` = any); text() also needs child rows."""
        tags = set()
        for b in self.branches:
            if b.terminal == ("text",) or b.steps[-1].tag is None:
                return None
            tags.add(b.steps[-1].tag)
        return tags

    @property
    def row_tags(self):
        """Tags whose elements need rows (``None`` = any), besides root and marked elements."""
        tags = set()
        for b in self.branches:
            last = b.steps[-1]
            if b.mark or (b.terminal != ("text",) and last.tag is None and last.axis == "child" and len(b.steps) == 1):
                continue
            if b.terminal == ("text",) or last.tag is None:
                return None
            tags.add(last.tag)
        return tags

    @property
    def needs_path(self) -> bool:
        return any(not b.mark and (b.terminal == ("text",) or len(b.steps) > 1) for b in self.branches)

    @property
    def structural(self) -> bool:
        """Whether node rows must come with the marks of this XPath."""
        return any(b.mark for b in self.branches)

    @property
    def needs_text(self) -> bool:
        return any(_uses(p, "dot") for b in self.branches for p in b.steps[-1].preds)

    @property
    def needs_texts(self) -> bool:
        return any(_uses(p, "text") for b in self.branches for p in b.steps[-1].preds)

    def fallback(self) -> XPath | None:
        """O-09: the same XPath without ``tbody/`` (browser-injected tables)."""
        if "/tbody/" not in self.source:
            return None
        return compile_xpath(self.source.replace("tbody/", ""))


# -- tokenizer ----------------------------------------------------------------------

_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*"
_TOKEN = re.compile(
    rf"""\s*(?:
      (?P<dslash>//) | (?P<slash>/) | (?P<lpar>\() | (?P<rpar>\)) | (?P<lbr>\[) | (?P<rbr>\]) |
      (?P<pipe>\|) | (?P<comma>,) | (?P<op>!=|<=|>=|=|<|>) |
      (?P<num>[0-9]+(?:\.[0-9]+)?) | '(?P<sq>[^']*)' | "(?P<dq>[^"]*)" |
      (?P<axis>[A-Za-z\-]+::) | (?P<dotdot>\.\.) | (?P<arith>[+]|-(?=\s|[0-9])) | (?P<var>\$\w+) |
      @(?P<attr>{_NAME}|\*) | (?P<dot>\.(?![.\w])) | (?P<star>\*) |
      (?P<func>{_NAME})\s*(?=\() | (?P<name>{_NAME})
    )""",
    re.VERBOSE,
)
_FUNCS = {"contains", "starts-with", "normalize-space", "string-length", "not", "text", "position", "last",
          "string", "concat"}


# fixed values: the other functions of XPath 1.0, valid but not evaluated here
_OTHER_FUNCS = {"id", "count", "name", "local-name", "namespace-uri", "substring", "substring-before", "substring-after",
                "translate", "boolean", "true", "false", "lang", "number", "sum", "floor", "ceiling", "round", "node",
                "comment", "processing-instruction"}


def _tokens(src: str):
    pos, out = 0, []
    src = src.strip()
    while pos < len(src):
        m = _TOKEN.match(src, pos)
        if not m or m.end() == pos:
            raise ValueError(f"bad token at {pos}")
        kind = m.lastgroup
        if kind in ("sq", "dq"):
            out.append(("str", m.group(kind)))
        elif kind == "num":
            out.append(("num", float(m.group(kind))))
        else:
            out.append((kind, m.group(kind)))
        pos = m.end()
    return out


def evaluable(tokens: list) -> list:
    """The tokens, unless there is arithmetic or a variable among them."""
    if any(kind in ("arith", "var") for kind, _ in tokens):
        raise Unsupported("arithmetic or a variable")
    return tokens


class _Parser:
    def __init__(self, toks):
        self.t = toks
        self.i = 0

    def peek(self, k=0):
        j = self.i + k
        return self.t[j] if j < len(self.t) else (None, None)

    def take(self, kind=None, value=None):
        tk = self.peek()
        if kind and tk[0] != kind or value is not None and tk[1] != value:
            raise ValueError(f"expected {kind or value}, got {tk}")
        self.i += 1
        return tk

    # union := pathexpr ('|' pathexpr)*
    def union(self):
        branches, gpred = [], None
        while True:
            if self.peek()[0] == "lpar":
                self.take("lpar")
                inner, inner_g = self.union()
                self.take("rpar")
                if inner_g is not None:
                    raise Unsupported("nested (…)[…]")
                if self.peek()[0] != "lbr":
                    raise Unsupported("steps after (…)")
                self.take("lbr")
                gpred = self.expr()
                self.take("rbr")
                term = self.terminal()
                if not term and self.peek()[0] in ("slash", "dslash", "lbr"):
                    raise Unsupported("steps after (…)[…]")
                if term:
                    inner = [Path(b.steps, term) for b in inner]
                branches.extend(inner)
            else:
                branches.extend(self.path())
            if self.peek()[0] != "pipe":
                break
            if gpred is not None:
                raise Unsupported("union after (…)[…]")
            self.take("pipe")
        return branches, gpred

    def terminal(self):
        if self.peek()[0] == "slash" and self.peek(1)[0] == "attr":
            self.take("slash")
            name = self.take("attr")[1]
            if name == "*":
                raise Unsupported("@*")
            return ("attr", name.lower())
        if self.peek()[0] == "slash" and self.peek(1) == ("func", "text"):
            self.take("slash")
            self.take("func")
            self.take("lpar")
            self.take("rpar")
            return ("text",)
        return None

    def below(self):
        """The attribute or text() result after ``//``, if that is what follows."""
        if self.peek()[0] == "dslash" and (self.peek(1)[0] == "attr" or self.peek(1) == ("func", "text")):
            self.t[self.i] = ("slash", "/")
            return self.terminal()
        return None

    def path(self):
        steps = []
        if self.peek()[0] == "dot" and self.peek(1)[0] in ("slash", "dslash"):
            self.take("dot")
        while self.peek()[0] in ("slash", "dslash"):
            everywhere = self.below()
            if everywhere:
                inner = Path((*steps, Step("desc", None, ())), everywhere)
                return [Path(tuple(steps), everywhere), inner] if steps else [inner]
            if steps:
                term = self.terminal()
                if term:
                    return [Path(tuple(steps), term)]
            axis = "desc" if self.take()[0] == "dslash" else "child"
            kind, val = self.peek()
            if kind == "name":
                tag = val.lower()
            elif kind == "star":
                tag = None
            elif kind is None or kind in ("slash", "dslash", "rbr", "rpar", "lbr", "op", "comma"):
                raise ValueError("expected a step")
            else:
                raise Unsupported("expected a name test")
            self.take()
            preds = []
            while self.peek()[0] == "lbr":
                self.take("lbr")
                preds.append(self.expr())
                self.take("rbr")
            steps.append(Step(axis, tag, tuple(preds)))
        if not steps:
            kind, val = self.peek()
            if kind in ("name", "star", "attr", "dot", "dotdot", "axis") or kind == "func" and val in _FUNCS | _OTHER_FUNCS:
                raise Unsupported("relative path or function")
            raise ValueError("empty path")
        return [Path(tuple(steps), None)]

    # expr := and ('or' and)* ; and := cmp ('and' cmp)* ; cmp := value (op value)?
    def expr(self):
        left = self.and_expr()
        while self.peek() == ("name", "or"):
            self.take()
            left = ("or", left, self.and_expr())
        return left

    def and_expr(self):
        left = self.cmp()
        while self.peek() == ("name", "and"):
            self.take()
            left = ("and", left, self.cmp())
        return left

    def cmp(self):
        left = self.value()
        if self.peek()[0] == "op":
            op = self.take()[1]
            return ("cmp", op, left, self.value())
        return left

    def value(self):
        kind, val = self.peek()
        if kind == "attr":
            self.take()
            if val == "*":
                raise Unsupported("@*")
            return ("attr", val.lower())
        if kind == "str":
            self.take()
            return ("str", val)
        if kind == "num":
            self.take()
            return ("num", val)
        if kind == "dot":
            if self.peek(1)[0] in ("slash", "dslash"):
                raise Unsupported("relative path in a predicate")
            self.take()
            return ("dot",)
        if kind == "lpar":
            self.take()
            e = self.expr()
            self.take("rpar")
            return e
        if kind == "func":
            if val not in _FUNCS:
                raise Unsupported(f"function {val}()") if val in _OTHER_FUNCS else ValueError(f"no function {val}()")
            self.take()
            self.take("lpar")
            args = []
            if self.peek()[0] != "rpar":
                args.append(self.expr())
                while self.peek()[0] == "comma":
                    self.take()
                    args.append(self.expr())
            self.take("rpar")
            if val == "text" and not args:
                return ("text",)
            if val in ("position", "last") and not args:
                return (val,)
            return ("fn", val, tuple(args))
        if kind in (None, "rbr", "rpar", "comma", "op"):
            raise ValueError(f"unexpected {val}")
        raise Unsupported(f"unexpected {kind} {val}")


def compile_xpath(source) -> XPath | None:
    """Parse an XPath; ``None`` when it is invalid, ``Unsupported`` is raised when it is
    valid but outside the subset."""
    if not isinstance(source, str) or not source.strip():
        return None
    try:
        p = _Parser(evaluable(_tokens(source)))
        branches, gpred = p.union()
        if p.i != len(p.t):
            raise ValueError("trailing tokens")
        for b in branches:
            for j, s in enumerate(b.steps):
                for k, pr in enumerate(s.preds):
                    if k > 0 and _uses_position(pr):
                        only = len(branches) == 1 and gpred is None and b.terminal != ("text",)
                        if only and j == len(b.steps) - 1 and k == len(s.preds) - 1:
                            continue
                        raise Unsupported("position after a filtering predicate")
                    if j < len(b.steps) - 1 and (_uses(pr, "dot") or _uses(pr, "text")):
                        raise Unsupported("text tests only on the last step")
                    if b.terminal == ("text",) and (_uses(pr, "dot") or _uses(pr, "text")):
                        raise Unsupported("text tests with a text() result")
        if gpred is not None and (_attrs_in(gpred) or _uses(gpred, "dot") or _uses(gpred, "text")):
            raise Unsupported("only positions in (…)[…]")
        return XPath(source, tuple(_late(b) for b in branches), gpred)
    except Unsupported as exc:
        return _structural(source, exc)
    except (ValueError, IndexError) as exc:
        log.warning("invalid XPath %r: %s", source, exc)
        return None


def _structural(source: str, why: Unsupported) -> XPath:
    """An XPath that needs more than an element and its ancestors."""
    from . import structure

    try:
        branches = structure.read(source)
    except (ValueError, IndexError) as exc:
        raise Unsupported(f"{source!r}: {exc if isinstance(exc, Unsupported) else why}") from None
    paths = []
    for k, (_, _, steps, result) in enumerate(branches):
        test = steps[-1][1] if steps else "*"
        last = Step("desc", None if test in ("*", "node()") else test, ())
        paths.append(Path((last,), result, None, structure.mark(source, k)))
    return XPath(source, tuple(paths), None)


def _late(b: Path) -> Path:
    """The path with a last position predicate after other predicates set apart."""
    last = b.steps[-1]
    if len(last.preds) < 2 or not _uses_position(last.preds[-1]):
        return b
    return Path((*b.steps[:-1], Step(last.axis, last.tag, last.preds[:-1])), b.terminal, last.preds[-1])


# -- AST helpers ----------------------------------------------------------------------


def _walk(node):
    yield node
    for c in node[1:]:
        if isinstance(c, tuple) and c and isinstance(c[0], str):
            yield from _walk(c)
        elif isinstance(c, tuple):
            for x in c:
                if isinstance(x, tuple):
                    yield from _walk(x)


def _uses(node, kind) -> bool:
    return any(n[0] == kind for n in _walk(node))


def _uses_position(node) -> bool:
    return node[0] == "num" or _uses(node, "position") or _uses(node, "last")


def _attrs_in(node) -> set:
    return {n[1] for n in _walk(node) if n[0] == "attr"}


# -- Column compilation -----------------------------------------------------------------


@dataclass
class _Ctx:
    tag: Column
    attrs: Column
    position: Column
    last: Column
    text: Column | None = None  # whole text (``.``)
    texts: Column | None = None  # direct text nodes (``text()``)


def _string(node, c: _Ctx) -> Column:
    kind = node[0]
    if kind == "attr":
        return c.attrs.getItem(node[1])
    if kind == "str":
        return F.lit(node[1])
    if kind == "num":
        v = node[1]
        return F.lit(str(int(v)) if v == int(v) else str(v))
    if kind == "dot":
        return F.coalesce(c.text, F.lit(""))
    if kind == "text":
        return F.element_at(c.texts, 1)  # first text node, null when there is none
    if kind == "position":
        return c.position.cast("string")
    if kind == "last":
        return c.last.cast("string")
    if kind == "fn":
        name, args = node[1], node[2]
        if name == "normalize-space":
            s = _string(args[0], c) if args else F.coalesce(c.text, F.lit(""))
            return F.regexp_replace(py_strip(F.coalesce(s, F.lit(""))), f"{WS_CLASS}+", " ")
        if name == "string":
            return F.coalesce(_string(args[0], c), F.lit("")) if args else F.coalesce(c.text, F.lit(""))
        if name == "concat":
            return F.concat(*[F.coalesce(_string(a, c), F.lit("")) for a in args])
        if name == "string-length":
            s = _string(args[0], c) if args else F.coalesce(c.text, F.lit(""))
            return F.length(F.coalesce(s, F.lit(""))).cast("string")
    raise Unsupported(f"not a string: {kind}")


def _number(node, c: _Ctx) -> Column:
    kind = node[0]
    if kind == "num":
        return F.lit(float(node[1]))
    if kind == "position":
        return c.position.cast("double")
    if kind == "last":
        return c.last.cast("double")
    if kind == "fn" and node[1] == "string-length":
        return _string(node, c).cast("double")
    return _string(node, c).try_cast("double")


def _is_numeric(node) -> bool:
    return node[0] in ("num", "position", "last") or (node[0] == "fn" and node[1] == "string-length")


def _bool(node, c: _Ctx) -> Column:
    kind = node[0]
    if kind == "num":  # [n] means position() = n
        return c.position == F.lit(int(node[1]))
    if kind == "last":  # [last()] means position() = last()
        return c.position == c.last
    if kind == "position":
        return F.lit(True)
    if kind == "or":
        return _bool(node[1], c) | _bool(node[2], c)
    if kind == "and":
        return _bool(node[1], c) & _bool(node[2], c)
    if kind == "attr":
        return c.attrs.getItem(node[1]).isNotNull()
    if kind == "text":
        return F.coalesce(F.size(c.texts) > 0, F.lit(False))
    if kind == "dot":
        return F.length(F.coalesce(c.text, F.lit(""))) > 0
    if kind == "str":
        return F.lit(len(node[1]) > 0)
    if kind == "fn":
        name, args = node[1], node[2]
        if name == "not":
            return ~_bool(args[0], c)
        if name == "contains":
            a, b = (F.coalesce(_string(x, c), F.lit("")) for x in args)
            return F.instr(a, b) > 0
        if name == "starts-with":
            a, b = (F.coalesce(_string(x, c), F.lit("")) for x in args)
            return a.startswith(b)
        return F.length(F.coalesce(_string(node, c), F.lit(""))) > 0
    if kind == "cmp":
        op, left, right = node[1], node[2], node[3]
        numeric = _is_numeric(left) or _is_numeric(right)

        def compare(lv, rv):
            if numeric:
                lv, rv = lv.try_cast("double"), rv.try_cast("double")
            return {"=": lv == rv, "!=": lv != rv, "<": lv < rv, "<=": lv <= rv, ">": lv > rv, ">=": lv >= rv}[op]

        # a node-set of text nodes compares true when any of its nodes does
        if left[0] == "text" and right[0] != "text":
            rv = _number(right, c) if numeric else _string(right, c)
            return F.coalesce(F.exists(c.texts, lambda t: compare(t, rv)), F.lit(False))
        if right[0] == "text" and left[0] != "text":
            lv = _number(left, c) if numeric else _string(left, c)
            return F.coalesce(F.exists(c.texts, lambda t: compare(lv, t)), F.lit(False))
        if numeric:
            lv, rv = _number(left, c), _number(right, c)
        else:
            lv, rv = _string(left, c), _string(right, c)
        return F.coalesce(compare(lv, rv), F.lit(False))
    raise Unsupported(f"not a predicate: {kind}")


def _step_test(step: Step, tag: Column, attrs: Column, sib: Column, pos: Column, nsib: Column, npos: Column,
               text: Column | None = None, texts: Column | None = None) -> Column:
    named = step.tag is not None
    c = _Ctx(tag, attrs, sib if named else pos, nsib if named else npos, text, texts)
    cond = (tag == F.lit(step.tag)) if named else F.lit(True)
    for p in step.preds:
        b = (c.position == F.lit(int(p[1]))) if p[0] == "num" else _bool(p, c)
        cond = cond & b
    return cond


def _el(el, step):
    return _step_test(step, el["tag"], el["attrs"], el["sib"], el["pos"], el["nsib"], el["npos"])


def _fold(path: Column, steps) -> Column:
    """``struct(e, a)`` after folding the steps over the elements of ``path``."""

    def merge(acc, el):
        exact, anyb = acc.getField("e"), acc.getField("a")
        terms = [F.lit(0).cast("long")]
        for i, s in enumerate(steps, start=1):
            prev = exact if s.axis == "child" else anyb
            ok = _el(el, s) & (prev.bitwiseAND(F.lit(1 << (i - 1)).cast("long")) != 0)
            terms.append(F.when(ok, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        new = reduce(lambda x, y: x + y, terms)
        return F.struct(new.alias("e"), anyb.bitwiseOR(new).alias("a"))

    init = F.struct(F.lit(1).cast("long").alias("e"), F.lit(1).cast("long").alias("a"))
    return F.aggregate(path, init, merge)


def _ancestors(path: str = "path") -> Column:
    p = F.col(path)
    return F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))


def _marked(mark: str) -> Column:
    """True for rows that the parse marked (``^``: children of a marked element)."""
    return F.coalesce(F.array_contains("marks", mark), F.lit(False))


def branch_match(b: Path, path: str = "path") -> Column:
    """True for node rows selected by one location path (before ``(…)[…]``)."""
    if b.mark:
        return _marked(b.mark)
    last = b.steps[-1]
    n = len(b.steps)
    self_ok = _step_test(last, F.col("tag"), F.col("attrs"), F.col("sib"), F.col("pos"), F.col("nsib"),
                         F.col("npos"), F.col("text"), F.col("texts"))
    if n == 1 and last.axis == "desc":
        return self_ok
    if n == 1:
        return self_ok & (F.col("depth") == 1)
    st = _fold(_ancestors(path), b.steps[:-1])
    mask = st.getField("e") if last.axis == "child" else st.getField("a")
    return self_ok & (mask.bitwiseAND(F.lit(1 << (n - 1)).cast("long")) != 0)


def branch_parent_match(b: Path, path: str = "path") -> Column:
    """True for node rows whose parent the location path selects (for ``text()``)."""
    if b.mark:
        return _marked(f"{b.mark}^")
    p = F.col(path)
    n = len(b.steps)
    st = _fold(_ancestors(path), b.steps)
    return (F.size(p) > 1) & (st.getField("e").bitwiseAND(F.lit(1 << n).cast("long")) != 0)


def element_match(xp: XPath, path: str = "path") -> Column:
    """True for node rows that any branch selects."""
    return reduce(lambda a, b: a | b, [branch_match(b, path) for b in xp.branches])


def global_keep(pred, rank: Column, count: Column) -> Column:
    """The ``(…)[pred]`` test for a match of page-global rank ``rank`` among ``count``."""
    c = _Ctx(F.lit(None), F.create_map(), rank, count)
    return (rank == F.lit(int(pred[1]))) if pred[0] == "num" else _bool(pred, c)
