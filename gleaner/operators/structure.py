"""O-08: XPaths evaluated on a page's tree, by structural joins over interval labels.

An element's label is its interval (``node_id``, ``end_id``): what it holds is numbered
within. A step is a join of two lists in document order, the elements so far and the
elements of the step's tag: intervals either nest or lie apart, so each list is read once
(``Page.step``). A relative path as a predicate (``[h2]``, ``[.//a/@href]``) is a join the
other way round: the elements that have a match are found once for the page, from the last step
up (``Page.owners``), and every candidate is looked up there.

All XPaths of a request go over one ``Page``, which remembers each prefix of steps, each
predicate's owners and each attribute's values: XPaths that begin alike are one walk, and a thousand
rules ``//a[@class='…']`` are lookups.

``xpath.compile_xpath`` turns row-local XPaths into Columns; this module is for what needs
more than an element and its ancestors (evaluated where the page is parsed, see
``nodes.parse_nodes``), and for a crawl's rules, which are rows and no part of the plan.

Supported: all XPath 1.0 axes but ``namespace``, abbreviated or not; name tests, ``*``, ``node()``; predicates
anywhere, in any number, positions at any place; relative and absolute paths in predicates; ``(…)[n]`` with further
predicates and steps; unions; comparisons of node sets; the string, boolean and counting functions
in ``FUNCTIONS``; results ``@name`` and ``text()``. Arithmetic, variables, ``@*``, ``comment()`` and
other functions raise ``Unsupported``.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from functools import lru_cache

from . import htmltree
from .xpath import Unsupported, _Parser, _tokens, evaluable

#: The document above the root element.
DOCUMENT = -1
AXES = {
    "child", "descendant", "descendant-or-self", "self", "parent", "ancestor", "ancestor-or-self",
    "following-sibling", "preceding-sibling", "following", "preceding", "attribute",
}
REVERSE = {"parent", "ancestor", "ancestor-or-self", "preceding-sibling", "preceding"}
FUNCTIONS = {
    "contains", "starts-with", "normalize-space", "string-length", "string", "concat", "not", "position", "last", "count",
    "name", "local-name", "number", "boolean", "true", "false", "substring-before", "substring-after", "translate",
}
NUMERIC = {"string-length", "count", "number", "position", "last"}
ANY = ("descendant-or-self", "node()", ())


class _Reader(_Parser):
    """Paths as hashable tuples: ``("path", start, steps, result)``.

    ``start`` is "document", "context", or ``("filter", expression, predicates)``; a step is ``(axis, test, predicates)``;
    ``result`` is ``None`` for elements, ``("attr", name)`` or ``("text",)``.
    """

    def branches(self):
        out = [self.location()]
        while self.peek()[0] == "pipe":
            self.take()
            out.append(self.location())
        return out

    def predicates(self):
        preds = []
        while self.peek()[0] == "lbr":
            self.take()
            preds.append(self.expr())
            self.take("rbr")
        return tuple(preds)

    def location(self):
        kind, val = self.peek()
        if kind == "lpar":
            self.take()
            inner = ("union", *self.branches())
            self.take("rpar")
            start, steps = ("filter", inner, self.predicates()), []
        elif kind in ("slash", "dslash"):
            start, steps = "document", []
            if kind == "slash":
                self.take()
            else:
                self.take()
                steps.append(ANY)
            result = self.step(steps)
            return self.rest(start, steps, result)
        else:
            start, steps = "context", []
            result = self.step(steps)
            return self.rest(start, steps, result)
        return self.rest(start, steps, None)

    def rest(self, start, steps, result):
        while self.peek()[0] in ("slash", "dslash"):
            if result:
                raise ValueError("a step after a string result")
            if self.take()[0] == "dslash":
                steps.append(ANY)
            result = self.step(steps)
        return ("path", start, tuple(_joined(steps)), result)

    def step(self, steps):
        """Read a step into ``steps``; returns the result kind if it is one."""
        kind, val = self.take()
        if kind == "dot":
            steps.append(("self", "node()", ()))
            return None
        if kind == "dotdot":
            steps.append(("parent", "node()", ()))
            return None
        axis = "child"
        if kind == "axis":
            axis = val[:-2]
            if axis not in AXES:
                raise Unsupported(f"axis {axis}") if axis == "namespace" else ValueError(f"no axis {axis}")
            kind, val = self.take()
            if axis == "attribute":
                kind, val = ("attr", val) if kind == "name" else ("attr", "*")
        if kind == "attr":
            if val == "*" or self.peek()[0] == "lbr":
                raise Unsupported("@* or a predicate on an attribute")
            return ("attr", val.lower())
        if kind == "func" and val in ("text", "node"):
            self.take("lpar")
            self.take("rpar")
            if val == "text":
                if axis != "child" or self.peek()[0] == "lbr":
                    raise Unsupported("text() on an axis or with a predicate")
                return ("text",)
            test = "node()"
        elif kind == "name":
            test = val.lower()
        elif kind == "star":
            test = "*"
        elif kind == "func":
            raise Unsupported(f"{val}()")
        else:
            raise ValueError(f"expected a step, got {val}")
        steps.append((axis, test, self.predicates()))
        return None

    def value(self):
        kind, val = self.peek()
        if kind in ("str", "num"):
            return super().value()
        if kind == "func" and val not in ("text", "node"):
            if val not in FUNCTIONS:
                raise Unsupported(f"function {val}()")
            self.take()
            self.take("lpar")
            args = []
            while self.peek()[0] != "rpar":
                args.append(self.expr())
                if self.peek()[0] == "comma":
                    self.take()
            self.take("rpar")
            return ("fn", val, tuple(args))
        if kind == "lpar":
            at = self.i
            try:
                return self.location()
            except ValueError:  # a condition in brackets, not a node set
                self.i = at
                self.take()
                e = self.expr()
                self.take("rpar")
                return e
        if kind in ("slash", "dslash", "name", "star", "attr", "dot", "dotdot", "axis", "func"):
            paths = [self.location()]
            while self.peek()[0] == "pipe":
                self.take()
                paths.append(self.location())
            return paths[0] if len(paths) == 1 else ("union", *paths)
        raise ValueError(f"unexpected {val}")


def _joined(steps):
    """``//`` before a child step without positions is one descendant step."""
    out = []
    for s in steps:
        if out and out[-1] == ANY and s[0] == "child" and not any(map(positional, s[2])):
            out[-1] = ("descendant", s[1], s[2])
        else:
            out.append(s)
    return out


def positional(pred) -> bool:
    """Whether a predicate asks for its element's place among the candidates."""
    kind = pred[0]
    if kind == "num" or kind == "fn" and pred[1] in NUMERIC:
        return True
    return _places(pred)


def _places(e) -> bool:
    kind = e[0]
    if kind == "fn":
        return e[1] in ("position", "last") or any(map(_places, e[2]))
    if kind in ("or", "and"):
        return _places(e[1]) or _places(e[2])
    return kind == "cmp" and (_places(e[2]) or _places(e[3]))


@lru_cache(maxsize=4096)
def read(source: str) -> tuple:
    """The branches of an XPath; ``ValueError`` if it is invalid, ``Unsupported`` if not evaluated here."""
    if not isinstance(source, str) or not source.strip():
        raise ValueError("empty")
    reader = _Reader(evaluable(_tokens(source)))
    out = reader.branches()
    if reader.i != len(reader.t):
        raise ValueError("trailing tokens")
    return tuple(out)


def mark(source: str, branch: int) -> str:
    """The name under which a node row says that a branch of an XPath selected it."""
    return f"{hashlib.sha1(source.encode()).hexdigest()[:12]}.{branch}"


class Strings(list):
    """A node set of attributes or text nodes."""


class Page:
    """A page's tree with what the XPaths of a request have found on it so far."""

    def __init__(self, tree):
        self.tree = tree
        self.everything = list(range(len(tree.tag)))
        self.roots = [i for i in self.everything if tree.parent[i] < 0]
        self.by_tag: dict[str, list[int]] = {}
        for i, t in enumerate(tree.tag):
            self.by_tag.setdefault(t, []).append(i)
        self.prefixes: dict = {}
        self.owned: dict = {}
        self.with_value: dict = {}
        self.whole_text = None

    # -- axes: lists in document order in, lists in document order out ---------------------

    def end(self, n: int) -> int:
        return len(self.everything) - 1 if n == DOCUMENT else self.tree.end[n]

    def kids(self, n: int) -> list[int]:
        return self.roots if n == DOCUMENT else self.tree.kids[n]

    def named(self, test: str) -> list[int]:
        return self.everything if test in ("*", "node()") else self.by_tag.get(test, [])

    def join(self, axis: str, test: str, here: list[int]) -> list[int]:
        """All elements of ``test`` on ``axis`` of any of ``here``, each once."""
        tag, parent = self.tree.tag, self.tree.parent
        fits = (lambda k: True) if test in ("*", "node()") else (lambda k: tag[k] == test)
        if axis == "child":
            return sorted(k for n in here for k in self.kids(n) if fits(k))
        if axis == "self":
            return [n for n in here if n == DOCUMENT and test == "node()" or n >= 0 and fits(n)]
        if axis == "parent":
            up = {(DOCUMENT if parent[n] < 0 else parent[n]) for n in here if n >= 0}
            return sorted(k for k in up if (k >= 0 and fits(k)) or (k < 0 and test == "node()"))
        if axis in ("descendant", "descendant-or-self"):
            found, among, covered = [], self.named(test), DOCUMENT - 1
            for n in here:
                # an interval within one before it brings nothing new
                if n <= covered:
                    continue
                low = bisect_right(among, n if axis == "descendant" else n - 1)
                found += among[low : bisect_right(among, self.end(n))]
                covered = max(covered, self.end(n))
            return [DOCUMENT, *found] if axis != "descendant" and here and here[0] == DOCUMENT and test == "node()" else found
        if axis in ("ancestor", "ancestor-or-self"):
            up: set[int] = set(here) if axis == "ancestor-or-self" else set()
            seen = set()
            for n in here:
                while n >= 0 and n not in seen:
                    seen.add(n)
                    n = DOCUMENT if parent[n] < 0 else parent[n]
                    up.add(n)
            return sorted(k for k in up if (k >= 0 and fits(k)) or (k < 0 and test == "node()"))
        if axis in ("following-sibling", "preceding-sibling"):
            edge: dict[int, int] = {}
            pick = min if axis == "following-sibling" else max
            for n in here:
                if n >= 0:
                    edge[parent[n]] = pick(n, edge.get(parent[n], n))
            after = axis == "following-sibling"
            return sorted(k for p, n in edge.items() for k in self.kids(DOCUMENT if p < 0 else p) if fits(k) and (k > n if after else k < n))
        below = [n for n in here if n >= 0]
        if not below:
            return []
        if axis == "following":
            return self.named(test)[bisect_right(self.named(test), min(self.tree.end[n] for n in below)) :]
        last = max(below)
        return [k for k in self.named(test)[: bisect_right(self.named(test), last - 1)] if self.tree.end[k] < last]

    # -- paths --------------------------------------------------------------------------

    def step(self, step: tuple, here: list[int]) -> list[int]:
        axis, test, preds = step
        if not any(map(positional, preds)):
            return self.filtered(self.join(axis, test, here), preds)
        found: set[int] = set()
        for n in here:
            own = self.join(axis, test, [n])
            if axis in REVERSE:
                own.reverse()
            for p in preds:
                own = [k for at, k in enumerate(own, 1) if self.holds(p, k, at, len(own))]
            found.update(own)
        return sorted(found)

    def filtered(self, nodes: list[int], preds: tuple) -> list[int]:
        """Those of ``nodes`` for which predicates without positions hold."""
        for p in preds:
            same = _equals(p)
            if same:
                nodes = self.meet(nodes, self.valued(same[0]).get(same[1], []))
            else:
                nodes = [n for n in nodes if self.holds(p, n, 1, 1)]
        return nodes

    def meet(self, a: list[int], b: list[int]) -> list[int]:
        """What two lists in document order share, looking the shorter one up in the longer."""
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        return [n for n in short if (k := bisect_right(long, n)) and long[k - 1] == n]

    def valued(self, name: str) -> dict[str, list[int]]:
        """Elements by the value of an attribute."""
        if name not in self.with_value:
            index = self.with_value[name] = {}
            for i, attrs in enumerate(self.tree.attrs):
                if name in attrs:
                    index.setdefault(attrs[name], []).append(i)
        return self.with_value[name]

    def elements(self, path: tuple, n: int) -> list[int]:
        """The elements before a path's result step."""
        _, start, steps, _ = path
        if start == "document" or start == "context" and n == DOCUMENT:
            at, here = 0, [DOCUMENT]
            for k in range(len(steps), 0, -1):
                if steps[:k] in self.prefixes:
                    at, here = k, self.prefixes[steps[:k]]
                    break
            for k in range(at, len(steps)):
                here = self.prefixes[steps[: k + 1]] = self.step(steps[k], here)
            return here
        if start == "context":
            here = [n]
        else:
            here = self.value(start[1], n, 1, 1)
            if isinstance(here, Strings) or not isinstance(here, list):
                raise Unsupported("steps or predicates after strings")
            for p in start[2]:
                here = [k for at, k in enumerate(here, 1) if self.holds(p, k, at, len(here))]
        for s in steps:
            here = self.step(s, here)
        return here

    def owners(self, path: tuple) -> set[int] | None:
        """All elements from which a relative path finds something; ``None`` if not found this way."""
        if path not in self.owned:
            _, start, steps, result = path
            simple = start == "context" and steps and result != ("text",)
            simple = simple and all(s[0] in ("child", "descendant") and not any(map(positional, s[2])) for s in steps)
            if not simple:
                self.owned[path] = None
            else:
                found = None
                for k in range(len(steps) - 1, -1, -1):
                    axis, test, preds = steps[k]
                    nodes = self.filtered(list(self.named(test)), preds)
                    if found is None and result:
                        nodes = [n for n in nodes if result[1] in self.tree.attrs[n]]
                    elif found is not None:
                        nodes = [n for n in nodes if n in found]
                    found = set(self.join("parent" if axis == "child" else "ancestor", "node()", nodes))
                self.owned[path] = found
        return self.owned[path]

    def select(self, path: tuple) -> list[int]:
        """Elements of a whole path, in document order (those that have its result step's strings, if any)."""
        return [n for n in self.elements(path, DOCUMENT) if n >= 0]

    # -- expressions ----------------------------------------------------------------------

    def text(self, n: int) -> str:
        if self.whole_text is None:
            self.whole_text = htmltree.doc_text(self.tree)
        return self.whole_text if n == DOCUMENT else self.whole_text[self.tree.t0[n] : self.tree.t1[n]]

    def texts(self, n: int) -> list[str]:
        t = self.tree
        parts = ["".join(t.lead[n]), *("".join(t.tail[k]) for k in t.kids[n])] if n >= 0 else []
        return [p for p in parts if p]

    def holds(self, e: tuple, n: int, position: int, last: int) -> bool:
        kind = e[0]
        if kind == "or":
            return self.holds(e[1], n, position, last) or self.holds(e[2], n, position, last)
        if kind == "and":
            return self.holds(e[1], n, position, last) and self.holds(e[2], n, position, last)
        if kind == "path":
            owners = self.owners(e)
            if owners is not None:
                return n in owners
        value = self.value(e, n, position, last)
        if isinstance(value, float):
            return value == position
        return bool(value)

    def value(self, e: tuple, n: int, position: int, last: int):
        kind = e[0]
        if kind in ("str", "num"):
            return e[1]
        if kind in ("or", "and"):
            return self.holds(e, n, position, last)
        if kind == "union":
            parts = [self.value(p, n, position, last) for p in e[1:]]
            if any(isinstance(p, Strings) for p in parts):
                return Strings(s for p in parts for s in self.strings(p))
            return sorted({k for p in parts for k in p})
        if kind == "path":
            here = self.elements(e, n)
            if e[3] is None:
                return here
            if e[3] == ("text",):
                return Strings(t for k in here for t in self.texts(k))
            return Strings(self.tree.attrs[k][e[3][1]] for k in here if k >= 0 and e[3][1] in self.tree.attrs[k])
        args = [(lambda a=a: self.value(a, n, position, last)) for a in (e[2:] if kind == "cmp" else e[2])]
        if kind == "cmp":
            return self.compared(e[1], args[0](), args[1]())
        return self.called(e, args, n, position, last)

    def strings(self, v) -> list[str]:
        return v if isinstance(v, Strings) else [self.text(k) for k in v]

    def string(self, v) -> str:
        if isinstance(v, list):
            return next(iter(self.strings(v[:1] if not isinstance(v, Strings) else v)), "")
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return "NaN" if math.isnan(v) else str(int(v)) if v == int(v) else str(v)
        return v

    def number(self, v) -> float:
        if isinstance(v, (bool, float)):
            return float(v)
        try:
            return float(self.string(v))
        except ValueError:
            return math.nan

    def compared(self, op: str, a, b) -> bool:
        if isinstance(a, bool) or isinstance(b, bool):
            sides = [(bool(a), bool(b))]
        else:
            left, right = (self.strings(v) if isinstance(v, list) else [v] for v in (a, b))
            sides = [(x, y) for x in left for y in right]
        for x, y in sides:
            if op in ("<", "<=", ">", ">=") or isinstance(x, float) or isinstance(y, float):
                x, y = self.number(x), self.number(y)
            if {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]:
                return True
        return False

    def called(self, e: tuple, args: list, n: int, position: int, last: int):
        name, given = e[1], e[2]

        def text(k: int) -> str:
            return self.string(args[k]()) if k < len(args) else self.text(n)

        if name in ("position", "last"):
            return float(position if name == "position" else last)
        if name in ("true", "false"):
            return name == "true"
        if name in ("not", "boolean"):
            held = args[0]()
            held = bool(held) and held == held
            if given[0][0] == "path":
                held = self.holds(given[0], n, position, last)
            return held if name == "boolean" else not held
        if name == "count":
            return float(len(args[0]()))
        if name in ("name", "local-name"):
            nodes = args[0]() if args else [n]
            return self.tree.tag[nodes[0]] if nodes and not isinstance(nodes, Strings) and nodes[0] >= 0 else ""
        if name == "number":
            return self.number(args[0]() if args else self.text(n))
        if name == "string-length":
            return float(len(text(0)))
        if name == "normalize-space":
            return " ".join(text(0).split())
        if name == "string":
            return text(0)
        if name == "concat":
            return "".join(text(k) for k in range(len(args)))
        a, b = text(0), text(1)
        if name == "contains":
            return b in a
        if name == "starts-with":
            return a.startswith(b)
        if name == "substring-before":
            return a.partition(b)[0] if b in a else ""
        if name == "substring-after":
            return a.partition(b)[2] if b in a else ""
        to = text(2)
        return a.translate({ord(c): to[k] if k < len(to) else None for k, c in reversed(list(enumerate(b)))})


def _equals(pred: tuple) -> tuple[str, str] | None:
    """``(name, value)`` of a predicate ``@name = 'value'``."""
    if pred[0] == "cmp" and pred[1] == "=" and pred[2][:3] == ("path", "context", ()) and pred[3][0] == "str":
        result = pred[2][3]
        return (result[1], pred[3][1]) if result and result[0] == "attr" else None
    return None
