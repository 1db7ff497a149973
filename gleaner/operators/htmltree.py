"""Lenient HTML → element rows, run inside Spark tasks (see ``nodes.parse_nodes``).

Built on the standard library's tokenizer (``html.parser``), with the few
tree-construction rules needed for real pages:

* void elements never take children;
* a block start tag closes an open ``<p>`` in scope, ``<li>`` closes an open
  ``<li>``, ``<dt>/<dd>``, ``<tr>``, ``<td>/<th>`` and ``<option>`` likewise;
* an end tag closes everything above the matching open element, a stray end
  tag is ignored;
* ``html``/``head``/``body`` are implied when missing, stray text in
  ``html``/``head`` opens an implied ``<body><p>`` (so plain text becomes
  ``html/body/p``);
* script/style content is raw text, never tokenised.

Every element row keeps pre-order ``node_id``, ``parent_id``, ``end_id`` (last
descendant), same-tag and element sibling positions, its direct leading text
and tail, the ``[start, end)`` slice of the source and of the page text.
"""

from __future__ import annotations

from html.parser import HTMLParser

# fixed values: HTML element categories (WHATWG HTML, tree construction)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr keygen command basefont frame isindex".split()
)
HEAD_ONLY = frozenset("title meta link style script base noscript".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template button".split())

_EMPTY_PAGE = "<html></html>"


def normalise(html) -> str:
    """A page as the parser sees it: missing/empty → empty document, else stripped."""
    if isinstance(html, str) and html:
        return html.strip()
    return _EMPTY_PAGE


class _Builder(HTMLParser):
    def __init__(self, src: str):
        super().__init__(convert_charrefs=True)
        self.src = src
        self.at = 0
        # per element
        self.tag: list[str] = []
        self.attrs: list[dict] = []
        self.parent: list[int] = []
        self.end: list[int] = []
        self.sib: list[int] = []
        self.pos: list[int] = []
        self.lead: list[list[str]] = []
        self.tail: list[list[str]] = []
        self.s0: list[int] = []
        self.s1: list[int] = []
        self.t0: list[int] = []
        self.t1: list[int] = []
        self.last_child: list[int] = []
        self.counts: list[dict] = []
        # parse state
        self.stack: list[int] = []
        self.text: list[str] = []
        self.tlen = 0
        self.body = -1
        self.head = -1
        self.explicit_end: dict[int, int] = {}

    # -- positions -------------------------------------------------------------------
    def updatepos(self, i, j):
        """The tokenizer goes on from ``i`` to ``j`` of what it holds: its place in the source, not lines and columns."""
        if i < j:
            self.at += j - i
        return j

    # -- tree ops ----------------------------------------------------------------------
    def _push(self, tag: str, attrs: dict, start: int, content_start: int, void: bool = False) -> int:
        nid = len(self.tag)
        parent = self.stack[-1] if self.stack else -1
        if parent >= 0:
            counts = self.counts[parent]
            counts[tag] = counts.get(tag, 0) + 1
            counts[""] = counts.get("", 0) + 1
            self.sib.append(counts[tag])
            self.pos.append(counts[""])
            self.last_child[parent] = nid
        else:
            self.sib.append(1)
            self.pos.append(1)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(parent)
        self.end.append(nid)
        self.lead.append([])
        self.tail.append([])
        self.s0.append(start)
        self.s1.append(content_start)
        self.t0.append(self.tlen)
        self.t1.append(self.tlen)
        self.last_child.append(-1)
        self.counts.append({})
        if not void:
            self.stack.append(nid)
        return nid

    def _pop(self, at: int) -> None:
        nid = self.stack.pop()
        self.s1[nid] = self.explicit_end.get(nid, at)
        self.t1[nid] = self.tlen
        self.end[nid] = len(self.tag) - 1

    def _pop_to(self, idx: int, at: int) -> None:
        while len(self.stack) > idx:
            self._pop(at)

    def _find_in_scope(self, names, boundary=SCOPE, stop=frozenset()) -> int:
        for i in range(len(self.stack) - 1, -1, -1):
            t = self.tag[self.stack[i]]
            if t in names:
                return i
            if t in boundary or t in stop:
                return -1
        return -1

    def _ensure_root(self, at: int) -> None:
        if not self.stack:
            if self.tag:  # root was closed already: reopen it for trailing content
                self.stack.append(0)
            else:
                self._push("html", {}, at, at)

    def _ensure_body(self, at: int) -> None:
        self._ensure_root(at)
        if self.body >= 0:
            if self.body not in self.stack:
                self.stack[:] = self.stack[:1] + [self.body]
            return
        if self.head >= 0 and self.head in self.stack:
            self._pop_to(self.stack.index(self.head), at)
        self._pop_to(1, at)
        self.body = self._push("body", {}, at, at)

    # -- tokenizer callbacks ---------------------------------------------------------
    def handle_starttag(self, tag, attrs):
        start = self.at
        raw = self.get_starttag_text() or ""
        after = start + len(raw)
        amap: dict[str, str] = {}
        for k, v in attrs:
            if k not in amap:
                amap[k] = "" if v is None else v
        if tag == "html":
            if not self.tag:
                self._push("html", amap, start, after)
            else:
                for k, v in amap.items():
                    self.attrs[0].setdefault(k, v)
            return
        self._ensure_root(start)
        if tag == "head":
            if self.head < 0 and self.body < 0:
                self._pop_to(1, start)
                self.head = self._push("head", amap, start, after)
            return
        if tag == "body":
            if self.body < 0:
                if self.head >= 0 and self.head in self.stack:
                    self._pop_to(self.stack.index(self.head), start)
                self._pop_to(1, start)
                self.body = self._push("body", amap, start, after)
            else:
                for k, v in amap.items():
                    self.attrs[self.body].setdefault(k, v)
            return
        top = self.tag[self.stack[-1]]
        if top == "html":
            if tag in HEAD_ONLY and self.body < 0:
                if self.head < 0:
                    self.head = self._push("head", {}, start, start)
                else:
                    self.stack.append(self.head)
            else:
                self._ensure_body(start)
        elif top == "head" and tag not in HEAD_ONLY:
            self._ensure_body(start)
        # implied end tags
        if tag in CLOSES_P:
            i = self._find_in_scope({"p"})
            if i >= 0:
                self._pop_to(i, start)
        if tag == "li":
            i = self._find_in_scope({"li"}, stop=frozenset({"ul", "ol", "menu"}))
            if i >= 0:
                self._pop_to(i, start)
        elif tag in ("dt", "dd"):
            i = self._find_in_scope({"dt", "dd"}, stop=frozenset({"dl"}))
            if i >= 0:
                self._pop_to(i, start)
        elif tag == "tr":
            i = self._find_in_scope({"tr"}, stop=frozenset({"tbody", "thead", "tfoot"}))
            if i >= 0:
                self._pop_to(i, start)
        elif tag in ("td", "th"):
            i = self._find_in_scope({"td", "th"}, boundary=frozenset({"tr", "table", "html"}))
            if i >= 0:
                self._pop_to(i, start)
        elif tag in ("option", "optgroup"):
            names = {"option"} if tag == "option" else {"option", "optgroup"}
            i = self._find_in_scope(names, stop=frozenset({"select", "datalist"}))
            if i >= 0:
                self._pop_to(i, start)
        self._push(tag, amap, start, after, void=tag in VOID)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.tag[self.stack[-1]] == tag:
            self._pop(self.at + len(self.get_starttag_text() or ""))

    def handle_endtag(self, tag):
        start = self.at
        close = self.src.find(">", start)
        after = len(self.src) if close < 0 else close + 1
        if tag in ("html", "body"):
            nid = 0 if tag == "html" else self.body
            if nid >= 0 and self.tag:
                self.explicit_end[nid] = after
            return
        if tag in VOID:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[i]] == tag:
                self.explicit_end[self.stack[i]] = after
                self._pop_to(i, start)
                return
            if tag == "p" and self.tag[self.stack[i]] in SCOPE:
                return

    def handle_data(self, data):
        if not data:
            return
        if not self.stack or self.tag[self.stack[-1]] in ("html", "head"):
            if not data.strip():
                return
            at = self.at
            self._ensure_body(at)
            self._push("p", {}, at, at)
        top = self.stack[-1]
        last = self.last_child[top]
        (self.lead[top] if last < 0 else self.tail[last]).append(data)
        self.text.append(data)
        self.tlen += len(data)

    def finish(self):
        self.close()
        if not self.tag:
            self._push("html", {}, 0, 0)
        self._pop_to(0, len(self.src))
        # children lists, and sibling counts (for last()): same-tag siblings and element siblings
        self.kids = [[] for _ in self.tag]
        for i, par in enumerate(self.parent):
            if par >= 0:
                self.kids[par].append(i)
        self.nsib = [1] * len(self.tag)
        self.npos = [1] * len(self.tag)
        for i, par in enumerate(self.parent):
            if par >= 0:
                counts = self.counts[par]
                self.nsib[i] = counts[self.tag[i]]
                self.npos[i] = counts[""]
        return self


def build(html) -> tuple[str, _Builder]:
    """Parse one page; returns the normalised source and the element table."""
    src = normalise(html)
    b = _Builder(src)
    b.feed(src)
    return src, b.finish()


def doc_text(b: _Builder) -> str:
    return "".join(b.text)
