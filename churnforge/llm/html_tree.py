"""Lenient HTML parsing into light trees, and simple tree matching."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable

import numpy as np

# Element names by role, and the words in class or id names (or
# roles) that mark what is not part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
          "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
AWAY = frozenset("aside audio button canvas dialog footer form head input map menu nav object select svg video".split())
AWAY_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search "
                       "toolbar".split())
AWAY_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo promoted promotion recommended related replies respond share sharing sidebar skip social sponsor "
    "sponsored subscribe subscription toolbar widget".split())
COMMENT_WORDS = frozenset(("comment", "comments", "replies", "respond", "disqus"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """``away``: furniture by element, role or because it is hidden. ``named``: the
    outermost element around the node whose class or id speaks of furniture,
    which is a hint and no proof; ``comments`` if it speaks of reader comments."""

    __slots__ = ("tag", "path", "parent", "kids", "blocks", "away", "named", "comments", "article", "main", "depth")

    def __init__(self, tag: str, sig: str, parent: Node | None, away: bool, words: frozenset[str] = frozenset()):
        self.tag, self.parent, self.away = tag, parent, away
        self.named = None if parent is None else parent.named
        self.comments = parent is not None and (parent.comments or not words.isdisjoint(COMMENT_WORDS))
        if self.named is None and not words.isdisjoint(AWAY_WORDS) and tag not in ("html", "body"):
            self.named = self
        self.path = sig if parent is None else f"{parent.path}>{sig}"
        self.depth = 0 if parent is None else parent.depth + 1
        self.article = None if parent is None else parent.article
        self.main = None if parent is None else parent.main
        self.kids: list[Node] = []
        self.blocks: list[str] = []


class Page:
    """Nodes and text blocks of one page, in page order."""

    def __init__(self, source: str):
        self.root = Node("#", "#", None, False)
        self.blocks: list[tuple[Node, str]] = []
        self._open = [self.root]
        self._text: list[str] = []
        self._owner = self.root
        self._attrs: dict[str, tuple[str, frozenset[str], str, bool]] = {}
        self._parse(source)

    def _parse(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = _TOKEN.search(source, at)
            if m is None:
                self._add(source[at:])
                break
            if m.start() > at:
                self._add(source[at:m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                self._flush_if(tag)
                at = close.end() if close else size
            else:
                self._start(tag, m[3])
        self._flush()

    def _add(self, text: str) -> None:
        if not self._text:
            self._owner = self._open[-1]
        self._text.append(text)

    def _flush_if(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()

    def _flush(self) -> None:
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            if text:
                node = self._owner
                while node.tag in INLINE:
                    node = node.parent
                node.blocks.append(text)
                self.blocks.append((node, text))
            self._text = []

    def _describe(self, raw: str) -> tuple[str, frozenset[str], str, bool]:
        """(signature, name words, role, hidden) of an attribute string."""
        found = self._attrs.get(raw)
        if found is None:
            attrs = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}
            names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
            words = frozenset(w.lower() for w in _NAME_WORD.findall(names))
            hidden = (attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style", "")))
                      or bool(re.search(r"(?:^|\s)hidden(?:[\s=/]|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", raw))))
            sig = "." + ".".join(sorted(attrs["class"].split())) if attrs.get("class") else ""
            found = self._attrs[raw] = sig, words, attrs.get("role", "").strip().lower(), hidden
        return found

    def _start(self, tag: str, raw: str) -> None:
        self._flush_if(tag)
        if tag in CLOSES_P:
            self._close_implied({"p"}, {"table", "button"}, None)
        if tag in CLOSES:
            self._close_implied(CLOSES[tag], SCOPES[tag], tag)
        if tag in VOID:
            return
        parent = self._open[-1]
        sig, words, role, hidden = self._describe(raw) if raw and not raw.isspace() else ("", frozenset(), "", False)
        inside = parent.article is not None or parent.main is not None
        away = parent.away or hidden or tag in AWAY or role in AWAY_ROLES or (tag == "header" and not inside)
        node = Node(tag, tag + sig, parent, away, words)
        if not away:
            if tag == "article" and node.article is None and not node.comments:
                node.article = node
            if (tag == "main" or role == "main") and node.main is None:
                node.main = node
        parent.kids.append(node)
        if not raw.endswith("/") or tag in INLINE or tag in CLOSES_P:
            self._open.append(node)

    def _close_implied(self, tags: set[str], scope: set[str], starting: str | None) -> None:
        """Pop up to the outermost open element of ``tags`` inside the scope."""
        cut = None
        for k in range(len(self._open) - 1, 0, -1):
            tag = self._open[k].tag
            if tag in tags:
                cut = k
            elif tag in scope or (starting is None and cut is None and tag not in INLINE):
                break
            elif cut is not None and starting is None:
                break
        if cut is not None:
            self._flush()
            del self._open[cut:]

    def _end(self, tag: str) -> None:
        self._flush_if(tag)
        for k in range(len(self._open) - 1, 0, -1):
            node = self._open[k]
            if node.tag == tag:
                del self._open[k:]
                return
            if tag in INLINE and node.tag not in INLINE:
                return                                     # a stray inline end does not close blocks


def match_trees(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: the largest top-down match of two trees in which
    matched nodes have equal signatures and siblings keep their order.

    Of any width and depth: the size of a match follows from the shapes of two
    subtrees, so each pair of shapes is worked out once, off an explicit stack;
    of a table of siblings only about the root of its rows is kept, and the way
    back computes the rows between two kept ones again.
    """
    shapes: dict[tuple[str, tuple[int, ...]], int] = {}
    names: list[str] = []
    kids: list[tuple[int, ...]] = []
    total: list[int] = []
    shape: dict[int, int] = {}
    for root in (a, b):
        order, todo = [], [root]
        while todo:
            order.append(n := todo.pop())
            todo += n.kids
        for n in reversed(order):
            key = n.path.rpartition(">")[2], tuple([shape[id(k)] for k in n.kids])
            if key not in shapes:
                shapes[key] = len(names)
                names.append(key[0])
                kids.append(key[1])
                total.append(1 + sum(total[k] for k in key[1]))
            shape[id(n)] = shapes[key]

    memo: dict[tuple[int, int], int] = {}

    def known(x: int, y: int) -> int | None:
        if names[x] != names[y]:
            return 0
        if x == y:
            return total[x]
        if not kids[x] or not kids[y]:
            return 1
        return memo.get((x, y))

    def gains(x: int, y: int) -> Callable[[int], np.ndarray]:
        """Row of match sizes of a kid of x with each kid of y."""
        own, place = np.unique(kids[y], return_inverse=True)
        rows: dict[int, np.ndarray] = {}

        def row(p: int) -> np.ndarray:
            if p not in rows:
                rows[p] = np.array([known(p, q) for q in own.tolist()])
            return rows[p][place]
        return row

    def below(last: np.ndarray, gain: np.ndarray) -> np.ndarray:
        row = np.zeros_like(last)
        np.maximum.accumulate(np.maximum(last[1:], last[:-1] + gain), out=row[1:])
        return row

    def solve(x: int, y: int) -> None:
        todo = [(x, y)]
        while todo:
            x, y = todo[-1]
            if known(x, y) is not None:
                todo.pop()
                continue
            missing = [(p, q) for p in set(kids[x]) for q in set(kids[y]) if known(p, q) is None]
            if missing:
                todo += missing
                continue
            row, gain = np.zeros(len(kids[y]) + 1, dtype=np.int64), gains(x, y)
            for p in kids[x]:
                row = below(row, gain(p))
            memo[x, y] = 1 + int(row[-1])

    def matched_kids(x: int, y: int) -> list[tuple[int, int]]:
        """Places of the matched kids, last first."""
        if x == y:
            return [(i, i) for i in reversed(range(len(kids[x])))]
        gain, step = gains(x, y), math.isqrt(len(kids[x])) + 1
        row, kept = np.zeros(len(kids[y]) + 1, dtype=np.int64), []
        for i, p in enumerate(kids[x]):
            if i % step == 0:
                kept.append(row)
            row = below(row, gain(p))
        out, j = [], len(kids[y])
        for block in reversed(range(len(kept))):
            first = block * step
            rows = [kept[block]]
            for p in kids[x][first:first + step]:
                rows.append(below(rows[-1], gain(p)))
            i = len(rows) - 1
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((first + i, j))
        return out

    pairs, todo = [], [(a, b)] if names[shape[id(a)]] == names[shape[id(b)]] else []
    if todo:
        solve(shape[id(a)], shape[id(b)])
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        if x.kids and y.kids:
            todo += [(x.kids[i], y.kids[j]) for i, j in matched_kids(shape[id(x)], shape[id(y)])]
    return pairs
