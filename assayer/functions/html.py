"""A small element tree from HTML text, for the page jobs that need structure. Standard library only.

Selectors: tag, .class, #id, [attr], [attr=value] and its ^=, $=, *= and ~=, :first-child, :last-child, :nth-child(n),
descendant (space), child (>), next sibling (+), later siblings (~), and alternatives (comma).
XPath: /tag, //tag, *, predicates [n], [last()], [@a], [@a='v'], [contains(@a, 'v')], [text()='v'], and a last step text() or @a.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that the next one of their kind closes.
SELF_CLOSING = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)$")


class Node:
    """start and end: the stretch of the page that the element takes, from its start tag to the tag that closes it."""

    __slots__ = ("attrs", "children", "end", "parent", "start", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, start: int = 0, end: int = 0):
        self.tag, self.attrs, self.parent, self.children, self.start, self.end = tag, attrs, parent, [], start, end

    def walk(self) -> Iterator[Node]:
        """All nodes below, in document order; a stack of our own, since pages with unclosed tags nest thousands deep."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag not in ("script", "style", "!--"):
                todo += reversed(c.children)
        return " ".join(" ".join(out).split())

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def remove(self) -> None:
        if self.parent and self in self.parent.children:
            self.parent.children.remove(self)

    def html(self) -> str:
        out, todo = [], [self]
        while todo:
            c = todo.pop()
            if isinstance(c, str):  # ready to be written
                out.append(c)
            elif c.tag == "!--":
                out.append(f"<!--{''.join(c.children)}-->")
            else:
                attrs = "".join(f' {k}="{escape(v)}"' for k, v in c.attrs.items())
                root, void, raw = c.tag == "#root", c.tag in VOID, c.tag in ("script", "style")
                out.append("" if root else f"<{c.tag}{attrs}>")
                todo += [] if root or void else [f"</{c.tag}>"]
                todo += [] if void else [x if isinstance(x, Node) or raw else escape(x, quote=False) for x in reversed(c.children)]
        return "".join(out)


class _Builder(HTMLParser):
    """Start tags open elements and end tags close them; void elements, a p before a p, and an open link before a link close by themselves."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None, 0, len(html))
        self.open: dict[str, int] = {}
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.feed(html)
        self.close()
        self._close_to(self.root, len(html))

    def _place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _close_to(self, node: Node, place: int) -> None:
        """Closes what is open below node."""
        while self.at is not node:
            self.at.end = place
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def _open(self, tag, attrs, stays: bool) -> None:
        start = self._place()
        # of an attribute that is there twice, the first counts
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at, start, start + len(self.get_starttag_text() or ""))
        node.attrs = {k: node.attrs[k] for k, _ in attrs}
        self.at.children.append(node)
        if stays:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def _nearest(self, tag: str) -> Node | None:
        if not self.open.get(tag):
            return None
        node = self.at
        while node.tag != tag:
            node = node.parent
        return node

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (link := self._nearest("a")):  # links do not nest
            self._close_to(link.parent, self._place())
        while self.at.tag in SELF_CLOSING.get(tag, ()):
            self._close_to(self.at.parent, self._place())
        self._open(tag, attrs, tag not in VOID)

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs, False)

    def handle_endtag(self, tag):
        if node := self._nearest(tag):
            place = self._place()
            self._close_to(node, place)
            self._close_to(node.parent, (self.rawdata.find(">", place) + 1) or len(self.rawdata))

    def handle_data(self, data):
        self.at.children.append(data)

    def handle_comment(self, data):
        note = Node("!--", {}, self.at)
        note.children.append(data)
        self.at.children.append(note)


def parse(html: str | None) -> Node:
    return _Builder(html or "").root


_PSEUDO = re.compile(r":(first-child|last-child|nth-child)(?:\((\d+)\))?$")


def _elements(node: Node) -> list[Node]:
    return [c for c in node.parent.children if isinstance(c, Node) and c.tag != "!--"] if node.parent else [node]


def _has(node: Node, test: str) -> bool:
    """[attr], [attr=value] and the like, without the brackets."""
    m = re.match(r"([\w-]+)\s*(?:([~^$*]?=)\s*(.*))?$", test.strip())
    if not m or m[1] not in node.attrs:
        return False
    value, wanted = node.attrs[m[1]], (m[3] or "").strip("\"'")
    return {None: True, "=": value == wanted, "^=": value.startswith(wanted), "$=": value.endswith(wanted), "*=": wanted in value, "~=": wanted in value.split()}[m[2]]


def _fits(node: Node, simple: str) -> bool:
    place = _PSEUDO.search(simple)
    m = _SIMPLE.match(simple[: place.start()] if place else simple)
    if not m or node.tag == "!--":
        return False
    if m[1] and m[1] != "*" and node.tag != m[1].lower():
        return False
    for part in re.findall(r"[.#][\w-]+|\[[^\]]+\]", m[2] or ""):
        if part[0] == ".":
            ok = part[1:] in node.classes()
        elif part[0] == "#":
            ok = node.attrs.get("id") == part[1:]
        else:
            ok = _has(node, part[1:-1])
        if not ok:
            return False
    if place:
        siblings = _elements(node)
        k = next(i for i, x in enumerate(siblings) if x is node)
        return k == (len(siblings) - 1 if place[1] == "last-child" else int(place[2] or 1) - 1)
    return True


def _matches(node: Node, steps: list[str], scope: Node) -> bool:
    """steps alternate simple selectors and, where it is no descendant, the combinator before them."""
    if not _fits(node, steps[-1]):
        return False
    rest = steps[:-1]
    if not rest:
        return True
    up = node.parent
    if rest[-1] in ("+", "~"):
        siblings = _elements(node)
        k = next(i for i, x in enumerate(siblings) if x is node)
        before = siblings[max(k - 1, 0) : k] if rest[-1] == "+" else siblings[:k]
        return any(_matches(x, rest[:-1], scope) for x in before)
    if rest[-1] == ">":
        return up is not None and up is not scope.parent and _matches(up, rest[:-1], scope)
    while up is not None and up.tag != "#root":
        if _matches(up, rest, scope):
            return True
        up = up.parent
    return False


def select(scope: Node, selector: str) -> list[Node]:
    """The nodes below scope, in document order, that one of the alternatives fits."""
    ways = [re.sub(r"\s*([>+~])(?!=)\s*", r" \1 ", s.strip()).split() for s in re.split(r",(?![^\[]*\])", selector) if s.strip()]
    return [n for n in scope.walk() if any(_matches(n, w, scope) for w in ways)]


_STEP = re.compile(r"(//|/)?(@[\w-]+|text\(\)|[\w-]+|\*|\.)((?:\[[^\]]*\])*)")


def _passes(node: Node, k: int, n: int, test: str) -> bool:
    if test.isdigit():
        return k == int(test)
    if test == "last()":
        return k == n
    m = re.match(r"contains\(\s*(@[\w-]+|text\(\))\s*,\s*(['\"])(.*)\2\s*\)$", test)
    if m:
        return m[3] in (node.text() if m[1] == "text()" else node.attrs.get(m[1][1:], ""))
    m = re.match(r"(@[\w-]+|text\(\))\s*(?:=\s*(['\"])(.*)\2)?$", test)
    if not m:
        raise ValueError(f"unknown XPath predicate: {test}")
    value = node.text() if m[1] == "text()" else node.attrs.get(m[1][1:])
    return value is not None and (m[2] is None or value == m[3])


def xpath(scope: Node, path: str) -> list[str]:
    """The texts, or attributes, that a path of the small XPath above finds from scope, in document order."""
    at, nodes, end = 0, [scope], len(path.strip())
    path = path.strip()
    while at < end:
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"unknown XPath: {path}")
        deep, name, at = m[1] == "//", m[2], m.end()
        if name.startswith("@"):
            found = [x for n in nodes for x in ([n, *n.walk()] if deep else [n])]
            return [n.attrs[name[1:]] for n in found if name[1:] in n.attrs]
        if name == "text()":
            return [" ".join("".join(c for c in n.children if isinstance(c, str)).split()) for n in nodes]
        if name == ".":
            continue
        step, seen = [], set()
        for n in nodes:
            parents = [n, *n.walk()] if deep else [n]
            for parent in parents:
                own = [c for c in parent.children if isinstance(c, Node) and c.tag != "!--" and name in ("*", c.tag)]
                for test in re.findall(r"\[([^\]]*)\]", m[3]):
                    own = [c for k, c in enumerate(own, 1) if _passes(c, k, len(own), test.strip())]
                step += [c for c in own if id(c) not in seen and not seen.add(id(c))]
        nodes = step
    order = {id(n): k for k, n in enumerate(scope.walk())}
    return [n.text() for n in sorted(nodes, key=lambda n: order.get(id(n), -1))]
