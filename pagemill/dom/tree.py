"""Tree of a page from the standard tokenizer; nodes are numbered in document order, a node's subtree is a range of numbers.

Tree rules: void elements; html, head and body are implied; a block ends an open paragraph; list items, cells, rows, terms and
options end the one before; script and style are raw text; an end tag closes the nearest open element of its name, if any;
comments are kept as nodes without a tag. Unknown or broken markup never raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HEAD = frozenset("title meta link base style script".split())
#: A start tag of the key ends open elements of the values, but not beyond the fences.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}


class Node:
    """An element, or a comment (tag is None). text stands before the children, tail after the node."""

    __slots__ = ("tag", "attrs", "text", "tail", "children", "parent", "id", "end")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.text, self.tail = tag, attrs or {}, "", ""
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.id = self.end = 0

    def iter(self) -> Iterator[Node]:
        """This node and its descendants in document order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def find_all(self, *tags: str) -> list[Node]:
        return [n for n in self.iter() if n is not self and n.tag in tags]

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.iter() if n is not self and n.tag in tags), None)

    def strings(self) -> Iterator[str]:
        """Pieces of text below the node in document order; comments have none."""
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                if x:
                    yield x
                continue
            if x is not self:
                stack.append(x.tail)
            if x.tag is not None:
                stack.extend(reversed(x.children))
                stack.append(x.text)

    def text_content(self) -> str:
        return "".join(self.strings())

    def joined(self, separator: str = "") -> str:
        """Pieces of text, each stripped, without empty ones."""
        return separator.join(x for s in self.strings() if (x := s.strip()))

    def remove(self, keep_tail: bool) -> None:
        """Take the node out of the tree, with its tail or leaving it in place."""
        up = self.parent
        if up is None:
            return
        at = next(i for i, c in enumerate(up.children) if c is self)
        if keep_tail and self.tail:
            if at:
                up.children[at - 1].tail += self.tail
            else:
                up.text += self.tail
        del up.children[at]
        self.parent = None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.body: Node | None = None

    def _append(self, node: Node) -> None:
        node.parent = self.open[-1]
        self.open[-1].children.append(node)

    def _into(self, name: str) -> None:
        """Make head or body the place to append to."""
        if name == "body" and self.body is None:
            self.open = [self.root]
            self.body = Node("body")
            self._append(self.body)
            self.open.append(self.body)
        elif name == "head" and len(self.open) == 1 and self.body is None:
            head = next((c for c in self.root.children if c.tag == "head"), None)
            if head is None:
                head = Node("head")
                self._append(head)
            self.open.append(head)

    def _close(self, tags: set[str], fences: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in fences:
                return
            if tag in tags:
                del self.open[i:]
                if tags == {"li"} or tags == {"option"}:
                    return

    def handle_starttag(self, tag: str, pairs: list[tuple[str, str | None]]) -> None:
        attrs: dict[str, str] = {}
        for name, value in pairs:
            attrs.setdefault(name, value or "")
        if tag == "html" or tag == "body" and self.body is not None:
            target = self.root if tag == "html" else self.body
            for name, value in attrs.items():
                target.attrs.setdefault(name, value)
            return
        if tag == "body":
            self._into("body")
            self.body.attrs.update(attrs)
            return
        if tag == "head":
            if self.body is None:
                self._into("head")
            return
        if self.body is None:
            in_head = any(n.tag == "head" for n in self.open)
            if tag in HEAD and tag not in ("script", "style") or tag in ("script", "style") and (in_head or len(self.open) == 1):
                if not in_head:
                    self._into("head")
            elif tag not in HEAD:
                self._into("body")
        if tag in BLOCK:
            self._close({"p"}, {"table", "td", "th", "li", "div", "section", "article", "blockquote", "button", "body"})
        if tag in ENDS:
            self._close(*ENDS[tag])
        node = Node(tag, attrs)
        self._append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, pairs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, pairs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in ("table", "body") and tag not in ("table", "body") and self.open[i].tag != tag:
                return

    def handle_data(self, data: str) -> None:
        if self.body is None and self.open[-1].tag in ("html", "head"):
            if not data.strip():
                return
            self._into("body")
        at = self.open[-1]
        if at.children:
            at.children[-1].tail += data
        else:
            at.text += data

    def handle_comment(self, data: str) -> None:
        node = Node(None)
        node.text = data
        self._append(node)


def parse(html: str) -> Node:
    """Tree of a page or fragment; the root is html."""
    builder = _Builder()
    try:
        builder.feed(html)
        builder.close()
    except Exception:  # what the tokenizer gives up on stays as far as it came
        pass
    number(builder.root)
    return builder.root


def number(root: Node) -> None:
    nodes = list(root.iter())
    for i, n in enumerate(nodes):
        n.id = n.end = i
    for n in reversed(nodes):
        if n.parent is not None and n.parent.end < n.end:
            n.parent.end = n.end


def body_of(root: Node) -> Node:
    return root if root.tag == "body" else root.find("body") or root


def serialize(node: Node, tail: bool = False) -> str:
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if tail or x is not node:
            stack.append(escape(x.tail, quote=False) if x.tail else "")
        if x.tag is None:
            out.append(f"<!--{x.text}-->")
            continue
        raw = x.tag in ("script", "style")
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in x.attrs.items())
        out.append(f"<{x.tag}{attrs}>")
        if x.tag in VOID:
            continue
        stack.append(f"</{x.tag}>")
        stack.extend(reversed(x.children))
        if x.text:
            stack.append(x.text if raw else escape(x.text, quote=False))
    return "".join(out)
