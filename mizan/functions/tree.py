"""A small tolerant HTML tree on the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag of these ends an open element of the named ones.
CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
#: Implied ends don't reach beyond these.
SCOPES = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}


class Node:
    """An element: name, attributes, children (elements and strings)."""

    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    def walk(self):
        """All elements below, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find_all(self, *names: str, cls: str | None = None) -> list[Node]:
        return [n for n in self.walk() if (not names or n.name in names) and (cls is None or cls in n.attrs.get("class", "").split())]

    def find(self, *names: str, cls: str | None = None) -> Node | None:
        return next(iter(self.find_all(*names, cls=cls)), None)

    def select(self, selector: str) -> list[Node]:
        """All elements below that match `tag`, `.class` or `tag.class`."""
        tag, _, cls = selector.partition(".")
        return self.find_all(*([tag] if tag else []), cls=cls or None)

    def first(self, selectors: str) -> Node | None:
        """The first match of the first of the selectors, between commas, that has one."""
        return next((found[0] for s in selectors.split(", ") if (found := self.select(s))), None)

    def strings(self):
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            else:
                todo.extend(reversed(x.children))

    def text(self) -> str:
        """Stripped pieces of text, joined."""
        return "".join(s.strip() for s in self.strings())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ends, scope = CLOSES.get(tag, ()), SCOPES.get(tag, {"div", "td", "li", "body", "article", "section"})
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in ends:
                del self.open[i:]
                if tag != "tr":
                    break
            elif self.open[i].name in scope:
                break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
