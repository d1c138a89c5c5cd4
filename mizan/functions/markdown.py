"""HTML to markdown as an Arrow UDF over the tree.

A line of markdown is made from the flat stream of events below an element:
texts become runs with a weight and a slant, and the marks are set where these
change from one run to the next, so they are balanced whatever the markup.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mizan.functions.text import ORDINALS
from mizan.functions.tree import Node, parse

# White space, headings, containers, bold and slanted elements and styles, and the length of a long table cell.
SPACE = re.compile("[ \t\r\n\u200b\u202f\u00a0]+")
HEADING = re.compile(rf"^(?:{'|'.join(ORDINALS)})\s+BÖLÜM\b|^EK[-–—]?\s*\d+", re.IGNORECASE)
CONTAINERS = {"div", "section", "article", "body", "main", "header", "footer"}
BOLD, BOLD_STYLES = ("b", "strong"), ("font-weight:700", "font-weight:bold")
SLANTED, SLANTED_STYLES = ("i", "em"), ("font-style:italic",)
LONG_CELL = 200
SILENT = ("script", "style")


def events(top: Node | str) -> Iterator[tuple[str, Node | str]]:
    """("open", element), ("text", string) and ("close", element) in document order."""
    todo: list[tuple[str, Node | str]] = [("open" if isinstance(top, Node) else "text", top)]
    while todo:
        kind, x = todo.pop()
        if kind == "open" and x.name in SILENT:
            continue
        yield kind, x
        if kind == "open":
            todo.append(("close", x))
            todo.extend(("open" if isinstance(c, Node) else "text", c) for c in reversed(x.children))


def marked(runs: list[tuple[str, bool, bool]]) -> str:
    """Runs (text, bold, slanted) as markdown, white space outside the marks and single.

    Bold goes on over white space between two bold runs, slant doesn't; slant is inside bold.
    """
    out, bold, slanted, space = [], False, False, False
    for text, b, s in [*runs, ("", False, False)]:
        core = SPACE.sub(" ", text)
        end = text == ""
        space = space or core[:1] == " "
        if not core.strip() and not end:
            continue
        if slanted and (space or not s or b != bold):
            out.append("*")
            slanted = False
        if bold and not b:
            out.append("**")
        if space and out and not end:
            out.append(" ")
        out.append("**" * (b and not bold) + "*" * (s and not slanted) + core.strip())
        bold, slanted, space = b, s, core[-1:] == " "
    return "".join(out).strip()


class Line:
    """The runs of one line while its events come in."""

    def __init__(self):
        self.runs: list[tuple[str, bool, bool]] = []
        self.open: list[tuple[bool, bool, int]] = [(False, False, 0)]  # bold, slanted, runs at the opening
        self.after_element, self.entered = False, 0

    def put(self, text: str, styled: bool = True) -> None:
        # what two neighbouring elements hold doesn't run together
        if self.after_element and self.entered:
            self.runs.append((" ", False, False))
        self.runs.append((text, *(self.open[-1][:2] if styled else (False, False))))
        self.after_element, self.entered = False, 0

    def opened(self, node: Node) -> None:
        style = node.attrs.get("style", "").lower().replace(" ", "")
        bold, slanted, _ = self.open[-1]
        bold = bold or node.name in BOLD or any(x in style for x in BOLD_STYLES)
        slanted = slanted or node.name in SLANTED or any(x in style for x in SLANTED_STYLES)
        self.open.append((bold, slanted, len(self.runs)))
        self.entered += self.after_element
        if node.name == "img" and node.attrs.get("src"):
            self.put(f"![{node.attrs.get('alt', '')}]({node.attrs['src']})", styled=False)

    def closed(self, node: Node) -> None:
        first = self.open.pop()[2]
        if len(self.runs) == first:
            self.entered = max(0, self.entered - 1)
            return
        if node.name == "a" and node.attrs.get("href") and (shown := marked(self.runs[first:])):
            glue = [self.runs[first]] if first and not self.runs[first][0].strip() else []
            self.runs[first:] = [*glue, (f"[{shown}]({node.attrs['href']})", False, False)]
        self.after_element, self.entered = True, 0

    def read(self, top: Node | str) -> str:
        for kind, x in events(top):
            if kind == "text":
                if x:
                    self.put(x)
            elif x.name == "br":
                if kind == "open":
                    self.after_element = False
                    self.put(" ")
            else:
                (self.opened if kind == "open" else self.closed)(x)
        return marked(self.runs)


def line(top: Node | str) -> str:
    return Line().read(top)


def cell(node: Node) -> str:
    """Each child by itself, a space between them."""
    return " ".join(filter(None, map(line, node.children))).replace("|", "\\|")


def _span(node: Node, name: str) -> int:
    value = node.attrs.get(name, "")
    return int(value) if value.isdigit() and int(value) else 1


def grid(lines: list[Node]) -> list[list[str]]:
    """The cells of table rows, spans laid out; the first place of a span across has its text."""
    places: list[dict[int, str]] = [{} for _ in lines]
    for r, own in enumerate(lines):
        c = 0
        for x in own.find_all("td", "th"):
            while c in places[r]:
                c += 1
            body = cell(x)
            for down in range(min(_span(x, "rowspan"), len(lines) - r)):
                for right in range(_span(x, "colspan")):
                    places[r + down][c + right] = "" if right else body
            c += _span(x, "colspan")
    width = max((max(row) + 1 for row in places if row), default=0)
    return [[row.get(i, "") for i in range(width)] for row in places]


def first_time(body: str, seen: set[str]) -> bool:
    """False for a long cell of which the letters and digits are in seen; adds those of long cells."""
    key = "".join(filter(str.isalnum, body))
    if min(len(body), len(key)) < LONG_CELL:
        return True
    known = len(seen)
    seen.add(key)
    return len(seen) > known


def table(node: Node, seen: set[str]) -> str:
    """A table with spans laid out; long cells that the document had before are blank.

    The header ends with the first row that has a header cell or bold element,
    and joins what stands above one another.
    """
    lines = node.find_all("tr")
    rows = [[x if first_time(x, seen) else "" for x in row] for row in grid(lines)]
    if not any(any(row) for row in rows):
        return ""
    heads = [i for i, own in enumerate(lines) if own.find("th", *BOLD)] or [0]
    top = [" / ".join(filter(None, column[: heads[0] + 1])) for column in zip(*rows, strict=True)]
    written = ["| " + " | ".join(row) + " |" for row in (top, *rows[heads[0] + 1 :])]
    return "\n".join([written[0], "|" + "---|" * len(top), *written[1:]])


def units(top: Node) -> Iterator[Node | str]:
    """What stands below containers, each a block of its own, in document order."""
    todo = list(reversed(top.children))
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and x.name in CONTAINERS:
            todo.extend(reversed(x.children))
        else:
            yield x


def block(x: Node | str, seen: set[str]) -> list[str]:
    """The blocks of markdown that one unit makes; empty ones are left to the caller."""
    if isinstance(x, str):
        return [x.strip()]
    if x.name == "table":
        return [table(x, seen)]
    if x.name in ("ul", "ol"):
        return [b for c in x.children if isinstance(c, Node) and c.name == "li" for b in block(c, seen)]
    body = line(x)
    plain = re.sub("[*_]", "", body).strip()
    marks = {"li": "- ", "p": "## " if HEADING.match(plain) else ""} | {f"h{n}": "#" * n + " " for n in range(1, 7)}
    if x.name == "p" and marks["p"]:
        body = plain
    return [marks.get(x.name, "") + body] if body else []


def to_markdown(html: str | None) -> str:
    """Blocks of the body, a blank line between them; "" for nothing."""
    if not html or not html.strip():
        return ""
    root, seen = parse(html), set()
    blocks = [b.strip() for x in units(root.find("body") or root) for b in block(x, seen)]
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(filter(None, blocks))).strip()


@F.pandas_udf(T.StringType())
def html_to_markdown(html: pd.Series) -> pd.Series:
    return html.map(to_markdown)
