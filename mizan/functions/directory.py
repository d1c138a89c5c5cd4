"""Rows out of grouped list pages, as Arrow UDFs over the tree; layouts are tables of selectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mizan.functions.tree import Node, parse

ACTIVE, CANCELLED = "Aktif", "İptal Edilmiş"
# What a cancelled group's title holds, the id of the group of active entries, and marks of digital banks.
CANCELLED_WORDS, ACTIVE_ID, DIGITAL = ("iptal", "mülga", "tmsf"), "faaliyette", "Dijital Banka"
NUMBER, COUNT, DETAIL = r"^\d+\.\s*", r"\s*\(\d+\)\s*$", r"\s*Detay\s*$"
# Characters of the shortest entry and of the shortest name.
LEAST_ENTRY, LEAST_NAME = 5, 3


@dataclass(frozen=True)
class Layout:
    """Where a page keeps its groups and their entries; selectors as Node.select has them."""

    group: str
    item: str
    title: str | None = None  # the group's title; a group without one has no entries
    body: str | None = None  # what holds the entries; else the group
    name: str | None = None  # the entry's name; else its own text without that of its link
    link: str | None = None  # what holds the entry's link; else the entry


CARDS = Layout(group="div.card", item="li", title="h5", body="div.card-body, div.collapse")
PANES = Layout(group="div.tab-pane", item="li.row", name="div.baslikContainer", link="div.webAdresiContainer")


def groups(root: Node, layout: Layout) -> Iterator[tuple[Node, str, Node]]:
    """(group, title without its count, body) of every group that has what the layout names."""
    for group in root.select(layout.group):
        title = group.first(layout.title) if layout.title else group
        body = group.first(layout.body) if layout.body else group
        if title is not None and body is not None:
            yield group, re.sub(COUNT, "", title.text()).strip() if layout.title else "", body


CARD_LINK = T.ArrayType(T.StructType([*(T.StructField(c, T.StringType()) for c in ("header", "href", "text")), T.StructField("pos", T.IntegerType())]))


def card_links(html: str | None) -> list[dict]:
    """Links of each card's body with the card's header, without its trailing count."""
    return [
        {"header": title, "href": a.attrs["href"].strip(), "text": a.text(), "pos": i}
        for _, title, body in groups(parse(html or ""), CARDS)
        for i, a in enumerate(x for x in body.select("a") if "href" in x.attrs)
    ]


@F.pandas_udf(CARD_LINK)
def html_card_links(html: pd.Series) -> pd.Series:
    return html.map(card_links)


INSTITUTION = T.ArrayType(T.StructType([*(T.StructField(c, T.StringType()) for c in ("name", "website", "subcategory", "status")), T.StructField("digital", T.BooleanType())]))


def website(item: Node, layout: Layout) -> Node | None:
    """The first link of an entry that leads outside."""
    place = item.first(layout.link) if layout.link else item
    return next((a for a in place.select("a") if a.attrs.get("href", "").startswith("http")), None) if place else None


def entry(item: Node, layout: Layout) -> dict | None:
    """name, website and digital of one entry; none if there is no name."""
    link = website(item, layout)
    if layout.name:
        holder = item.first(layout.name)
        shown, digital = holder.text() if holder else "", False
    else:
        shown = item.text()
        if len(shown) < LEAST_ENTRY:
            return None
        shown = re.sub(DETAIL, "", shown.replace(link.text() or "\0", "") if link else shown).strip()
        digital = DIGITAL in shown
    name = re.sub(NUMBER, "", shown).strip()
    name = name.replace(DIGITAL, "").strip() if digital else name
    return {"name": name, "website": link.attrs["href"] if link else "", "digital": digital} if len(name) >= LEAST_NAME else None


def institutions(html: str | None, kind: str) -> list[dict]:
    """Entries of a directory page, of cards or of tab panes, whichever it has; kind is the subcategory of panes."""
    root, out = parse(html or ""), []
    for layout in (CARDS, PANES):
        for group, title, body in groups(root, layout):
            active = not any(w in title.lower() for w in CANCELLED_WORDS) if layout.title else group.attrs.get("id") == ACTIVE_ID
            found = filter(None, (entry(x, layout) for x in body.select(layout.item)))
            out += [x | {"subcategory": title if layout.title else kind, "status": ACTIVE if active else CANCELLED} for x in found]
    return out


@F.pandas_udf(INSTITUTION)
def html_institutions(html: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([institutions(h, k) for h, k in zip(html, kind, strict=True)])
