"""Rows out of list pages: links, decisions, announcements, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mizan.functions import directory, text, urls

# Addresses of documents, decisions and announcements, and the title of a dated decision.
DOCUMENT_LINK, DECISION_LINK, DETAIL_LINK, NEWS_LINK = r"/DokumanGetir/(\d+)", r"/Mevzuat/DokumanGetir/(\d+)", "/Mevzuat/Detay/", r"/Duyuru/Detay/\d+"
TOKEN_FIELD, DEFAULT_DATE = "__RequestVerificationToken", r"""["']tarih["']\s*:\s*['"]([^'"]+)['"]"""
DATED_TITLE = r"^\((\d{2}[./]\d{2}[./]\d{4})\s*[-–—]\s*(\d+)\)\s*(.*)"

_ANCHOR = r"(?is)<a\b[^>]*?\bhref=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def plain(html: Column) -> Column:
    """Text of a fragment: tags dropped, the common entities decoded, white space collapsed."""
    x = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"[\s ]+", " "))


def anchors(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, pos, href, text of flat anchors."""
    hrefs, inner = (F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(i)) for i in (1, 2))
    found = pages.select(key, F.posexplode(F.arrays_zip(hrefs.alias("href"), inner.alias("inner"))).alias("pos", "a"))
    return found.select(key, "pos", F.trim("a.href").alias("href"), plain(F.col("a.inner")).alias("text"))


def links(found: DataFrame, base: str, category: Column, key: str = "page_id") -> DataFrame:
    """Documents among anchors: detail links and textless ones go, then the first of each address counts.

    The id is the number in the path, else that of a known external address;
    others drop.
    """
    some = found.where((F.col("text") != "") & ~F.contains("href", F.lit(DETAIL_LINK)))
    first = F.row_number().over(Window.partitionBy(key, "href").orderBy("pos"))
    some = some.withColumn("rn", first).where("rn = 1")
    number = F.regexp_extract("href", DOCUMENT_LINK, 1)
    outside = F.when(F.col("href").startswith("http"), urls.external_id(F.col("href")))
    some = some.withColumn("document_id", F.when(number != "", number).otherwise(outside)).where(F.col("document_id").isNotNull())
    source = F.when(F.col("href").startswith("/"), F.concat(F.lit(base), F.col("href"))).otherwise(F.col("href"))
    return some.select(key, "pos", "document_id", F.col("text").alias("title"), category.alias("category"), source.alias("source_url"))


def flat_pages(pages: DataFrame, base: str, categories: dict[int, str]) -> DataFrame:
    """Links of flat lists; the category by page id, else its number."""
    table = F.create_map(*[F.lit(x) for pair in categories.items() for x in pair]) if categories else F.create_map().cast("map<int,string>")
    category = F.coalesce(F.try_element_at(table, F.col("page_id").cast("int")), F.concat(F.lit("Sayfa "), F.col("page_id").cast("string")))
    return links(anchors(pages), base, category)


def accordion_pages(pages: DataFrame, base: str, categories: dict[str, str]) -> DataFrame:
    """Links of cards; the category by the header, else the header itself."""
    found = pages.select("page_id", F.explode(directory.html_card_links("html")).alias("a")).select("page_id", "a.*")
    cards = found.withColumn("key", F.struct("page_id", "header"))
    table = F.create_map(*[F.lit(x) for pair in categories.items() for x in pair]) if categories else F.create_map().cast("map<string,string>")
    out = links(cards, base, F.coalesce(F.try_element_at(table, F.col("key.header")), F.col("key.header")), "key")
    return out.select("key.page_id", "pos", "document_id", "title", "category", "source_url")


def decisions(found: DataFrame, category: str, template: str, key: str = "page_id") -> DataFrame:
    """Decision anchors: (date - number) title, or the whole text as the title."""
    shape = DATED_TITLE
    number = F.regexp_extract("href", DECISION_LINK, 1)
    some = found.where((number != "") & (F.col("text") != ""))
    before, after = template.split("{}")
    dated = F.col("text").rlike(shape)
    return some.select(
        key, "pos", number.alias("document_id"), F.when(dated, F.trim(F.regexp_extract("text", shape, 3))).otherwise(F.col("text")).alias("title"),
        F.regexp_extract("text", shape, 1).alias("decision_date"), F.regexp_extract("text", shape, 2).alias("decision_number"),
        F.lit(category).alias("category"), F.concat(F.lit(before), number, F.lit(after)).alias("source_url"),
    )


def announcements(pages: DataFrame, base: str, key: str = "page_id") -> DataFrame:
    """Announcement anchors: date span, title span (else the whole text) without the date, whole address; empty titles go."""
    hrefs, inner = (F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(i)) for i in (1, 2))
    found = pages.select(key, F.posexplode(F.arrays_zip(hrefs.alias("href"), inner.alias("inner"))).alias("pos", "a")).select(key, "pos", "a.*")
    found = found.where(F.col("href").rlike(NEWS_LINK))
    span = lambda cls: plain(F.regexp_extract("inner", rf"(?is)<span\b[^>]*class=[\"'][^\"']*\b{cls}\b[^\"']*[\"'][^>]*>(.*?)</span>", 1))
    found = found.withColumn("date", span("gorunenTarih")).withColumn("titled", span("text"))
    title = F.when(F.col("titled") != "", F.col("titled")).otherwise(plain(F.col("inner")))
    title = F.trim(F.when(F.col("date") != "", F.replace(title, F.col("date"), F.lit(""))).otherwise(title))
    address = F.when(F.col("href").startswith("/"), F.concat(F.lit(base), F.col("href"))).otherwise(F.col("href"))
    return found.select(key, "pos", title.alias("title"), "date", address.alias("url")).where(F.col("title") != "")


def headings(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The first heading's text and the number of paragraphs."""
    return pages.select(key, F.trim(F.regexp_extract("html", r"(?is)<h1[^>]*>([^<]*)</h1>", 1)).alias("heading"), F.regexp_count("html", F.lit(r"(?i)<p[ >]")).alias("paragraphs"))


def bulletin_settings(html: Column) -> Column:
    """Struct of a bulletin page's request token and default date, empty where there is none."""
    field = F.regexp_extract(html, rf"(?is)<input\b[^>]*\bname=[\"']{TOKEN_FIELD}[\"'][^>]*>", 0)
    return F.struct(F.regexp_extract(field, r"(?is)\bvalue=[\"']([^\"']*)", 1).alias("token"), F.regexp_extract(html, DEFAULT_DATE, 1).alias("date"))


def snapshot_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Table rows that open a chart and have four cells or more: row_number, name, metric_id, tp, yp as shown."""
    lines = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("pos", "tr"))
    cells = F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), plain)
    metric = F.regexp_extract("tr", r"ShowModalGraph\('([^']+)'", 1)
    some = lines.withColumn("c", cells).withColumn("metric_id", metric).where((F.size("c") >= 4) & (F.col("metric_id") != ""))
    return some.select(key, "pos", F.col("c")[0].alias("row_number"), F.col("c")[1].alias("name"), "metric_id", F.col("c")[2].alias("tp"), F.col("c")[3].alias("yp"))


def monthly_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """JSON rows of seven cells or more: name, and tp, yp, total as formatted numbers."""
    wire = "struct<Json: struct<data: struct<rows: array<struct<cell: array<string>>>>>>"
    rows = payloads.select(F.posexplode(F.from_json(column, wire)["Json"]["data"]["rows"]).alias("pos", "r")).where(F.size("r.cell") >= 7)
    c = F.col("r.cell")
    number = lambda x: F.coalesce(text.format_number(x.try_cast("double")), x)
    return rows.select("pos", c[2].alias("name"), number(c[4]).alias("tp"), number(c[5]).alias("yp"), number(c[6]).alias("total"))


def iframe_or_content(html: Column, name: str = "icerik", least: int = 100) -> Column:
    """Address of the first iframe, else the named div's text if longer than `least`; struct."""
    source = F.regexp_extract(html, r"(?is)<iframe\b[^>]*?\bsrc=[\"']([^\"']+)", 1)
    body = plain(F.regexp_extract(html, rf"(?is)<div\b[^>]*?\bid=[\"']{name}[\"'][^>]*>(.*?)</div>", 1))
    return F.struct(F.nullif(source, F.lit("")).alias("src"), F.when((source == "") & (F.length(body) > least), body).alias("content"))
