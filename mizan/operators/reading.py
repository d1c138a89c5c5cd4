"""Reading a document: its stored page with metadata, or a fetched one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mizan.functions import markup, text
from mizan.operators import extraction, store

# Extraction methods of which a page needs no warning, and the warning of others.
FORMULA_METHODS = ("lightocr", "chandra2", "pp_structure", "manual_latex")
DEGRADED_WARNING = (
    "Bu belgedeki matematiksel formüller ve bazı görseller çıkartılamamış olabilir. "
    "Metin 'aşağıdaki formül', 'aşağıda yer alan formül' gibi bir ifadeye atıfta bulunuyorsa, "
    "formülü hafızadan veya standart literatürden yeniden kurma — kullanıcıyı kaynak PDF'e yönlendir."
)


def wanted_forms(requests: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """requests (requested, page) with every form of the id, in the order in which they count; only digits get prefixes."""
    plain = F.array(F.col("requested"))
    more = F.array(*[F.concat(F.lit(p), F.col("requested")) for p in prefixes]) if prefixes else F.array().cast("array<string>")
    forms = F.when(F.col("requested").rlike("^[0-9]+$"), F.concat(plain, more)).otherwise(plain)
    return requests.select("requested", "page", F.posexplode(forms).alias("form", "document_id"))


def pages_of(wanted: DataFrame, contents: DataFrame, source: int) -> DataFrame:
    """Pages that there are: requested, form, source, document_id, page, total_pages, content."""
    both = wanted.join(contents.select("document_id", "content"), "document_id").where("content <> ''")
    both = both.withColumn("total_pages", text.page_count(F.col("content"))).where(F.col("page").between(1, F.col("total_pages")))
    return both.select("requested", "form", F.lit(source).alias("source"), "document_id", "page", "total_pages", text.page(F.col("content"), F.col("page")).alias("content"))


def read_pages(requests: DataFrame, chunks: DataFrame, docs: DataFrame, catalog: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """One row for each request (requested, page): the page with metadata and warning, or no document_id.

    The first form of the id that has the page counts, from its chunks (source
    0) before its document (source 1). catalog: document_id, title,
    decision_date, decision_number, category, source_url; a document without a
    row has its id as title.
    """
    wanted = wanted_forms(requests, prefixes)
    ids = wanted.select("document_id").distinct()
    cut = store.rebuilt(chunks.join(ids, "document_id", "left_semi"))
    stored = docs.select("document_id", F.col("markdown_content").alias("content"))
    found = pages_of(wanted, cut, 0).unionByName(pages_of(wanted, stored, 1))
    best = F.row_number().over(Window.partitionBy("requested", "page").orderBy("form", "source"))
    found = found.withColumn("rn", best).where("rn = 1").drop("rn", "form")
    found = found.join(docs.select("document_id", "extraction_method"), "document_id", "left").join(catalog, "document_id", "left")
    found = found.withColumn("title", F.coalesce("title", "document_id"))
    warned = found.withColumn("warning", F.when(extraction.degraded(F.col("extraction_method"), FORMULA_METHODS), F.lit(DEGRADED_WARNING)))
    return requests.select("requested", "page").distinct().join(warned, ["requested", "page"], "left")


def read_or_fetch(requests: DataFrame, docs: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Pages from the store, else from fetch(missing ids); and the fetched documents to store.

    requests: requested, page. fetch gets document_id and returns document_id,
    content, null where nothing came. A page beyond the last has a message as
    content; a document that nobody has, an empty one.
    """
    wanted = requests.select("requested", F.col("requested").alias("document_id"), "page", F.lit(0).alias("form"))
    stored = pages_of(wanted, docs.select("document_id", F.col("markdown_content").alias("content")), 0)
    missing = wanted.join(stored.select("requested", "page"), ["requested", "page"], "left_anti")
    got = fetch(missing.select("document_id").distinct())
    total = text.page_count(F.coalesce("content", F.lit("")))
    live = missing.join(got, "document_id", "left").select("requested", "form", F.lit(1).alias("source"), "document_id", "page", total.alias("total_pages"), F.coalesce(text.page(F.col("content"), F.col("page")), F.lit("")).alias("content"))
    new = got.where("content <> ''").select("document_id", F.col("content").alias("markdown_content"), text.content_hash(F.col("content")).alias("content_hash"))
    return stored.unionByName(live).drop("form"), new


def page_audit(docs: DataFrame) -> DataFrame:
    """One row for each class of pages: class, pages, documents, images and the documents that have any.

    Every page of every document is read: passed, empty (white space alone) or
    invalid (the message of a page that there isn't).
    """
    number = F.explode(F.sequence(F.lit(1), text.page_count(F.coalesce("markdown_content", F.lit("")))))
    pages = docs.select("document_id", F.coalesce("markdown_content", F.lit("")).alias("x"), number.alias("page"))
    pages = pages.select("document_id", text.page(F.col("x"), F.col("page")).alias("body"))
    blank = F.regexp_replace("body", r"(?U)\s+", "") == ""
    kind = F.when(blank, "empty").when(F.contains(F.substring("body", 1, 200), F.lit("Invalid page")), "invalid").otherwise("passed")
    images = F.regexp_count("body", F.lit(markup.IMAGE_REFERENCES[0]))
    rows = pages.select("document_id", kind.alias("class"), images.cast("long").alias("images"))
    per = rows.groupBy("class", "document_id").agg(F.count("*").alias("pages"), F.sum("images").alias("images"))
    return per.groupBy("class").agg(F.sum("pages").alias("pages"), F.count("*").alias("documents"), F.sum("images").alias("images"), F.count_if(F.col("images") > 0).alias("with_images"))


def document_audit(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """One row: of the asked ids how many have text (passed), none (empty) or no document (missing); least, middle and most characters."""
    both = asked.select("document_id").join(docs.select("document_id", "markdown_content"), "document_id", "left")
    blank = F.regexp_replace("markdown_content", r"(?U)\s+", "") == ""
    kind = F.when(F.col("markdown_content").isNull(), "missing").when(blank, "empty").otherwise("passed")
    some = both.select(kind.alias("class"), F.length("markdown_content").cast("long").alias("n"))
    size = F.when(F.col("class") == "passed", F.col("n"))
    counts = [F.count_if(F.col("class") == c).alias(c) for c in ("passed", "empty", "missing")]
    # of an even number the upper one of the two in the middle
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY -CASE WHEN class = 'passed' THEN n END)")
    return some.agg(*counts, F.min(size).alias("least"), (-middle).cast("long").alias("middle"), F.max(size).alias("most"))
