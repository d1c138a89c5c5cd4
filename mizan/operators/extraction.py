"""Choosing among downloads and extraction backends, and extraction slots."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mizan.functions import markdown, text

#: Least size of a download by layer; layers not named here have no magic bytes.
LEAST_BYTES = {"generate_pdf": 500, "pdf": 500, "htm": 200, "iframe": 200, "div": 100, "doc": 100}
FORMULA_METHODS = ("lightocr", "chandra", "manual_latex")
LEAST_CONTENT = 200


def layer_order(prefer_html: bool) -> list[str]:
    """Layers as they are tried for one type code; HTML first moves the frame up."""
    rest = ["generate_pdf", "pdf", "htm", "iframe", "div", "doc"]
    return ["iframe", "div", *[x for x in rest if x not in ("iframe", "div")]] if prefer_html else rest


def acceptable(layer: Column, status: Column, content: Column) -> Column:
    """Success, larger than the layer's limit, and of its kind: PDF, OLE or ZIP magic, no error page."""
    size, head = F.octet_length(content), F.hex(F.substring(content, 1, 4))
    limit = F.try_element_at(F.create_map(*[F.lit(x) for pair in LEAST_BYTES.items() for x in pair]), layer)
    body = F.coalesce(F.try_validate_utf8(content.cast("string")), F.lit(""))
    magic = (
        F.when(layer.isin("generate_pdf", "pdf"), F.hex(F.substring(content, 1, 5)) == "255044462D")
        .when(layer == "doc", head.isin("D0CF11E0", "504B0304"))
        .when(layer == "htm", ~text.is_error_page(body))
        .otherwise(F.lit(True))
    )
    return F.coalesce((status == 200) & (size > limit) & magic, F.lit(False))


def choose_download(candidates: DataFrame, prefer_html: bool = False) -> DataFrame:
    """The first acceptable download of each document: by type code tried, then by layer.

    candidates: document_id, type_rank, layer, status, content. The Word layer
    counts for the document's own type (rank 0) only.
    """
    order = layer_order(prefer_html)
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("layer"))
    fine = candidates.where(acceptable(F.col("layer"), F.col("status"), F.col("content")) & ((F.col("layer") != "doc") | (F.col("type_rank") == 0)))
    best = F.row_number().over(Window.partitionBy("document_id").orderBy("type_rank", rank))
    return fine.withColumn("rn", best).where("rn = 1").select("document_id", "type_rank", "layer", "content")


def content_problem(content: Column, least: int) -> Column:
    """Why a backend's output isn't accepted, or null."""
    return F.when(F.length(content) < least, F.format_string("output too short (%d < %d)", F.length(content), F.lit(least))).when(content.rlike(r"(?i)<form>\s*</form>"), "contains empty form block")


def accepted(content: Column, least: int = LEAST_CONTENT) -> Column:
    """Whether a backend's output counts."""
    return content_problem(content, least).isNull()


def choose_backend(attempts: DataFrame, least: int = LEAST_CONTENT) -> DataFrame:
    """First acceptable output of each document, else `failed` with the reasons in order.

    attempts: document_id, rank, backend, available, output, error.
    """
    reason = F.when(~F.col("available"), "unavailable").when(F.col("error").isNotNull(), F.col("error")).when(F.col("output").isNull(), "returned None").otherwise(content_problem(F.col("output"), least))
    tried = attempts.withColumn("reason", reason)
    win = F.min(F.when(F.col("reason").isNull(), F.struct("rank", "backend", F.col("output").alias("content"))))
    why = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat("backend", F.lit(": "), "reason").alias("t")))), lambda x: x["t"]), "; ")
    out = tried.groupBy("document_id").agg(win.alias("win"), why.alias("why"))
    return out.select(
        "document_id",
        F.coalesce("win.backend", F.lit("failed")).alias("method"),
        F.coalesce("win.content", F.lit("")).alias("content"),
        F.when(F.col("win").isNull(), F.concat(F.lit("all backends failed: "), "why")).alias("error"),
    )


def formula_aware(method: Column, methods: tuple[str, ...] = FORMULA_METHODS) -> Column:
    """Whether the extraction method keeps formulas; degraded ones are the other non-empty methods."""
    low, hit = F.lower(F.coalesce(method, F.lit(""))), F.lit(False)
    for m in methods:
        hit = hit | F.contains(low, F.lit(m))
    return hit


def degraded(method: Column, methods: tuple[str, ...] = FORMULA_METHODS) -> Column:
    return (F.coalesce(method, F.lit("")) != "") & ~formula_aware(method, methods)


def backend_slot(extract: Callable[[bytes], str | None]) -> Callable:
    """A backend as an Arrow UDF: binary in, text or null out; errors give null."""

    @F.pandas_udf(T.StringType())
    def run(content: pd.Series) -> pd.Series:
        def one(x):
            try:
                return extract(x) if x is not None else None
            except (ValueError, OSError, RuntimeError):
                return None

        return content.map(one)

    return run


def extract_html(files: DataFrame) -> DataFrame:
    """document_id, content (binary) of HTML files to text, method, error and retryable.

    Empty results and error pages fail; small files and error pages may be tried again.
    """
    decoded = text.decode_bytes(F.col("content"))
    made = files.select("document_id", F.octet_length("content").alias("size"), markdown.html_to_markdown(decoded).alias("made"))
    bad = text.is_error_page(F.col("made"))
    empty = F.coalesce("made", F.lit("")) == ""
    failed = empty | bad
    return made.select(
        "document_id",
        F.when(failed, "").otherwise(F.col("made")).alias("content"),
        F.when(failed, "failed").otherwise("html_parser").alias("method"),
        F.when(empty, "no meaningful content extracted").when(bad, "extracted content is a navigation page").alias("error"),
        F.when(failed, (F.col("size") < 200) | bad).otherwise(False).alias("retryable"),
    )
