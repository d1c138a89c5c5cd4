"""Reports over the store: health, quality, comparisons and rescue results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mizan.functions import markup, text
from mizan.operators import store


def document_health(docs: DataFrame, chunks: DataFrame, failures: DataFrame, catalog_rows: int) -> DataFrame:
    """One row: coverage of the catalog, short texts, stored error pages, long texts without chunks, failures."""
    n, preview = F.length("markdown_content"), F.substring("markdown_content", 1, 500)
    full = docs.agg(
        F.count("*").alias("documents"),
        F.count_if(n < 100).alias("too_short"),
        F.count_if((n >= 100) & text.is_error_page(preview)).alias("corrupted"),
    )
    share = F.when(F.lit(catalog_rows) > 0, F.round(F.col("documents") / catalog_rows * 100, 1))
    thin = store.thin_chunks(docs, chunks).agg(F.count("*").alias("missing_chunks"))
    failed = failures.agg(F.count("*").alias("failures"), F.count_if("retryable").alias("retryable"))
    return full.withColumn("coverage", share).crossJoin(thin).crossJoin(failed)


def quality_report(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """signal, n: the anomalies, orphan chunks and documents without chunks; one pass over the texts."""
    flags = markup.anomalies(F.col("markdown_content"))
    counts = docs.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
    long = counts.unpivot([], list(flags), "signal", "n")
    orphans = store.orphan_chunks(chunks, docs).agg(F.lit("orphan_chunks").alias("signal"), F.count("*").alias("n"))
    bare = store.without_chunks(docs, chunks).agg(F.lit("docs_without_chunks").alias("signal"), F.count("*").alias("n"))
    return long.unionByName(orphans).unionByName(bare)


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metrics of each current document against its former text; what was missing counts as empty."""
    old = before.select("document_id", F.col("markdown_content").alias("old_text"), F.col("extraction_method").alias("method_before"))
    both = after.join(old, "document_id", "left").withColumn("b", markup.text_metrics(F.col("old_text"))).withColumn("a", markup.text_metrics(F.col("markdown_content")))
    return both.select(
        "document_id", "method_before", F.col("extraction_method").alias("method_after"),
        (F.length("markdown_content") - F.coalesce(F.length("old_text"), F.lit(0))).alias("chars_delta"),
        (F.col("a.latex_markers") - F.col("b.latex_markers")).alias("latex_delta"),
        markup.regressed(F.col("b"), F.col("a")).alias("regression"),
    )


def rescue_report(outcomes: DataFrame, first: int = 20) -> DataFrame:
    """One row: how many are well, how many failed, the first failures and how many more."""
    failed = outcomes.where("NOT ok").orderBy("document_id").limit(first)
    shown = failed.agg(F.array_sort(F.collect_list(F.struct("document_id", "reason"))).alias("failures"))
    counts = outcomes.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))
    return counts.crossJoin(shown).withColumn("more", F.greatest(F.col("failed") - first, F.lit(0)))


def formula_inventory(docs: DataFrame, least: int = 1) -> DataFrame:
    """Documents with signals of dropped formulas, the highest score first; docs: document_id, markdown_content, extraction_method."""
    signals = markup.formula_signals(F.col("markdown_content"), F.col("extraction_method"))
    found = docs.select("document_id", signals.alias("s")).select("document_id", "s.*")
    return found.where(F.col("score") >= least).orderBy(F.desc("score"), "document_id")


def apart(places: Column, least: int = 40) -> Column:
    """Ascending positions without those that lie closer than `least` to one that stays."""
    none = F.array().cast("array<int>")
    return F.aggregate(F.array_sort(places), none, lambda kept, p: F.when((F.size(kept) == 0) | (p - F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(0)) >= least), F.concat(kept, F.array(p))).otherwise(kept))


def places_of(x: Column, part: Column, most: int | None = None) -> Column:
    """Positions, from 0, of a text's occurrences without overlaps: all, or the first `most` if that many are asked for."""
    pieces = F.split(x, F.concat(F.lit("\\Q"), part, F.lit("\\E")), -1)
    if most is not None:
        pieces = F.slice(pieces, 1, most + 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda s, p: F.struct((s["at"] + F.length(p) + F.length(part)).alias("at"), F.concat(s["found"], F.array(s["at"] + F.length(p))).alias("found"))
    # what follows the last occurrence isn't one
    return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step, lambda s: s["found"])


def write_results(rows: DataFrame, folder: str, now: str) -> str:
    """Results as JSON under a folder named by the time; returns it."""
    target = f"{folder}/results-{now}"
    rows.write.mode("errorifexists").json(target)
    return target


def console_lines(scores: dict[str, float], gates: dict[str, float]) -> list[str]:
    """A line for each score with a mark below its limit."""
    return [f"{name:<24} {value:>7.1%} {'' if value >= gates.get(name, 0) else '< ' + format(gates[name], '.0%')}".rstrip() for name, value in sorted(scores.items())]


def repeated_cells(cells: DataFrame, least: int = 200) -> DataFrame:
    """Long cells that their document had before, by letters and digits, become empty.

    cells: document_id, pos, cell.
    """
    letters = F.regexp_replace("cell", r"[^\p{L}\p{N}]", "")
    long = (F.length("cell") >= least) & (F.length(letters) >= least)
    seen = F.row_number().over(Window.partitionBy("document_id", F.when(long, letters).otherwise(F.concat(F.lit("#"), F.col("pos").cast("string")))).orderBy("pos"))
    return cells.withColumn("cell", F.when(long & (seen > 1), "").otherwise(F.col("cell")))
