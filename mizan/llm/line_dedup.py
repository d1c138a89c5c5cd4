"""Line dedup by overlapping three-line windows (operator 10), DataFrame functions only.

Lines end at line feeds. Every window of `width` consecutive lines that holds a
character other than a space gets a 128-bit key; of the windows that share a
key, all but the first (by doc_id, then position) are later occurrences. The
positions a document's later occurrences cover merge into intervals, and those
lines go. What is removed is judged on the input: the earliest copy of a line
is never covered, so no content is lost.

Defined results: null text stays null, with no lines; empty text is one empty
line; texts of fewer lines than a window are unchanged; a null doc_id comes
before all others; rows with equal doc_id and text are one document given
twice, and get the same result; rows that share a doc_id only are ordered by a
hash of the text. Columns of any other name are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mizan.llm import common


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, pos and key of every window."""
    lines = F.col("lines")

    def key(i: Column) -> Column:
        part = [F.element_at(lines, (i + j + 1).cast("int")) for j in range(width)]
        blank = F.trim(F.concat(*part)) == ""
        return F.when(~blank, F.struct(i.cast("int").alias("pos"), F.xxhash64(*part).alias("h1"), F.xxhash64(F.lit(width), *part[::-1]).alias("h2")))

    cut = docs.select("doc_id", F.xxhash64("text").alias("text_key"), _lines(F.col("text")).alias("lines"))
    cut = cut.where(F.size("lines") >= width)
    found = F.transform(F.sequence(F.lit(0), F.size("lines") - width), key)
    return cut.select("doc_id", "text_key", F.explode(found).alias("w")).where(F.col("w").isNotNull()).select("doc_id", "text_key", "w.pos", "w.h1", "w.h2")


def covered(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, text_key, intervals: sorted (first, last) lines to remove."""
    windows = _windows(docs, width)
    place = F.struct("doc_id", "text_key", "pos")
    repeated = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = repeated.where(~F.col("first").eqNullSafe(F.col("last")))
    # written, so that either side of the join is a plain exchange and the rows of a window that very many documents hold can be split
    repeated = common.written(repeated.select("h1", "h2", "first"), "repeated-windows")
    later = windows.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    later = later.select("doc_id", "text_key", "pos").distinct()
    by_doc = Window.partitionBy("doc_id", "text_key").orderBy("pos")
    apart = F.coalesce((F.col("pos") > F.lag("pos").over(by_doc) + width).cast("int"), F.lit(1))
    island = later.withColumn("apart", apart).withColumn("island", F.sum("apart").over(by_doc))
    spans = island.groupBy("doc_id", "text_key", "island").agg(F.min("pos").alias("a"), (F.max("pos") + width - 1).alias("b"))
    return spans.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("intervals"))


def dedup_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, source row (struct `row`), kept text, n_lines, n_removed."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("row"))
    gone = covered(whole.select("doc_id", "text"), width).select(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key"), "intervals")
    found = whole.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.xxhash64("text") == F.col("g_key")), "left")
    lines = _lines(F.col("text"))
    heads = F.concat(F.array(F.lit(0)), F.transform("intervals", lambda x: x["b"] + 1))
    ends = F.concat(F.transform("intervals", lambda x: x["a"]), F.array(F.size(lines)))
    kept = F.flatten(F.transform(F.arrays_zip(heads.alias("f"), ends.alias("t")), lambda x: F.slice(F.col("lines"), x["f"] + 1, x["t"] - x["f"])))
    removed = F.coalesce(F.aggregate("intervals", F.lit(0), lambda n, x: n + x["b"] - x["a"] + 1), F.lit(0))
    found = found.withColumn("lines", lines)
    return found.select(
        "doc_id",
        "row",
        F.when(F.col("intervals").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        removed.cast("long").alias("n_removed"),
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(common.read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


ORACLE = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, ls, unnest(range(len(ls) - 2)) AS p FROM l WHERE len(ls) >= 3),
k AS (SELECT doc_id, p, ls[p + 1] || chr(10) || ls[p + 2] || chr(10) || ls[p + 3] AS key FROM w
      WHERE trim(ls[p + 1] || ls[p + 2] || ls[p + 3], ' ') <> ''),
f AS (SELECT key, min(struct_pack(d := doc_id, p := p)) AS first FROM k GROUP BY key HAVING count(*) > 1),
later AS (SELECT k.doc_id, k.p FROM k JOIN f USING (key) WHERE NOT (k.doc_id = f.first.d AND k.p = f.first.p)),
gone AS (SELECT DISTINCT doc_id, p + unnest([0, 1, 2]) AS pos FROM later),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l),
kept AS (SELECT x.doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n
         FROM lines x ANTI JOIN gone USING (doc_id, pos) GROUP BY x.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       CAST(coalesce(len(l.ls), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(l.ls), 0) - coalesce(kept.n, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
