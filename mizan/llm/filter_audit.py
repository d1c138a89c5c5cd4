"""Interaction of document filters (operator 11), DataFrame functions only.

Every document gets a mask with one bit for each filter that it fails. The
conditions on a text alone are native expressions in the scan; that a text
repeats a smaller doc_id's is found by grouping the texts, which gives the
smallest doc_id of each. Texts are grouped by their SHA-256, so that no text is
shuffled. Rows of one text are first added up by part, mask and label, so that
a text that very many documents have is a few rows; these are then added up to
the 2^k cells (masks) of each part, and what each filter of each order removes
is read from the cells: no order looks at the documents again.

Shapley values need no orders either: a document that fails j filters is
removed by each of them in 1/j of all orders.

Defined results: null text is empty; a null source is the part ''; a null
doc_id is larger and smaller than none, so it never fails the test of copies
and makes no other fail; repeated rows count each, and rows with the text's
smallest doc_id all pass; labels that repeat a doc_id count as one, which has
quality (or toxic) 1 if any has; documents without labels are neither good nor
toxic; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mizan.llm import common

#: More filters than this would give too many orders to list.
MOST_FILTERS = 7


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _capitals(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))


#: By letter, from the text and its words to whether the text fails.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long"),
    "C": lambda text, words: 100 * _capitals(text).cast("long") > 5 * F.length(text).cast("long"),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
#: The letter of the filter that no text but the first of its copies passes.
COPY = "E"


def masked(docs: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """doc_id, part, copy (the text's SHA-256) and mask, without the bit of copies."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", _words(F.col("text")))
    mask = F.lit(0)
    for i, fails in enumerate((filters or FILTERS).values()):
        mask = mask + F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0)
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("copy"), mask.alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct rows of masked() with their number n, good and toxic (0 or 1)."""
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"), labels["toxic"].cast("int").alias("toxic"))
    marks = marks.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # written, so that either side of the join is a plain exchange and a repeated id's rows can be split
    marks = common.written(marks.withColumn("salt", F.lit(0).cast("long")), "labels")
    rows = rows.groupBy("doc_id", "part", "copy", "mask").agg(F.count("*").alias("n"))
    # rows without an id match nothing; dealt by their texts they don't meet in one task
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("copy")).otherwise(0))
    bit = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c)
    return rows.join(marks, ["doc_id", "salt"], "left").select("doc_id", "part", "copy", "mask", "n", bit("good"), bit("toxic"))


def cells(rows: DataFrame, copy_bit: int) -> DataFrame:
    """Documents n, good and toxic of each part and mask, the bit of copies included."""
    nulls = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    held = rows.groupBy("copy", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), nulls.alias("nulls"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first")
    )
    # a few rows for each part that has the text, however many documents it is in
    least = F.min("first").over(Window.partitionBy("copy"))
    kept = F.col("nulls") + F.when(F.col("first") == least, F.col("n_first")).otherwise(0)
    held = held.withColumn("kept", kept)
    both = F.explode(F.array(F.struct("mask", F.col("kept").alias("n")), F.struct((F.col("mask") + copy_bit).alias("mask"), (F.col("n") - F.col("kept")).alias("n"))))
    dealt = held.select("part", "good", "toxic", both.alias("c")).where("c.n > 0")
    n = F.col("c.n")
    return dealt.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def orders(found: DataFrame, letters: str) -> DataFrame:
    """Every order and step of each part, from its cells: at most 2^k rows a part meet each of its orders' steps."""
    every = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = found.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    bits = F.array(*[F.lit(1 << i) for i in range(len(letters))])
    bit = lambda at: F.element_at(bits, F.instr(F.lit(letters), F.substring("filter_order", at, F.lit(1))))
    before = sum((F.when(F.col("step") > i, bit(F.lit(i))).otherwise(0) for i in range(1, len(letters))), F.lit(0))
    steps = steps.withColumn("own", bit(F.col("step"))).withColumn("before", before)
    mask, own, ways = F.col("mask"), F.col("own"), factorial(len(letters))
    fails, gone = mask.bitwiseAND(own) != 0, mask.bitwiseAND(F.col("before")) != 0
    total = lambda what, holds, name: F.sum(F.when(holds, what).otherwise(0)).alias(name)
    return steps.groupBy("part", "filter_order", "step").agg(
        total(F.col("n"), ~fails & ~gone, "kept"),
        total(F.col("n"), fails & ~gone, "removed"),
        total(F.col("n"), fails & gone, "redundant"),
        total(F.col("n"), mask == own, "unique_fails"),
        total(F.col("good"), fails & ~gone, "good_lost"),
        total(F.col("toxic"), fails & ~gone, "toxic_lost"),
        # the number of orders is a multiple of every number of filters
        total(F.col("n") * (F.lit(ways) / F.bit_count(mask)).cast("long"), fails, "shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] | None = None, copy: str = COPY) -> DataFrame:
    """Per part, order of the filters and step: what that step keeps and removes.

    filters: conditions on the text and its words, by letter; the test of copies
    is one more filter, with the letter `copy`.
    """
    filters = filters or FILTERS
    letters = "".join([*filters, copy])
    if len(letters) != len(filters) + 1 or len(set(letters)) != len(letters) or len(letters) > MOST_FILTERS:
        raise ValueError(f"filters need different names of one letter, and may be {MOST_FILTERS} at most with that of copies")
    return orders(cells(labelled(masked(docs, filters), labels), 1 << len(filters)), letters)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS mask
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS xs, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT array_to_string(xs, '') AS filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, own,
             coalesce(sum(n) FILTER (mask & (own + before) = 0), 0) AS kept,
             coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS removed,
             coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0) AS redundant,
             coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
             coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""
