"""Corpus pipeline: from documents to packed training sequences.

Each stage takes what the one before kept, written as Parquet and read again.
All but the last return the columns of documents, whatever those are named.

Defined results of all stages: an empty table gives no rows; repeated rows are
treated each like the others (near_duplicates keeps one of them); very long
texts are whole; columns other than doc_id, text and lang pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm import common, decontamination, language_id, line_dedup, near_dedup, packing

#: Documents whose best language is less probable than this are rejected.
LEAST_SCORE = 0.3
#: Documents whose five-word shingle sets are at least so alike, in percent, are near copies.
SIMILARITY = 80

#: Language identification, alignment and packing are beyond SQL.
ORACLE_SQL = None


def held(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row but for its text (struct `held`, fields by position): no other name can clash."""
    fields = [docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), F.struct(*fields).alias("held"))


def restored(rows: DataFrame, columns: list[str], source: str = "held", **changed) -> DataFrame:
    """The columns that held() put away, but for those that are given anew, and the text."""
    text = {"text": F.col("text")}
    return rows.select(*[(changed | text).get(c, F.col(f"{source}.c{i}")).alias(c) for i, c in enumerate(columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or a likely language go, so those with null or empty text too.

    A null doc_id or lang is no ground for rejection.
    """
    rows = held(docs).withColumn("lang", F.col(f"held.c{docs.columns.index('lang')}"))
    found = language_id.with_language(rows, ["held"])
    found = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return restored(found, docs.columns, "row.held")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go, and documents of which nothing is left.

    Null texts and empty ones stay as they are; n_chars follows the text. Rows
    with equal doc_id and text are one document given twice.
    """
    found = line_dedup.dedup_lines(held(docs)).where("n_removed < n_lines OR n_lines = 0")
    return restored(found, docs.columns, "row.held", n_chars=F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id.

    Rows that repeat a document are one. Documents are told apart by doc_id and
    text; those without a doc_id are compared like others and come after them.
    Null and wordless texts are no copies of each other and stay.
    """
    rows = held(docs).withColumn("d_key", F.xxhash64("text")).dropDuplicates(["doc_id", "d_key"])
    rows = rows.orderBy(F.col("doc_id").asc_nulls_last(), "d_key")
    rows = common.written(rows.select(F.monotonically_increasing_id().alias("own"), "text", "held"), "documents")
    kept = near_dedup.near_duplicates(rows.select(F.col("own").alias("doc_id"), "text"), percent=SIMILARITY).where("kept")
    return restored(rows.join(kept.select(F.col("doc_id").alias("own")), "own"), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go.

    Those without a doc_id are searched too; null and wordless texts stay.
    """
    rows = held(docs)
    found = decontamination.leaks(rows, common.read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("f_id"), F.col("text_key").alias("f_key")).distinct()
    found = common.written(found, "leaks")
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.xxhash64("text") == F.col("f_key"))
    return restored(rows.join(found, same, "left_anti"), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences.

    Null and empty texts are one piece, the end id alone; a null doc_id stays null.
    """
    found = packing.pack(docs)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's own tables are removed when its result is written."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spark, name)
    return STAGES[-1][1](spark, docs, sf_dir)
