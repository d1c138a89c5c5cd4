"""Driver tables as the relations of the document store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables of long texts: work on a row is dear, moving it is cheap.
TEXTS = ("documents", "pages")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan, dealt to all cores if its files have fewer splits than there are; larger tables are left as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def dealt(scan: DataFrame) -> DataFrame:
    """A plain scan, dealt to all cores whatever its splits are: those without the middle of a row group have no rows."""
    return scan.repartition(max(scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in TEXTS else found


#: Columns that say where a row stands in its table.
PLACE = ("file_path", "row_index")


def table_order() -> list[Column]:
    """The place of each row of a plain Parquet scan."""
    return [F.col(f"_metadata.{c}").alias(c) for c in PLACE]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as stored documents: title is the first line, category the source, method the language."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("source").alias("category"),
        F.col("lang").alias("extraction_method"),
        F.col("text").alias("markdown_content"),
        (F.lit(1.7e9) + F.col("doc_id") * 3600.0).alias("downloaded_at"),
        F.col("n_chars").alias("file_size"),
        "doc_id",
    )


#: The same relation for SQL.
DOCS = (
    "docs AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, split_part(text, chr(10), 1) AS title, source AS category, lang AS extraction_method, "
    "text AS markdown_content, 1.7e9 + doc_id * 3600.0 AS downloaded_at, n_chars AS file_size, doc_id FROM documents)"
)


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as series: value by event type and day, pos in time order."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric_id"), F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.round(F.sum("value"), 4).alias("value"))
    return e.withColumn("pos", F.row_number().over(Window.partitionBy("metric_id").orderBy("date")) - 1)


WEEKLY = (
    "series AS (SELECT metric_id, date, value, row_number() OVER (PARTITION BY metric_id ORDER BY date) - 1 AS pos FROM "
    "(SELECT event_type AS metric_id, strftime(ts, '%Y-%m-%d') AS date, round(sum(value), 4) AS value FROM events GROUP BY 1, 2))"
)
