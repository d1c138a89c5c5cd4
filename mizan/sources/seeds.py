"""JSON seeds of the store, reports, and legacy caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType()}


def _schema(fields: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in fields.split(", "))])


DOCUMENTS = _schema(
    "document_id string, title string, category string, decision_date string, decision_number string, source_url string, markdown_content string, content_hash string, "
    "downloaded_at double, extracted_at double, extraction_method string, total_pages int, file_size int"
)
CATALOG = _schema("document_id string, title string, content string, decision_date string, decision_number string, category string, source_url string, cached_at double")
CHUNKS = _schema("document_id string, chunk_index int, total_chunks int, content_hash string, chunk_text string")
NLI = _schema("id int, premise string, hypothesis string, label string, source string")
#: Columns that seeds leave out.
HEAVY = ("pdf_blob", "embedding", "tokens")


def export_seed(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as JSON lines, without blobs and vectors."""
    for name, df in tables.items():
        df.drop(*HEAVY).write.mode("overwrite").json(f"{folder}/{name}")


def import_seed(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(f"{folder}/{name}")


def read_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that holds one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_array(rows: DataFrame, path: str) -> None:
    """Rows as one JSON array, in the file that read_array reads; for data sets that a person keeps, a few MB."""
    line = F.to_json(F.struct(*rows.columns))
    text = rows.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(line)), ",\n"), F.lit("]")).alias("value"))
    text.coalesce(1).write.mode("overwrite").text(path)


def legacy_cache(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an old cache file: an object with items and the time of their scan."""
    item = T.StructType([f for f in CATALOG if f.name != "cached_at"])
    schema = T.StructType([T.StructField("timestamp", T.DoubleType()), T.StructField("items", T.ArrayType(item))])
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.explode("items").alias("i"), F.col("timestamp").alias("cached_at")).select("i.*", "cached_at")


def comparison_report(rows: DataFrame, folder: str) -> None:
    """Rows as CSV with a header, and as a markdown table, one line a row."""
    rows.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |"))
    rows.select(line.alias("value")).write.mode("overwrite").text(f"{folder}/markdown")
