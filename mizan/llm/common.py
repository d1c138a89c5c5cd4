"""Shared folder, written tables and component search used by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.sources import tables

_own_folder: str | None = None


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table; texts of fewer splits than cores are dealt anew."""
    return tables.read(spark, sf_dir, name)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Without that setting a session whose driver and executors are one process
    gets a temporary folder; on a cluster it is an error, as each machine would
    write to a folder of its own.
    """
    global _own_folder
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="corpus-")
    return _own_folder


#: Folders made inside each open `scratch`.
_scratch: list[list[str]] = []


def new_folder(spark: SparkSession, what: str) -> str:
    found = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(found)
    return found


def remove(spark: SparkSession, *folders: str) -> None:
    """Delete folders of the shared folder; those that aren't there are passed over."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def size(spark: SparkSession, folder: str) -> int:
    """Bytes of all files in a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


@contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, all folders made within but those taken out of the list that it yields.

    What was made from them must be written by then.
    """
    _scratch.append([])
    try:
        yield _scratch[-1]
    finally:
        remove(spark, *_scratch.pop())


def settled(df_of, spark: SparkSession, what: str) -> DataFrame:
    """The rows of df_of() as a written table, without the tables made on the way there."""
    with scratch(spark) as made:
        found = written(df_of(), what)
        kept = made.pop()  # the table just written
    if _scratch:
        _scratch[-1].append(kept)
    return found


#: Rows and bytes of an Arrow batch between Spark and a worker; texts can be long.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow in small batches: the default of 10,000 rows of text takes hundreds of MB on either side.

    The limits are settings of the session, read when the plan runs; they stay set.
    Smaller limits that the session has already are left alone.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}") or ""
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df.mapInArrow(run, schema)


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder; cuts the lineage."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, for tasks that write or read plain files."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_file(uri: str, data: bytes) -> None:
    """Write a whole file under a name that no other attempt uses."""
    fs, path = store(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(data)


def read_file(uri: str) -> bytes:
    fs, path = store(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def are_stars(links: DataFrame) -> bool:
    """Whether every a has one link, and no b is an a."""
    each = links.groupBy("a").agg(F.count("*").alias("n"))
    heads = links.select(F.col("b").alias("a")).distinct().withColumn("head", F.lit(True))
    return each.join(heads, "a", "left").where("n > 1 OR head").isEmpty()


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b).

    Component is the smallest node reachable. Alternates large-star and
    small-star steps, each a grouped minimum and a join on the node, until every
    node has one link, to a node without any; the number of steps grows with the logarithm of
    the largest component. Each step is a table in the shared folder, so a lost
    executor costs at most one step, and no task gathers a component.
    """
    a, b = F.col("a"), F.col("b")
    links = edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    spark = edges.sparkSession

    def step(links: DataFrame) -> DataFrame:
        both = links.union(links.select(b.alias("a"), a.alias("b")))
        # written, so that either side of the join is a plain exchange and a hot node's rows can be split
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), what)
        large = both.join(low, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b"))
        large = written(large.where(a != b).distinct(), what)
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), what)
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.select(b.alias("a"), F.col("m").alias("b")))
        return small.where(a != b).distinct()

    links = written(links, what)
    while not are_stars(links):
        links = settled(lambda links=links: step(links), spark, what)
    roots = links.select(b.alias("a"), b.alias("b")).distinct()
    return links.union(roots).select(a.alias("node"), b.alias("component"))
