"""Nearest vectors from a stored index: inverted lists with product-quantised residuals.

Two levels of centroids, the second of what the first leaves, name the list of
a vector; what both leave is kept as a code of one byte for each of its
subspaces. All are fitted on a bounded sample. Every row is stored in its list,
with its code and its vector, and a search compares each query with the lists
whose centres are nearest to it: codes give approximate distances, and the best
of these are measured exactly.

How many lists a query meets (`probes`) is measured when the index is built: as
few as hold `recall` of the true neighbours of a bounded number of rows. The
number of lists follows the number of rows (`list_rows` a list). Where vectors
lie in groups a few lists are enough, however large the table is, and a query
set that grows with the table costs work in proportion to it. Directions without
any order have no such lists: then the probes are a share of all lists, and the
exact search is as good. Lists are cut into shards,
and queries that are equal are asked once, so that neither a vector that very
many rows share nor a query that very many ask gathers in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mizan.operators import search


@dataclass(frozen=True)
class Fit:
    """Parameters of an index."""

    sample: int = 1 << 15  # vectors that centroids and codes are fitted on: those with the smallest hash of their key
    list_rows: int = 256
    most_cells: int = 1 << 11  # of either level: beyond 2^22 lists their rows grow instead
    subspaces: int = 16
    codes: int = 256
    rounds: int = 8
    shard_rows: int = 4096
    recall: float = 0.95  # share of the true neighbours of some rows whose lists are probed
    asked: int = 200  # rows whose neighbours are searched exactly for that
    neighbours: int = 10


#: Candidates for each row asked for (and at least), queries that meet a shard in one task, and those that are computed at once.
CANDIDATES, LEAST_CANDIDATES, QUERY_ROWS, AT_ONCE = 4, 64, 4096, 128
#: Rows of queries with their lists that are made at once.
PROBED_ROWS = 1 << 13


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of c."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1), 0)


def nearest_of(x: np.ndarray, c: np.ndarray, step: int = 4096) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[squares(x[i : i + step], c).argmin(axis=1) for i in range(0, len(x), step)]])


def centroids(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k-means from rows of x at equal distances in order; a centre that loses all rows stays."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest_of(x, c)
        many = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[many > 0] = total[many > 0] / many[many > 0, None]
    return c


@dataclass
class Model:
    """Centroids of two levels, and a codebook for each subspace of what they leave."""

    first: np.ndarray
    second: np.ndarray
    books: np.ndarray  # subspaces x codes x dimensions of a subspace

    @property
    def size(self) -> int:
        return self.first.shape[1]

    @staticmethod
    def fitted(x: np.ndarray, cells: int, fit: Fit) -> Model:
        """x: the sample, of unit length. Dimensions that the subspaces don't divide go to the last ones as zeros."""
        first = centroids(x, cells, fit.rounds)
        left = x - first[nearest_of(x, first)]
        second = centroids(left, cells, fit.rounds)
        left -= second[nearest_of(left, second)]
        wide = Model.padded(left, fit.subspaces).reshape(len(x), fit.subspaces, -1)
        books = np.stack([Model.filled(centroids(np.ascontiguousarray(wide[:, j]), fit.codes, fit.rounds), fit.codes) for j in range(fit.subspaces)])
        return Model(first, second, books)

    @staticmethod
    def padded(x: np.ndarray, subspaces: int) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, -x.shape[1] % subspaces)))

    @staticmethod
    def filled(book: np.ndarray, codes: int) -> np.ndarray:
        return np.concatenate([book, np.repeat(book[-1:], codes - len(book), axis=0)])

    def centre(self, cell: int) -> np.ndarray:
        return self.first[cell // len(self.second)] + self.second[cell % len(self.second)]

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of every row of unit length."""
        a = nearest_of(x, self.first)
        left = x - self.first[a]
        b = nearest_of(left, self.second)
        left -= self.second[b]
        wide = self.padded(left, len(self.books)).reshape(len(x), len(self.books), -1)
        code = np.stack([nearest_of(np.ascontiguousarray(wide[:, j]), book) for j, book in enumerate(self.books)], axis=1)
        return a * len(self.second) + b, code.astype(np.uint8)

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        """The lists with the nearest centres of every query of unit length, the nearest first."""
        some = min(len(self.first), max(8, probes))
        out = np.zeros((len(q), min(probes, some * len(self.second))), np.int64)
        for i in range(len(q)):
            a = np.argsort(squares(q[i : i + 1], self.first)[0], kind="stable")[:some]
            d = squares(q[i] - self.first[a], self.second)
            best = np.argsort(d, axis=None, kind="stable")[: out.shape[1]]
            out[i] = a[best // len(self.second)] * len(self.second) + best % len(self.second)
        return out

    def approximate(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to all rows of a list, by their codes."""
        left = self.padded(q - self.centre(cell), len(self.books)).reshape(len(q), len(self.books), -1)
        out = np.zeros((len(q), len(codes)), np.float32)
        for j, book in enumerate(self.books):
            out += squares(left[:, j], book)[:, codes[:, j]]
        return out


def vectors(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), size)


def distances(e: np.ndarray, q: np.ndarray, some: np.ndarray) -> np.ndarray:
    """search.cosine_distances of each query (rows of q) to its own rows of e (rows of some)."""
    norms = [np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1]) for x in (e, q)]
    out = np.zeros(some.shape)
    for j in range(e.shape[1]):
        out += e[some, j] * q[:, j, None]
    return np.round(1 - out / (norms[0][some] * norms[1][:, None]), 12)


class VectorIndex:
    """An index in a folder: model, and rows by list."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        parts = {r["name"]: np.frombuffer(r["data"], np.float32).reshape(r["shape"]) for r in spark.read.parquet(f"{folder}/model").collect()}
        self.probes = int(parts.pop("probes", [0])[0])
        self.model = Model(**parts) if parts else None
        self.rows = spark.read.parquet(f"{folder}/rows") if parts else None

    @staticmethod
    def build(chunks: DataFrame, folder: str, fit: Fit | None = None) -> VectorIndex:
        """Index doc_id, chunk_index, category, embedding; null vectors, those without a direction and those of another length than most are left out, as exact search never finds them."""
        fit, spark = fit or Fit(), chunks.sparkSession
        rows = chunks.select("doc_id", "chunk_index", "category", F.col("embedding").cast("array<double>").alias("embedding"))
        rows = rows.where(F.exists("embedding", lambda v: v != 0) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v)))
        size, n = rows.agg(F.mode(F.size("embedding")), F.count("*")).first()
        model = spark.createDataFrame([], "name string, shape array<int>, data binary")
        if not n:
            model.write.parquet(f"{folder}/model")
            return VectorIndex(spark, folder)
        rows = rows.where(F.size("embedding") == F.lit(size))
        cells = int(np.clip(np.sqrt(n / fit.list_rows), 1, fit.most_cells))
        some = rows.select(F.xxhash64("doc_id", "chunk_index").alias("h"), "embedding").orderBy("h", "embedding").limit(fit.sample)
        # equal vectors count once, lest many centroids fall on one
        x = np.unique(unit(vectors(some.toArrow().column("embedding"), size)), axis=0)
        x = x[np.random.default_rng(11).permutation(len(x))]
        fitted = Model.fitted(x, cells, fit)

        def encode(batches):
            for batch in batches:
                if batch.num_rows:
                    cell, code = fitted.encoded(unit(vectors(batch.column("embedding"), size)))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array([c.tobytes() for c in code], pa.binary())], names=[*batch.schema.names, "cell", "code"])

        schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", cell long, code binary"
        coded = rows.mapInArrow(encode, schema)
        coded.write.parquet(f"{folder}/coded")  # encoded once, counted and dealt from there
        coded = spark.read.schema(coded.schema).parquet(f"{folder}/coded")
        kept = [("first", fitted.first), ("second", fitted.second), ("books", fitted.books), ("probes", np.array([VectorIndex._probes(coded, fitted, fit)]))]
        spark.createDataFrame([(name, list(p.shape), p.astype(np.float32).tobytes()) for name, p in kept], model.schema).coalesce(1).write.parquet(f"{folder}/model")
        counts = coded.groupBy("cell").agg(F.ceil(F.count("*") / fit.shard_rows).cast("int").alias("shards"))
        dealt = coded.join(counts, "cell").withColumn("shard", F.pmod(F.xxhash64("doc_id", "chunk_index"), F.col("shards")).cast("int")).drop("shards")
        # in ranges of lists, so that a search of few lists reads few files
        tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt.repartitionByRange(tasks, "cell", "shard", "doc_id", "chunk_index").sortWithinPartitions("cell", "shard").write.parquet(f"{folder}/rows")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/coded")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return VectorIndex(spark, folder)

    @staticmethod
    def _probes(coded: DataFrame, model: Model, fit: Fit) -> int:
        """As few lists as hold the wanted share of the true neighbours of some rows."""
        asked = coded.select(F.xxhash64("chunk_index", "doc_id").alias("query_id"), "embedding").orderBy("query_id", "embedding").limit(fit.asked)
        asked = coded.sparkSession.createDataFrame(asked.toPandas(), asked.schema)  # at most fit.asked rows
        near = search.nearest(coded, asked, fit.neighbours, search.cosine_distances).select("query_id", "doc_id", "chunk_index")
        near = coded.select("doc_id", "chunk_index", "cell").join(near, ["doc_id", "chunk_index"]).join(asked, "query_id").select("embedding", "cell").toArrow()
        q, cell = unit(vectors(near.column("embedding"), model.size)), near.column("cell").to_numpy()
        every = len(model.first) * len(model.second)
        once, which = np.unique(q, axis=0, return_inverse=True)
        place, turn = np.zeros(len(q), np.int64), np.zeros(every, np.int64)
        for i in range(len(once)):  # one order of all lists at a time
            turn[model.probed(once[i : i + 1], every)[0]] = np.arange(every)
            own = which.ravel() == i
            place[own] = turn[cell[own]]
        return int(np.sort(place)[min(len(place) - 1, int(np.ceil(fit.recall * len(place))) - 1)]) + 1

    def prober(self, probes: int):
        """A function of batches of queries (ask, q): a row for every list that a query meets, PROBED_ROWS at once."""
        model, size, most = self.model, self.model.size, PROBED_ROWS

        def probe(batches):
            for batch in batches:
                # a few queries at once: each becomes a row, with its vector, for every list that it meets
                step = max(1, most // probes)
                for begin in range(0, batch.num_rows, step):
                    part = batch.slice(begin, step)
                    lists = model.probed(unit(vectors(part.column("q"), size)), probes).ravel()
                    each = len(lists) // part.num_rows
                    for i in range(0, len(lists), most):
                        some = lists[i : i + most]
                        at = pa.array(np.arange(i, i + len(some)) // each)
                        yield pa.RecordBatch.from_arrays([*[c.take(at) for c in part.columns], pa.array(some)], names=[*batch.schema.names, "cell"])

        return probe

    def nearest(self, queries: DataFrame, fetch: int, probes: int | None = None, category: str | None = None) -> DataFrame:
        """query_id, doc_id, chunk_index, category, value as search.nearest with the cosine distance gives them, from the probed lists."""
        kind = queries.schema["query_id"].dataType.simpleString()
        if self.model is None:
            return self.spark.createDataFrame([], f"query_id {kind}, doc_id long, chunk_index long, category string, value double")
        model, size, probes = self.model, self.model.size, probes or self.probes
        asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")).where((F.size("q") == size) & F.exists("q", lambda v: v != 0))
        once = asked.groupBy("q").agg(F.min("query_id").alias("ask"))

        held = once.select("ask", "q").mapInArrow(self.prober(probes), f"ask {kind}, q array<double>, cell long")
        rows = self.rows if category is None else self.rows.where(F.col("category") == category)
        # shards of each list, and blocks of the queries of a list with very many
        shards = rows.groupBy("cell").agg((F.max("shard") + 1).alias("shards"))
        blocks = held.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
        lists = shards.join(blocks, "cell")
        left = rows.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        right = held.join(lists, "cell").withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int"))
        right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("blocks", "shards")
        kinds = [self.rows.schema[c].dataType.simpleString() for c in ("doc_id", "chunk_index", "category")]
        schema = f"ask {kind}, doc_id {kinds[0]}, chunk_index {kinds[1]}, category {kinds[2]}, value double"

        def look(own: pa.Table, asks: pa.Table) -> pa.Table:
            found, picked, values = [], [], []
            if own.num_rows and asks.num_rows:
                own = own.take(pa.array(np.lexsort((own["chunk_index"].to_numpy(), own["doc_id"].to_numpy()))))
                e, every = vectors(own["embedding"], size), vectors(asks["q"], size)
                codes = np.frombuffer(b"".join(own["code"].to_pylist()), np.uint8).reshape(len(e), -1)
                few, cell = max(LEAST_CANDIDATES, CANDIDATES * fetch), int(own["cell"][0].as_py())
                for i in range(0, len(every), AT_ONCE):
                    q = every[i : i + AT_ONCE]
                    if len(e) <= few:
                        some = np.tile(np.arange(len(e)), (len(q), 1))
                    else:  # of rows with equal codes those with the smallest keys
                        some = np.sort(np.argsort(model.approximate(unit(q), cell, codes), axis=1, kind="stable")[:, :few], axis=1)
                    d = distances(e, q, some)
                    best = np.argsort(d, axis=1, kind="stable")[:, :fetch]  # ties stay in the order of their keys
                    found.append(np.repeat(np.arange(i, i + len(q)), best.shape[1]))
                    picked.append(np.take_along_axis(some, best, axis=1).ravel())
                    values.append(np.take_along_axis(d, best, axis=1).ravel())
            at, row = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (found, picked))
            out = [asks["ask"].take(pa.array(at)), *[own[c].take(pa.array(row)) for c in ("doc_id", "chunk_index", "category")], pa.array(np.concatenate([np.zeros(0), *values]))]
            return pa.table(out, names=["ask", "doc_id", "chunk_index", "category", "value"])

        keys = ["cell", "shard", "block"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(look, schema)
        order = Window.partitionBy("ask").orderBy("value", "doc_id", "chunk_index")
        best = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= fetch).drop("at")
        each = asked.join(once, "q").select("query_id", "ask")
        return each.join(best, "ask").select("query_id", "doc_id", "chunk_index", "category", "value")
