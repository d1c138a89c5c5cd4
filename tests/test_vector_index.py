"""The vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mizan import catalogue
from mizan.operators import search, vector_index
from mizan.sources.folders import new_folder

SCHEMA = "doc_id long, chunk_index long, category string, embedding array<float>"


def grouped(rng, n, groups=40, size=24):
    """Vectors about `groups` centres."""
    centres = rng.normal(size=(groups, size))
    return (centres[rng.integers(0, groups, n)] + 0.3 * rng.normal(size=(n, size))).astype(np.float32)


def table(spark, x):
    return spark.createDataFrame([(i // 2, i % 2, str(i % 3), e if e is None else [float(v) for v in e]) for i, e in enumerate(x)], SCHEMA)


def asked(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "query_id int, embedding array<double>")


def rows(df):
    return sorted((r.query_id, r.value, r.doc_id, r.chunk_index, r.category) for r in df.collect())


def index(spark, chunks, **fit):
    return vector_index.VectorIndex.build(chunks, new_folder(spark, "index"), vector_index.Fit(**fit))


def test_all_lists_give_the_exact_result(spark):
    rng = np.random.default_rng(1)
    x = [*grouped(rng, 700), *[np.ones(24, np.float32)] * 90, None, np.zeros(24), np.full(24, np.nan), np.ones(3), np.full(24, 7.0)]
    chunks = table(spark, x)
    queries = asked(spark, [*x[:30], np.ones(24), np.ones(24), x[0], -x[1], np.ones(5), np.zeros(24)])
    built = index(spark, chunks, list_rows=20, shard_rows=16, codes=32, rounds=3)
    assert built.rows.count() == 791  # all that have a direction
    assert built.rows.agg(F.max("shard")).first()[0] > 2  # equal vectors don't gather in one shard
    every = len(built.model.first) * len(built.model.second)
    for category in (None, "1"):
        some = chunks if category is None else chunks.where(F.col("category") == category)
        assert rows(built.nearest(queries, 7, every, category)) == rows(search.nearest(some, queries, 7, search.cosine_distances))
    found = search.vector_search(None, queries, 3, index=vector_index.VectorIndex(spark, built.folder))  # opened again
    assert {(r.query_id, r.position) for r in found.where("query_id = 0").collect()} == {(0, 1), (0, 2), (0, 3)}


def test_few_lists_find_grouped_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = grouped(rng, 6000)
    chunks, queries = table(spark, x), asked(spark, x[::50])
    built = index(spark, chunks, list_rows=40)
    lists = built.rows.select("cell").distinct().count()
    assert built.probes <= 0.4 * lists
    monkeypatch.setattr(vector_index, "LEAST_CANDIDATES", 16)  # codes choose the candidates
    want = {r[:1] + r[2:4] for r in rows(search.nearest(chunks, queries, 10, search.cosine_distances))}
    got = {r[:1] + r[2:4] for r in rows(built.nearest(queries, 10))}
    assert len(want) == 1200 and len(want & got) >= 0.9 * len(want)


def test_queries_meet_their_lists_in_small_batches(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = grouped(rng, 600)
    chunks, queries = table(spark, x), asked(spark, x[::10])
    built = index(spark, chunks, list_rows=10)
    monkeypatch.setattr(vector_index, "PROBED_ROWS", 7)
    every = len(built.model.first) * len(built.model.second)
    run = built.prober(5)
    batch = queries.withColumnRenamed("query_id", "ask").withColumnRenamed("embedding", "q").toArrow().to_batches()
    made = list(run(batch))
    assert max(b.num_rows for b in made) <= 7 and sum(b.num_rows for b in made) == 5 * 60
    assert {b.num_rows for b in built.prober(every)(batch)} <= set(range(1, 8))
    assert rows(built.nearest(queries, 7, every)) == rows(search.nearest(chunks, queries, 7, search.cosine_distances))


def test_more_rows_make_more_lists_and_not_more_work_a_query(spark):
    rng = np.random.default_rng(3)
    met = []
    for n in (2000, 8000):
        built = index(spark, table(spark, grouped(rng, n, groups=n // 40)), list_rows=40)
        each = {r["cell"]: r["count"] for r in built.rows.groupBy("cell").count().collect()}
        lists = built.model.probed(vector_index.unit(grouped(rng, 50)), built.probes)
        met.append(np.mean([sum(each.get(c, 0) for c in row) for row in lists.tolist()]) / n)
    assert met[1] < 0.75 * met[0]  # a smaller share of four times the rows


def test_codes_give_the_distance_about(spark):
    rng = np.random.default_rng(4)
    x = vector_index.unit(grouped(rng, 3000))
    model = vector_index.Model.fitted(x, 4, vector_index.Fit(subspaces=7))  # 24 dimensions in 7 parts
    cell, code = model.encoded(x)
    for c in np.unique(cell)[:3].tolist():
        own = np.flatnonzero(cell == c)
        q = vector_index.unit(grouped(rng, 5))
        near = model.approximate(q, c, code[own])
        assert np.abs(near - vector_index.squares(q, x[own])).mean() < 0.1


@pytest.mark.parametrize("x", [[], [None], [np.zeros(4)]])
def test_nothing_to_index(spark, x):
    built = index(spark, table(spark, x))
    assert built.nearest(asked(spark, [np.ones(4)]), 5).collect() == []


def test_recall_on_the_driver_rows(spark):
    for size in ("0.01", "0.1"):
        found = catalogue.queries()["vector_index_recall"](spark, f"/root/testdata/sf{size}").agg(F.sum("n_found"), F.sum("n_true")).first()
        assert found[0] >= 0.9 * found[1] > 0
