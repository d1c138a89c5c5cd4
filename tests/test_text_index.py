"""The stored full-text index against ranking of whole token arrays."""

import random

import pytest
from pyspark.sql import functions as F

from mizan.operators import search, text_index
from mizan.operators.text_index import TextIndex
from mizan.sources.folders import new_folder
from mizan.streaming import jobs

SCHEMA = "key int, category string, tokens array<string>"
ASKED = [(0, "a"), (1, "a b"), (2, "c b a"), (3, "zz"), (4, "rare a"), (5, "d"), (6, "d a b c")]


def documents(rng, keys):
    return [(k, rng.choice("xy"), [rng.choice("abcd" + "efgh" * rng.randrange(0, 12)) for _ in range(rng.randrange(0, 60))] + ["rare"] * (k % 97 == 0)) for k in keys]


def rows(df):
    return sorted((r.query_id, r.key, round(r["rank"], 9), r.position) for r in df.collect())


def expected(spark, docs, queries, **options):
    return rows(search.fts(spark.createDataFrame(docs, SCHEMA), queries, "key", **options))


@pytest.mark.parametrize("block", [8, 1024])
def test_ranks_are_those_of_the_token_arrays(spark, monkeypatch, block):
    monkeypatch.setattr(text_index, "BLOCK_DOCS", block)
    monkeypatch.setattr(text_index, "FIRST_BLOCKS", 2)
    rng = random.Random(3)
    queries = spark.createDataFrame(ASKED, "query_id int, query string")
    first, second = documents(rng, range(150)), documents(rng, range(100, 220))
    index = TextIndex(spark, new_folder(spark, "text"))
    assert index.search(queries).collect() == []
    index.add(spark.createDataFrame(first, SCHEMA))
    assert rows(index.search(queries, limit=5)) == expected(spark, first, queries, limit=5)
    index.add(spark.createDataFrame(second, SCHEMA))  # new texts of 50 documents, and 70 new ones
    docs = {d[0]: d for d in first} | {d[0]: d for d in second}
    for options in ({"limit": 5}, {"limit": 1000, "threshold": None}, {"category": "x", "limit": 3}):
        assert rows(index.search(queries, **options)) == expected(spark, list(docs.values()), queries, **options)
    index.remove(spark.createDataFrame([(k,) for k in range(0, 220, 3)], "key int"))
    docs = {k: d for k, d in docs.items() if k % 3}
    want = expected(spark, list(docs.values()), queries, limit=7)
    assert rows(index.search(queries, limit=7)) == want
    index.compact()
    assert len(index.segments(index.store.state())) == 1 and rows(index.search(queries, limit=7)) == want
    opened = TextIndex(spark, index.store.folder)
    assert rows(opened.search(queries, limit=7)) == want


def test_bounds_hold_and_blocks_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_DOCS", 4)
    rng = random.Random(4)
    docs = documents(rng, range(200)) + [(1000 + i, "x", ["a", "b"] * 300) for i in range(3)]
    index = TextIndex(spark, new_folder(spark, "text"))
    index.add(spark.createDataFrame(docs, SCHEMA))
    queries = spark.createDataFrame([(1, "a b"), (2, "c b a")], "query_id int, query string")
    terms = search.query_terms(queries)
    own = terms.groupBy("query_id").agg(F.count("*").alias("need"))
    state = index.store.state()
    blocks = index.blocks(index._rows(state, index.segments(state)), terms, own)
    ranks = search.fts(spark.createDataFrame(docs, SCHEMA), queries, "key", limit=1000, threshold=None)
    n = blocks.agg(F.max("block")).first()[0] + 1
    of = ranks.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(-(-len(docs) // 4))).cast("int"))
    both = of.join(blocks, ["query_id", "block"], "left")
    assert both.where("bound IS NULL OR rank > bound + 1e-9").count() == 0 and n > 20
    low = blocks.where("query_id = 1 AND bound < 1").count()
    assert low > 10  # can't reach the rank of the three long ones, and aren't read for three results
    assert [r[1] for r in rows(index.search(queries.where("query_id = 1"), limit=3))] == [1000, 1001, 1002]


def test_only_asked_terms_are_scanned(spark):
    index = TextIndex(spark, new_folder(spark, "text"))
    index.add(spark.createDataFrame(documents(random.Random(5), range(50)), SCHEMA))
    found = index.search(spark.createDataFrame([(0, "a b")], "query_id int, query string"))
    plan = found._jdf.queryExecution().toString()
    assert "In(term, [" in plan or ("EqualTo(term" in plan)
    assert not any(x in plan for x in ("BroadcastNestedLoopJoin", "CartesianProduct"))


def test_the_index_follows_the_stream(spark, tmp_path):
    schema = "document_id string, title string, category string, markdown_content string"
    folder, source, check = (str(tmp_path / x) for x in ("store", "in", "ck"))
    queries = spark.createDataFrame([(0, "yeni"), (1, "eski metin")], "query_id int, query string")
    for content in ("eski metin", "yeni metin"):
        spark.createDataFrame([("a", "t", "c", content), ("b", "t", "c", "eski metin")], schema).coalesce(1).write.mode("append").parquet(source)
        assert jobs.ingest(spark.readStream.schema(schema).parquet(source), folder, check, 1.0, full_text=True).awaitTermination(180)
    found = {(r.query_id, r.key) for r in TextIndex(spark, folder).search(queries).collect()}
    assert found == {(0, "a"), (1, "b")}


def test_documents_are_inverted_in_their_blocks(spark):
    docs = [(1, None, ["b", "a", "b", None]), (2, "x", ["a"]), (3, "x", None), (4, "y", []), (None, "x", ["a"])]
    made = text_index.postings(spark.createDataFrame(docs, SCHEMA), 1)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # documents, and no postings
    assert [(r.term, r.block, r.most, [(h.key, h.category, h.positions) for h in r.hits]) for r in made.collect()] == [("a", 0, 1, [(1, None, [1]), (2, "x", [0])]), ("b", 0, 2, [(1, None, [0, 2])])]
