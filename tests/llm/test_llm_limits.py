"""Checksums of all rows, unknown likeness, bounds, shared folders and what is left in them."""

import os
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from mizan.llm import common, fingerprints, language_id, line_dedup, packing, substring_dedup, token_output, tokens


def encoded(spark, small):
    plain = tokens.Encoder(tokens.default_path())
    rows = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    return {r.doc_id: np.array([*plain.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in rows}


def test_checksums_of_token_files(spark, small):
    want, start = [], 0
    for name, ids in encoded(spark, small).items():
        want.append((name, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_output.op5_token_output(spark, small).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def test_checksums_of_pieces(spark, small):
    want = set()
    for name, ids in encoded(spark, small).items():
        want |= {(name, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(packing.cut_points(len(ids), 2048))}
    got = packing.op9_best_fit_packing(spark, small).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_short_unrelated_texts_are_not_alike(spark):
    texts = [f"short text number {i} here" for i in range(24)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, "same words again now ok"), (101, "same words again now ok"), (102, None), (103, "")]
    got = {r.doc_id: r for r in fingerprints.with_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i].fingerprint == "" for i in range(24)) > 6
    assert all(got[i].near_next == 0 for i in range(1, 24))
    assert got[101].near_next == 1 and got[103].near_next == 1 and got[102].near_next == 0


def test_ranges_of_ids_stay_in_order(spark):
    ids = [-(2**62), -5, -5, 0, 1, 2**53, 2**53 + 1, 2**62, None]
    d = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string")
    rows = fingerprints.in_descending_order(d).collect()
    own = {}
    for r in rows:
        if not r.peek:
            own.setdefault(r.bucket, []).append(r.doc_id)
    found = [i for b in sorted(own, reverse=True) for i in own[b]]
    assert found == sorted((i for i in ids if i is not None), reverse=True) + [None]


def test_many_languages_are_bounded(spark):
    fit = language_id.Fit(per_language=5, documents=20, languages=6)
    word = lambda k: "".join(chr(97 + (k * 7 + j * (k % 5 + 1)) % 26) for j in range(6))
    rows = [(100 * k + i, " ".join([word(k)] * 8), f"l{k:02d}") for k in range(9) for i in range(20 + (k < 6))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(language_id.learning_rows(d), fit)
    many = language_id.learning_rows(d).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(6).collect()
    assert model.languages == sorted(r.lang for r in many)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    def session(master, folder=None):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda name, default: folder)))

    assert common.shared_folder(session("spark://host:7077", "hdfs://a/b/")) == "hdfs://a/b"
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match=r"spark.checkpoint.dir"):
            common.shared_folder(session(master))
    assert common.shared_folder(session("local[4]")).startswith("file://")


def test_stages_leave_only_their_result(spark):
    held = lambda: set(os.listdir(common.shared_folder(spark).removeprefix("file://")))
    before = held()
    d = spark.createDataFrame([(i, f"a\nb\nc\nline {i // 2}") for i in range(20)], "doc_id long, text string")
    out = common.settled(lambda: line_dedup.dedup_lines(d).select("doc_id", "text"), spark, "kept")
    assert len(held() - before) == 1 and out.count() == 20


def test_a_smaller_batch_limit_is_left_alone(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = spark.conf.get(name)
    try:
        spark.conf.set(name, "7")
        common.mapped(spark.range(3).toDF("a"), lambda b: b, "a long")
        assert spark.conf.get(name) == "7"
        spark.conf.set(name, "10000")
        common.mapped(spark.range(3).toDF("a"), lambda b: b, "a long")
        assert spark.conf.get(name) == str(common.BATCH_ROWS)
    finally:
        spark.conf.set(name, now)


def test_copies_with_other_words_are_not_taken(spark):
    schema = "doc_id long, text_key long, path long, source long, a long, b long, n long, digest struct<x: long>"
    rows = [(1, 0, 9, 1, 0, 60, 11, (5,)), (2, 0, 9, 1, 3, 63, 11, (5,)), (3, 0, 9, 1, 3, 63, 11, (6,)), (4, 0, 9, 1, 3, 62, 10, (5,)), (1, 0, 9, 1, 80, 140, 11, (5,))]
    found = substring_dedup.verified_copies(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in found] == [(2, 0, 3, 63)]


def test_path_digests_know_the_order(spark):
    schema = "doc_id long, text_key long, m long, id long, proof long, source long, copies long, branching boolean, start int, n int"
    rows = [(1, 0, 0, 7, 70, 1, 2, False, 0, 5), (1, 0, 0, 8, 80, 1, 2, False, 5, 5), (2, 0, 0, 8, 80, 1, 2, False, 0, 5), (2, 0, 0, 7, 70, 1, 2, False, 5, 5)]
    found = substring_dedup.paths(spark.createDataFrame(rows, schema), 50).collect()
    assert len({tuple(r.digest) for r in found}) == len({(r.path, r.n) for r in found})


def test_hot_windows_join_a_written_table(spark):
    d = spark.createDataFrame([(i, "x\ny\nz\nown " + str(i)) for i in range(50)], "doc_id long, text string")
    plan = line_dedup.covered(d)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation [h1" in plan  # the windows' first places come from a table, not from an aggregate on the exchange
