"""Maintenance jobs, legacy files and extraction choice."""

import json

from pyspark.sql import functions as F

from mizan.functions import text
from mizan.operators import evaluation, extraction, series, store
from mizan.plans import maintenance
from mizan.sources import seeds, snapshots


def test_stale_catalog_only_without_fresh_rows(spark):
    fresh = spark.createDataFrame([("a",)], "document_id string")
    old = spark.createDataFrame([("b",)], "document_id string")
    assert maintenance.with_stale_fallback(fresh, old).collect() == [("a",)]
    assert maintenance.with_stale_fallback(fresh.limit(0), old).collect() == [("b",)]


def test_legacy_cache_and_arrays(spark, tmp_path):
    (tmp_path / "cache.json").write_text(json.dumps({"timestamp": 5.0, "items": [{"document_id": "1", "title": "t"}, {"document_id": "2"}]}))
    rows = seeds.legacy_cache(spark, str(tmp_path / "cache.json")).orderBy("document_id").collect()
    assert [(r.document_id, r.title, r.cached_at) for r in rows] == [("1", "t", 5.0), ("2", None, 5.0)]
    pairs = [{"id": 1, "premise": "p", "hypothesis": "h", "label": "neutral", "source": "s"}]
    (tmp_path / "pairs.json").write_text(json.dumps(pairs))
    assert [r.asDict() for r in seeds.read_array(spark, str(tmp_path / "pairs.json"), seeds.NLI).collect()] == pairs


def test_rescue_keeps_failures(spark):
    def fetch(name):
        if name == "b":
            raise ValueError("404")
        return "" if name == "c" else "ok"

    d = spark.createDataFrame([("a",), ("b",), ("c",)], "document_id string")
    got = {r.document_id: (r.ok, r.reason) for r in maintenance.rescue(d, fetch, 0).collect()}
    assert got == {"a": (True, None), "b": (False, "ValueError: 404"), "c": (False, "empty")}


def test_start_up_skips_after_the_timeout():
    now = iter([0, 0, 1, 400, 401])

    def bad():
        raise RuntimeError("x")

    steps = [("one", lambda: None), ("two", bad), ("three", lambda: None)]
    assert maintenance.start_up(steps, 300, lambda: next(now)) == [("one", "done"), ("two", "failed: x"), ("three", "skipped")]


def test_embeddings_fill_only_gaps(spark):
    c = spark.createDataFrame([("a", "x y", [1.0, 0.0]), ("b", "x", None)], "document_id string, chunk_text string, embedding array<float>")
    got = {r.document_id: r.embedding for r in maintenance.with_embeddings(c, maintenance.embedder(lambda t: [[float(len(x)), 0.0] for x in t])).collect()}
    assert got == {"a": [1.0, 0.0], "b": [10.0, 0.0]}


def test_stand_in_embeddings_have_unit_length():
    # w0 and w179 have one place and opposite signs
    for v in maintenance.hashed_embedding(["w0 w179", "", "w0", "w0 w0 w1"]):
        assert abs(sum(x * x for x in v) - 1) < 1e-9


def test_html_first_takes_the_frame(spark):
    pdf = b"%PDF-" + b"x" * 600
    rows = [("a", 0, "iframe", 200, b"y" * 300), ("a", 0, "generate_pdf", 200, pdf)]
    d = spark.createDataFrame(rows, "document_id string, type_rank int, layer string, status int, content binary")
    assert extraction.choose_download(d, prefer_html=True).first().layer == "iframe"
    assert extraction.choose_download(d).first().layer == "generate_pdf"


def test_patches_are_checked(spark):
    d = spark.createDataFrame([("a", "c", "eski", "h")], "document_id string, category string, markdown_content string, content_hash string")
    chunks = spark.createDataFrame([("a", "c", "h", 1, 0, "eski")], "document_id string, category string, content_hash string, total_chunks int, chunk_index int, chunk_text string")
    patches = spark.createDataFrame([("a", "x\n---\nyeni"), ("b", "yok")], "document_id string, content string")
    docs, cut, rejected = maintenance.patched(d, chunks, patches)
    assert docs.first().markdown_content == "yeni" and [r.chunk_text for r in cut.collect()] == ["yeni"]
    assert [(r.document_id, r.issues) for r in rejected.collect()] == [("b", ["unknown document"])]


def test_periods():
    assert series.PERIODS == {"day": 1, "week": 7, "month": 30, "quarter": 90}


def test_a_scan_falls_back_only_after_failures(spark):
    row = "document_id string, title string, category string"
    flat = spark.createDataFrame([("1", "Bir", "c"), ("2", "Eski bir", "c")], row)
    dated = spark.createDataFrame([("3", "Üç", "d", "1.1.2024")], row + ", decision_date string")
    stale, failed = spark.createDataFrame([("9", "Dokuz", "c")], row), spark.createDataFrame([(49, "HTTPError")], "page_id int, error string")
    run = lambda found, errors: sorted(r.document_id for r in maintenance.scanned(found, errors, stale, ("x",), ("eski",)).collect())
    assert run([flat, dated], failed) == ["1", "3"]
    assert run([flat.limit(0), dated.limit(0)], failed) == ["9"] and run([flat.limit(0), dated.limit(0)], failed.limit(0)) == []


def test_coverage_from_nine_tenths(spark):
    got = [maintenance.covers(spark.range(n), spark.range(10)).first().complete for n in (8, 9, 10)]
    assert got == [False, True, True]


def test_patches_of_a_store_in_parts(spark, tmp_path):
    folder = str(tmp_path)
    docs = spark.createDataFrame([(str(i), "c", f"metin {i}") for i in range(6)], "document_id string, category string, markdown_content string").withColumn("content_hash", text.content_hash(F.col("markdown_content")))
    parts = tuple(range(snapshots.PARTS))
    rows = {"documents": docs, "chunks": store.chunk_table(docs)}
    snapshots.Store(spark, folder).update(lambda _: {t: snapshots.Change(d, "document_id", parts) for t, d in rows.items()})
    patches = spark.createDataFrame([("1", "yeni"), ("2", "$$ açık"), ("77", "kim")], "document_id string, content string")
    for dry in (True, False):
        assert sorted(r.document_id for r in maintenance.patch_store(spark, folder, patches, dry).collect()) == ["2", "77"]
        held = {r.document_id: r.markdown_content for r in snapshots.current(spark, f"{folder}/documents").collect()}
        assert held == {str(i): f"metin {i}" for i in range(6)} | ({} if dry else {"1": "yeni"})
    assert {r.document_id: r.chunk_text for r in snapshots.current(spark, f"{folder}/chunks").collect()} == held


def test_arrays_are_written_as_they_are_read(spark, tmp_path):
    rows = [(2, "p", "h", "neutral", "s"), (1, "ç", "h", "entailment", "s")]
    seeds.write_array(spark.createDataFrame(rows, seeds.NLI), str(tmp_path / "a"))
    assert sorted(tuple(r) for r in seeds.read_array(spark, str(tmp_path / "a"), seeds.NLI).collect()) == sorted(rows)


def test_prompt_variants(spark):
    def chat(prompt):
        if "boz" in prompt:
            raise ValueError("yok")
        return "neutral" if prompt.startswith("A") else "contradiction"

    cases = spark.createDataFrame([("x", "neutral"), ("boz", "neutral"), ("y", "contradiction")], "text string, expected string")
    variants = spark.createDataFrame([("a", "A: {}"), ("b", "B: {}")], "variant string, template string")
    got = {r.variant: (r.cases, r.answers, r.accuracy) for r in evaluation.variant_scores(cases, variants, evaluation.chat_slot(chat)).collect()}
    assert got == {"a": (3, 2, 0.3333), "b": (3, 2, 0.3333)}
