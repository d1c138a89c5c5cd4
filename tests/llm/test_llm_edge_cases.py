"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mizan.llm import decontamination, fingerprints, language_id, line_dedup, near_dedup, packing, substring_dedup, surrogates, token_output, warc

LONG = " ".join(f"w{i}" for i in range(30_000)) + "\n" + "x" * 200_000
ROWS = [
    (1, "bir iki üç dört beş altı yedi sekiz\nson satır\n\nüç", "tr", "s"),
    (2, None, "tr", None),
    (3, "", None, "s"),
    (4, LONG, "tr", "s"),
    (5, "tek", "en", "s"),
    (5, "tek", "en", "s"),
    (6, " \t\n ", "en", None),
    (None, "the name of the thing is not here", "en", "s"),
    (7, "12345 67890", "en", "s"),
    (8, "the name of the thing is not here", "en", "s"),
]
#: Names that operators use themselves, as columns of the input.
CLASHES = ["row", "lines", "intervals", "text_key", "a", "b", "n", "rank", "length", "sequence_id", "start", "spans", "bucket", "peek", "doc", "component", "turn", "key", "_", "a.b", "k_id", "k_key", "f_id", "f_key", "g_id", "g_key", "s_id", "d_id", "d_key", "c0", "c1", "own", "held", "place", "range", "rep", "cell", "part", "post", "item_id", "kept", "h1", "first"]

OPERATORS = {
    "surrogates": surrogates.with_surrogates,
    "substring": substring_dedup.dedup_substrings,
    "fingerprints": fingerprints.with_edited,
    "tokens": token_output.token_files,
    "near": near_dedup.near_duplicates,
    "language": language_id.with_language,
    "packing": packing.pack,
    "lines": line_dedup.dedup_lines,
}


def documents(spark, rows=ROWS, clash=False):
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return d.withColumns({c: F.lit(c) for c in CLASHES}) if clash else d


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    out = OPERATORS[name](documents(spark)).collect()
    per_row = [r for r in out if name != "packing" or r["piece"] == 0]
    assert sorted(str(r["doc_id"]) for r in per_row) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](documents(spark, [])).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, name):
    keep = lambda df: sorted(str(r[:2]) for r in df.drop("row").collect())
    assert keep(OPERATORS[name](documents(spark, clash=True))) == keep(OPERATORS[name](documents(spark)))


@pytest.mark.parametrize("i", range(5))
def test_stages(spark, small, i):
    stage = corpus_pipeline.STAGES[i][1]
    d = documents(spark)
    out = stage(spark, d, small)
    if i < 4:
        assert out.columns == d.columns and out.dtypes == d.dtypes
    rows = sorted(out.collect(), key=str)
    if i < 4:  # which rows stay, by doc_id
        repeated = [5] if i != 2 else []
        every = [1, 4, 5, 8, None, *repeated]
        assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, [every, [*every, 2, 3, 6, 7], [1, 2, 3, 4, 5, 6, 7, 8], [*every, 2, 3, 6, 7]][i]))
        whole = {(r[0], r[1]) for r in ROWS}
        assert {(r.doc_id, r.text) for r in rows} <= whole
    else:
        assert {r.doc_id for r in rows} == {r[0] for r in ROWS}
        assert {(r.piece, r.length) for r in rows if r.doc_id in (2, 3)} == {(0, 1)}
    assert stage(spark, documents(spark, []), small).count() == 0
    clashing = stage(spark, documents(spark, clash=True), small)
    if i < 4:
        assert clashing.columns == [*d.columns, *CLASHES]
        assert all(r[c] == c for r in clashing.limit(1).collect() for c in CLASHES)
        clashing = clashing.select(*d.columns)
    assert sorted(clashing.collect(), key=str) == rows


def test_decontamination_of_odd_rows(spark):
    item = "the name of the thing is not here"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "kısa"), (1, item)], "item_id long, text string")
    out = decontamination.leaks(documents(spark, clash=True), bench).collect()
    assert sorted((str(r.doc_id), r.item_id, r.score) for r in out) == [("8", 1, 1.0)] * 2 + [("None", 1, 1.0)] * 2
    assert decontamination.leaks(documents(spark, []), bench).count() == 0
    assert decontamination.leaks(documents(spark), bench.limit(0)).count() == 0


def test_archives_of_odd_rows(spark, tmp_path):
    rows = [(1, "http://a", "x"), (2, None, "x"), (2, None, "x"), (1, "http://a", "x"), (None, "u\r\nv", "x"), (3, "", None), (4, "h", ""), (None, None, "only"), (5, "l", "ü" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("path", "n", "payload_key", "first_id")})
    out = warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/w")).collect()
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in out)
    assert got == sorted(
        [("1", 1, "response", None)] * 2 + [("2", 1, "revisit", 1)] * 2 + [("None", 1, "revisit", 1), ("3", 0, "response", None), ("4", 0, "revisit", 3), ("None", 4, "response", None), ("5", 600_000, "response", None)]
    )
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_defined_results(spark):
    near = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(documents(spark)).collect()}
    assert {(2, 0, 2, True), (3, 0, 3, True), (6, 0, 6, True), (5, 1, 5, True), (None, 4, None, False), (8, 4, 8, True)} <= near
    lang = {r.doc_id: (r.lang_pred, r.score) for r in language_id.with_language(documents(spark)).collect()}
    assert lang[2] == lang[3] == lang[6] == lang[7] == ("und", 0.0)
    lines = {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(documents(spark)).collect()}
    assert {(2, None, 0, 0), (3, "", 1, 0), (5, "tek", 1, 0)} <= lines
    words = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(documents(spark)).collect()}
    assert {(2, 0, 0, hashlib.sha256(b"").hexdigest()), (4, 30_001, 0, hashlib.sha256(LONG.replace("\n", " ").encode()).hexdigest())} <= words
    ids = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in token_output.token_files(documents(spark)).collect()}
    assert {(2, 1, zlib.crc32(bytes(4))), (3, 1, zlib.crc32(bytes(4)))} <= ids
    marks = {r.doc_id: (r.n_chars, r.fingerprint) for r in fingerprints.with_edited(documents(spark)).collect()}
    assert marks[2] == marks[3] == (0, "") and marks[4][0] == len(LONG)
