"""Text functions: pinned behaviour and round trips."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mizan.functions import text
from mizan.functions.text import SUFFIXES
from mizan.operators import store


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_stem(spark):
    for word, stem in (("bankalar", "banka"), ("alar", "alar"), ("kredinin", "kred"), ("", "")):
        assert one(spark, word, text.stem_tr) == stem


def test_stem_strips_the_first_listed_suffix(spark):
    words = [a + b for a in ("kan", "ka", "mevzuat", "faiz") for b in SUFFIXES]

    def written_out(word):
        for s in SUFFIXES:
            if word.endswith(s) and len(word) - len(s) >= 3:
                return word[: -len(s)]
        return word

    found = spark.createDataFrame([(w,) for w in words], "x string").select("x", text.stem_tr(F.col("x")).alias("y")).collect()
    assert [(r.x, r.y) for r in found if r.y != written_out(r.x)] == []


def test_chunks_of_a_long_text(spark):
    cut = one(spark, "a" * 1500, text.chunks)
    assert [len(c) for c in cut] == [1000, 700]
    assert one(spark, "", text.chunks) == [] and one(spark, " \n", text.chunks) == []
    assert one(spark, "x" * 1000 + " " * 2000, text.chunks)[0] == "x" * 1000
    assert one(spark, None, text.chunks) == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Z", "Cc")), min_size=1, max_size=4000), min_size=1, max_size=4))
def test_chunks_put_together_are_the_text(spark, texts):
    docs = spark.createDataFrame([(str(i), "c", t) for i, t in enumerate(texts)], "document_id string, category string, markdown_content string")
    found = {r.document_id: r.content for r in store.rebuilt(store.chunk_table(docs)).collect()}
    assert found == {str(i): t for i, t in enumerate(texts)}


def test_pages(spark):
    d = spark.createDataFrame([("a" * 12000,), ("",)], "x string")
    assert [r[0] for r in d.select(text.page_count(F.col("x"))).collect()] == [3, 1]
    assert "Invalid page 9" in d.select(text.page(F.col("x"), 9)).first()[0]


def test_sanitize_keeps_other_controls(spark):
    assert one(spark, "a\x00\x0cĐ\x07", text.sanitize) == "aİ\x07"
    assert one(spark, None, text.sanitize) is None and one(spark, "", text.sanitize) == ""


def test_decode(spark):
    rows = [("çğ".encode(),), ("ığ".encode("iso-8859-9"),), (b"a\x96b",)]
    found = spark.createDataFrame(rows, "x binary").select(text.decode_bytes(F.col("x"))).collect()
    assert [r[0] for r in found] == ["çğ", "ığ", "a–b"]


def test_dates(spark):
    assert str(one(spark, "1.3.2024", text.parse_date)) == "2024-03-01"
    assert one(spark, "31.02.2024", text.parse_date) is None and one(spark, None, text.parse_date) is None


def test_emphasis(spark):
    cases = {"** a** b": "**a** b", "**a **b": "**a** b", "**a** **b**": "**a b**", "x **a****b** y": "x **ab** y", "a ** b": "a ** b", "**a** ** ** b": "**a** b", "  düz   metin ": "düz metin"}
    d = spark.createDataFrame(list(cases.items()), "x string, want string").select("x", "want", text.fix_emphasis(F.col("x")).alias("got")).collect()
    assert [(r.x, r.got) for r in d if r.got != r.want] == []
