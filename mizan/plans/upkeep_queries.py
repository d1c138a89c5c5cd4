"""Extraction, report and maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mizan.functions import text
from mizan.operators import extraction, reports, store
from mizan.plans import maintenance
from mizan.plans.registry import query
from mizan.plans.store_queries import _FAILURES, CHUNKS, _failures
from mizan.plans.text_queries import ANOMALIES, drops_sql, markers_sql
from mizan.sources.tables import DOCS, documents, read

def _labelled(spark, sf_dir, where="true"):
    return read(spark, sf_dir, "labels").where(where).select(F.col("doc_id").cast("string").alias("document_id"))


def _unlabelled_chunks(spark, sf_dir, docs):
    """Chunks of a store that misses the labelled documents."""
    return store.chunk_table(docs).join(_labelled(spark, sf_dir), "document_id", "left_anti")


_PDF = b"%PDF-" + b"x" * 600


@query(f"WITH {DOCS} SELECT * FROM (VALUES ('a', 0, 'pdf'), ('b', 1, 'generate_pdf'), ('c', 0, 'doc'), ('d', 0, 'htm')) t(document_id, type_rank, layer) UNION ALL SELECT document_id, 0, CASE WHEN strlen(markdown_content) > 200 THEN 'htm' ELSE 'div' END FROM docs WHERE strlen(markdown_content) > 100")
def download_selection(spark, sf_dir):
    rows = [
        ("a", 0, "generate_pdf", 200, b"<html>" + b"x" * 900), ("a", 0, "pdf", 200, _PDF), ("a", 1, "generate_pdf", 200, _PDF), ("a", 0, "doc", 200, b"PK\x03\x04" + b"x" * 200),
        ("b", 0, "pdf", 404, _PDF), ("b", 0, "htm", 200, "404 - Sayfa Bulunamadı".encode() * 20), ("b", 1, "generate_pdf", 200, _PDF),
        ("c", 0, "pdf", 200, b"%PDF-kisa"), ("c", 0, "doc", 200, b"\xd0\xcf\x11\xe0" + b"x" * 200), ("d", 0, "htm", 200, b"<p>" + b"x" * 300), ("d", 0, "doc", 200, b"PK\x03\x04" + b"x" * 200), ("e", 1, "doc", 200, b"PK\x03\x04" + b"x" * 200),
    ]
    d = spark.createDataFrame(rows, "document_id string, type_rank int, layer string, status int, content binary")
    own = documents(spark, sf_dir).select("document_id", F.lit(0).alias("type_rank"), F.explode(F.array(F.lit("htm"), F.lit("div"))).alias("layer"), F.lit(200).alias("status"), F.col("markdown_content").cast("binary").alias("content"))
    d = d.unionByName(own)
    return extraction.choose_download(d).select("document_id", "type_rank", "layer")


@query(
    f"WITH {DOCS}, n AS (SELECT document_id, length(markdown_content) AS n FROM docs) SELECT * FROM (VALUES ('a', 'two', NULL), ('b', 'failed', 'all backends failed: one: unavailable; two: output too short (4 < 200); three: returned None')) t(document_id, method, error) "
    "UNION ALL SELECT document_id, CASE WHEN n >= 200 THEN 'one' WHEN 2 * n >= 200 THEN 'two' ELSE 'failed' END, CASE WHEN 2 * n < 200 THEN 'all backends failed: one: output too short (' || n || ' < 200); two: output too short (' || 2 * n || ' < 200)' END FROM n"
)
def extraction_chain(spark, sf_dir):
    rows = [("a", 1, "one", True, "<form> </form>" + "x" * 300, None), ("a", 2, "two", True, "y" * 300, None), ("a", 3, "three", True, "z" * 300, None), ("b", 1, "one", False, None, None), ("b", 2, "two", True, "kısa", None), ("b", 3, "three", True, None, None)]
    d = spark.createDataFrame(rows, "document_id string, rank int, backend string, available boolean, output string, error string")
    x = F.col("markdown_content")
    tries = F.array(F.struct(F.lit(1).alias("rank"), F.lit("one").alias("backend"), x.alias("output")), F.struct(F.lit(2).alias("rank"), F.lit("two").alias("backend"), F.concat(x, x).alias("output")))
    own = documents(spark, sf_dir).select("document_id", F.explode(tries).alias("t")).select("document_id", "t.rank", "t.backend", F.lit(True).alias("available"), "t.output", F.lit(None).cast("string").alias("error"))
    d = d.unionByName(own)
    return extraction.choose_backend(d).select("document_id", "method", "error")


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN doc_id % 3 = 0 THEN '# Başlık ' || source ELSE '' END AS content, CASE WHEN doc_id % 3 = 0 THEN 'html_parser' ELSE 'failed' END AS method, "
    "CASE doc_id % 3 WHEN 1 THEN 'no meaningful content extracted' WHEN 2 THEN 'extracted content is a navigation page' END AS error, doc_id % 3 <> 0 AS retryable FROM documents"
)
def extraction_of_html(spark, sf_dir):
    """Downloads made of each document's source: a heading, a script alone and a page that says it isn't there."""
    d, kind = read(spark, sf_dir, "documents"), F.col("doc_id") % 3
    html = F.when(kind == 0, F.concat(F.lit("<h1>Başlık "), "source", F.lit("</h1>"))).when(kind == 1, "<script>x</script>").otherwise("<p>404 - Sayfa Bulunamadı</p>" + " " * 400)
    return extraction.extract_html(d.select(F.col("doc_id").cast("string").alias("document_id"), html.cast("binary").alias("content")))


@query("SELECT * FROM (VALUES (-1, true, false), (-2, false, true), (-3, false, false), (-4, true, false)) t(id, aware, degraded) UNION ALL SELECT doc_id, doc_id % 4 IN (0, 3), doc_id % 4 = 1 FROM documents")
def formula_methods(spark, sf_dir):
    d = spark.createDataFrame([(-1, "LightOCR-1"), (-2, "markitdown_degraded"), (-3, ""), (-4, "x+manual_latex")], "id long, m string")
    d = d.union(read(spark, sf_dir, "documents").select("doc_id", F.expr("element_at(array('LightOCR-' || coalesce(lang, ''), 'markitdown_degraded', '', coalesce(lang, '') || '+manual_latex'), int(doc_id % 4) + 1)")))
    return d.select("id", extraction.formula_aware(F.col("m")).alias("aware"), extraction.degraded(F.col("m")).alias("degraded"))


_HEALTH = (
    ", e AS (SELECT document_id, count(*) AS cnt FROM chunks WHERE doc_id_even GROUP BY 1) SELECT count(*) AS documents, count(*) FILTER (WHERE length(markdown_content) < 100) AS too_short, 0 AS corrupted, round(count(*) / 2000.0 * 100, 1) AS coverage, "
    "(SELECT count(*) FROM docs d LEFT JOIN e USING (document_id) WHERE length(markdown_content) > 1000 AND coalesce(cnt, 0) <= 1) AS missing_chunks, (SELECT count(*) FROM failures) AS failures, (SELECT count(*) FROM failures WHERE retryable) AS retryable FROM docs"
).replace("doc_id_even", "document_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")


@query(_FAILURES + f", {CHUNKS}" + _HEALTH.replace("round(count(*) / 2000.0 * 100, 1)", "round(CAST(count(*) AS DOUBLE) / 2000 * 100, 1)").replace("0 AS corrupted", "CAST(0 AS BIGINT) AS corrupted"))
def document_health(spark, sf_dir):
    d = documents(spark, sf_dir)
    return reports.document_health(d, _unlabelled_chunks(spark, sf_dir, d), _failures(spark, sf_dir), 2000)


@query(
    f"WITH {CHUNKS}, some_chunks AS (SELECT * FROM chunks WHERE document_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)) " + " UNION ALL ".join(f"SELECT '{name}' AS signal, count(*) FILTER (WHERE {test}) AS n FROM docs" for name, test in ANOMALIES.items()) + " UNION ALL "
    "SELECT 'docs_without_chunks', count(*) FROM docs WHERE length(markdown_content) > 500 AND document_id NOT IN (SELECT document_id FROM some_chunks) UNION ALL SELECT 'orphan_chunks', count(*) FROM some_chunks WHERE document_id NOT IN (SELECT document_id FROM docs)"
)
def quality_report(spark, sf_dir):
    d = documents(spark, sf_dir)
    return reports.quality_report(d, _unlabelled_chunks(spark, sf_dir, d))


@query(
    f"WITH {DOCS}, o AS (SELECT *, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN title END AS old FROM docs) SELECT document_id, CASE WHEN old IS NOT NULL THEN 'old' END AS method_before, extraction_method AS method_after, CAST(length(markdown_content) - length(coalesce(old, '')) AS INT) AS chars_delta, "
    f"CAST({markers_sql('markdown_content')} - {markers_sql('old')} AS INT) AS latex_delta, {drops_sql('markdown_content')} > {drops_sql('old')} OR {markers_sql('markdown_content')} < {markers_sql('old')} AS regression FROM o"
)
def before_after_compare(spark, sf_dir):
    d = documents(spark, sf_dir)
    before = d.join(_labelled(spark, sf_dir), "document_id", "left_semi").select("document_id", F.col("title").alias("markdown_content"), F.lit("old").alias("extraction_method"))
    return reports.before_after(before, d)


@query(f"WITH {DOCS}, f AS (SELECT document_id FROM docs WHERE doc_id % 4 = 0 ORDER BY document_id LIMIT 20) SELECT count(*) FILTER (WHERE doc_id % 4 <> 0) AS ok, count(*) FILTER (WHERE doc_id % 4 = 0) AS failed, (SELECT list(document_id ORDER BY document_id) FROM f) AS first_failed, greatest(count(*) FILTER (WHERE doc_id % 4 = 0) - 20, 0) AS more FROM docs")
def rescue_report(spark, sf_dir):
    d = documents(spark, sf_dir).select("document_id", (F.col("doc_id") % 4 != 0).alias("ok"), F.lit("empty").alias("reason"))
    return reports.rescue_report(d).select("ok", "failed", F.transform("failures", lambda x: x["document_id"]).alias("first_failed"), "more")


@query(f"WITH {DOCS} SELECT document_id, title, category FROM docs WHERE category <> 'src2' AND NOT contains(lower(title), 'the') ORDER BY document_id")
def catalog_load(spark, sf_dir):
    return maintenance.load_catalog(documents(spark, sf_dir).select("document_id", "title", "category"), ("src2",), ("The",))


@query(f"WITH {DOCS} SELECT b.item_id, d.title FROM benchmark b JOIN docs d ON d.document_id = CAST(b.item_id * 3 AS VARCHAR)")
def catalog_lookup(spark, sf_dir):
    ids = read(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") * 3).cast("string").alias("document_id"))
    return maintenance.catalog_lookup(ids, documents(spark, sf_dir).select("document_id", "title")).select("item_id", "title")


_LETTERS = "regexp_replace(cell, '[^\\p{L}\\p{N}]', '', 'g')"


@query(
    f"WITH {DOCS}, c AS (SELECT document_id, unnest(range(len(l))) AS pos, unnest(l) AS cell FROM (SELECT document_id, string_split(markdown_content, chr(10)) AS l FROM docs)), "
    f"k AS (SELECT *, CASE WHEN length(cell) >= 200 AND length({_LETTERS}) >= 200 THEN {_LETTERS} END AS long FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY document_id, long ORDER BY pos) AS nth FROM k) "
    "SELECT document_id, CAST(pos AS INT) AS pos, CASE WHEN long IS NOT NULL AND nth > 1 THEN '' ELSE cell END AS cell FROM r UNION ALL SELECT * FROM (VALUES ('a', 0, repeat('uzun ', 60)), ('a', 1, 'kısa'), ('a', 2, 'kısa'), ('a', 3, ''), ('b', 0, repeat('uzun ', 60))) t(document_id, pos, cell)"
)
def repeated_cells(spark, sf_dir):
    long = "uzun " * 60
    rows = [("a", 0, long), ("a", 1, "kısa"), ("a", 2, "kısa"), ("a", 3, f"**{long}**"), ("b", 0, long)]
    own = documents(spark, sf_dir).select("document_id", F.posexplode(F.split("markdown_content", "\n", -1)).alias("pos", "cell"))
    return reports.repeated_cells(own.union(spark.createDataFrame(rows, "document_id string, pos int, cell string")))


@query(
    f"WITH {DOCS}, n AS (SELECT document_id, markdown_content AS x, (length(markdown_content) - length(replace(markdown_content, 'et ', ''))) // 3 AS n FROM docs) SELECT * FROM (VALUES ('a', 'bir ON iki, üç', NULL), ('b', 'x x', 'step 1: anchor occurs 2 times'), ('c', 'bir', 'step 2: anchor occurs 0 times')) t(document_id, content, error) "
    "UNION ALL SELECT document_id, CASE WHEN n = 1 THEN replace(x, 'et ', 'et cetera ') ELSE x END, CASE WHEN n <> 1 THEN 'step 1: anchor occurs ' || n || ' times' END FROM n"
)
def edit_script(spark, sf_dir):
    docs = spark.createDataFrame([("a", "bir iki"), ("b", "x x"), ("c", "bir"), ("d", "dokunma")], "document_id string, markdown_content string")
    edits = [("a", 1, "after", "bir", " ON"), ("a", 2, "replace", "iki", "iki, üç"), ("b", 1, "replace", "x", "y"), ("c", 1, "before", "bir", "ön "), ("c", 2, "replace", "yok", "z")]
    own = documents(spark, sf_dir).select("document_id", "markdown_content")
    steps = own.select("document_id", F.lit(1).alias("step"), F.lit("after").alias("kind"), F.lit("et ").alias("anchor"), F.lit("cetera ").alias("new"))
    return maintenance.edited(docs.union(own), spark.createDataFrame(edits, "document_id string, step int, kind string, anchor string, new string").union(steps))


@query(f"WITH {DOCS} SELECT document_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN sha256('yeni ' || document_id) ELSE sha256(markdown_content) END AS content_hash FROM docs")
def patch_documents(spark, sf_dir):
    d = documents(spark, sf_dir).select("document_id", "category", "markdown_content").withColumn("content_hash", text.content_hash(F.col("markdown_content")))
    good = _labelled(spark, sf_dir, "toxic = 1").withColumn("content", F.concat(F.lit("başlık\n---\n yeni "), "document_id"))
    broken = _labelled(spark, sf_dir, "toxic = 0").withColumn("content", F.lit("$$ kapanmadı"))
    docs, _, _ = maintenance.patched(d, store.chunk_table(d), good.union(broken))
    return docs.select("document_id", "content_hash")


@query(f"WITH {CHUNKS} SELECT document_id, chunk_index, true AS unit FROM chunks")
def fill_embeddings(spark, sf_dir):
    c = store.chunk_table(documents(spark, sf_dir)).select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_text", F.lit(None).cast("array<float>").alias("embedding"))
    done = maintenance.with_embeddings(c, maintenance.embedder(maintenance.hashed_embedding))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return done.select("document_id", "chunk_index", (F.abs(norm - 1) < 1e-4).alias("unit"))
