"""Document store queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mizan.functions import text
from mizan.operators import store
from mizan.plans.registry import query
from mizan.sources.tables import DOCS, documents, read

NOW = 1.71e9
LEN_TRIM = "regexp_replace(markdown_content, '[\\s\\p{Z}]+', '', 'g')"

def _labelled(spark, sf_dir, where="true"):
    return read(spark, sf_dir, "labels").where(where).select(F.col("doc_id").cast("string").alias("document_id"))


#: SQL of the chunk table over docs.
CHUNKS = (
    f"{DOCS}, cut AS (SELECT document_id, category, sha256(markdown_content) AS content_hash, "
    f"CASE WHEN {LEN_TRIM} = '' THEN [] WHEN length(markdown_content) <= 1000 THEN [markdown_content] ELSE "
    "list_filter(list_transform(range(0, length(markdown_content), 800), lambda s: substring(markdown_content, s + 1, 1000)), "
    "lambda c: regexp_replace(c, '[\\s\\p{Z}]+', '', 'g') <> '') END AS parts FROM docs), "
    "chunks AS (SELECT document_id, category, content_hash, CAST(len(parts) AS INT) AS total_chunks, unnest(range(len(parts))) AS chunk_index, unnest(parts) AS chunk_text FROM cut)"
)


@query(
    f"WITH {DOCS} SELECT count(*) AS total_documents, round(coalesce(sum(file_size), 0) / 1048576.0, 2) AS total_size_mb, "
    "strftime(make_timestamp(CAST(min(downloaded_at) * 1000000 AS BIGINT)), '%Y-%m-%d') AS oldest, strftime(make_timestamp(CAST(max(downloaded_at) * 1000000 AS BIGINT)), '%Y-%m-%d') AS newest, "
    "count(*) FILTER (WHERE markdown_content = '' OR downloaded_at < 1.71e9 - 30 * 86400) AS documents_needing_refresh FROM docs"
)
def store_stats(spark, sf_dir):
    return store.stats(documents(spark, sf_dir), NOW, 30)


@query(f"WITH {DOCS} SELECT coalesce(nullif(category, ''), 'Unknown') AS category, count(*) AS n FROM docs GROUP BY 1")
def category_counts(spark, sf_dir):
    return store.count_by(documents(spark, sf_dir), "category", "Unknown", "category")


@query(f"WITH {DOCS} SELECT coalesce(nullif(extraction_method, ''), 'none') AS method, count(*) AS n FROM docs WHERE markdown_content <> '' GROUP BY 1")
def method_counts(spark, sf_dir):
    return store.count_by(documents(spark, sf_dir), "extraction_method", "none", "method", content_only=True)


@query(f"WITH {DOCS} SELECT extraction_method, count(*) AS n, CAST(round(avg(length(markdown_content))) AS BIGINT) AS avg_len FROM docs GROUP BY 1")
def quality_methods(spark, sf_dir):
    return store.method_breakdown(documents(spark, sf_dir))


@query(
    f"WITH {DOCS} SELECT document_id, title, category, downloaded_at, extraction_method, file_size FROM docs WHERE category = 'src3' ORDER BY downloaded_at DESC, document_id LIMIT 10 OFFSET 5"
)
def list_documents_page(spark, sf_dir):
    return store.list_documents(documents(spark, sf_dir), "src3", 10, 5)


@query(f"WITH {DOCS} SELECT document_id, title, coalesce(markdown_content, '') AS markdown_content FROM docs WHERE document_id = '7'")
def document_lookup(spark, sf_dir):
    return store.get_document(documents(spark, sf_dir), "7").select("document_id", "title", "markdown_content")


@query(f"WITH {DOCS}, ids AS (SELECT CAST(item_id * 40 AS VARCHAR) AS document_id FROM benchmark) SELECT document_id, document_id IN (SELECT document_id FROM docs WHERE markdown_content <> '') AS has_content FROM ids")
def document_exists(spark, sf_dir):
    ids = read(spark, sf_dir, "benchmark").select((F.col("item_id") * 40).cast("string").alias("document_id"))
    return store.has_content(documents(spark, sf_dir), ids)


@query(
    f"WITH {DOCS}, ids AS (SELECT DISTINCT CAST(user_id * 9 AS VARCHAR) AS document_id FROM events) SELECT ids.document_id, "
    "d.document_id IS NULL OR coalesce(markdown_content, '') = '' OR (1.7015e9 - coalesce(downloaded_at, 0)) / 86400 > 10 AS needs_refresh FROM ids LEFT JOIN docs d USING (document_id)"
)
def needs_refresh(spark, sf_dir):
    ids = read(spark, sf_dir, "events").select((F.col("user_id") * 9).cast("string").alias("document_id")).distinct()
    return store.needs_refresh(ids, documents(spark, sf_dir), 1.7015e9, 10)


@query(f"WITH {DOCS} SELECT document_id, CAST(greatest(1, ceil(length(markdown_content) / 5000.0)) AS INT) AS total_pages, unnest(range(1, CAST(greatest(1, ceil(length(markdown_content) / 5000.0)) AS BIGINT) + 1)) AS page_number, substring(markdown_content, (page_number - 1) * 5000 + 1, 5000) AS content FROM docs")
def paginate_documents(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("total_pages", text.page_count(F.col("markdown_content")))
    d = d.select("document_id", "total_pages", "markdown_content", F.explode(F.sequence(F.lit(1), F.col("total_pages"))).alias("page_number"))
    return d.select("document_id", "total_pages", F.col("page_number").cast("long").alias("page_number"), text.page(F.col("markdown_content"), F.col("page_number")).alias("content"))


@query(
    f"WITH {DOCS}, p AS (SELECT *, CAST(greatest(1, ceil(length(markdown_content) / 5000.0)) AS INT) AS n FROM docs) SELECT document_id, CASE WHEN n >= 2 THEN substring(markdown_content, 5001, 5000) "
    "ELSE 'Invalid page 2, document has ' || n || ' pages' END AS content FROM p"
)
def document_page(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("document_id", text.page(F.col("markdown_content"), 2).alias("content"))


@query(f"WITH {DOCS} SELECT count(*) AS documents, sum(n) AS pages, max(n) AS most FROM (SELECT CAST(greatest(1, ceil(length(markdown_content) / 5000.0)) AS BIGINT) AS n FROM docs)")
def pages_per_document(spark, sf_dir):
    return store.page_totals(documents(spark, sf_dir))


@query(f"WITH {CHUNKS} SELECT document_id, category, content_hash, total_chunks, chunk_index, chunk_text FROM chunks")
def chunk_documents(spark, sf_dir):
    return store.chunk_table(documents(spark, sf_dir)).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(f"WITH {DOCS} SELECT document_id, sha256(markdown_content) AS hash FROM docs WHERE {LEN_TRIM} <> ''")
def reconstruct_documents(spark, sf_dir):
    rebuilt = store.rebuilt(store.chunk_table(documents(spark, sf_dir)))
    return rebuilt.select("document_id", text.content_hash(F.col("content")).alias("hash"))


@query(f"WITH {DOCS} SELECT document_id, substring(markdown_content, 5001, 5000) AS content FROM docs WHERE length(markdown_content) > 5000")
def page_from_chunks(spark, sf_dir):
    return store.page_from_chunks(store.chunk_table(documents(spark, sf_dir)), 2)


@query(f"WITH {CHUNKS} SELECT category, count(DISTINCT document_id) AS documents, count(*) AS chunks FROM chunks GROUP BY 1 UNION ALL SELECT NULL, count(DISTINCT document_id), count(*) FROM chunks")
def chunk_store_stats(spark, sf_dir):
    return store.chunk_counts(store.chunk_table(documents(spark, sf_dir)))


@query(f"WITH {CHUNKS} SELECT document_id, count(*) AS n FROM chunks WHERE document_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) GROUP BY 1")
def orphan_chunks(spark, sf_dir):
    known = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("document_id"))
    return store.orphan_chunks(store.chunk_table(documents(spark, sf_dir)), known).groupBy("document_id").agg(F.count("*").alias("n"))


@query(f"WITH {DOCS} SELECT document_id FROM docs WHERE length(markdown_content) > 500 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def docs_without_chunks(spark, sf_dir):
    have = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("document_id"))
    return store.without_chunks(documents(spark, sf_dir), have).select("document_id")


@query(f"WITH {CHUNKS}, few AS (SELECT document_id, count(*) AS cnt FROM chunks WHERE document_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) GROUP BY 1) SELECT d.document_id, coalesce(cnt, 0) AS cnt FROM docs d LEFT JOIN few USING (document_id) WHERE length(markdown_content) > 1000 AND coalesce(cnt, 0) <= 1")
def thin_chunks(spark, sf_dir):
    d = documents(spark, sf_dir)
    return store.thin_chunks(d, store.chunk_table(d).join(_labelled(spark, sf_dir), "document_id", "left_anti"))


_HASHED = f"{DOCS}, a AS (SELECT document_id, sha256(markdown_content) AS content_hash, doc_id FROM docs), b AS (SELECT document_id, CASE WHEN doc_id % 7 = 0 THEN 'x' WHEN doc_id % 11 = 0 THEN NULL ELSE content_hash END AS content_hash FROM a WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"


def _hashed(spark, sf_dir):
    a = documents(spark, sf_dir).select("document_id", text.content_hash(F.col("markdown_content")).alias("content_hash"), "doc_id", "markdown_content")
    changed = F.when(F.col("doc_id") % 7 == 0, "x").when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(F.col("content_hash"))
    return a, a.join(_labelled(spark, sf_dir, "toxic = 1"), "document_id", "left_anti").withColumn("content_hash", changed)


@query(f"WITH {_HASHED} SELECT a.document_id FROM a LEFT JOIN b USING (document_id) WHERE b.document_id IS NULL OR coalesce(a.content_hash, '') <> coalesce(b.content_hash, '')")
def hash_drift(spark, sf_dir):
    a, b = _hashed(spark, sf_dir)
    return store.drifted(a, b)


@query(f"WITH {_HASHED} SELECT count(DISTINCT document_id) AS stale_documents FROM a JOIN b USING (document_id) WHERE a.content_hash <> b.content_hash")
def stale_chunks(spark, sf_dir):
    a, b = _hashed(spark, sf_dir)
    return store.stale_chunk_documents(b, a)


@query(
    f"WITH {_HASHED}, d AS (SELECT count(*) AS drift FROM a LEFT JOIN b USING (document_id) WHERE b.document_id IS NULL OR coalesce(a.content_hash, '') <> coalesce(b.content_hash, '')) "
    "SELECT (SELECT count(*) FROM a) AS seed_rows, (SELECT count(*) FROM b) AS store_rows, drift, (SELECT count(*) FROM b) >= (SELECT count(*) FROM a) AND drift = 0 AS skip FROM d"
)
def import_decision(spark, sf_dir):
    a, b = _hashed(spark, sf_dir)
    return store.may_skip_import(a, b)


@query("SELECT conv_id AS document_id, count(*) AS versions, max(turn) AS latest FROM conversations GROUP BY 1")
def version_counts(spark, sf_dir):
    return store.version_counts(read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("version")))


@query(
    "WITH h AS (SELECT conv_id, turn, text, sha256(text) AS content_hash, lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) "
    "SELECT conv_id, turn, content_hash, before IS NOT NULL AND before <> content_hash AS changed FROM h"
)
def content_hash_versions(spark, sf_dir):
    return store.content_changes(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "content_hash", "changed")


@query(f"WITH {_HASHED}, m AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, max(quality) + 1 AS last FROM labels GROUP BY 1) SELECT b.document_id, coalesce(m.last, 0) + 1 AS version, b.content_hash FROM b JOIN a USING (document_id) LEFT JOIN m USING (document_id) WHERE b.content_hash <> '' AND a.content_hash <> '' AND b.content_hash <> a.content_hash")
def archive_versions(spark, sf_dir):
    a, b = _hashed(spark, sf_dir)
    versions = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("document_id"), (F.col("quality") + 1).alias("version"))
    return store.archived(b, a, versions, NOW).select("document_id", "version", "content_hash")


_TWO = f"{DOCS}, old AS (SELECT document_id, title, CASE WHEN doc_id % 2 = 0 THEN category END AS blob FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), new AS (SELECT document_id, 'new ' || title AS title, CASE WHEN doc_id % 5 = 0 THEN 'b' END AS blob FROM docs WHERE doc_id IN (SELECT doc_id FROM labels))"


def _two(spark, sf_dir):
    d = documents(spark, sf_dir)
    old = d.join(_labelled(spark, sf_dir, "toxic = 1"), "document_id", "left_anti").select("document_id", "title", F.when(F.col("doc_id") % 2 == 0, F.col("category")).alias("blob"))
    new = d.join(_labelled(spark, sf_dir), "document_id", "left_semi").select("document_id", F.concat(F.lit("new "), "title").alias("title"), F.when(F.col("doc_id") % 5 == 0, F.lit("b")).alias("blob"))
    return old, new


@query(f"WITH {_TWO} SELECT document_id, title, blob FROM old WHERE document_id NOT IN (SELECT document_id FROM new) UNION ALL SELECT n.document_id, n.title, coalesce(n.blob, o.blob) FROM new n LEFT JOIN old o USING (document_id)")
def upsert_documents(spark, sf_dir):
    old, new = _two(spark, sf_dir)
    return store.upsert(old, new, keep_if_null=("blob",))


@query(f"WITH {_TWO} SELECT * FROM old UNION ALL SELECT * FROM new WHERE document_id NOT IN (SELECT document_id FROM old)")
def insert_if_absent(spark, sf_dir):
    return store.insert_absent(*_two(spark, sf_dir))


@query(f"WITH {CHUNKS}, own AS (SELECT document_id, chunk_index, chunk_text FROM chunks), n AS (SELECT document_id, CAST(0 AS BIGINT) AS chunk_index, 'new ' || title AS chunk_text FROM docs WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) SELECT * FROM own WHERE document_id NOT IN (SELECT document_id FROM n) UNION ALL SELECT * FROM n")
def replace_chunks(spark, sf_dir):
    d = documents(spark, sf_dir)
    own = store.chunk_table(d).select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_text")
    new = d.join(_labelled(spark, sf_dir, "toxic = 1"), "document_id", "left_semi").select("document_id", F.lit(0).cast("long").alias("chunk_index"), F.concat(F.lit("new "), "title").alias("chunk_text"))
    return store.replace_children(own, new)


@query(f"WITH {DOCS} SELECT document_id FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_documents(spark, sf_dir):
    gone = read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("document_id"))
    return store.delete_keys(documents(spark, sf_dir), gone).select("document_id")


@query(f"WITH {DOCS}, have AS (SELECT CAST(doc_id AS VARCHAR) AS document_id FROM labels) SELECT document_id FROM docs WHERE markdown_content <> '' AND document_id NOT IN (SELECT document_id FROM have) AND (SELECT avg(CASE WHEN document_id IN (SELECT document_id FROM have) THEN 1.0 ELSE 0.0 END) FROM docs WHERE markdown_content <> '') < 0.9 ORDER BY document_id LIMIT 2000")
def migration_candidates(spark, sf_dir):
    have = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("document_id"))
    return store.missing_for_migration(documents(spark, sf_dir), have)


@query(f"WITH {DOCS} SELECT document_id FROM docs UNION SELECT CAST(doc_id AS VARCHAR) FROM labels")
def all_ids_union(spark, sf_dir):
    a = documents(spark, sf_dir).select("document_id")
    return a.union(read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string"))).distinct()


_MESSAGES = (
    "CASE user_id % 8 WHEN 0 THEN 'HTTP 403 forbidden' WHEN 1 THEN 'Read timed out' WHEN 2 THEN 'Extraction failed: error page' WHEN 3 THEN 'All download layers failed' "
    "WHEN 4 THEN 'Connection reset' WHEN 5 THEN 'connect timeout' WHEN 6 THEN '404 no content' ELSE 'odd' END"
)
_RULES = (
    "CASE WHEN contains(lower(e), 'robots') OR contains(lower(e), '403') THEN 'robots_txt' WHEN contains(lower(e), 'timeout') OR contains(lower(e), 'timed out') THEN 'timeout' "
    "WHEN contains(lower(e), 'extraction failed') OR contains(lower(e), '404') OR contains(lower(e), 'error page') THEN 'extraction' "
    "WHEN contains(lower(e), 'all download') OR contains(lower(e), 'no content') THEN 'download' WHEN contains(lower(e), 'connect') THEN 'connection' ELSE 'unknown' END"
)


@query(f"WITH m AS (SELECT {_MESSAGES} AS e FROM events WHERE event_type = 'error'), c AS (SELECT {_RULES} AS category FROM m) SELECT category, category NOT IN ('robots_txt', 'extraction') AS retryable, count(*) AS n FROM c GROUP BY 1, 2")
def error_categories(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("event_type = 'error'").select(F.expr(_MESSAGES).alias("e"))
    return e.select(store.classify_error(F.col("e")).alias("c")).groupBy("c.category", "c.retryable").agg(F.count("*").alias("n"))


_FAILURES = (
    f"WITH x AS (SELECT CAST(user_id AS VARCHAR) AS document_id, {_MESSAGES} || ' ' || event_type AS e, CAST(event_id AS DOUBLE) AS t, event_type FROM events), "
    "o AS (SELECT document_id, arg_max(e, t) AS e, count(*) AS n, min(t) AS a, max(t) AS b FROM x WHERE event_type = 'error' GROUP BY 1), "
    "w AS (SELECT document_id, arg_max(e, t) AS e, count(*) AS n, min(t) AS a, max(t) AS b FROM x WHERE event_type = 'signup' GROUP BY 1), "
    "f AS (SELECT coalesce(w.document_id, o.document_id) AS document_id, coalesce(w.e, o.e) AS e, coalesce(o.n, 0) + coalesce(w.n, 0) AS attempts, coalesce(o.a, w.a) AS first_failed_at, coalesce(w.b, o.b) AS last_failed_at FROM o FULL JOIN w ON o.document_id = w.document_id), "
    f"failures AS (SELECT document_id, e AS error, {_RULES} AS error_category, {_RULES} NOT IN ('robots_txt', 'extraction') AS retryable, attempts, first_failed_at, last_failed_at FROM f) "
)


def _failures(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    x = e.select(F.col("user_id").cast("string").alias("document_id"), F.concat(F.expr(_MESSAGES), F.lit(" "), "event_type").alias("error"), F.col("event_id").cast("double").alias("ts"), "event_type")
    empty = spark.createDataFrame([], "document_id string, error string, error_category string, retryable boolean, attempts long, first_failed_at double, last_failed_at double")
    old = store.merge_failures(empty, x.where("event_type = 'error'"))
    return store.merge_failures(old, x.where("event_type = 'signup'"))


@query(_FAILURES + "SELECT * FROM failures")
def failure_upsert(spark, sf_dir):
    return _failures(spark, sf_dir)


@query(_FAILURES + "SELECT * FROM failures WHERE retryable ORDER BY last_failed_at DESC, document_id")
def retryable_failures(spark, sf_dir):
    return store.retryable(_failures(spark, sf_dir))


@query(
    _FAILURES + ", r AS (SELECT *, row_number() OVER (PARTITION BY error_category ORDER BY last_failed_at DESC, document_id) AS rn FROM failures) "
    "SELECT error_category, count(*) AS failures, count(*) FILTER (WHERE retryable) AS retryable, list(document_id ORDER BY rn) FILTER (WHERE rn <= 5) AS first_ids, greatest(count(*) - 5, 0) AS more FROM r GROUP BY 1"
)
def failure_report(spark, sf_dir):
    return store.failure_report(_failures(spark, sf_dir))


@query("SELECT event_type AS category, count(*) AS total, count(*) FILTER (WHERE value > 50 AND user_id % 3 = 0) AS downloaded, count(*) FILTER (WHERE value > 50 AND user_id % 3 <> 0) AS skipped, count(*) FILTER (WHERE NOT value > 50) AS failed FROM events GROUP BY 1")
def sync_report(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("category"), (F.col("value") > 50).alias("success"), (F.col("user_id") % 3 != 0).alias("cached"))
    return store.sync_report(e, "category")


@query(
    "WITH o AS (SELECT CAST(user_id AS VARCHAR) AS document_id, 'e' || min(event_id) AS etag, count(*) AS c FROM events WHERE event_id % 2 = 0 GROUP BY 1), "
    "n AS (SELECT CAST(user_id + 5 AS VARCHAR) AS document_id, max(event_id) AS ts, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1) "
    "SELECT coalesce(o.document_id, n.document_id) AS document_id, CASE WHEN n.ts IS NOT NULL THEN 't' || n.ts ELSE etag END AS etag, 'm' AS last_modified, CAST(coalesce(n.ts, 0) AS DOUBLE) AS last_sync_at, coalesce(c, 0) + coalesce(n, 0) AS sync_count FROM o FULL JOIN n USING (document_id)"
)
def sync_metadata(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    old = e.where("event_id % 2 = 0").groupBy(F.col("user_id").cast("string").alias("document_id")).agg(F.concat(F.lit("e"), F.min("event_id")).alias("etag"), F.count("*").alias("sync_count"))
    old = old.withColumn("last_modified", F.lit("m")).withColumn("last_sync_at", F.lit(0.0))
    done = e.where("event_id % 2 = 1").select((F.col("user_id") + 5).cast("string").alias("document_id"), F.concat(F.lit("t"), "event_id").alias("etag"), F.lit("m").alias("last_modified"), F.col("event_id").cast("double").alias("ts"))
    return store.merge_sync_metadata(old, done)


@query(f"WITH {DOCS} SELECT document_id, encode(markdown_content) AS pdf_blob FROM docs WHERE document_id = '7'")
def document_blob(spark, sf_dir):
    d = documents(spark, sf_dir).select("document_id", F.col("markdown_content").cast("binary").alias("pdf_blob"))
    return store.blob(d, "7")


@query(f"WITH {DOCS} SELECT document_id, length(markdown_content) AS n FROM docs ORDER BY n DESC, document_id LIMIT 25")
def backfill_candidates(spark, sf_dir):
    d = documents(spark, sf_dir).select("document_id", F.length("markdown_content").cast("long").alias("n"))
    return store.candidates(d, [F.desc("n"), "document_id"], 25)
