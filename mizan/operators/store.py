"""Document store: lookups, listings, statistics, joins with chunks, and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mizan.functions import text


def get_document(docs: DataFrame, document_id: str) -> DataFrame:
    """Point lookup; missing text columns come back empty."""
    found = docs.where(F.col("document_id") == document_id)
    return found.select(*[F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in docs.dtypes])


def list_documents(docs: DataFrame, category: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Columns without content, newest first, ties by id."""
    some = docs if category is None else docs.where(F.col("category") == category)
    some = some.select("document_id", "title", "category", "downloaded_at", "extraction_method", "file_size")
    return some.orderBy(F.desc("downloaded_at"), "document_id").offset(offset).limit(limit)


def has_content(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """For each id whether a row with content exists."""
    full = docs.where(F.col("markdown_content") != "").select("document_id", F.lit(True).alias("has_content")).distinct()
    return ids.join(full, "document_id", "left").withColumn("has_content", F.coalesce("has_content", F.lit(False)))


def needs_refresh(ids: DataFrame, docs: DataFrame, now: float, max_age_days: int) -> DataFrame:
    """Missing row, empty content, or older than the limit; a missing time counts as the epoch."""
    own = docs.select("document_id", "markdown_content", "downloaded_at", F.lit(True).alias("there"))
    age = (F.lit(now) - F.coalesce("downloaded_at", F.lit(0.0))) / 86400
    stale = F.col("there").isNull() | (F.coalesce("markdown_content", F.lit("")) == "") | (age > max_age_days)
    return ids.join(own, "document_id", "left").select("document_id", stale.alias("needs_refresh"))


def stats(docs: DataFrame, now: float, max_age_days: int) -> DataFrame:
    """Counts, size in MB, first and last day, and how many need a refresh; one row."""
    day = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd")
    old = (F.col("markdown_content") == "") | (F.col("downloaded_at") < now - max_age_days * 86400)
    return docs.agg(
        F.count("*").alias("total_documents"),
        F.round(F.coalesce(F.sum("file_size"), F.lit(0)) / 1048576, 2).alias("total_size_mb"),
        day(F.min("downloaded_at")).alias("oldest"),
        day(F.max("downloaded_at")).alias("newest"),
        F.count_if(old).alias("documents_needing_refresh"),
    )


def count_by(docs: DataFrame, column: str, missing: str, name: str, content_only: bool = False) -> DataFrame:
    """Rows by group, empty and null under one name."""
    some = docs.where(F.col("markdown_content") != "") if content_only else docs
    group = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(missing))
    return some.groupBy(group.alias(name)).agg(F.count("*").alias("n"))


def method_breakdown(docs: DataFrame) -> DataFrame:
    """Documents and rounded average length by method."""
    return docs.groupBy("extraction_method").agg(F.count("*").alias("n"), F.round(F.avg(F.length("markdown_content"))).cast("long").alias("avg_len"))


def version_counts(versions: DataFrame) -> DataFrame:
    return versions.groupBy("document_id").agg(F.count("*").alias("versions"), F.max("version").alias("latest"))


def chunk_table(docs: DataFrame) -> DataFrame:
    """document_id, chunk_index, total_chunks, content_hash, chunk_text."""
    cut = docs.select("document_id", "category", text.content_hash(F.col("markdown_content")).alias("content_hash"), text.chunks(F.col("markdown_content")).alias("parts"))
    # the inner form would cut every text twice, first to test for an empty array
    out = cut.select("document_id", "category", "content_hash", F.size("parts").alias("total_chunks"), F.posexplode_outer("parts").alias("chunk_index", "chunk_text"))
    return out.where(F.col("chunk_text").isNotNull())


def rebuilt(chunks: DataFrame) -> DataFrame:
    """Documents put together from their chunks."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda x: x["chunk_text"])
    return chunks.groupBy("document_id").agg(text.unchunk(parts).alias("content"))


def page_from_chunks(chunks: DataFrame, page: int, size: int = text.PAGE_CHARS) -> DataFrame:
    """One page of each document, read from the chunks that hold it alone."""
    step = text.CHUNK_CHARS - text.CHUNK_OVERLAP
    start, end = (page - 1) * size, page * size
    first = start // step
    near = chunks.where(F.col("chunk_index").between(first, end // step + 1))
    local = start - first * step
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda x: x["chunk_text"])
    return near.groupBy("document_id").agg(F.substring(text.unchunk(parts), local + 1, size).alias("content")).where(F.col("content") != "")


def orphan_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return chunks.join(docs.select("document_id"), "document_id", "left_anti")


def without_chunks(docs: DataFrame, chunks: DataFrame, longer_than: int = 500) -> DataFrame:
    return docs.where(F.length("markdown_content") > longer_than).join(chunks.select("document_id"), "document_id", "left_anti")


def thin_chunks(docs: DataFrame, chunks: DataFrame, longer_than: int = 1000) -> DataFrame:
    """Long documents with at most one chunk."""
    n = chunks.groupBy("document_id").agg(F.count("*").alias("cnt"))
    found = docs.where(F.length("markdown_content") > longer_than).join(n, "document_id", "left")
    return found.select("document_id", F.coalesce("cnt", F.lit(0)).alias("cnt")).where(F.col("cnt") <= 1)


def drifted(seed: DataFrame, store: DataFrame) -> DataFrame:
    """Seed documents whose hash the store lacks or has otherwise."""
    own = store.select("document_id", F.col("content_hash").alias("stored_hash"), F.lit(True).alias("there"))
    differs = F.col("there").isNull() | ~F.coalesce("content_hash", F.lit("")).eqNullSafe(F.coalesce("stored_hash", F.lit("")))
    return seed.join(own, "document_id", "left").where(differs).select("document_id")


def stale_chunk_documents(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """How many documents have chunks of another content."""
    own = docs.select("document_id", F.col("content_hash").alias("doc_hash"))
    return chunks.join(own, "document_id").where(F.col("content_hash") != F.col("doc_hash")).agg(F.countDistinct("document_id").alias("stale_documents"))


def may_skip_import(seed: DataFrame, store: DataFrame, force: bool = False) -> DataFrame:
    """One row: skip iff not forced, the store has as many rows and nothing drifted."""
    counts = seed.agg(F.count("*").alias("seed_rows")).crossJoin(store.agg(F.count("*").alias("store_rows")))
    both = counts.crossJoin(drifted(seed, store).agg(F.count("*").alias("drift")))
    return both.withColumn("skip", ~F.lit(force) & (F.col("store_rows") >= F.col("seed_rows")) & (F.col("drift") == 0))


def upsert(store: DataFrame, new: DataFrame, key: str = "document_id", keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace old ones by key; listed columns keep the old value where the new one is null."""
    old = store.select(F.col(key), *[F.col(c).alias(f"old_{c}") for c in keep_if_null])
    merged = new.join(old, key, "left") if keep_if_null else new
    merged = merged.select(*[F.coalesce(c, f"old_{c}").alias(c) if c in keep_if_null else F.col(c) for c in store.columns])
    return store.join(new.select(key), key, "left_anti").select(*store.columns).unionByName(merged)


def archived(store: DataFrame, new: DataFrame, versions: DataFrame, now: float) -> DataFrame:
    """Versions to add: the stored content of documents whose hash changes, next number of each.

    Content that is the last version already is not added again: the change was
    archived before, and the store didn't take it.
    """
    incoming = new.select("document_id", F.col("content_hash").alias("new_hash"))
    known = F.max_by("content_hash", "version") if "content_hash" in versions.columns else F.lit(None)
    last = versions.groupBy("document_id").agg(F.max("version").alias("last"), known.cast("string").alias("last_hash"))
    changed = store.join(incoming, "document_id").where((F.col("content_hash") != "") & (F.col("new_hash") != "") & (F.col("content_hash") != F.col("new_hash")))
    changed = changed.join(last, "document_id", "left").where(~F.col("content_hash").eqNullSafe(F.col("last_hash")))
    return changed.select("document_id", (F.coalesce("last", F.lit(0)) + 1).alias("version"), "content_hash", "markdown_content", F.lit(now).alias("synced_at"))


def insert_absent(store: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    return store.unionByName(new.join(store.select(key), key, "left_anti").select(*store.columns))


def replace_children(table: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """All rows of the keys in new go; new comes."""
    return table.join(new.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def delete_keys(table: DataFrame, ids: DataFrame, key: str = "document_id") -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def classify_error(error: Column) -> Column:
    """Struct of category and retryable by the first rule that holds."""
    low = F.lower(error)
    rules = [
        (("robots", "403"), "robots_txt", False),
        (("timeout", "timed out"), "timeout", True),
        (("extraction failed", "404", "error page"), "extraction", False),
        (("all download", "no content"), "download", True),
        (("connect", "connection"), "connection", True),
    ]
    out = None
    for words, name, retry in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        value = F.struct(F.lit(name).alias("category"), F.lit(retry).alias("retryable"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(F.lit("unknown").alias("category"), F.lit(True).alias("retryable")))


def merge_failures(old: DataFrame, attempts: DataFrame) -> DataFrame:
    """attempts (document_id, error, ts) into failures: counts add, first time stays, last error counts."""
    new = attempts.groupBy("document_id").agg(F.max_by("error", "ts").alias("error"), F.count("*").alias("attempts"), F.min("ts").alias("first_failed_at"), F.max("ts").alias("last_failed_at"))
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.document_id") == F.col("n.document_id"), "full_outer")
    error = F.coalesce("n.error", "o.error")
    kind = classify_error(error)
    return both.select(
        F.coalesce("n.document_id", "o.document_id").alias("document_id"),
        error.alias("error"),
        kind["category"].alias("error_category"),
        kind["retryable"].alias("retryable"),
        (F.coalesce("o.attempts", F.lit(0)) + F.coalesce("n.attempts", F.lit(0))).alias("attempts"),
        F.coalesce("o.first_failed_at", "n.first_failed_at").alias("first_failed_at"),
        F.coalesce("n.last_failed_at", "o.last_failed_at").alias("last_failed_at"),
    )


def failure_report(failures: DataFrame, first: int = 5) -> DataFrame:
    """By category: failures, retryable ones, the first ids and how many more.

    Counted apart, so that only the first rows of each task are ranked.
    """
    order = Window.partitionBy("error_category").orderBy(F.desc("last_failed_at"), "document_id")
    ranked = failures.select("error_category", "document_id", "last_failed_at").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= first)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rn", "document_id"))), lambda x: x["document_id"])
    shown = ranked.groupBy(F.col("error_category").alias("c")).agg(ids.alias("first_ids"))
    counts = failures.groupBy("error_category").agg(F.count("*").alias("failures"), F.count_if("retryable").alias("retryable"))
    found = counts.join(shown, F.col("error_category").eqNullSafe(F.col("c"))).drop("c")
    return found.withColumn("more", F.greatest(F.col("failures") - first, F.lit(0)))


def retryable(failures: DataFrame) -> DataFrame:
    """Failures that may be tried again, the last first."""
    return failures.where("retryable").orderBy(F.desc("last_failed_at"), "document_id")


def sync_report(results: DataFrame, group: str) -> DataFrame:
    """By group: all results, downloaded, skipped (there already) and failed; results: success, cached."""
    return results.groupBy(group).agg(
        F.count("*").alias("total"), F.count_if(F.col("success") & ~F.col("cached")).alias("downloaded"), F.count_if(F.col("success") & F.col("cached")).alias("skipped"), F.count_if(~F.col("success")).alias("failed")
    )


def page_totals(docs: DataFrame) -> DataFrame:
    """One row: documents, their pages and the most of one."""
    n = docs.select(text.page_count(F.col("markdown_content")).cast("long").alias("n"))
    return n.agg(F.count("*").alias("documents"), F.sum("n").alias("pages"), F.max("n").alias("most"))


def content_changes(versions: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """Versions with their hash and whether it differs from that of the one before."""
    hashed = versions.withColumn("content_hash", text.content_hash(F.col(content)))
    before = F.lag("content_hash").over(Window.partitionBy(key).orderBy(order))
    return hashed.withColumn("changed", F.coalesce(before != F.col("content_hash"), F.lit(False)))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """By category and, with category null, overall: documents and chunks."""
    per = chunks.groupBy("document_id", "category").agg(F.count("*").alias("n"))
    by_category = per.groupBy("category").agg(F.count("*").alias("documents"), F.sum("n").alias("chunks"))
    return by_category.unionByName(per.agg(F.lit(None).cast("string").alias("category"), F.count_distinct("document_id").alias("documents"), F.sum("n").alias("chunks")))


def blob(docs: DataFrame, document_id: str, column: str = "pdf_blob") -> DataFrame:
    """The stored bytes of a document; no row if there are none."""
    return docs.where((F.col("document_id") == document_id) & F.col(column).isNotNull()).select("document_id", column)


def merge_sync_metadata(old: DataFrame, done: DataFrame) -> DataFrame:
    """old (document_id, etag, last_modified, last_sync_at, sync_count) after syncs (document_id, etag, last_modified, ts).

    The last sync counts, and each adds one to the counter.
    """
    last = F.max(F.struct("ts", "etag", "last_modified")).alias("s")
    new = done.groupBy("document_id").agg(last, F.count("*").alias("n"))
    return old.join(new, "document_id", "full_outer").select(
        "document_id",
        F.coalesce("s.etag", "etag", F.lit("")).alias("etag"),
        F.coalesce("s.last_modified", "last_modified", F.lit("")).alias("last_modified"),
        F.coalesce("s.ts", "last_sync_at").alias("last_sync_at"),
        (F.coalesce("sync_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("sync_count"),
    )


def candidates(rows: DataFrame, order: list, limit: int = 0) -> DataFrame:
    """Rows in order, the first `limit` of them; 0 is all."""
    ordered = rows.orderBy(*order)
    return ordered.limit(limit) if limit else ordered


def missing_for_migration(docs: DataFrame, chunked: DataFrame, cap: int = 2000) -> DataFrame:
    """Documents to move to the chunk store: none if nine tenths are there, else the first `cap` missing ones."""
    have = chunked.select("document_id").distinct()
    full = docs.where(F.col("markdown_content") != "").select("document_id")
    share = full.join(have.withColumn("there", F.lit(1)), "document_id", "left").agg(F.try_divide(F.count("there"), F.count("*")).alias("share"))
    missing = full.join(have, "document_id", "left_anti").orderBy("document_id").limit(cap)
    return missing.join(F.broadcast(share), F.coalesce("share", F.lit(1.0)) < 0.9, "left_semi")
