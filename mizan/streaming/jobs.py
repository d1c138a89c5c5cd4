"""Streams: new items, counters, event-time windows and ingestion.

Each function takes a streaming DataFrame and returns one, or starts a query
that ends once it has read what is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mizan.functions import text
from mizan.operators import pages, search, store, text_index
from mizan.sources import snapshots


def new_items(items: DataFrame, key: str = "url", time: str | None = None, late: str = "7 days") -> DataFrame:
    """The first of each key; with a time column, keys are forgotten after `late`."""
    some = items.where(F.coalesce(key, F.lit("")) != "")
    if time is None:
        return some.dropDuplicates([key])
    return some.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def new_announcements(polled: DataFrame, base: str) -> DataFrame:
    """page_id, pos, title, date, url, baseline of announcements that the page seen before didn't have.

    polled: rows of sources.web.ListPageStream. Those of a page that is seen for
    the first time are its baseline.
    """
    as_text = lambda c: F.make_valid_utf8(F.col(c).cast("string"))
    rows = polled.select(F.struct("page_id", as_text("seen").alias("seen")).alias("k"), as_text("content").alias("html"))
    found = pages.announcements(rows, base, "k")
    # the address stands in the old page as it is, or without the host
    old, own = F.col("k.seen"), F.replace("url", F.lit(base), F.lit(""))
    quoted = [F.contains(old, F.concat(F.lit(q), a, F.lit(q))) for q in "\"'" for a in (F.col("url"), own)]
    known = quoted[0] | quoted[1] | quoted[2] | quoted[3]
    return found.where(old.isNull() | ~known).select("k.page_id", "pos", "title", "date", "url", old.isNull().alias("baseline"))


def tool_metrics(calls: DataFrame) -> DataFrame:
    """Requests, errors and total latency by tool; for update or complete mode."""
    return calls.groupBy("tool").agg(F.count("*").alias("requests"), F.count_if("error").alias("errors"), F.sum("latency").alias("latency"))


def windows(events: DataFrame, time: str, width: str, slide: str | None = None, late: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Counts and sums in tumbling or sliding windows of event time."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return timed.groupBy(key, window.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(key, "w.start", "w.end", "n", "value")


def sessions(events: DataFrame, time: str, gap: str, late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Events in sessions that end after a gap."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, "w.start", "w.end", "n")


def ingest(incoming: DataFrame, folder: str, checkpoint: str, now: float, full_text: bool = False):
    """Upsert documents, archive changed versions and replace chunks, batch by batch.

    incoming: document_id, title, category, markdown_content, and downloaded_at
    if the last of several rows of a document is to count (else that with the
    greatest hash). The tables are those of a store, kept in parts by document_id;
    a batch writes the parts that it touches, of all tables in one commit that
    also says which batch it was: one that runs again after a crash is left out
    if it was committed. With full_text the same commit keeps a TextIndex of the
    documents current. Returns the query.
    """
    schema = "document_id string, title string, category string, markdown_content string, content_hash string"
    chunk_schema = "document_id string, category string, content_hash string, total_chunks int, chunk_index int, chunk_text string"
    version_schema = "document_id string, version int, content_hash string, markdown_content string, synced_at double"

    def one(batch: DataFrame, number: int) -> None:
        held = snapshots.Store(batch.sparkSession, folder)
        clean = batch.withColumn("markdown_content", text.sanitize(F.col("markdown_content"))).where("markdown_content <> ''")
        hashed = clean.withColumn("content_hash", text.content_hash(F.col("markdown_content")))
        columns = [c.split()[0] for c in schema.split(", ")]
        order = [c for c in ("downloaded_at", "content_hash") if c in hashed.columns]
        new = hashed.groupBy("document_id").agg(F.max(F.struct(*order, *[F.col(c).alias(f"new_{c}") for c in columns])).alias("r"))
        new = new.select(*[F.col(f"r.new_{c}").alias(c) for c in columns]).persist()
        touched = tuple(sorted(r[0] for r in new.select(snapshots.part_of("document_id")).distinct().collect()))

        def change(state):
            if not touched or state.marks.get(checkpoint, -1) >= number:
                return None
            old, versions, chunks = (held.read(t, s, touched, state) for t, s in (("documents", schema), ("versions", version_schema), ("chunks", chunk_schema)))
            versions = versions.unionByName(store.archived(old, new, versions, now).select(*versions.columns))
            rows = {"versions": versions, "chunks": store.replace_children(chunks, store.chunk_table(new)), "documents": store.upsert(old, new)}
            changes = {t: snapshots.Change(d, "document_id", touched) for t, d in rows.items()}
            if full_text:
                words = search.document_tokens(new).withColumnRenamed("document_id", "key")
                changes |= text_index.TextIndex(batch.sparkSession, folder).changes(words, state)
            return changes

        held.update(change, {checkpoint: number})
        new.unpersist()

    return incoming.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
