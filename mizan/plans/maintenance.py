"""Upkeep: catalog load, patches, missing vectors, rescue and start-up."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mizan.functions import markup, text
from mizan.operators import search, store
from mizan.sources import snapshots


def load_catalog(rows: DataFrame, categories: tuple[str, ...], substrings: tuple[str, ...]) -> DataFrame:
    """Catalog rows in scope, missing texts as empty, in id order."""
    kept = rows.where(search.in_scope(F.col("title"), F.col("category"), categories, substrings))
    return kept.select(*[F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in kept.dtypes]).orderBy("document_id")


def with_stale_fallback(fresh: DataFrame, stale: DataFrame) -> DataFrame:
    """The fresh rows, or the stale ones if a scan brought none."""
    some = fresh.agg((F.count("*") > 0).alias("some"))
    old = stale.join(F.broadcast(some), ~F.col("some"), "left_semi")
    return fresh.unionByName(old.select(*fresh.columns))


def scanned(found: list[DataFrame], errors: DataFrame, stale: DataFrame, categories: tuple[str, ...], substrings: tuple[str, ...]) -> DataFrame:
    """The catalog after a scan: rows of all pages (bag union) in scope, or the stale ones if none came and a page failed.

    found: rows by kind of page, of which missing columns are null; errors: a row for each page that failed.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    fresh = rows.where(search.in_scope(F.col("title"), F.col("category"), categories, substrings))
    failed = errors.agg((F.count("*") > 0).alias("failed"))  # one row
    old = stale.join(F.broadcast(failed), F.col("failed"), "left_semi")
    return with_stale_fallback(fresh, old.select(*[F.col(c) if c in old.columns else F.lit(None).alias(c) for c in fresh.columns]))


def covers(docs: DataFrame, catalog: DataFrame, least: float = 0.9) -> DataFrame:
    """One row: documents, catalog rows and whether the store has the least share of them, so that nothing is to be downloaded."""
    both = docs.agg(F.count("*").alias("documents")).crossJoin(F.broadcast(catalog.agg(F.count("*").alias("catalog_rows"))))
    return both.withColumn("complete", F.col("documents") >= F.col("catalog_rows") * least)


def patch_store(spark, folder: str, patches: DataFrame, dry_run: bool = False) -> DataFrame:
    """Patches documents and their chunks, tables of the store in the folder, in one commit; returns the rejected patches.

    If another writer changes one of the documents' parts meanwhile, the patch is
    made again from there. A dry run writes nothing.
    """
    known, held = patches.persist(), snapshots.Store(spark, folder)
    touched = tuple(sorted(r[0] for r in known.select(snapshots.part_of("document_id")).distinct().collect()))
    found = []

    def change(state):
        docs, chunks = (held.read(t, only=touched, state=state) for t in ("documents", "chunks"))
        new_docs, new_chunks, rejected = patched(docs, chunks, known)
        found.append(rejected)
        return None if dry_run else {"documents": snapshots.Change(new_docs, "document_id", touched), "chunks": snapshots.Change(new_chunks, "document_id", touched)}

    held.update(change)
    return found[-1]


def catalog_lookup(ids: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog row of each id that has one."""
    return ids.join(catalog, "document_id")


def edited(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits in turn on each document: document_id, content, error.

    edits: document_id, step, kind (replace, before, after), anchor, new. An
    anchor must occur exactly once in the text so far; the first that doesn't
    ends the document's edits with an error and its text stays as it was.
    """
    steps = edits.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("step", "kind", "anchor", "new"))).alias("steps"))
    start = F.struct(F.col("markdown_content").alias("content"), F.lit(None).cast("string").alias("error"))

    def apply(acc, e):
        n = markup.occurrences(acc["content"], e["anchor"])
        new = F.when(e["kind"] == "after", F.concat(e["anchor"], e["new"])).when(e["kind"] == "before", F.concat(e["new"], e["anchor"])).otherwise(e["new"])
        wrong = F.format_string("step %d: anchor occurs %d times", e["step"], n)
        error = F.coalesce(acc["error"], F.when(n != 1, wrong))
        return F.struct(F.when(error.isNull(), F.replace(acc["content"], e["anchor"], new)).otherwise(acc["content"]).alias("content"), error.alias("error"))

    done = docs.join(steps, "document_id").withColumn("r", F.aggregate("steps", start, apply))
    content = F.when(F.col("r.error").isNull(), F.col("r.content")).otherwise(F.col("markdown_content"))
    return done.select("document_id", content.alias("content"), F.col("r.error").alias("error"))


def patched(docs: DataFrame, chunks: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New documents, new chunks and rejected patches (document_id, issues); nothing is written.

    patches: document_id, content. A patch loses its dump header; one with
    LaTeX issues or of an unknown document is rejected.
    """
    new = patches.select("document_id", text.strip_dump_header(F.col("content")).alias("markdown_content"))
    known = docs.select("document_id", F.lit(True).alias("known"))
    checked = new.join(known, "document_id", "left").withColumn("issues", markup.latex_issues(F.col("markdown_content")))
    checked = checked.withColumn("issues", F.when(F.col("known").isNull(), F.concat(F.array(F.lit("unknown document")), "issues")).otherwise(F.col("issues")))
    good = checked.where(F.size("issues") == 0).select("document_id", "markdown_content")
    rows = docs.drop("markdown_content", "content_hash").join(good, "document_id").withColumn("content_hash", text.content_hash(F.col("markdown_content")))
    merged = store.upsert(docs, rows.select(*docs.columns))
    cut = store.chunk_table(rows).select(*chunks.columns)
    return merged, store.replace_children(chunks, cut), checked.where(F.size("issues") > 0).select("document_id", "issues")


def embedder(embed: Callable[[list[str]], list[list[float]]], prefix: str = "passage: ", batch: int = 32) -> Callable:
    """An embedding model as an Arrow UDF; it sees `batch` texts at a time."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), batch):
            out += embed([prefix + t for t in texts.iloc[at : at + batch]])
        return pd.Series(out)

    return run


def hashed_embedding(texts: list[str], size: int = 64) -> list[list[float]]:
    """A stand-in for a model: words hashed to signed places, unit length; where they cancel out, or there are none, the text's own hash names the place."""
    import zlib

    out = []
    for t in texts:
        v = [0.0] * size
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            v[h % size] += 1.0 if h & 0x10000 else -1.0
        if not any(v):
            v[zlib.crc32(t.encode()) % size] = 1.0
        norm = sum(x * x for x in v) ** 0.5
        out.append([x / norm for x in v])
    return out


def with_embeddings(chunks: DataFrame, model: Callable) -> DataFrame:
    """Chunks whose vector is missing get one; the others stay."""
    have = chunks.where("embedding IS NOT NULL")
    return have.unionByName(chunks.where("embedding IS NULL").withColumn("embedding", model("chunk_text")))


def rescue(candidates: DataFrame, fetch: Callable[[str], str], delay: float = 2.0) -> DataFrame:
    """document_id, ok, reason of fetching each candidate again, one at a time with a pause."""

    def run(batches):
        for batch in batches:
            ok, reason = [], []
            for name in batch["document_id"]:
                try:
                    done = bool(fetch(name))
                    ok.append(done)
                    reason.append(None if done else "empty")
                except (OSError, ValueError, RuntimeError) as error:
                    ok.append(False)
                    reason.append(f"{type(error).__name__}: {error}")
                time.sleep(delay)
            yield pd.DataFrame({"document_id": batch["document_id"], "ok": ok, "reason": reason})

    # one partition: the pause is a rate limit of the site; dealt anew, so that what makes the candidates runs in its own tasks
    return candidates.select("document_id").repartition(1).mapInPandas(run, "document_id string, ok boolean, reason string")


def start_up(steps: list[tuple[str, Callable[[], object]]], timeout: float = 300.0, clock=time.monotonic, spark=None, grace: float = 10.0) -> list[tuple[str, str]]:
    """Phases in order until the time is over; a phase that fails doesn't end the others.

    With a session each phase has its share of the time left. The Spark jobs of
    one that takes longer are cancelled by their tag, and the next phase begins;
    what else it does goes on in its own thread.
    """
    began, out = clock(), []
    for i, (name, step) in enumerate(steps):
        left = timeout - (clock() - began)
        if left <= 0:
            out.append((name, "skipped"))
            continue
        said: list[str] = []

        def run(step=step, said=said, tag=None):
            if tag:
                spark.sparkContext.addJobTag(tag)
            try:
                step()
                said.append("done")
            except Exception as error:  # noqa: BLE001  a phase may fail in any way
                said.append(f"failed: {error}")

        if spark is None:
            run()
        else:
            tag = f"start-up-{uuid.uuid4().hex}"
            thread = InheritableThread(target=lambda run=run, tag=tag: run(tag=tag))
            thread.daemon = True
            thread.start()
            thread.join(left / (len(steps) - i))
            if thread.is_alive():
                spark.sparkContext.cancelJobsWithTag(tag)
                thread.join(grace)
                said[:] = ["timed out"]
        out.append((name, said[0]))
    return out
