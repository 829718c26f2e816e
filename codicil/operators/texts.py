"""From pages to stored texts and chunks: source, text, hash, chunks, and what the run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.functions.chunks import MAX_CHARS, chunked
from codicil.functions.pages import decode_page, page_text
from codicil.functions.text import content_hash, picked_source, summary_text

LEAST_TEXT = 80


def process_texts(regulations: DataFrame, pages: DataFrame, stored: DataFrame, force: bool = False, most: int = MAX_CHARS, limit: int | None = None) -> DataFrame:
    """status of each regulation (saved, unchanged, failed), reason, source, source_url, content, content_hash and its chunks.

    pages: id, source, ok, reason, body, content_type of the pages that could be had; a regulation without a published text is described by its
    summary, as one chunk. Texts whose hash is stored already are unchanged, unless forced. With ``limit`` only so many regulations are taken, the oldest ids first."""
    regulations = regulations if limit is None else regulations.orderBy("id").limit(limit)
    source, url = picked_source(F.col("updated_text_url"), F.col("original_text_url"))
    wanted = regulations.withColumns({"_source": source, "_url": url})
    p = pages.select(F.col("id").alias("_id"), F.col("source").alias("_from"), "ok", F.col("reason").alias("_why"), decode_page(F.col("body"), F.col("content_type")).alias("_page"))
    rows = wanted.join(p, (wanted.id == p._id) & (wanted._source == p._from), "left")
    summary = summary_text(F.col("type"), F.col("number"), F.col("topic"), F.col("title"), F.col("summary"))
    rows = rows.select(
        F.col("id").alias("regulation_id"), F.coalesce("_source", F.lit("summary")).alias("source"), F.col("_url").alias("source_url"), "ok", "_why",
        F.when(F.col("_source").isNull(), summary).otherwise(page_text(F.col("_page"))).alias("content"),
    )
    is_summary = F.col("source") == "summary"
    reason = (
        F.when(is_summary & (F.coalesce("content", F.lit("")) == ""), "no text and no summary")
        .when(~is_summary & F.col("ok").isNull(), "not in cache")
        .when(~is_summary & ~F.col("ok"), F.coalesce("_why", F.lit("failed")))
        .when(~is_summary & (F.length("content") < LEAST_TEXT), "page has no text")
    )
    rows = rows.withColumn("reason", reason).withColumn("content_hash", F.when(F.col("reason").isNull(), content_hash(F.col("content"))))
    old = stored.select("regulation_id", F.col("content_hash").alias("_old"))
    rows = rows.join(old, "regulation_id", "left")
    same = F.lit(not force) & F.coalesce(F.col("_old") == F.col("content_hash"), F.lit(False))
    rows = rows.withColumn("status", F.when(F.col("reason").isNotNull(), "failed").when(same, "unchanged").otherwise("saved"))
    one = F.array(F.struct(F.lit(0).alias("ordinal"), F.lit("summary").alias("section"), F.lit(None).cast("string").alias("label"), F.col("content").alias("content")))
    cut = F.when(F.col("status") == "saved", F.when(is_summary, one).otherwise(chunked(F.col("content"), most)))
    return rows.select("regulation_id", "status", "reason", "source", "source_url", "content", "content_hash", cut.alias("chunks"))


def text_report(rows: DataFrame) -> DataFrame:
    """One row of counters; failure reasons are counted by failure_reasons()."""
    count = lambda s: F.count_if(F.col("status") == s)
    return rows.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if((F.col("source") == "summary") & F.coalesce(F.col("reason") != "no text and no summary", F.lit(True))).alias("summaries"),
        count("unchanged").alias("unchanged"), count("saved").alias("saved"), count("failed").alias("failed"),
        F.coalesce(F.sum(F.size("chunks").cast("long")), F.lit(0)).alias("chunks"),
    )


def failure_reasons(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def chunk_rows(rows: DataFrame) -> DataFrame:
    """regulation_id, ordinal, section, label, content of what was saved."""
    return rows.where("status = 'saved'").select("regulation_id", F.inline("chunks"))
