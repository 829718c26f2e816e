"""Quality rules: word and line statistics of each document, and line frequency across documents.

Lines are normalised (lower case, runs of white space as one space, trimmed) and hashed;
the distinct documents of each host that hold a line are counted. A line held by more than
``max(line_docs, line_share * documents of the host)`` documents is boilerplate of the host
and counts as removed; a document that keeps less than ``left_share`` of its words is
depleted and rejected, as is one that fails the base rules.

Rules: a null text has no words (so it fails), a null host is a host of its own, empty lines
are never counted. Repeated rows count as documents of their own and get the same verdict.
Counting is pre-aggregated before the shuffle, so that a line which a host repeats in all of its
documents arrives as one row a task. The lines above the limit are at most
(words a document) / line_share for each host, as each takes that share of its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Carried, arrow_map, pick, texts_of

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
LINE_DOCS, LINE_SHARE, LEFT_SHARE = 20, 0.10, 0.30
_SYMBOLS, _SPACE = b"#*$%&|<>", b" \t\n\v\f\r"
_M = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes]) -> int:
    """Words inside runs of WINDOW words that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    if len(number) == len(ids):
        return 0
    x = np.array(ids, np.uint64) + np.uint64(1)
    x = x * _M
    x ^= x >> np.uint64(29)
    key = x[:n].copy()
    for i in range(1, WINDOW):
        key = key * _M + x[i : i + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n + 1, np.int64)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice[:n])
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at the six ASCII white-space characters only
    bare = raw.translate(None, _SPACE)
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
    return (
        len(words),
        len(text) - (len(raw) - len(bare)),
        len(bare) - len(bare.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _lines(text: Column) -> Column:
    flat = F.regexp_replace(F.lower(text), r"[\x20\t\x0B\f\r]+", " ")
    return F.filter(F.transform(F.split(flat, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def quality(
    docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left_share: float = LEFT_SHARE,
    keep_hash: bool = False,
) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, n_removed_words (words in lines above the limit); with keep_hash also
    th, the hash of the text."""
    base = pick(docs, doc_id="long", text="string", **{host: "string"}).withColumnRenamed(host, "host")
    stats = base.withColumn("th", F.xxhash64("text"))
    counted = arrow_map(
        stats,
        _count_batch,
        "doc_id long, th long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long",
    )
    removed = removed_words(stats, line_docs, line_share).withColumnsRenamed({"doc_id": "r_doc", "th": "r_th"})
    joined = counted.join(removed, counted.doc_id.eqNullSafe(F.col("r_doc")) & (counted.th == F.col("r_th")), "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    gone = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ((F.col("n_words") - gone) >= left_share * F.col("n_words"))).alias("kept"),
        gone.alias("n_removed_words"),
        *["th"] * keep_hash,
    )


def removed_words(stats: DataFrame, line_docs: int, line_share: float) -> DataFrame:
    """doc_id, th, n_removed_words of the documents (doc_id, th, host, text) that hold lines above the limit."""
    lines = stats.where("text is not null").select("host", F.explode(F.array_distinct(_lines(F.col("text")))).alias("line"))
    held = lines.groupBy("host", F.xxhash64("line").alias("line")).agg(F.count(F.lit(1)).alias("n"))
    hosts = stats.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    limit = F.greatest(F.lit(float(line_docs)), line_share * F.col("host_docs"))
    above = held.where(F.col("n") > line_docs).join(hosts, held.host.eqNullSafe(hosts.host)).where(F.col("n") > limit).select(held.host.alias("a_host"), F.col("line").alias("a_line"))
    every = stats.where("text is not null").select("doc_id", "th", "host", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    every = every.select("doc_id", "th", "host", "at", F.xxhash64("line").alias("line"), F.size(F.split("line", " ")).cast("long").alias("words"))
    hit = every.join(above, every.host.eqNullSafe(above.a_host) & (every.line == above.a_line))
    # repeated rows have the same id, text, position and words: each position counts once
    once = hit.groupBy("doc_id", "th", "at").agg(F.max("words").alias("words"))
    return once.groupBy("doc_id", "th").agg(F.sum("words").alias("n_removed_words"))


def _count_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [text_counts(t) for t in texts_of(batch)]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("th"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(5))],
        ["doc_id", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
    )


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """documents without those rejected; the same columns. A rejected pair (doc_id, text) goes in all its rows."""
    bad = quality(docs, host, keep_hash=True).where("not kept").select(F.col("doc_id").alias("bad_doc"), F.col("th").alias("bad_th")).distinct()
    table = Carried(docs)
    return table.back(table.rows.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_doc")) & (F.xxhash64("text") == F.col("bad_th")), "left_anti"))
