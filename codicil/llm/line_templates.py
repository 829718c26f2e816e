"""Line dedup with a log-template tree.

A line goes down a tree of fixed depth: by its number of tokens, then by its DEPTH leading tokens (tokens with digits
are variable and stand as one). In the leaf that it reaches, each token has the number of documents that have it at that position there.
The support of a line is the largest number that CONSTANT of its tokens reach: about the documents of its template, whatever else is in the leaf.
Leading tokens, and those of at least SHARE of the support (and MIN_DOCS), are constants, the others variable fields; the constants in
their places are the line's template. As fields are told by shares, a template gives the same result in few documents and in many.
Templates of a support of MIN_DOCS or more that MIN_DOCS documents or more hold recur: their lines are dropped, except in the first
document (by id) that has the template.

Steps: leaves with too few lines to recur are left out by a bitmap of a fixed size (2**BITS bits; a full one only lets more
lines through). Positions of the other leaves are counted in blocks of BLOCK, so that a leaf with very many different
lines is spread over partitions by position; equal lines are combined before they are sent. The counts of a line's blocks are gathered by line. Lines and templates meet in joins that
can be split where one line is in a great part of all documents.

Rules: empty lines stay and are never counted. A null text is empty, a null id comes before all others. Rows that repeat an id are the
same document. Documents that lose all their lines stay as empty texts (drop_recurring_lines leaves them out).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, SLICE, Carried, arrow_map, buckets_for, gathered, hex_sha, joined_rows, map_batches, mix, packed, packed_batch, pick, settled, texts_of

DEPTH, MIN_DOCS, CONSTANT, SHARE, BITS, BLOCK = 3, 10, 0.8, 0.25, 24, 8
NULL_ID = -(1 << 63)
_DIGIT = re.compile("[0-9]")
_hash = xxhash.xxh3_64_intdigest


def parse(line: str) -> tuple[int, int, list[str]] | None:
    """leaf, hash of the line with its variable tokens masked, tokens; None for an empty line."""
    tokens = line.split()
    if not tokens:
        return None
    if _DIGIT.search(line):
        tokens = ["\0" if _DIGIT.search(t) else t for t in tokens]
        joined = " ".join(tokens)
    else:
        joined = line if "  " not in line and "\t" not in line and not line[0].isspace() and not line[-1].isspace() else " ".join(tokens)
    leaf = _hash(f"{len(tokens)} {' '.join(tokens[:DEPTH])}".encode("utf-8", "surrogatepass"))
    return leaf, _hash(joined.encode("utf-8", "surrogatepass")), tokens


_LINE = np.dtype([("leaf", "<u8"), ("line", "<u8"), ("n", "<u4")])
_BLOCKED = np.dtype([("key", "<u8"), ("line", "<u8"), ("n", "<u4"), ("at", "<u4"), ("size", "<u4"), ("tok", "<u4", BLOCK)])
_COUNTED = np.dtype([("line", "<u8"), ("at", "<u4"), ("size", "<u4"), ("tok", "<u4", BLOCK), ("docs", "<u4", BLOCK)])


def _live_leaves(docs: DataFrame, min_docs: int) -> np.ndarray:
    """The bitmap of leaves whose lines are in min_docs documents or more, counting each line by itself."""
    buckets = buckets_for(docs.sparkSession)

    def counted(batch: pa.RecordBatch) -> list[tuple[int, int, bytes]]:
        pairs: list[tuple[int, int]] = []
        for text in texts_of(batch):
            pairs += {p[:2] for line in text.split("\n") if (p := parse(line))}
        found, n = np.unique(np.array(pairs, [("leaf", "<u8"), ("line", "<u8")]), return_counts=True)
        rec = np.empty(len(found), _LINE)
        rec["leaf"], rec["line"], rec["n"] = found["leaf"], found["line"], n
        return [(0, b, d) for b, d in packed(rec["leaf"], rec, buckets)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(packed_batch, joined_rows(counted(b.slice(at, SLICE)) for b in batches for at in range(0, b.num_rows, SLICE)))

    def receive(parts: Iterator[tuple[int, int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        width = max(1, (1 << BITS) // buckets)
        for _, bucket, data in parts:
            rec = np.frombuffer(b"".join(data), _LINE)
            leaf, of = np.unique(rec["leaf"], return_inverse=True)
            total = np.bincount(of, rec["n"], len(leaf))
            bits = np.zeros(width, np.uint8)
            bits[(leaf[total >= min_docs] >> np.uint64(64 - BITS)).astype(np.int64) - bucket * width] = 1
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bucket", "bits"])

    bitmap = np.zeros((1 << BITS) // 8, np.uint8)
    for r in gathered(map_batches(docs, send, PACKED), receive, "bucket int, bits binary").collect():
        bits = np.frombuffer(r.bits, np.uint8)
        bitmap[r.bucket * len(bits) : (r.bucket + 1) * len(bits)] = bits
    return bitmap


LINES, BLOCKS = 0, 1


def _live_lines(docs: DataFrame, live: np.ndarray) -> DataFrame:
    """LINES rows (doc, line) of lines in live leaves, and their tokens in BLOCKS rows, packed by leaf and block."""
    buckets = buckets_for(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(live)

    def blocks(batch: pa.RecordBatch, docs_: list, lines_: list) -> list[tuple[int, int, bytes]]:
        """The blocks of a slice; its (document, line) pairs are added to docs_ and lines_."""
        live = shared.value
        held: dict[int, list] = {}  # line: documents of the slice, leaf, tokens
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
            own = set()
            for raw in text.split("\n"):
                p = parse(raw)
                if p is None:
                    continue
                slot = p[0] >> (64 - BITS)
                if live[slot >> 3] >> (7 - (slot & 7)) & 1 and p[1] not in own:
                    own.add(p[1])
                    held.setdefault(p[1], [0, p[0], p[2]])[0] += 1
            docs_ += [NULL_ID if doc is None else doc] * len(own)
            lines_ += own
        rec = []
        for line, (n, leaf, tokens) in held.items():
            for at in range(0, len(tokens), BLOCK):
                toks = [_hash(t.encode("utf-8", "surrogatepass")) & 0xFFFFFFFF for t in tokens[at : at + BLOCK]]
                rec.append((_hash(f"{leaf} {at}".encode()), line, n, at, len(tokens), tuple(toks + [0] * (BLOCK - len(toks)))))
        rec = np.array(rec, _BLOCKED)
        return [(BLOCKS, b, d) for b, d in packed(rec["key"], rec, buckets)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_: list[int] = []
        lines_: list[int] = []
        for rows in joined_rows(blocks(b.slice(at, SLICE), docs_, lines_) for b in batches for at in range(0, b.num_rows, SLICE)):
            n, m = len(lines_), len(rows)
            lines = np.array(lines_, np.uint64).view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([LINES] * n + [BLOCKS] * m, pa.int32()),
                    pa.array([None] * n + [b for _, b, _ in rows], pa.int32()),
                    pa.array([None] * n + [d for _, _, d in rows], pa.binary()),
                    pa.array(docs_ + [None] * m, pa.int64()),
                    pa.array(lines + [None] * m, pa.int64()),
                ],
                ["kind", "bucket", "data", "doc", "line"],
            )
            docs_.clear()
            lines_.clear()

    return settled(map_batches(docs, send, PACKED + ", doc long, line long"))


def _counts(parts: Iterator[tuple[int, int, list[bytes]]], buckets: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Each line and block once, with the documents of each of its tokens, packed by line."""
    for _, _, data in parts:
        rec = np.frombuffer(b"".join(data), _BLOCKED)
        docs = np.zeros((len(rec), BLOCK), np.uint32)
        for i in range(BLOCK):
            here = rec["at"].astype(np.int64) + i < rec["size"]
            pair = mix(rec["key"] ^ mix(rec["tok"][:, i].astype(np.uint64) + np.uint64(1)))
            _, token = np.unique(pair, return_inverse=True)
            docs[:, i] = np.bincount(token, rec["n"] * here)[token]
        # equal lines of several slices come several times
        _, first = np.unique(np.stack([rec["key"], rec["line"]], axis=1), axis=0, return_index=True)
        out = np.empty(len(first), _COUNTED)
        for c in ("line", "at", "size", "tok"):
            out[c] = rec[c][first]
        out["docs"] = docs[first]
        yield [(BLOCKS, b, d) for b, d in packed(mix(out["line"]), out, buckets)]


def _templates(parts: Iterator[tuple[int, int, list[bytes]]], min_docs: int, constant: float) -> Iterator[pa.RecordBatch]:
    """line, template of the lines of enough support."""
    for _, _, data in parts:
        rec = np.frombuffer(b"".join(data), _COUNTED)
        rec = rec[np.lexsort((rec["at"], rec["line"]))]
        place = rec["at"].astype(np.int64)[:, None] + np.arange(BLOCK)
        here = place < rec["size"].astype(np.int64)[:, None]
        place, tok, docs = place[here], rec["tok"][here].astype(np.uint64), rec["docs"][here].astype(np.int64)
        line = np.repeat(rec["line"], here.sum(axis=1))
        start = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        size = np.diff(np.r_[start, len(line)])
        of = np.repeat(np.arange(len(start)), size)
        support = docs[np.lexsort((-docs, of))][start + np.maximum(1, np.ceil(constant * size).astype(np.int64)) - 1]
        fixed = (place < DEPTH) | (docs >= np.maximum(min_docs, SHARE * support)[of])
        value = np.where(fixed, tok + np.uint64(1), np.uint64(0))
        template = np.bitwise_xor.reduceat(mix(value + mix(place.astype(np.uint64) + np.uint64(7))), start) ^ mix(size.astype(np.uint64))
        enough = support >= min_docs
        yield pa.RecordBatch.from_arrays([pa.array(line[start][enough].view(np.int64)), pa.array(template[enough].view(np.int64))], ["line", "template"])


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> tuple[DataFrame, DataFrame]:
    """(template, n_docs, first_doc) of the templates that recur, and (doc, line, template) of the lines that have them."""
    base = pick(docs, doc_id="long", text="string")
    live = _live_lines(base, _live_leaves(base, min_docs))
    buckets = buckets_for(base.sparkSession)

    def counted(parts: Iterator[tuple[int, int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        yield from map(packed_batch, joined_rows(_counts(parts, buckets)))

    blocks = gathered(live.where(F.col("kind") == BLOCKS).select("kind", "bucket", "data"), counted, PACKED)
    # written, so that the joins below have shuffles on both sides, of which one can be split where a line or template is hot
    lines = settled(gathered(blocks, lambda parts: _templates(parts, min_docs, constant), "line long, template long"))
    held = settled(live.where(F.col("kind") == LINES).select("doc", "line").join(lines, "line"))
    templates = held.select("template", "doc").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc").alias("first_doc"))
    return settled(templates.where(F.col("n_docs") >= min_docs)), held


def _apply(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
        lines, gone = (text or "").split("\n"), {x & 0xFFFFFFFFFFFFFFFF for x in gone or ()}
        if gone:
            parsed = [parse(x) for x in lines]
            kept = [x for x, p in zip(lines, parsed) if p is None or p[1] not in gone]
            n = sum(p is not None for p in parsed)
        else:
            kept, n = lines, sum(1 for x in lines if x and not x.isspace())
        out.append((n, len(lines) - len(kept), "\n".join(kept)))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            *(batch.column(c) for c in batch.schema.names if c not in ("doc_id", "text", "gone")),
            pa.array([n for n, _, _ in out], pa.int64()),
            pa.array([d for _, d, _ in out], pa.int64()),
            pa.array([t for _, _, t in out], pa.string()),
            pa.array([hex_sha(t.encode("utf-8", "surrogatepass")) for _, _, t in out], pa.string()),
        ],
        ["doc_id", *(c for c in batch.schema.names if c not in ("doc_id", "text", "gone")), "n_lines", "n_dropped", "kept", "kept_sha256"],
    )


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT, keep: dict[str, str] | None = None) -> DataFrame:
    """doc_id, the columns of ``keep``, n_lines (with a token), n_dropped, kept (the text that stays), kept_sha256."""
    keep = keep or {}
    base = pick(docs, doc_id="long", text="string", **keep)
    templates, held = recurring(docs, min_docs, constant)
    gone = held.join(templates, "template").where("doc != first_doc").groupBy("doc").agg(F.collect_set("line").alias("gone"))
    # the lists grow with the documents: both are shuffled, whatever their size
    joined = base.join(gone.hint("merge"), F.coalesce("doc_id", F.lit(NULL_ID)) == gone.doc, "left").drop("doc")
    schema = "doc_id long" + "".join(f", {k} {v}" for k, v in keep.items()) + ", n_lines long, n_dropped long, kept string, kept_sha256 string"
    return arrow_map(joined, _apply, schema)


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """documents with the lines that stay; the same columns, n_chars counted anew. Documents that lost all their lines go."""
    table = Carried(docs)
    out = drop_lines(table.rows, min_docs, constant, table.kept)
    out = out.where((F.col("n_dropped") == 0) | (F.trim(F.translate("kept", "\n\t\r", "   ")) != "")).withColumnRenamed("kept", "text")
    changed = {"text": F.col("text")} if "text" in docs.columns else {}
    if "n_chars" in docs.columns:
        before = F.col(f"kept_{docs.columns.index('n_chars')}")
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(before)
    return table.back(out, **changed)
