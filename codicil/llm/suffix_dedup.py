"""Exact removal of repeated strings, by prefix-free parsing.

A string of SPAN bytes that also starts earlier (in a document of smaller id, or earlier in the
same one) is removed; overlaps count, and all strings are judged on the input.

Parsing: a rolling hash of GRAM bytes gives each position a rank; the trigger of a window of SPAN bytes is
the leftmost position of the least rank inside it, so equal windows have equal triggers at equal places. The
windows that share a trigger are neighbours; the text they cover is a phrase. Phrases overlap by less than a window,
no phrase can begin another of the same trigger and offset, and each window lies in exactly one of them: the phrases are
the dictionary, their order in the documents is the parse.

1. Triggers are counted by their hash. Those that occur once can't be part of a repeated window. The others are put
   in a bitmap of a fixed size (BITS bits, whatever the input; a full one lets more phrases through, no fewer).
2. Phrases of triggers in the bitmap are shuffled by trigger. In a partition equal phrases are dictionary
   entries with their places in the parse: all but the first are repeated as a whole. For the first ones the suffixes
   (of SPAN bytes) of the dictionary are sorted, ties by place in the corpus; all but the first of equal suffixes are repeated.
   Triggers that occur very often (at most HOT of them can) are not brought together: their windows go to
   partitions by their own hashes, after being combined on the sending side.
3. The removed ranges of each document are merged and cut out.

Suffixes are ordered by 64-bit fingerprints of their SPAN bytes, since only their equality matters, not which is smaller. Phrases and suffixes
count as equal only if their triggers' hashes are equal as well, so that a fingerprint has to tell apart no more than what shares a trigger
(windows of very frequent triggers go by the fingerprint alone).

Rules: a null text is empty; a null id comes before all others. Rows that repeat an id are the same document: a
string at the same place of it isn't earlier. Texts shorter than SPAN bytes are never touched. Documents of any length
are taken whole, in pieces that overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, arrow_map, bucket_of, buckets_for, gathered, hex_sha, joined_rows, map_batches, mix, packed, packed_batch, pick

SPAN, GRAM = 100, 32
#: log2 of the bits of the bitmap; triggers that may count as very frequent; bytes of text handled at once.
BITS, HOT, PIECE = 27, 20_000, 1 << 19
_WIDE = SPAN - GRAM + 1
_BASE = 0x9E3779B97F4A7C15
_POWER = [np.uint64(pow(_BASE, 1 << i, 1 << 64)) for i in range(6)]  # base ** (2 ** i)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
NULL_ID = -(1 << 63)

_PHRASE = np.dtype([("h", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("n", "u1"), ("d", "u1")])  # trigger, place of the first window, windows, trigger's offset
_WINDOW = np.dtype([("w", "<u8"), ("doc", "<i8"), ("at", "<i4")])
_RANGE = np.dtype([("doc", "<i8"), ("a", "<i4"), ("b", "<i4")])
_COUNT = np.dtype([("h", "<u8"), ("n", "<u4")])
PHRASES, WINDOWS, RANGES = range(3)


class Hashes:
    """Polynomial hashes of the runs of 4 and GRAM bytes of a text."""

    def __init__(self, raw: np.ndarray):
        h = _BYTE[raw]
        for i in range(5):
            step = 1 << i
            h = h[:-step] * _POWER[i] + h[step:] if len(h) > step else h[:0]
            if i == 1:
                self.four = h
        self.gram = h

    def span(self, at: np.ndarray) -> np.ndarray:
        """Of the SPAN = 3 * 32 + 4 bytes from each position."""
        g, p = self.gram, _POWER[5]
        return mix(((g[at] * p + g[at + 32]) * p + g[at + 64]) * _POWER[2] + self.four[at + 96])


class Parsed:
    """The phrases of some pieces of text, laid end to end."""

    def __init__(self, pieces: list[tuple[int, int, bytes]]):
        """pieces: (id, offset in the document, bytes); windows start in a piece so that all of them lie inside."""
        self.raw = np.frombuffer(b"".join(b for _, _, b in pieces), np.uint8)
        size = np.array([len(b) for _, _, b in pieces])
        first = np.cumsum(size) - size
        self.hashes = Hashes(self.raw)
        n = len(self.hashes.gram) - _WIDE + 1
        windows = np.maximum(size - SPAN + 1, 0)
        if n <= 0 or not windows.sum():
            self.start = self.n = self.d = self.trigger = self.h = np.zeros(0, np.int64)
            self.doc, self.at = self.start, self.start
            return
        g = self.hashes.gram
        g = (g ^ (g >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        low = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16, 32):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[:n], low[_WIDE - 64 : _WIDE - 64 + n])
        trigger = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = np.zeros(n + 1, np.int8)
        has = windows > 0
        np.add.at(inside, first[has], 1)
        np.add.at(inside, (first + windows)[has], -1)
        at = np.flatnonzero(np.cumsum(inside)[:n])
        owner = np.searchsorted(first, at, "right") - 1
        t = trigger[at]
        cut = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (owner[1:] != owner[:-1])])
        self.start, self.trigger = at[cut], t[cut]
        self.n = np.diff(np.r_[cut, len(at)])
        self.d = self.trigger - self.start
        self.h = mix(self.hashes.gram[self.trigger])
        own = owner[cut]
        self.doc = np.array([i for i, _, _ in pieces], np.int64)[own]
        self.at = self.start - first[own] + np.array([o for _, o, _ in pieces], np.int64)[own]


def phrase_key(hashes: Hashes, start: np.ndarray, n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Of a whole phrase: its first and last window cover it, as it is shorter than two."""
    shape = n.astype(np.uint64) << np.uint64(8) | d.astype(np.uint64)
    return mix(hashes.span(start) ^ mix(hashes.span(start + n - 1) + shape * np.uint64(_BASE)))


def pieces_of(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, bytes]]]:
    """The documents of a batch in lists of about PIECE bytes; long ones are cut, with SPAN - 1 bytes of overlap."""
    pieces, size = [], 0
    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        raw = (text or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(raw) - SPAN + 1), PIECE):
            part = raw[at : at + PIECE + SPAN - 1]
            if len(part) < SPAN:
                continue
            pieces.append((NULL_ID if doc is None else doc, at, part))
            size += len(part)
            if size >= PIECE:
                yield pieces
                pieces, size = [], 0
    if pieces:
        yield pieces


def later(key: np.ndarray, doc: np.ndarray, at: np.ndarray, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first of each key (and trigger h), by (doc, at), and of those that come later. What stands at the first's own place is neither."""
    order = np.lexsort((at, doc, key) if h is None else (at, doc, h, key))
    head = np.r_[True, key[order[1:]] != key[order[:-1]]]
    if h is not None:
        head[1:] |= h[order[1:]] != h[order[:-1]]
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    after = (doc[order] != doc[lead]) | (at[order] != at[lead])
    return order[head], order[after]


def ranges(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(doc), _RANGE)
    out["doc"], out["a"], out["b"] = doc, a, b
    return out


def merge_ranges(r: np.ndarray) -> np.ndarray:
    """Sorted, overlapping and touching ranges of a document as one."""
    if not len(r):
        return r
    r = r[np.lexsort((r["a"], r["doc"]))]
    new_doc = np.r_[True, r["doc"][1:] != r["doc"][:-1]]
    group = np.cumsum(new_doc).astype(np.int64)
    reach = np.maximum.accumulate(r["b"].astype(np.int64) + (group << 32)) - (group << 32)  # the furthest end so far in the document
    head = new_doc | np.r_[True, r["a"][1:] > reach[:-1]]
    at = np.flatnonzero(head)
    return ranges(r["doc"][at], r["a"][at], reach[np.r_[at[1:], len(r)] - 1])


# ---- the three steps --------------------------------------------------------------------------------------------


def repeated_triggers(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of the triggers that occur twice or more, by the first BITS bits of their hash, and the sorted hashes of those too
    frequent to bring together: more than one in HOT of all phrases, so fewer than HOT."""
    buckets = buckets_for(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
        for batch in batches:
            for pieces in pieces_of(batch):
                h, n = np.unique(Parsed(pieces).h.astype(np.uint64), return_counts=True)
                rec = np.empty(len(h), _COUNT)
                rec["h"], rec["n"] = h, n
                yield [(0, b, d) for b, d in packed(h, rec, buckets)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(packed_batch, joined_rows(counted(batches)))

    def total(parts: Iterator[tuple[int, int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        width = max(1, (1 << BITS) // buckets)
        for _, bucket, data in parts:
            rec = np.frombuffer(b"".join(data), _COUNT)
            rec = rec[np.argsort(rec["h"], kind="stable")]
            at = np.flatnonzero(np.r_[True, rec["h"][1:] != rec["h"][:-1]])
            n, h = np.add.reduceat(rec["n"].astype(np.int64), at), rec["h"][at]
            bits = np.zeros(width, np.uint8)
            slot = (h[n > 1] >> np.uint64(64 - BITS)).astype(np.int64)
            bits[slot - bucket * width] = 1
            often = h[n >= 1000]
            top = np.empty(len(often), _COUNT)
            top["h"], top["n"] = often, np.minimum(n[n >= 1000], 0xFFFFFFFF)
            # of its most frequent triggers a partition can only have so many
            top = top[np.argsort(-top["n"].astype(np.int64), kind="stable")][: max(64, 4 * HOT // buckets)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary()), pa.array([top.tobytes()], pa.binary()), pa.array([int(n.sum())], pa.int64())],
                ["bucket", "bits", "often", "n"],
            )

    found = gathered(map_batches(docs, count, PACKED), total, "bucket int, bits binary, often binary, n long").collect()
    bitmap = np.zeros((1 << BITS) // 8, np.uint8)
    for r in found:
        bits = np.frombuffer(r.bits, np.uint8)
        bitmap[r.bucket * len(bits) : (r.bucket + 1) * len(bits)] = bits
    often = np.frombuffer(b"".join(bytes(r.often) for r in found), _COUNT)
    limit = max(1000, sum(r.n for r in found) // HOT)
    return bitmap, np.sort(often["h"][often["n"] > limit])


def removed_ranges(docs: DataFrame) -> DataFrame:
    """key, spans: a document's ranges to remove (pairs of little-endian 32-bit integers, merged)."""
    spark = docs.sparkSession
    buckets = buckets_for(spark)
    shared = spark.sparkContext.broadcast(repeated_triggers(docs))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
        bitmap, hot = shared.value
        for batch in batches:
            for pieces in pieces_of(batch):
                p = Parsed(pieces)
                if not len(p.h):
                    continue
                h = p.h
                slot = (h >> np.uint64(64 - BITS)).astype(np.int64)
                use = np.flatnonzero(bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
                if not len(use):
                    continue
                key = phrase_key(p.hashes, p.start[use], p.n[use], p.d[use])
                head, again = later(key, p.doc[use], p.at[use], h[use])
                done, use = use[again], use[np.sort(head)]
                gone = [ranges(p.doc[done], p.at[done], p.at[done] + p.n[done] + SPAN - 1)]
                often = hot[np.minimum(np.searchsorted(hot, h[use]), len(hot) - 1)] == h[use] if len(hot) else np.zeros(len(use), bool)
                rows = []
                if often.any():
                    s = use[often]
                    which = np.repeat(s, p.n[s])
                    step = np.arange(len(which)) - np.repeat(np.cumsum(p.n[s]) - p.n[s], p.n[s])
                    win = np.empty(len(which), _WINDOW)
                    win["w"], win["doc"], win["at"] = p.hashes.span(p.start[which] + step), p.doc[which], p.at[which] + step
                    head, again = later(win["w"], win["doc"], win["at"])
                    gone.append(ranges(win["doc"][again], win["at"][again], win["at"][again] + SPAN))
                    rows += [(WINDOWS, b, d) for b, d in packed(win["w"][head], win[head], buckets)]
                s = use[~often]
                bucket = bucket_of(h[s], buckets)
                s = s[np.argsort(bucket, kind="stable")]
                bucket = np.sort(bucket)
                rec = np.empty(len(s), _PHRASE)
                rec["h"], rec["doc"], rec["at"], rec["n"], rec["d"] = h[s], p.doc[s], p.at[s], p.n[s], p.d[s]
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(s) else [0]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    texts = [p.raw[x : x + n + SPAN - 1].tobytes() for x, n in zip(p.start[s[a:b]].tolist(), p.n[s[a:b]].tolist())]
                    size = sum(map(len, texts))
                    rows.append((PHRASES, int(bucket[a]), b"".join([np.array([b - a, size], np.int32).tobytes(), rec[a:b].tobytes(), *texts])))
                every = merge_ranges(np.concatenate(gone))
                yield rows + by_document(every)

    def by_document(every: np.ndarray) -> list[tuple[int, int, bytes]]:
        return [(RANGES, b, d) for b, d in packed(mix(every["doc"].astype(np.uint64)), every, buckets)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(packed_batch, joined_rows(parsed(batches)))

    def receive(parts: Iterator[tuple[int, int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        gone = []
        for kind, _, data in parts:
            if kind == RANGES:
                gone.append(np.frombuffer(b"".join(data), _RANGE))
            elif kind == WINDOWS:
                win = np.frombuffer(b"".join(data), _WINDOW)
                _, again = later(win["w"], win["doc"], win["at"])
                gone.append(ranges(win["doc"][again], win["at"][again], win["at"][again] + SPAN))
            else:
                gone += compare_phrases(data)
            if len(gone) > 32:
                gone = [merge_ranges(np.concatenate(gone))]
        if gone:
            yield packed_batch(by_document(merge_ranges(np.concatenate(gone))))

    def merge(parts: Iterator[tuple[int, int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        for _, _, data in parts:
            every = merge_ranges(np.frombuffer(b"".join(data), _RANGE))
            cuts = np.flatnonzero(np.r_[True, every["doc"][1:] != every["doc"][:-1], True])
            spans = np.stack([every["a"], every["b"]], axis=1).astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [pa.array(every["doc"][cuts[:-1]]), pa.array([spans[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], ["key", "spans"]
            )

    found = gathered(map_batches(docs, send, PACKED), receive, PACKED)
    return gathered(found, merge, "key long, spans binary")


def in_order(w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes by fingerprint and trigger, equal ones as they stand, and which of them equal the one before."""
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if (same & (h[order[1:]] != h[order[:-1]])).any():  # suffixes of different triggers with one fingerprint
        order = np.lexsort((h, w))
        same = (w[order[1:]] == w[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
    return order, np.r_[False, same]


def compare_phrases(data: list[bytes]) -> list[np.ndarray]:
    """What is repeated in the phrases of a bucket."""
    recs, texts = [], []
    for d in data:
        at = 0
        while at < len(d):
            n, size = np.frombuffer(d, np.int32, 2, at).tolist()
            recs.append(np.frombuffer(d, _PHRASE, n, at + 8))
            at += 8 + n * _PHRASE.itemsize
            texts.append(d[at : at + size])
            at += size
    rec, raw = np.concatenate(recs), np.frombuffer(b"".join(texts), np.uint8)
    size = rec["n"].astype(np.int64) + SPAN - 1
    start = np.cumsum(size) - size
    hashes = Hashes(raw)
    n = rec["n"].astype(np.int64)
    key = phrase_key(hashes, start, n, rec["d"].astype(np.int64))
    head, again = later(key, rec["doc"], rec["at"], rec["h"])
    gone = [ranges(rec["doc"][again], rec["at"][again], rec["at"][again] + size[again])]
    # phrases of a trigger that has others: their windows, in the order of the corpus
    h = np.sort(rec["h"][head])
    several = h[1:][h[1:] == h[:-1]]
    head = head[np.isin(rec["h"][head], several)]
    head = head[np.lexsort((rec["at"][head], rec["doc"][head]))]
    if len(head):
        which = np.repeat(head, n[head])
        step = np.arange(len(which)) - np.repeat(np.cumsum(n[head]) - n[head], n[head])
        w, doc, at = hashes.span(start[which] + step), rec["doc"][which], rec["at"][which] + step
        order, same = in_order(w, rec["h"][which])
        lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        again = order[same & ((doc[order] != doc[lead]) | (at[order] != at[lead]))]
        gone.append(merge_ranges(ranges(doc[again], at[again], at[again] + SPAN)))
    return gone


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
        raw = (text or "").encode("utf-8", "surrogatepass")
        at, kept, gone = 0, [], []
        for a, b in np.frombuffer(spans or b"", "<i4").reshape(-1, 2).tolist():
            kept.append(raw[at:a])
            gone.append({"start": a, "end": b})
            at = b
        kept.append(raw[at:])
        out.append((len(raw), sum(g["end"] - g["start"] for g in gone), len(gone), b"".join(kept), gone))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            *(pa.array([o[i] for o in out], pa.int64()) for i in range(3)),
            pa.array([hex_sha(o[3]) for o in out], pa.string()),
            pa.array([o[3] for o in out], pa.binary()),
            pa.array([o[4] for o in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
    )


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay), spans (byte ranges removed) of each document."""
    base = pick(docs, doc_id="long", text="string")
    found = removed_ranges(base)
    joined = base.join(found, F.coalesce("doc_id", F.lit(NULL_ID)) == found.key, "left").select("doc_id", "text", "spans")
    return arrow_map(joined, _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>")
