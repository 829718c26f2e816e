"""Benchmark decontamination with training suffix arrays.

Each batch of documents is a shard. Its words become numbers (by the words of the
benchmark), its suffixes are sorted, and every suffix of every benchmark item is
looked up in that order by binary search. Suffixes of the shard that don't begin with
a k-word run of the benchmark (k: the words every match has at least) can't match and
are left out of the array before sorting; sorting goes as deep as a window is long.
Windows that items share are looked up once, and matches are carried on word by word to
their full length in the sorted suffixes of the benchmark, so that a prompt that all
items begin with costs no more than one of them.

Rules: words are runs of a-z, 0-9 and code points above 127, after lower-casing A-Z. A
window is ``window`` consecutive words of an item; an item of fewer words, but not none,
is one window. Null and empty texts have no words and are never hit; items without words
or without an id are never found (an item's null id drops it). Repeated items count once
for each id. Repeated documents give repeated rows.

The benchmark is dealt by hash to blocks of a bounded number of bytes, which are written; one block after the other is read, broadcast and
held against all documents, and what blocks hit is merged by document (id and text), so that the number of blocks changes no result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, arrow_map, hex_sha, pick, settled, texts_of

#: Bytes of benchmark text in a block at most (a single longer item is a block of its own).
BLOCK_BYTES = 8 << 20

#: Lower-cases A-Z and turns what is no word byte into a space; bytes above 127 are parts of words.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Block:
    """Part of the benchmark, ready for search: its different windows, each with the items that hold it, and its suffixes in order."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.ids = np.array([i for i, _ in items], np.int64)
        seqs = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in ws], np.int64) for _, ws in items]
        self.least = min([window, *map(len, seqs)])
        self.k = min(3, self.least)
        base = len(self.number) + 2
        while self.k > 1 and base**self.k > 2**62:
            self.k -= 1
        self.base = base
        self.runs = np.unique(np.concatenate([self.run_keys(s) for s in seqs])) if seqs else np.zeros(0, np.int64)
        # items one after the other, a 0, which is no word, after each; a window at each start, an item of fewer words being one
        lengths = np.array([len(s) for s in seqs], np.int64)
        first = np.cumsum(lengths + 1) - lengths - 1
        self.words = np.concatenate([np.append(s, 0) for s in seqs]) if seqs else np.zeros(1, np.int64)
        n = np.maximum(1, lengths - window + 1)
        owner = np.repeat(np.arange(len(seqs)), n)
        starts = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        size = np.minimum(window, lengths)[owner]
        rows = self.words[np.minimum(starts[:, None] + np.arange(window), len(self.words) - 1)]
        rows[np.arange(window)[None, :] >= size[:, None]] = 0
        # windows that several items share are one
        _, at, which = np.unique(as_keys(rows), return_index=True, return_inverse=True)
        self.suffix, self.size = rows[at], size[at]
        held = np.unique(np.stack([which.ravel(), owner], 1), axis=0) if len(owner) else np.zeros((0, 2), np.int64)
        self.holder, self.held = held[:, 1], np.searchsorted(held[:, 0], np.arange(len(at) + 1))
        # the suffixes that begin with a whole window, in the order of all their words: those of one window lie together
        whole = np.flatnonzero(size == window)
        whole = whole[np.argsort(suffix_ranks(self.words, int(lengths.max(initial=0)))[starts[whole]], kind="stable")]
        self.order = starts[whole]
        self.low, self.high = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        of = which.ravel()[whole]
        begins = np.flatnonzero(np.diff(of, prepend=-1))
        self.low[of[begins]], self.high[of[begins]] = begins, np.append(begins[1:], len(of))

    def run_keys(self, s: np.ndarray) -> np.ndarray:
        n = len(s) - self.k + 1
        key = np.zeros(max(n, 0), np.int64)
        for i in range(self.k):
            key = key * self.base + s[i : i + n] if n > 0 else key
        return key

    def items_with(self, windows: np.ndarray) -> set[int]:
        """The ids of the items that hold any of the windows."""
        found = [self.holder[self.held[w] : self.held[w + 1]] for w in windows]
        return set(self.ids[np.unique(np.concatenate(found))].tolist()) if found else set()

    def _bound(self, low: np.ndarray, high: np.ndarray, word: np.ndarray, depth: int, after: bool) -> np.ndarray:
        """Where word stands, or ends, among the suffixes of each range, which agree up to ``depth``."""
        low, high = low.copy(), high.copy()
        while (still := low < high).any():
            mid = (low + high) // 2
            v = self.words[np.minimum(self.order[np.minimum(mid, len(self.order) - 1)] + depth, len(self.words) - 1)]
            up = still & ((v <= word) if after else (v < word))
            low, high = np.where(up, mid + 1, low), np.where(still & ~up, mid, high)
        return low

    def longest(self, which: np.ndarray, at: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """How many words from each place ``at`` of seq, where a window stands, stand so in some item: the range of suffixes that agree is narrowed a word at a time."""
        size, low, high = self.size[which].copy(), self.low[which], self.high[which]
        on, depth = np.flatnonzero(size == self.window), self.window
        while len(on):
            word = seq[at[on] + depth]
            on, word = on[word > 0], word[word > 0]
            a, b = self._bound(low[on], high[on], word, depth, False), self._bound(low[on], high[on], word, depth, True)
            on, a, b = on[b > a], a[b > a], b[b > a]
            low[on], high[on] = a, b
            size[on] += 1
            depth += 1
        return size


def suffix_ranks(words: np.ndarray, longest: int) -> np.ndarray:
    """The ranks of all suffixes by their first ``longest`` words at least, by doubling the length that they are sorted by."""
    _, rank = np.unique(words, return_inverse=True)
    rank, known = rank.astype(np.int64).ravel(), 1
    while known <= longest and rank.max(initial=0) + 1 < len(rank):
        later = np.zeros(len(rank), np.int64)
        later[: max(0, len(rank) - known)] = rank[known:] + 1
        _, rank = np.unique(rank * (len(rank) + 1) + later, return_inverse=True)
        rank, known = rank.astype(np.int64).ravel(), 2 * known
    return rank


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort alike."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


class Shard:
    """The suffix array of a batch of documents, over the suffixes that can match."""

    def __init__(self, block: Block, docs: list[list[bytes]]):
        self.block, window = block, block.window
        get = block.number.get
        self.lengths = np.array([len(d) for d in docs], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths + 1)])  # a 0 stands between documents
        self.seq = np.zeros(self.first[-1] + window, np.int64)
        for a, d in zip(self.first, docs):
            self.seq[a : a + len(d)] = [get(w, 0) for w in d]
        s = self.seq
        can = np.flatnonzero(s[: self.first[-1]])
        for i in range(1, block.k):
            can = can[s[can + i] > 0]
        key = np.zeros(len(can), np.int64)
        for i in range(block.k):
            key = key * block.base + s[can + i]
        at = np.searchsorted(block.runs, key)
        can = can[(at < len(block.runs)) & (block.runs[np.minimum(at, max(0, len(block.runs) - 1))] == key)] if len(block.runs) else can[:0]
        keys = as_keys(s[can[:, None] + np.arange(window)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], can[order]

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """(window of the benchmark, position in the shard): a window for each length that stands at a position, whoever holds it."""
        b = self.block
        low = as_keys(b.suffix)
        high = b.suffix.copy()
        high[np.arange(b.window)[None, :] >= b.size[:, None]] = 0xFFFFFFFF  # a shorter item matches whatever follows
        left, right = np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, as_keys(high), "right")
        n = right - left
        which = np.repeat(np.arange(len(n)), n)
        rank = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)
        return which, self.at[rank]


def _find(block: Block, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[int], int]]:
    """For each document its hit word ranges, apart from each other, the items found, and the words of its longest match."""
    shard = Shard(block, docs)
    which, at = shard.matches()
    doc = np.searchsorted(shard.first, at, "right") - 1
    most = np.zeros(len(docs), np.int64)
    np.maximum.at(most, doc, block.longest(which, at, shard.seq))
    change = np.zeros(len(shard.seq) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + block.size[which], -1)
    edges = np.flatnonzero(np.diff(np.cumsum(change) > 0, prepend=False)).reshape(-1, 2)
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    for d, a, b in zip((np.searchsorted(shard.first, edges[:, 0], "right") - 1).tolist(), *edges.T.tolist()):
        start = int(shard.first[d])
        spans[d].append((a - start, b - start))
    pairs = np.unique(doc * max(1, len(block.size)) + which)
    owner, windows = np.divmod(pairs, max(1, len(block.size)))
    ends = np.searchsorted(owner, np.arange(len(docs) + 1))
    known: dict[bytes, set[int]] = {}  # documents that hold the same windows hold the same items
    items = []
    for d in range(len(docs)):
        own = windows[ends[d] : ends[d + 1]]
        if (key := own.tobytes()) not in known:
            known[key] = block.items_with(own)
        items.append(known[key])
    return list(zip(spans, items, most.tolist()))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks_of(benchmark: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The items with a block number, so that a block has ``limit`` bytes at most or a single item, and the number of blocks."""
    items = pick(benchmark, item_id="long", text="string").where("item_id is not null and text is not null").distinct()
    items = settled(items.select("*", (F.octet_length("text") + 8).alias("bytes"), F.xxhash64("item_id", "text").alias("h")))
    total = items.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first().n
    blocks = 1 if total <= limit else 2 * -(-total // limit)
    while blocks > 1:
        full = items.groupBy(F.pmod("h", F.lit(blocks))).agg(F.sum("bytes").alias("n"), F.count(F.lit(1)).alias("items")).where((F.col("n") > limit) & (F.col("items") > 1))
        if full.isEmpty():
            break
        blocks *= 2
    return items.withColumn("block", F.pmod("h", F.lit(blocks))), blocks


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, spans array<struct<start:long,end:long>>, items array<long>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _found(batch: pa.RecordBatch, keep: list[str], words: list[int], found: list[tuple[list[tuple[int, int]], set[int], int]]) -> pa.RecordBatch:
    spans = [merged(s) for s, _, _ in found]
    sums = [sum(b - a for a, b in s) for s in spans]
    cols = [
        batch.column("doc_id"),
        *(batch.column(k) for k in keep),
        pa.array(words, pa.int64()),
        pa.array(sums, pa.int64()),
        pa.array([len(i) for _, i, _ in found], pa.int64()),
        pa.array([hex_sha(",".join(sorted(map(str, i))).encode()) for _, i, _ in found], pa.string()),
        pa.array([n > 0 for n in sums], pa.bool_()),
        pa.array([n for _, _, n in found], pa.int64()),
        pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPAN),
        pa.array([sorted(i) for _, i, _ in found], pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", *keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "spans", "items"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, keep: dict[str, str] | None = None) -> DataFrame:
    """One row for each document: its words, the words inside occurrences of windows, the items found (sorted as strings in
    the digest), the longest verbatim match in words, and the hit word ranges. ``keep``: further columns, with their types."""
    spark, keep = docs.sparkSession, keep or {}
    base = pick(docs, doc_id="long", text="string", **keep)
    items, blocks = blocks_of(benchmark, block_bytes)
    schema = RESULT.replace("doc_id long", "doc_id long" + "".join(f", {k} {v}" for k, v in keep.items()), 1)

    def block(n: int) -> Block:
        rows = items.where(F.col("block") == n).select("item_id", "text", "h").collect()
        found = [(r.item_id, words_of(r.text)) for r in sorted(rows, key=lambda r: (r.item_id, r.h))]
        return Block([x for x in found if x[1]], window)

    def against(shared, texts: list[str]) -> tuple[list[list[bytes]], list]:
        words = [words_of(t) for t in texts]
        return words, _find(shared.value, words) if len(shared.value.ids) else [([], set(), 0)] * len(words)

    if blocks == 1:
        shared = spark.sparkContext.broadcast(block(0))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, found = against(shared, texts_of(batch))
            return _found(batch, list(keep), [len(w) for w in words], found)

        return arrow_map(base, run, schema)
    # one block at a time; only documents that one hits are written, by id and hash of the text
    hits = []
    for n in range(blocks):
        shared = spark.sparkContext.broadcast(block(n))

        def run_block(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            _, found = against(shared, texts_of(batch))
            at = [i for i, (s, _, _) in enumerate(found) if s]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(at, pa.int64())),
                    batch.column("th").take(pa.array(at, pa.int64())),
                    pa.array([[{"start": a, "end": b} for a, b in merged(found[i][0])] for i in at], _SPAN),
                    pa.array([sorted(found[i][1]) for i in at], pa.list_(pa.int64())),
                    pa.array([found[i][2] for i in at], pa.int64()),
                ],
                ["doc_id", "th", "spans", "items", "longest"],
            )

        texts = pick(docs, doc_id="long", text="string").withColumn("th", F.xxhash64("text")).where("text is not null")
        hits.append(settled(arrow_map(texts, run_block, "doc_id long, th long, spans array<struct<start:long,end:long>>, items array<long>, longest long")))
        shared.unpersist()
    every = functools.reduce(DataFrame.unionByName, hits).groupBy(F.col("doc_id").alias("hit_doc"), F.col("th").alias("hit_th"))
    every = every.agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("all_spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("all_items"), F.max("longest").alias("most"))
    joined = base.join(every, base.doc_id.eqNullSafe(F.col("hit_doc")) & (F.xxhash64(base.text) == F.col("hit_th")), "left")

    def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [
            ([(x["start"], x["end"]) for x in s or ()], set(i or ()), n or 0)
            for s, i, n in zip(*(batch.column(c).to_pylist() for c in ("all_spans", "all_items", "most")))
        ]
        return _found(batch, list(keep), [len(words_of(t)) for t in texts_of(batch)], found)

    return arrow_map(joined.select("doc_id", "text", *keep, "all_spans", "all_items", "most"), merge, schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """documents without those that hold a window of the benchmark; the same columns."""
    table = Carried(docs)
    rows = table.rows.withColumn("own_text", F.col("text"))
    out = find_leaks(rows, benchmark, window, keep=table.kept | {"own_text": "string"})
    return table.back(out.where("not contaminated").withColumnRenamed("own_text", "text"))
