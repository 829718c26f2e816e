"""Phrases of two and three words that occur together more often than their parts suggest, mined from position bitmaps.

Texts are dealt to shards of about SHARD words of one language. In a shard each word has a compressed bitmap of its positions: only bytes that aren't zero are kept,
as entries (block of eight positions, word, bits), sorted by block. Pieces are parted by a position that no word has, so nothing extends across them. A phrase is
extended by shifting its bitmap one position on (the eighth bit carries into the next block) and ANDing it with the bitmaps of all words that have entries in
the same blocks; popcounts of what remains are the shard's counts. First words are taken in runs whose entries are few, and each run is
extended to two and three words before the next one, so that a task holds the bitmaps of one run at a time.

Counts are summed over shards in three steps: words, then phrases of two words that are frequent themselves, then phrases of three words whose two halves are frequent.
What is frequent is sent to the shards as a bitmap of FILTER bits by hash, a fixed size; a word or half that is let through by chance costs work,
never results, as all sums are compared with the least count afterwards.

Rules: null text is empty, null language is ``und``. A-Z is lower-cased and nothing else. Pieces end at ``. , ; : ! ?`` and at the bytes 0A to 0D, words at spaces and tabs. Rows are
counted as they stand, repeated ids too.
"""

from __future__ import annotations

import collections
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, mix, settled, spread_join, texts_of

#: Words in a shard, entries that are extended at once, bits of the filters (2 MB).
SHARD, RUN, FILTER = 1 << 20, 1 << 18, 1 << 24
#: What ends a piece becomes a full stop, which then is a word of its own that no text has.
_MAP = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else 32 if b == 9 else b for b in range(256))
_GAP, _M = b".", np.uint64(0x9E3779B97F4A7C15)
COUNTS = "lang string, phrase string, n long"


def hashes_of(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed=seed) for w in words), np.uint64, len(words))


def pair_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hashes of phrases of two words from those of the words."""
    return mix(a * _M + b)


class Filter:
    """A set of phrases by their hashes, without misses."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & np.uint64(FILTER - 1)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class Shard:
    """The bitmaps of the words of some texts."""

    def __init__(self, lang: str, texts: list[bytes]):
        names: dict[bytes, int] = collections.defaultdict(itertools.count().__next__)
        gap = names[_GAP]
        ids: list[np.ndarray] = []
        for text in texts:
            words = text.translate(_MAP).replace(_GAP, b" . ").split()
            words.append(_GAP)
            ids.append(np.fromiter(map(names.__getitem__, words), np.int32, len(words)))
        word = np.concatenate(ids)
        self.size = len(names)
        self.names = pa.array([w.decode("utf-8", "replace") for w in names], pa.string())
        self.hashes = hashes_of(lang, list(names))
        at = np.flatnonzero(word != gap)
        self._set(*self._packed((at >> 3).astype(np.int32), word[at], np.uint8(1) << (at & 7).astype(np.uint8)))

    def _set(self, *entries: np.ndarray) -> None:
        self.entries = entries
        self.start = np.searchsorted(entries[0], np.arange(int(entries[0][-1]) + 3 if len(entries[0]) else 2))  # of each block, and of one beyond the last

    @staticmethod
    def _packed(block: np.ndarray, owner: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries with the bits of equal ones joined, sorted by block."""
        order = np.argsort(block * np.int64(owner.max(initial=0) + 1) + owner)
        block, owner, bits = block[order], owner[order], bits[order]
        first = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (owner[1:] != owner[:-1])]) if len(block) else np.zeros(0, np.int64)
        return block[first], owner[first], np.bitwise_or.reduceat(bits, first) if len(first) else bits

    def only(self, keep: np.ndarray) -> None:
        """Leaves the bitmaps of the words that are kept."""
        owner = self.entries[1]
        self._set(*(x[keep[owner]] for x in self.entries))

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The bitmaps of runs of first words, with about RUN entries in all each."""
        block, owner, bits = self.entries
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.unique(owner[order[RUN::RUN]])) if len(order) > RUN else np.zeros(0, np.int64)
        for part in np.split(order, np.unique(cuts)):
            if len(part):
                yield block[part], owner[part], bits[part]

    def extended(self, block: np.ndarray, owner: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shift and AND: block, owner, word and bits of the phrases of owner that each word goes on, where any bit is left."""
        carry = np.flatnonzero(bits & 128)
        block, owner = np.r_[block, block[carry] + 1], np.r_[owner, owner[carry]]
        bits = np.r_[(bits << 1).astype(np.uint8), np.ones(len(carry), np.uint8)]
        _, words, word_bits = self.entries
        low = self.start[block]
        many = self.start[block + 1] - low
        left = np.repeat(np.arange(len(block), dtype=np.int32), many)
        right = np.arange(len(left), dtype=np.int32) + np.repeat((low - np.cumsum(many) + many).astype(np.int32), many)
        both = bits[left] & word_bits[right]
        there = np.flatnonzero(both)
        left, right = left[there], right[there]
        return block[left], owner[left], words[right], both[there]


def _summed(key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The popcounts of each key."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(np.bitwise_count(bits[order]).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def _joined(shard: Shard, *words: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(*(shard.names.take(pa.array(w)) for w in words), " ")


def count_words(shard: Shard) -> Iterator[tuple[pa.Array, np.ndarray]]:
    _, owner, bits = shard.entries
    words, n = _summed(owner, bits)
    yield shard.names.take(pa.array(words)), n


def count_pairs(shard: Shard, words: Filter) -> Iterator[tuple[pa.Array, np.ndarray]]:
    shard.only(words.has(shard.hashes))
    for run in shard.runs():
        _, a, b, bits = shard.extended(*run)
        keys, n = _summed(a * np.int64(shard.size) + b, bits)
        yield _joined(shard, keys // shard.size, keys % shard.size), n


def count_triples(shard: Shard, words: Filter, pairs: Filter) -> Iterator[tuple[pa.Array, np.ndarray]]:
    shard.only(words.has(shard.hashes))
    h = shard.hashes
    for run in shard.runs():
        block, a, b, bits = shard.extended(*run)
        keep = pairs.has(pair_of(h[a], h[b]))
        pair, at = np.unique(a[keep] * np.int64(shard.size) + b[keep], return_inverse=True)
        _, owner, c, bits = shard.extended(block[keep], at, bits[keep])  # owner: the pair's place in pair
        keep = pairs.has(pair_of(h[pair[owner] % shard.size], h[c]))
        keys, n = _summed(owner[keep] * np.int64(shard.size) + c[keep], bits[keep])
        first = pair[keys // shard.size]
        yield _joined(shard, first // shard.size, first % shard.size, keys % shard.size), n


def _over_shards(docs: DataFrame, count, *filters) -> DataFrame:
    """lang, phrase, n: the counts of all shards, summed. filters: of fixed size, broadcast."""
    sent = [docs.sparkSession.sparkContext.broadcast(x) for x in filters]

    def counted(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        for phrases, n in count(Shard(lang, texts), *(Filter(x.value) for x in sent)):
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int64))), phrases, pa.array(n, pa.int64())], ["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
                held.setdefault(lang, []).append(text := text.encode("utf-8", "surrogatepass"))
                size[lang] = size.get(lang, 0) + len(text) // 6 + 1
                if size[lang] >= SHARD:
                    yield from counted(lang, held.pop(lang))
                    del size[lang]
        for lang, texts in held.items():
            yield from counted(lang, texts)

    return map_batches(docs, run, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _filter_of(counts: DataFrame) -> np.ndarray:
    """The bitmap of the phrases of a table, put together in each task and then over tasks."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(FILTER // 64, np.uint64)
        for batch in batches:
            by: dict[str, list[list[bytes]]] = {}
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                by.setdefault(lang, []).append(phrase.encode("utf-8", "surrogatepass").split(b" "))
            for lang, phrases in by.items():
                columns = [hashes_of(lang, list(words)) for words in zip(*phrases)]  # all of one length
                at = (functools.reduce(pair_of, columns) & np.uint64(FILTER - 1)).astype(np.int64)
                np.bitwise_or.at(found, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        word = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(found[word].view(np.int64))], ["word", "bits"])

    joined = map_batches(counts.select("lang", "phrase"), bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER // 64, np.int64)
    out[joined.column("word").to_numpy()] = joined.column("bits").to_numpy()
    return out.view(np.uint8)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)).cast("decimal(30,0)"), wide(left) * wide(right)).cast("long")


def phrases(docs: DataFrame, least: int = 10, within: int = 50) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every candidate (least occurrences) that no longer candidate stands for: one with ``within`` percent of its occurrences at least."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words = settled(_over_shards(docs, count_words))
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    often = settled(words.where(F.col("n") >= least))
    word_filter = _filter_of(often)
    pairs = settled(_over_shards(docs, count_pairs, word_filter).where(F.col("n") >= least))
    triples = settled(_over_shards(docs, count_triples, word_filter, _filter_of(pairs)).where(F.col("n") >= least))

    part = lambda a, b: F.array_join(F.slice(F.split("phrase", " "), a, b), " ")
    counts = often.unionByName(pairs).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    both = triples.select("lang", "phrase", F.col("n").alias("a"), F.lit(3).alias("size")).unionByName(pairs.select("lang", "phrase", F.col("n").alias("a"), F.lit(2).alias("size")))
    longer = triples.select("lang", F.explode(F.array(part(1, 2), part(2, 2))).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longest"))
    kept = both.join(longer, ["lang", "phrase"], "left").where((F.col("size") == 3) | F.col("longest").isNull() | (100 * F.col("longest") < within * F.col("a")))

    def cut(rows: DataFrame, k: int) -> DataFrame:
        """rows with the counts of the first k words and of the rest."""
        rows = rows.withColumns({"head": part(1, k), "tail": part(k + 1, 2)})
        for end, name in (("head", f"l{k}"), ("tail", f"r{k}")):
            rows = rows.join(counts.select("lang", F.col("part").alias(end), F.col("f").alias(name)), ["lang", end])
        return rows.drop("head", "tail")

    two = cut(kept.where("size = 2"), 1).select("lang", "phrase", "a", F.struct(_score(F.col("a"), F.col("l1"), F.col("r1")).alias("score"), F.lit(1).alias("k"), F.col("l1").alias("l"), F.col("r1").alias("r")).alias("cut"))
    three = cut(cut(kept.where("size = 3"), 1), 2)
    cuts = [F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]
    scored = two.unionByName(three.select("lang", "phrase", "a", F.least(*cuts).alias("cut")))
    return spread_join(settled(scored), total, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")


def collocations(docs: DataFrame, least: int = 10, within: int = 50, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of each language with their rank: by score, then occurrences, then the bytes of the phrase."""
    found = phrases(docs, least, within)
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    # no task gets all phrases of a language: first the best of each part, then the best of those
    parts = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    best = parts.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
