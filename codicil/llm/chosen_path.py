"""Near-duplicates by a chosen-path set similarity join.

A document's set holds the hashes of its shingles; equal sets are one node, with a sketch of WIDTH minwise tokens. A tree branches nodes recursively: the path so far
selects which minwise tokens a branch is taken by (one, or two for so many paths that 100 / percent are taken on average, which keeps a linked pair together
along some path however deep it goes), and nodes that agree in a selected token go on together. Groups of SMALL nodes or fewer end there; those still larger after DEPTH tokens are
dealt out. TREES independent trees repeat this: a pair at the least similarity meets in one of them with the probability that recall() gives, 0.9999 for the defaults.

What meets is compared by sketches: pairs that agree in as many tokens as all but one linked pair in 10**10 do, and whose sizes allow a link, are candidates. Candidates are
confirmed on the full sets, read again from the texts. As only components are asked for, this takes two steps.

* In the groups of the first FIRST trees the strongest candidates that connect what can be connected (a maximum spanning forest) are confirmed. A large group is dealt
  in chunks, each together with the same two of its nodes.
* In the groups of all trees the nodes that aren't connected yet are compared again, by parity bitmaps of their whole sets: the bits in which two of them differ are no more than the
  elements in which the sets differ, and nearly as many. Groups that are connected are left out; in a large group the nodes outside its largest component are compared
  with all others, by chunks of both. Of the pairs that the bitmaps leave possible first a forest between components is confirmed, then every
  one whose nodes are apart even then: those are few, as a pair that the bitmaps let through is nearly always a link.

So no link that a tree brings together is lost, and copies of one text are never expanded into pairs.

Rules: those of jaccard_join: with fewer than k words the whole sequence is one shingle, without words the set is empty and linked with nothing; a null id takes no part
and has a null component; rows that repeat an id are one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, arrow_map, map_batches, mix, pick, settled, shuffle_partitions, spread_join, texts_of
from .graph import components
from .jaccard_join import _dealt, _named, _rooted, in_groups, node_of, shingles

WIDTH, TREES, FIRST, DEPTH, SMALL, CHUNK, PAIRS, PARITY = 128, 12, 2, 4, 48, 512, 256, 19
_A = (mix(np.arange(1, WIDTH + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(WIDTH + 1, 2 * WIDTH + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def sketch_of(s: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set of hashes."""
    least = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    half = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(half), 2048):
        np.minimum(least, ((half[at : at + 2048, None] ^ _B) * _A).min(axis=0), out=least)
    return least


def least_agreement(percent: int) -> int:
    """Tokens in which a linked pair agrees at least, but for one in 10**10."""
    p = percent / 100
    return max(1, math.floor(WIDTH * p - 6.4 * math.sqrt(WIDTH * p * (1 - p))))


def recall(similarity: float, percent: int, depth: int = DEPTH, trees: int = TREES) -> float:
    """The chance that a pair of this similarity meets in a group of some tree, if all its groups are large until ``depth``."""
    twice = 100 / percent - 1
    meets = 1.0
    for level in range(depth):  # from the leaves up: one token at the root, one or two below
        miss = 1 - similarity * meets
        meets = 1 - miss if level == depth - 1 else 1 - ((1 - twice) * miss + twice * miss**2)
    return 1 - (1 - meets) ** trees


def branches(path: np.ndarray, tokens: np.ndarray, percent: int, root: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of each branch that rows of tokens with these paths take. root: each path takes one token."""
    at = np.arange(len(path))
    chance = mix(path ^ np.uint64(0x5851F42D4C957F2D))
    twice = np.zeros(0, np.int64) if root else np.flatnonzero((chance >> np.uint64(11)).astype(np.float64) / 2.0**53 < 100 / percent - 1)
    row = np.r_[at, twice]
    turn = np.r_[np.zeros(len(at), np.uint64), np.ones(len(twice), np.uint64)]
    spot = mix(path)
    place = ((spot[row] >> np.uint64(8)) + turn * (np.uint64(1) + (spot[row] & np.uint64(0x3F)))) % np.uint64(WIDTH)
    token = tokens[row, place.astype(np.int64)]
    return row, mix(mix(path[row] + place + np.uint64(1)) + token.astype(np.uint64))


def root_path(tree: int) -> np.uint64:
    return mix(np.array([0x632BE59BD9B4E019 + tree], np.uint64))[0]


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), WIDTH)


def _long_rows(*columns: np.ndarray, names: tuple[str, ...] = ("key", "node")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, pa.int64()) for c in columns], list(names))


def sketched(base: DataFrame, k: int) -> DataFrame:
    """doc_id, node, n_shingles, sketch of each document with words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = [], [], [], []
        for i, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
            if len(s := shingles(text, k)):
                for c, v in zip(out, (i, node_of(s), len(s), sketch_of(s).tobytes())):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "node", "n_shingles", "sketch"])

    return arrow_map(base.where("doc_id is not null"), run, "doc_id long, node long, n_shingles long, sketch binary")


def leaf_groups(nodes: DataFrame, percent: int) -> DataFrame:
    """key, node, tree, n of the nodes of each group that a tree ends with, groups of one left out; n: its nodes."""

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, node = _tokens(batch.column("sketch")), np.asarray(batch.column("node"))
        found = [branches(np.full(len(node), root_path(t)), tokens, percent, True) for t in range(TREES)]
        return _long_rows(np.concatenate([p for _, p in found]), np.concatenate([node[r] for r, _ in found]), np.repeat(np.arange(TREES), [len(r) for r, _ in found]), names=("key", "node", "tree"))

    def deeper(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, node = _tokens(batch.column("sketch")), np.asarray(batch.column("node"))
        lists = batch.column("groups").to_pylist()
        of = np.repeat(np.arange(len(node)), [len(x) for x in lists])
        flat = [g for x in lists for g in x]
        key, tree = (np.array([g[c] for g in flat], np.int64) for c in ("key", "tree"))
        row, path = branches(key.view(np.uint64), tokens[of], percent, False)
        return _long_rows(path, node[of][row], tree[row], names=("key", "node", "tree"))

    kind = "key long, node long, tree long"
    rows = settled(arrow_map(nodes, first, kind))
    ended = None
    for depth in range(1, DEPTH + 1):
        sizes = settled(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        sized = settled(spread_join(rows, sizes, "key"))
        done = sized if depth == DEPTH else sized.where(F.col("n") <= SMALL)
        ended = done if ended is None else ended.unionByName(done)
        large = sized.where(F.col("n") > SMALL)
        if depth == DEPTH or large.isEmpty():
            return ended
        lists = large.groupBy("node").agg(F.collect_list(F.struct("key", "tree")).alias("groups"))
        rows = settled(arrow_map(lists.join(nodes, "node"), deeper, kind).distinct())


def agreement(tokens: np.ndarray) -> np.ndarray:
    """In how many tokens each pair agrees."""
    return np.stack([(tokens == row).sum(axis=1, dtype=np.int16) for row in tokens])


def _sizes_fit(n: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)


def forest(strength: np.ndarray) -> list[tuple[int, int]]:
    """The edges (from, to) of a maximum spanning forest over the pairs of strength above 0, grown from the first node of each tree."""
    left = np.ones(len(strength), bool)
    best, via, out = np.zeros(len(strength), strength.dtype), np.zeros(len(strength), np.int64), []
    while left.any():
        at = int(np.argmax(np.where(left, best, -1)))
        if best[at] > 0:
            out.append((int(via[at]), at))
        left[at] = False
        near = strength[at] > best
        best[near], via[near] = strength[at][near], at
    return out


def first_candidates(groups: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a, b: the strongest candidates that connect the nodes of each group of the first trees."""
    need = least_agreement(percent)
    some = groups.where(F.col("tree") < FIRST)
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK)).cast("long")
    own = some.select("key", F.when(F.col("n") > SMALL, F.pmod(F.xxhash64("node"), chunks)).otherwise(0).alias("part"), "node")
    ends = some.where(F.col("n") > CHUNK).groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max(chunks).alias("chunks"))
    hubs = ends.select("low", "high", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("part")).select("key", "part", F.explode(F.array("low", "high")).alias("node"))
    rows = spread_join(settled(own.unionByName(hubs)), nodes, "node")

    def compare(_: tuple, columns: list[list]) -> list[tuple]:
        node, at = np.unique(np.array(columns[0], np.int64), return_index=True)
        if len(node) < 2:
            return []
        n = np.array(columns[1], np.int64)[at]
        strength = agreement(np.stack([np.frombuffer(columns[2][i], np.uint32) for i in at]))
        strength[(strength < need) | ~_sizes_fit(n, percent)] = 0
        return [(int(node[i]), int(node[j])) for i, j in forest(strength)]

    return in_groups(rows.select("key", "part", "node", "n_shingles", "sketch"), ("key", "part"), ("node", "n_shingles", "sketch"), compare, "a long, b long").distinct()


def parity_of(s: np.ndarray) -> np.ndarray:
    """Of each of some 16 buckets for each element (2**PARITY at most), whether it holds an odd number of them, as bits of words."""
    size = 1 << min(PARITY, max(8, math.ceil(math.log2(16 * len(s)))))
    held = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(held.astype(np.uint8), bitorder="little").view(np.uint64)


def halved(bits: np.ndarray, words: int) -> np.ndarray:
    """Parity bitmaps (rows) as narrower ones of the same sets."""
    while bits.shape[1] > words:
        bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
    return bits


def likeness(bits: list[np.ndarray], n: np.ndarray, percent: int) -> np.ndarray:
    """For each pair of sets the most that its similarity can be, in 10,000ths and one more; 0 where that doesn't make a link."""
    out = np.zeros((len(n), len(n)), np.int32)
    words = np.array([len(x) for x in bits])
    for w in np.unique(words).tolist():
        own, wide = np.flatnonzero(words == w), np.flatnonzero((words >= w) & (words <= 2 * w))
        table = np.concatenate([halved(np.stack([bits[i] for i in wide[words[wide] == v]]), w) for v in (w, 2 * w) if (words[wide] == v).any()])
        wide = np.concatenate([wide[words[wide] == v] for v in (w, 2 * w)])
        for i in own:
            differ = np.bitwise_count(table ^ bits[i]).sum(axis=1, dtype=np.int64)
            total = n[wide] + n[i]
            likely = np.where(differ * (100 + percent) <= total * (100 - percent), 1 + np.maximum(0, total - differ) * 10_000 // (total + differ), 0)
            out[i, wide] = out[wide, i] = likely
    out[~_sizes_fit(n, percent)] = 0
    return out


def parities(nodes: DataFrame, names: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """node, bits: the parity bitmaps of nodes, from their texts."""
    reps = nodes.join(names, "node").select("node", "rep")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(node, parity_of(s).tobytes()) for node, text in zip(batch.column("node").to_pylist(), texts_of(batch)) if len(s := shingles(text, k)) and node_of(s) == node]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["node", "bits"])

    return arrow_map(base.join(reps, base.doc_id == reps.rep).select("node", "text"), run, "node long, bits binary").dropDuplicates(["node"])


def apart(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of groups, with ``root``, of those that hold several roots."""
    rooted = settled(_rooted(groups, roots, "node").withColumnRenamed("rnode", "root"))
    ends = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = settled(ends.where("low < high").select("key", F.lit(1).alias("mixed")))
    return settled(spread_join(rooted, mixed, "key").drop("mixed"))


def other_candidates(rows: DataFrame, nodes: DataFrame, percent: int, every: bool) -> DataFrame:
    """a, b: pairs of nodes with different roots in the same group that the bitmaps leave possible; every: all of them, else a forest in each part. rows: from apart()."""
    small = rows.where(F.col("n") <= SMALL).select("key", F.lit(0).cast("long").alias("part"), "node", "root")
    large = settled(rows.where(F.col("n") > SMALL).select("key", "node", "root"))
    main = settled(large.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main")))
    strays = settled(spread_join(large, main, "key").select("key", "node", "root", (F.col("root") != F.col("main")).alias("stray")))
    dealt = _dealt(strays, "key", "stray", lambda n: F.ceil(n / CHUNK)).select("key", "part", "node", "root")
    there = settled(small.unionByName(dealt)).join(nodes, "node")

    def compare(_: tuple, columns: list[list]) -> list[tuple]:
        node, at = np.unique(np.array(columns[0], np.int64), return_index=True)
        if len(node) < 2:
            return []
        root, n = (np.array(columns[c], np.int64)[at] for c in (1, 2))
        likely = likeness([np.frombuffer(columns[3][i], np.uint64) for i in at], n, percent)
        same = root[:, None] == root[None, :]
        if every:
            found = zip(*np.nonzero(np.triu((likely > 0) & ~same)))
        else:
            likely[same] = 20_000
            found = ((i, j) for i, j in forest(likely) if root[i] != root[j])
        return [(int(node[i]), int(node[j])) for i, j in found]

    return in_groups(there.select("key", "part", "node", "root", "n_shingles", "bits"), ("key", "part"), ("node", "root", "n_shingles", "bits"), compare, "a long, b long").distinct()


def confirmed(pairs: DataFrame, names: DataFrame, base: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a written table) that link, by their full sets. Each task reads the set of a once and then one b after the other, PAIRS of them at most."""
    counts = settled(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("long").alias("parts")))
    dealt = settled(spread_join(pairs, counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b"))
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    reps = ends.join(names, "node").select("node", "rep")
    texts = settled(base.join(reps, base.doc_id == reps.rep).select("node", "text"))
    heads = dealt.select("a", "part").distinct().withColumn("node", F.col("a")).withColumn("other", F.lit(0))
    rows = heads.unionByName(dealt.select("a", "part", F.col("b").alias("node"), F.lit(1).alias("other"))).join(texts, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for whole in batches:
            found: list[tuple[int, int]] = []
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                for a, part, node, text in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "node", "text"))):
                    if key != (a, part):
                        key, own = (a, part), None
                    s = shingles(text, k)
                    if not len(s) or node_of(s) != node:  # another row of the id
                        continue
                    if node == a:
                        own = s
                    elif own is not None and links(own, s, percent):
                        found.append((a, node))
            if found:
                yield _long_rows(*np.array(found, np.int64).T.copy(), names=("a", "b"))

    dealt_rows = rows.select("a", "part", "other", "node", "text").repartition(shuffle_partitions(pairs.sparkSession), "a", "part").sortWithinPartitions("a", "part", "other")
    return map_batches(dealt_rows, run, "a long, b long").distinct()


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Do two sorted sets link?"""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def chosen_path_groups(docs: DataFrame, k: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach) of each document."""
    base = pick(docs, doc_id="long", text="string")
    found = settled(sketched(base, k))
    nodes = settled(found.groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("rep")))
    names, sketches = nodes.select("node", "rep"), nodes.select("node", "n_shingles", "sketch")
    groups = settled(leaf_groups(sketches, percent))
    first = settled(first_candidates(groups, sketches, percent))
    linked = settled(confirmed(first, names, base, k, percent))
    tried, bits = first, None
    for every in (False, True):
        rows = apart(groups.select("key", "node", "n"), settled(components(linked)))
        if bits is None:
            bits = settled(parities(rows.select("node").distinct(), names, base, k).join(sketches.drop("sketch"), "node"))
        found_now = other_candidates(rows, bits, percent, every).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        past = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        now = settled(found_now.join(past, ["a", "b"], "left_anti"))
        linked = settled(linked.unionByName(confirmed(now, names, base, k, percent)))
        tried = tried.unionByName(now)
    return _named(base, found.select("doc_id", "node", "n_shingles"), names, components(linked))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85) -> DataFrame:
    """chosen_path_groups with ``kept``: of each component the smallest id stays (a document with a null id stays as well)."""
    return chosen_path_groups(docs, k, percent).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
