"""N-gram Jaccard join with signature trees, and the groups it links.

A document's set holds the hashes of its shingles of K words. Equal sets are one node. Two sets with
100 * intersection >= PERCENT * union differ in at most D elements, so if the range of hashes is cut into more than D
segments, the two agree in at least one whole segment. Sizes are classed so that linked sets are in the same class or in
neighbouring ones; each set gives the signature of each of its non-empty segments for its own class and the next.
(A few more segments are cut than needed, so that sets with few empty ones always agree in a non-empty one; sets with more empty
ones give signatures by a second cut of the range as well, and so on; those that fail all cuts meet under one signature. How many more is
reckoned for the smallest set that a pair of the class can have, so that hardly any fails: those that do are a cluster, however unlike they are.)

The segments are cut by hash, so linked sets agree in many of them: all but one linked pair in 10**12 (NEVER) have NEED or more
in common, by class. In that sense, and only in that one, the join is approximate. Signatures that more than SMALL nodes have are hot.

* Pairs of nodes with a common signature that isn't hot are counted; those of NEED or more are candidates.
* A pair of fewer must make up for them by hot ones, of which it can't have more in common than either node has: where that can be, the
  bitmaps of the two decide.
* Nodes with fewer than NEED hot signatures leave the hot groups, as each of their links shows in the pairs above: what a passage, a line or a notice
  brings together goes apart again. The groups that remain are joined to zones. In each zone the candidates so far connect most nodes; the others (strays)
  are compared with all nodes of the zone by their bitmaps, in a signature tree.

What remains links nodes to clusters, which are compared exactly: sets become leaves of a signature tree, whose
nodes hold the OR and the AND of the bitmaps below and the range of sizes. Two nodes are traversed together only while the
largest possible overlap, from the bits that one side surely has and the other surely lacks, can make a link; pairs that are connected
already are skipped, as only components are asked for. Clusters beyond CHUNK nodes are dealt out in chunks: first every chunk with
the first one; then only the nodes that aren't connected with the first chunk's largest part are compared with all others. So a cluster of N nodes, of
which U remain, makes N + 2 * U * N / CHUNK rows at most, and no more than that.

Rules: with fewer than K words the whole sequence is one shingle; without words or text the set is empty and linked with
nothing. A document with a null id takes no part: its component is null. Rows that repeat an id are one document with the links of
all of them.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, SLICE, arrow_map, bucket_of, buckets_for, forget, gathered, joined_rows, map_batches, mix, packed, packed_batch, pick, settled, shuffle_partitions, spread_join, texts_of
from .graph import components

CHUNK, CHUNK_SHINGLES, SKETCH_CHUNK, LEAF, FAN, CUTS, SMALL, NEVER = 1024, 1 << 20, 4096, 32, 4, 4, 6, 1e-12
#: Pairs and members of groups that a task holds before it sends them on.
PAIRS_HELD = 500_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 120_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted set of shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(_words.__getitem__, words)), np.uint64)
    if len(h) < k:
        return np.array([functools.reduce(lambda x, y: int(mix(np.array([x], np.uint64) * _M + y)[0]), h, len(h))], np.uint64)
    n = len(h) - k + 1
    key = h[:n].copy()
    for i in range(1, k):
        key = key * _M + h[i : i + n]
    return np.unique(mix(key))


def node_of(s: np.ndarray) -> int:
    """A 63-bit name of a set."""
    return int(mix(np.array([mix(s + _M).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0] >> np.uint64(1))


class Classes:
    """Classes of sizes, and the segments of each."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [1]

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(self.low[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.low, n, "right")) - 1

    @functools.cache  # noqa: B019
    def segments(self, j: int) -> tuple[int, int]:
        """(segments, empty segments a set may have) for pairs whose larger set is in class j; (1, 0): only equal sets link."""
        self.of(self.low[-1] if j + 1 >= len(self.low) else 1)
        while len(self.low) < j + 2:
            self.of(self.low[-1])
        differ = 2 * (self.low[j + 1] - 1) * (100 - self.percent) // (100 + self.percent)
        if not differ:
            return 1, 0
        spare, least = 0, -(-self.low[j] * self.percent // 100)  # the smaller set of a pair can be in the class below
        for _ in range(4):
            m = differ + 1 + spare
            empty = m * math.exp(-least / m)
            spare = math.ceil(empty + 2 * math.sqrt(empty))
        return differ + 1 + spare, spare


    @functools.cache  # noqa: B019
    def common(self, j: int) -> int:
        """Signatures of class j that linked sets have in common, but for chances below NEVER; 1 at least."""
        m, spare = self.segments(j)
        p = math.exp(-(m - spare - 1) / m) * (1 - math.exp(-self.low[j] / m))
        if m > 500:
            return max(1, int(m * p - 8 * math.sqrt(m * p)))
        below, term, r = 0.0, (1 - p) ** m, 0
        while r < m and below + term < NEVER:
            below += term
            r += 1
            term *= (m - r + 1) / r * p / (1 - p)
        return max(1, r)


def signatures(s: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a set, and the class of each."""
    out, of = [], []
    own = classes.of(len(s))
    for j in (own, own + 1):
        m, spare = classes.segments(j)
        if m == 1:
            continue
        for cut in range(CUTS):
            h = s if not cut else np.sort(mix(s + np.uint64(cut * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)))
            seg = (h >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
            at = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            total = np.add.reduceat(h * _M ^ (h >> np.uint64(31)), at)
            out.append(mix(total ^ mix(seg[at] + np.uint64((j << 40) + (cut << 32)))))
            of.append(np.full(len(at), j, np.uint8))
            if m - len(at) <= spare:
                break
        else:
            out.append(mix(np.array([(j << 40) + (CUTS << 32)], np.uint64)))
            of.append(np.full(1, ALWAYS, np.uint8))
    return (np.concatenate(out), np.concatenate(of)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint8))


def bitmap_of(s: np.ndarray, bits: int) -> np.ndarray:
    """bits: a power of two, 64 at least."""
    row = np.zeros(bits // 64, np.uint64)
    at = (s & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(row, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return row


def folded(row: np.ndarray, words: int) -> np.ndarray:
    """A bitmap as a narrower one of the same set."""
    while len(row) > words:
        row = row[: len(row) // 2] | row[len(row) // 2 :]
    return row


#: Classes looked up one by one; sets of later ones (more shingles than a text can have) would need as many common signatures as the last.
CLASSES = 250
#: The class of signatures that need no others beside them.
ALWAYS = 255
_SIG = np.dtype([("low", "<u4"), ("mid", "<u2"), ("j", "u1"), ("node", "<u8")])
_NODE = np.dtype([("node", "<u8"), ("doc", "<i8"), ("n", "<u4")])
_SKETCH = np.dtype([("node", "<u8"), ("n", "<u4"), ("words", "<u4")])
SIGS, NODES, SKETCHES, GROUPS = range(4)
OUT = "kind int, a long, b long, c long, j int, n long, data binary"


def nodes_and_edges(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows of OUT: NODES (id, node, size of the set) of the documents with words and an id; SKETCHES (node, -, size, bitmap); SIGS
    (node, node, common signatures of class j, in part); GROUPS (group, member, -, class j, n) of the groups of more than SMALL nodes that n signatures have."""
    buckets = buckets_for(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(packed_batch, joined_rows(signed(batches)))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
        classes = Classes(percent)
        for whole in batches:
            for x in range(0, whole.num_rows, SLICE):
                batch = whole.slice(x, SLICE)
                nodes, sigs, owner, known, sketches = [], [], [], set(), []
                for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                    s = shingles(text, k)
                    if doc is None or not len(s):
                        continue
                    node = node_of(s)
                    nodes.append((node, doc, len(s)))
                    if node not in known:  # equal sets of a slice are sent once
                        known.add(node)
                        sigs.append(signatures(s, classes))
                        owner.append(node)
                        row = bitmap_of(s, max(64, 1 << (len(s) - 1).bit_length()))
                        head = np.array([(node, len(s), len(row))], _SKETCH)
                        sketches.append((SKETCHES, int(bucket_of(mix(head["node"]), buckets)[0]), head.tobytes() + row.tobytes()))
                sig = np.concatenate([x for x, _ in sigs]) if sigs else np.zeros(0, np.uint64)
                rec = np.empty(len(sig), _SIG)
                rec["low"], rec["mid"] = sig & np.uint64(0xFFFFFFFF), (sig >> np.uint64(32)) & np.uint64(0xFFFF)
                rec["j"] = np.concatenate([x for _, x in sigs]) if sigs else 0
                rec["node"] = np.repeat(np.array(owner, np.uint64), [len(x) for x, _ in sigs])
                rows = _pack(SIGS, sig, rec, buckets)
                rec = np.array(nodes, _NODE)
                yield rows + sketches + _pack(NODES, mix(rec["node"]), rec, buckets)

    def receive(parts: Iterator[tuple[int, int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        pairs: list[np.ndarray] = []
        groups: dict[int, list] = {}  # of groups with the same members and class: members, class, signatures

        def flush() -> Iterator[pa.RecordBatch]:
            p = np.concatenate(pairs) if pairs else np.zeros(0, _PAIR)
            pairs.clear()
            key, of = np.unique(p[["a", "b", "j"]], return_inverse=True)
            if len(key):
                count = np.bincount(of.ravel(), p["n"], len(key)).astype(np.int64)
                yield _rows(SIGS, key["a"].astype(np.int64), key["b"].astype(np.int64), count, key["j"].astype(np.int32))
            if groups:
                size = [len(g) for g, _, _ in groups.values()]
                member = np.concatenate([g for g, _, _ in groups.values()]).astype(np.int64)
                many = lambda x, t: np.repeat(np.array(list(x), t), size)
                yield _rows(GROUPS, many(groups, np.int64), member, np.zeros(len(member), np.int64), many((j for _, j, _ in groups.values()), np.int32), many((n for _, _, n in groups.values()), np.int64))
                groups.clear()

        held = 0
        for kind, _, data in parts:
            if kind == NODES:
                rec = np.frombuffer(b"".join(data), _NODE)
                yield _rows(NODES, rec["doc"], rec["node"].astype(np.int64), rec["n"].astype(np.int64))
            elif kind == SKETCHES:
                yield _sketch_rows(b"".join(data))
            else:
                # the same pair comes from many signatures: counted here, then over partitions
                p, large = candidates(np.frombuffer(b"".join(data), _SIG))
                pairs.append(p)
                held += len(p)
                for j, g in large:
                    seen = groups.setdefault(node_of(np.r_[g, np.uint64(j)]), [g, j, 0])
                    seen[2] += 1
                    held += len(g) * (seen[2] == 1)
                if held > PAIRS_HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    return gathered(map_batches(docs, send, PACKED), receive, OUT)


_PAIR = np.dtype([("a", "<u8"), ("b", "<u8"), ("j", "u1"), ("n", "<u4")])


def candidates(rec: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Pairs of nodes with a common signature, in groups of more than SMALL nodes those with the first one; class and members (in order) of such groups."""
    key = rec["low"].astype(np.uint64) | rec["mid"].astype(np.uint64) << np.uint64(32)
    order = np.lexsort((rec["node"], key))
    key, node, j = key[order], rec["node"][order], rec["j"][order]
    new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])] if len(key) else np.zeros(0, bool)
    key, node, j = key[new], node[new], j[new]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[at, len(key)])
    out, large = [], []

    def add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        p = np.empty(len(a), _PAIR)
        p["a"], p["b"], p["j"], p["n"] = a, b, c, 1
        out.append(p)

    for n in range(2, SMALL + 1):
        g = at[size == n]
        for x in range(n - 1):
            for y in range(x + 1, n):
                add(node[g + x], node[g + y], j[g])
    for a, n in zip(at[size > SMALL].tolist(), size[size > SMALL].tolist()):
        large.append((int(j[a]), node[a : a + n]))
        add(np.full(n - 1, node[a]), node[a + 1 : a + n], j[a + 1 : a + n])
    return np.concatenate(out) if out else np.zeros(0, _PAIR), large


def _pack(kind: int, keys: np.ndarray, rec: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    return [(kind, b, d) for b, d in packed(keys, rec, buckets)]


def _rows(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray, j: np.ndarray | None = None, n: np.ndarray | None = None, data: list[bytes] | None = None) -> pa.RecordBatch:
    cols = [pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())]
    cols += [pa.nulls(len(a), t) if x is None else pa.array(x, t) for x, t in ((j, pa.int32()), (n, pa.int64()), (data, pa.binary()))]
    return pa.RecordBatch.from_arrays(cols, ["kind", "a", "b", "c", "j", "n", "data"])


def _sketch_rows(data: bytes) -> pa.RecordBatch:
    found, at = {}, 0
    while at < len(data):
        node, n, words = np.frombuffer(data, _SKETCH, 1, at)[0].tolist()
        at += _SKETCH.itemsize
        found[node] = (n, data[at : at + 8 * words])
        at += 8 * words
    nodes = list(found)
    return _rows(SKETCHES, np.array(nodes, np.int64), np.zeros(len(nodes), np.int64), np.array([n for n, _ in found.values()], np.int64), data=[d for _, d in found.values()])


# ---- exact comparison --------------------------------------------------------------------------------------------


class Tree:
    """A signature tree over sets, in the order of their sizes."""

    def __init__(self, sizes: list[int], bitmaps: list[np.ndarray]):
        """bitmaps: of one width."""
        self.order = sorted(range(len(sizes)), key=sizes.__getitem__)
        self.size = np.array([sizes[i] for i in self.order])
        self.bitmap = np.stack([bitmaps[i] for i in self.order])
        # a node: (first leaf, end, OR, AND, least size, largest size, children)
        level = [self._node(a, min(a + LEAF, len(sizes)), ()) for a in range(0, len(sizes), LEAF)]
        while len(level) > 1:
            level = [self._node(g[0][0], g[-1][1], tuple(g)) for g in (level[i : i + FAN] for i in range(0, len(level), FAN))]
        self.root = level[0]

    def _node(self, a: int, b: int, children: tuple) -> tuple:
        rows = self.bitmap[a:b]
        return a, b, np.bitwise_or.reduce(rows), np.bitwise_and.reduce(rows), int(self.size[a]), int(self.size[b - 1]), children


def links(sets: list[np.ndarray], percent: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets that join all that the links of all pairs would join (a spanning forest). label: sets of the same one are joined already."""
    bits = 64 << max(0, int(max(map(len, sets)) * 4 - 1).bit_length() - 6)

    def linked(i: int, j: int) -> bool:
        a, b = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
        common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return 100 * common >= percent * (len(a) + len(b) - common)

    return traverse(Tree([len(s) for s in sets], [bitmap_of(s, bits) for s in sets]), percent, linked, np.arange(len(sets)) if label is None else label)


def plausible(sizes: list[int], bitmaps: list[np.ndarray], percent: int, label: np.ndarray) -> list[tuple[int, int]]:
    """The same for all pairs that bitmaps and sizes leave possible. Sets of very different sizes aren't held in one tree, so that
    the narrowest bitmap is wide enough for each."""
    out = []
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    a = 0
    while a < len(order):  # runs of sizes without a gap that no link can bridge
        b = a + 1
        while b < len(order) and 100 * sizes[order[b - 1]] >= percent * sizes[order[b]]:
            b += 1
        run = order[a:b]
        if len(run) > 1:
            by: dict[int, list[int]] = {}
            for i in run:
                by.setdefault(len(bitmaps[i]), []).append(i)
            widths = sorted(by)
            for w, wider in zip(widths, [*widths[1:], 0]):  # linked sets have bitmaps of the same or the next width
                part = by[w] + (by[wider] if wider == 2 * w else [])
                tree = Tree([sizes[i] for i in part], [folded(bitmaps[i], w) for i in part])
                out += [(part[x], part[y]) for x, y in traverse(tree, percent, lambda i, j: True, label[part])]
        a = b
    return out


def traverse(tree: Tree, percent: int, linked, label: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that the tree leaves possible and linked() accepts; it gets the positions before sorting."""
    label = np.unique(label, return_inverse=True)[1].ravel()[tree.order]
    out: list[tuple[int, int]] = []

    def possible(x: tuple, y: tuple) -> bool:
        """Whether a set below x and one below y can be linked: by size, and by bits that one surely has and the other surely lacks."""
        if min(x[5], y[5]) * 100 < percent * max(x[4], y[4]):
            return False
        lacks_x = int(np.bitwise_count(y[3] & ~x[2]).sum())
        lacks_y = int(np.bitwise_count(x[3] & ~y[2]).sum())
        return (lacks_x + lacks_y) * (100 + percent) <= (x[5] + y[5]) * (100 - percent)

    def leaves(x: tuple, y: tuple) -> None:
        for i in range(x[0], x[1]):
            a = max(y[0], i + 1)
            apart = np.flatnonzero(label[a : y[1]] != label[i]) + a
            if not len(apart):
                continue
            differ = np.bitwise_count(tree.bitmap[apart] ^ tree.bitmap[i]).sum(axis=1)
            total = tree.size[apart] + tree.size[i]
            for j in apart[differ.astype(np.int64) * (100 + percent) <= total * (100 - percent)].tolist():
                if label[i] != label[j] and linked(tree.order[i], tree.order[j]):
                    label[label == label[j]] = label[i]
                    out.append((tree.order[i], tree.order[j]))

    def walk(x: tuple, y: tuple) -> None:
        if (label[x[0] : x[1]] == label[y[0]]).all() and (label[y[0] : y[1]] == label[y[0]]).all() or x is not y and not possible(x, y):
            return
        if not x[6] and not y[6]:
            leaves(x, y)
        elif x is y:
            for i, c in enumerate(x[6]):
                for d in x[6][i:]:
                    walk(c, d)
        else:
            for c in x[6] or (x,):
                for d in y[6] or (y,):
                    walk(c, d)

    walk(tree.root, tree.root)
    return out


def in_groups(rows: DataFrame, by: tuple[str, str], columns: tuple[str, ...], fn, schema: str) -> DataFrame:
    """Brings the rows of each group (two columns of longs) together and calls fn(group, lists of the columns) for one after the other; fn gives rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        key, held, out = None, [[] for _ in columns], []

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
            out.clear()
            return batch

        for b in batches:
            group = np.stack([np.asarray(b.column(c)) for c in by], axis=1)
            cuts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1), True]) if len(group) else [0]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if (now := tuple(group[x].tolist())) != key:
                    if key:
                        out += fn(key, held)
                        if len(out) >= 10_000:
                            yield made()
                    key, held = now, [[] for _ in columns]
                for h, c in zip(held, columns):
                    h += b.column(c).slice(x, y - x).to_pylist()
        if key:
            out += fn(key, held)
        if out:
            yield made()

    return map_batches(rows.repartition(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by), run, schema)


def clusters(both: DataFrame, percent: int) -> DataFrame:
    """node, root: the clusters of nodes that may be linked, but for clusters of one."""
    classes = Classes(percent)
    table = F.array(*(F.lit(min(classes.common(j), 1 << 20)) for j in range(CLASSES)))
    need = F.when(F.col("j") == ALWAYS, 1).otherwise(F.element_at(table, F.least(F.col("j"), F.lit(CLASSES - 1)) + 1))
    pairs = settled(both.where(F.col("kind") == SIGS).groupBy("a", "b", "j").agg(F.sum("c").alias("n")).withColumn("need", need))
    hot = both.where(F.col("kind") == GROUPS).select(F.col("a").alias("g"), F.col("b").alias("node"), "j", "n")
    held = settled(hot.groupBy("node", "j").agg(F.sum("n").alias("h")).withColumn("much", F.col("h") >= need))
    sketch = both.where(F.col("kind") == SKETCHES).select(F.col("a").alias("node"), F.col("c").alias("size"), "data")
    roots = settled(components(pairs.where("n >= need").select("a", "b").distinct()))
    near = settled(zone_edges(hot.join(held.where("much"), ["node", "j"]).select("g", "node").distinct(), roots, sketch, percent).unionByName(weak_edges(pairs, held, roots, sketch, percent)))
    # what these edges link, by clusters
    moved = _rooted(_rooted(near, roots, "a"), roots, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    moved = components(moved.distinct()).select(F.col("node").alias("root"), F.col("root").alias("last"))
    ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    every = roots.unionByName(ends.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    return spread_join(settled(every), moved, "root", "left").select("node", F.coalesce("last", "root").alias("root"))


def _rooted(rows: DataFrame, roots: DataFrame, of: str) -> DataFrame:
    """rows with r<of>: the root of column ``of``, itself where it has none."""
    found = roots.select(F.col("node").alias(of), F.col("root").alias(f"r{of}"))
    return rows.join(found, of, "left").withColumn(f"r{of}", F.coalesce(f"r{of}", of))


def weak_edges(pairs: DataFrame, held: DataFrame, roots: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs that would need hot signatures beside those counted, as far as their bitmaps leave a link possible."""
    of = lambda c: held.select(F.col("node").alias(c), "j", F.col("h").alias(f"h{c}"), F.col("much").alias(f"m{c}"))
    weak = pairs.where("n < need").join(of("a"), ["a", "j"]).join(of("b"), ["b", "j"]).where("n + least(ha, hb) >= need and not (ma and mb)").select("a", "b").distinct()
    weak = _rooted(_rooted(weak, roots, "a"), roots, "b").where("ra != rb").select("a", "b")
    side = lambda c: sketch.select(F.col("node").alias(c), F.col("size").alias(f"s{c}"), F.col("data").alias(f"d{c}"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y, dx, dy in zip(*(batch.column(c).to_pylist() for c in ("sa", "sb", "da", "db"))):
            u, v = np.frombuffer(dx, np.uint64), np.frombuffer(dy, np.uint64)
            w = min(len(u), len(v))
            differ = int(np.bitwise_count(folded(u, w) ^ folded(v, w)).sum())
            keep.append(differ * (100 + percent) <= (x + y) * (100 - percent))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return arrow_map(weak.join(side("a"), "a").join(side("b"), "b"), run, "a long, b long")


def _dealt(rows: DataFrame, key: str, apart: str, chunk) -> DataFrame:
    """Rows (a written table) of each group ``key`` dealt to parts: those that stand ``apart`` by chunks of all the others. chunk(size): chunks for so many."""
    sizes = settled(rows.groupBy(key).agg(chunk(F.count(F.lit(1))).alias("chunks"), chunk(F.sum(F.col(apart).cast("long"))).alias("apart_chunks")))
    rows = spread_join(rows, sizes, key)
    dealt = lambda of: F.pmod(F.xxhash64("node", F.lit(3)), F.col(of))
    wide = F.lit(1 << 20).cast("long")
    every = rows.where("apart_chunks > 0").withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.col("apart_chunks") - 1), lambda i: i * wide + dealt("chunks")))).withColumn(apart, F.lit(False))
    other = rows.where(apart).withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: dealt("apart_chunks") * wide + i)))
    return every.unionByName(other).drop("chunks", "apart_chunks")


def zone_edges(groups: DataFrame, roots: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """a, b: edges between nodes of hot groups that the candidates leave unconnected, as far as bitmaps leave a link possible; groups: g, node."""
    rooted = settled(_rooted(groups, roots, "node").withColumnRenamed("rnode", "root"))
    ends = settled(rooted.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("g", "low"))
    zones = components(spread_join(rooted, ends, "g").select(F.col("root").alias("a"), F.col("low").alias("b")).distinct())
    zones = settled(zones.select(F.col("node").alias("root"), F.col("root").alias("zone")))
    inside = settled(spread_join(settled(rooted.select("node", "root").distinct()), zones, "root"))
    main = inside.groupBy("zone", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("zone").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    rows = spread_join(inside, settled(main), "zone").select("zone", "node", "root", (F.col("root") != F.col("main")).alias("stray"))
    rows = _dealt(settled(rows), "zone", "stray", lambda n: F.ceil(n / SKETCH_CHUNK)).join(sketch, "node")

    def compare(_: tuple, columns: list[list]) -> list[tuple]:
        nodes = {node: x for node, *x in zip(*columns)}
        names = sorted(nodes)
        maps = [np.frombuffer(nodes[x][2], np.uint64) for x in names]
        return [(names[i], names[j]) for i, j in plausible([nodes[x][1] for x in names], maps, percent, np.array([nodes[x][0] for x in names]))]

    return in_groups(rows.select("zone", "part", "node", "root", "size", "data"), ("zone", "part"), ("node", "root", "size", "data"), compare, "a long, b long")


def _sets(nodes: list[int], texts: list[str], k: int) -> dict[int, np.ndarray]:
    """The sets of texts by node; a row whose text isn't the node's (repeated ids) is left out."""
    found = {}
    for node, text in zip(nodes, texts):
        if node not in found and len(s := shingles(text, k)) and node_of(s) == node:
            found[node] = s
    return found


def exact_links(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links that join what is linked in each cluster; texts: cluster, chunks, chunk, node, text."""

    def with_first(group: tuple, columns: list[list]) -> list[tuple]:
        """All pairs of a chunk and the first one; (cluster, node, null) for nodes that aren't connected with the first one's largest part."""
        sets = _sets(*columns[:2], k)
        first = {x for x, c in zip(columns[0], columns[2]) if c == 0 and x in sets}
        several = columns[3][0] > 1
        names = sorted(first) + sorted(set(sets) - first)
        label = np.arange(len(names))
        found = []

        def join(part: list[tuple[int, int]]) -> None:
            for i, j in part:
                label[label == label[j]] = label[i]
                found.append((names[i], names[j]))

        if several and len(first) > 1:
            join(links([sets[x] for x in names[: len(first)]], percent))
        main = label[np.bincount(label[: len(first)]).argmax()] if several and first else -1
        main = int(np.flatnonzero(label == main)[0]) if main >= 0 else -1
        if len(names) > 1:
            join(links([sets[x] for x in names], percent, label))
        out = [(None, a, b) for a, b in found]
        if several:
            out += [(group[0], x, None) for i, x in enumerate(names) if (main < 0 or label[i] != label[main]) and (group[1] == 1 or x not in first)]
        return out

    def with_all(_: tuple, columns: list[list]) -> list[tuple]:
        """The nodes that stand apart with all others, which are connected."""
        apart = {x for x, c in zip(columns[0], columns[2]) if c}
        sets = _sets(*columns[:2], k)
        names = sorted(sets)
        label = np.array([1 + i if x in apart else 0 for i, x in enumerate(names)])
        return [(names[i], names[j]) for i, j in links([sets[x] for x in names], percent, label)] if len(names) > 1 else []

    chunk = F.when((F.col("chunk") == 0) & (F.col("chunks") > 1), F.sequence(F.lit(1), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    first = texts.withColumn("part", F.explode(chunk))
    found = settled(in_groups(first, ("cluster", "part"), ("node", "text", "chunk", "chunks"), with_first, "cluster long, a long, b long"))
    linked = found.where("cluster is null").select("a", "b")
    left = settled(found.where("cluster is not null").select("cluster", F.col("a").alias("node")).distinct())
    if left.isEmpty():
        return linked
    some = spread_join(texts, settled(left.select("cluster").distinct()), "cluster").drop("chunk")
    rows = some.join(left.withColumn("apart", F.lit(True)), ["cluster", "node"], "left").withColumn("apart", F.coalesce("apart", F.lit(False)))
    rows = rows.select("cluster", "node", "text", "apart", F.col("chunks").alias("whole"))
    sizes = lambda n: F.ceil(n * F.max("whole") / F.count(F.lit(1)))
    return linked.unionByName(in_groups(_dealt(settled(rows), "cluster", "apart", sizes), ("cluster", "part"), ("node", "text", "apart"), with_all, "a long, b long"))


def jaccard_groups(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach) of each document."""
    base = pick(docs, doc_id="long", text="string")
    both = settled(nodes_and_edges(base, k, percent))
    nodes = both.where(F.col("kind") == NODES).select(F.col("a").alias("doc_id"), F.col("b").alias("node"), F.col("c").alias("n_shingles"))
    members = settled(clusters(both, percent)).withColumnRenamed("root", "cluster")
    names = settled(nodes.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size")))
    placed = settled(members.join(names, "node"))
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("size") / CHUNK_SHINGLES)).cast("long")
    placed = spread_join(placed, settled(placed.groupBy("cluster").agg(chunks.alias("chunks"))), "cluster")
    placed = placed.select("cluster", "rep", "node", "chunks", F.pmod(F.xxhash64("node", F.lit(3)), "chunks").alias("chunk"))
    texts = settled(base.join(placed, base.doc_id == placed.rep).select("cluster", "chunks", "chunk", "node", "text"))
    joined = components(exact_links(texts, k, percent))  # written
    forget(texts)
    return _named(base, nodes, names, joined)


def _named(base: DataFrame, nodes: DataFrame, names: DataFrame, joined: DataFrame) -> DataFrame:
    roots = settled(names.join(joined, "node"))
    least = roots.groupBy("root").agg(F.min("rep").alias("least"))
    linked = spread_join(roots, settled(least), "root").select("node", "least")
    label = settled(names.join(linked, "node", "left").select("node", F.coalesce("least", "rep").alias("component")))
    sized = spread_join(nodes, label, "node").select("doc_id", "n_shingles", "component")
    # documents without words or without an id have no node
    bare = base.where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    bare = bare.select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component"))
    every = sized.unionByName(bare)
    least_of = every.groupBy("doc_id").agg(F.min("component").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    twice = least_of.where("rows > 1 and doc_id is not null").select(F.col("doc_id").alias("d"), "component_id")
    return every.join(twice, every.doc_id == twice.d, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "component").alias("component_id"))
