"""Toxicity from the nearest labelled examples.

Terms are runs of GRAM bytes of the lower-cased text; the vocabulary keeps those that labelled
examples of the two classes hold at clearly different rates. Examples are unit vectors of
TF-IDF weights in a block-max inverted index: for each term its blocks of BLOCK examples, each with the
largest weight in it. A query sums the largest weights into a bound for each block, scores the
blocks with the highest bounds, and then only those whose bound still reaches the K-th best cosine:
the K nearest are exact. Their votes, weighted by cosine, are calibrated to the share of toxic
documents among labelled rows; the neighbours are the evidence.

Rules: a text without a known term (null and empty ones included) gets the share of toxic rows among
examples without one. Labels are one a document (the largest, if several); rows with a null id or label
are ignored. Without examples of both classes the score is the share of toxic labels, or 0.
Ties between neighbours go to the example that comes first.

Learning is bounded: at most SAMPLE examples of each class, the first by a hash of their id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_of_id, pick, texts_of

SAMPLE, GRAM, TERMS, LEAST_Z, LEAST_RATIO, K, BLOCK, LINE = 3000, 6, 2048, 6.0, 8.0, 15, 64, 0.3
#: A vote against that every text has: distant neighbours alone don't outvote it.
DOUBT = 0.3


def grams(text: str) -> np.ndarray:
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass").replace(b"\n", b" "), np.uint8)
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = raw[:n].astype(np.uint64)
    for i in range(1, GRAM):
        key = (key << np.uint64(8)) | raw[i : i + n]
    return key


class Vocabulary:
    """Sorted grams, and a table that says quickly that a gram is none of them."""

    BITS = 20

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[self._slot(terms)] = True

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the text and how often each occurs."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = grams(text)
        key = key[self.maybe[self._slot(key)]]
        at = np.minimum(np.searchsorted(self.terms, key), len(self.terms) - 1)
        return np.unique(at[self.terms[at] == key], return_counts=True)


def choose_terms(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """Grams held at clearly different rates: a two-sample z of LEAST_Z and a ratio of LEAST_RATIO at least, the TERMS strongest."""
    sides = []
    for side in (True, False):
        held = [np.unique(grams(t)) for t, y in zip(texts, toxic) if y == side]
        sides.append((len(held), *np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)))
    every = np.union1d(sides[0][1], sides[1][1])
    rate = []
    for n, keys, count in sides:
        c = np.zeros(len(every))
        c[np.searchsorted(every, keys)] = count
        rate.append((c, n))
    (a, na), (b, nb) = rate
    p, q, pool = a / na, b / nb, (a + b) / (na + nb)
    z = (p - q) / np.sqrt(pool * (1 - pool) * (1 / na + 1 / nb) + 1e-12)
    ratio = ((a + 0.5) / (na + 1)) / ((b + 0.5) / (nb + 1))
    good = np.flatnonzero((np.abs(z) >= LEAST_Z) & (np.maximum(ratio, 1 / ratio) >= LEAST_RATIO))
    best = good[np.argsort(-np.abs(z[good]), kind="stable")[:TERMS]]
    return np.sort(every[best])


class BlockMaxIndex:
    """Exact nearest neighbours by cosine."""

    def __init__(self, vectors: np.ndarray):
        n, terms = vectors.shape
        self.n, self.blocks = n, -(-n // BLOCK)
        padded = np.zeros((self.blocks * BLOCK, terms), np.float32)
        padded[:n] = vectors
        cube = padded.reshape(self.blocks, BLOCK, terms)
        most = cube.max(axis=1)
        self.lists = []  # of each term: its blocks, the largest weight in each, the weights
        for t in range(terms):
            at = np.flatnonzero(most[:, t])
            self.lists.append((at, most[at, t], np.ascontiguousarray(cube[at, :, t])))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine above 0, largest first, and the cosines."""
        bound = np.zeros(self.blocks)
        for t, w in zip(terms, weights):
            at, most, _ = self.lists[t]
            bound[at] += w * most
        bound *= 1 + 1e-5  # sums in single precision may exceed it by rounding
        score = np.full((self.blocks, BLOCK), -1.0)
        done = np.zeros(self.blocks, bool)
        order = np.argsort(-bound, kind="stable")
        take = order[: -(-4 * k // BLOCK)]
        while True:
            take = take[~done[take] & (bound[take] > 0)]
            self._score(take, terms, weights, score)
            done[take] = True
            flat = score.ravel()
            if 0 <= without < len(flat):
                flat[without] = -1.0
            least = np.partition(flat, -k)[-k] if len(flat) >= k else -1.0
            left = order[~done[order] & (bound[order] > 0) & (bound[order] >= least)]
            if not len(left):
                break
            take = left
        flat = score.ravel()[: self.n]
        best = np.flatnonzero(flat > 0)
        best = best[np.lexsort((best, -flat[best]))[:k]]
        return best, flat[best]

    def _score(self, take, terms, weights, score) -> None:
        want = np.zeros(self.blocks, bool)
        want[take] = True
        score[take] = 0.0
        for t, w in zip(terms, weights):
            at, _, rows = self.lists[t]
            use = want[at]
            score[at[use]] += w * rows[use]


class Model:
    def __init__(self, texts: list[str], toxic: np.ndarray, share: float):
        """share: of toxic rows among all labelled rows, for which the classes are weighted."""
        self.share = share
        self.ready = bool(len(texts)) and 0 < toxic.mean() < 1
        if not self.ready:
            return
        self.words = Vocabulary(choose_terms(texts, toxic))
        counts = [self.words.counts(t) for t in texts]
        df = np.zeros(len(self.words.terms))
        for at, _ in counts:
            df[at] += 1
        self.idf = np.log((1 + len(texts)) / (1 + df)) + 1
        has = np.array([len(at) > 0 for at, _ in counts])
        self.toxic = toxic[has].astype(float)
        w = np.where(toxic == 1, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
        self.weight = w[has]
        none = ~has
        self.bare = float((w * toxic)[none].sum() / max(1e-9, w[none].sum())) if none.any() else 0.0
        vectors = np.zeros((int(has.sum()), len(df)), np.float32)
        for row, (at, c) in zip(vectors, (x for x in counts if len(x[0]))):
            row[at] = self._weights(at, c)
        self.index = BlockMaxIndex(vectors) if len(vectors) else None
        # calibration: the votes of the examples about each other, made monotone (pool adjacent violators)
        votes = np.array([self._vote(np.flatnonzero(v), v[np.flatnonzero(v)], i)[0] for i, v in enumerate(vectors)])
        self.knots = _isotonic(votes, self.toxic, self.weight) if len(votes) else (np.zeros(1), np.zeros(1))

    def _weights(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = (1 + np.log(count)) * self.idf[at]
        return (w / np.sqrt((w * w).sum())).astype(np.float32)

    def _vote(self, terms, weights, without=-1):
        best, cosine = self.index.nearest(terms, weights, K, without)
        w = cosine**2 * self.weight[best]
        return float((w * self.toxic[best]).sum() / (w.sum() + DOUBT)), best, cosine

    def __call__(self, text: str) -> tuple[float, list[int], list[float]]:
        """score, the positions of the nearest examples, their cosines."""
        if not self.ready:
            return self.share, [], []
        at, count = self.words.counts(text)
        if not len(at) or self.index is None:
            return self.bare, [], []
        vote, best, cosine = self._vote(at, self._weights(at, count))
        return float(np.interp(vote, *self.knots)), best[:3].tolist(), cosine[:3].tolist()


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blocks: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        blocks.append([w[i] * y[i], w[i], x[i], x[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
    xs = np.array([v for b in blocks for v in (b[2], b[3] + 1e-9)])
    return xs, np.clip(np.repeat([b[0] / b[1] for b in blocks], 2), 0, 1)


def learn(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, sample: int = SAMPLE) -> tuple[Model, list[int]]:
    """The model, and the ids of its examples with known terms."""
    rows = pick(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic is not null")
    rows = rows.where(crc_of_id(F.col("doc_id")) % folds != held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("bad")).first()
    chosen = []
    for y in (1, 0):
        best = rows.where((F.col("toxic") == 1) == bool(y)).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample)
        chosen += [(r.doc_id, y) for r in best.collect()]
    known = dict(chosen)
    texts = {}
    if known:
        for r in pick(docs, doc_id="long", text="string").where(F.col("doc_id").isin(list(known))).collect():
            texts[r.doc_id] = max(texts.get(r.doc_id, ""), r.text or "")
    ids = [i for i, _ in chosen if i in texts]
    model = Model([texts[i] for i in ids], np.array([known[i] for i in ids]), (counts.bad / counts.n) if counts.n else 0.0)
    if model.ready:
        ids = [i for i in ids if len(model.words.counts(texts[i])[0])]
    return model, ids


def score(docs: DataFrame, model: Model, ids: list[int], line: float = LINE) -> DataFrame:
    """doc_id, score, predicted, and as evidence the ids and cosines of the three nearest examples."""
    shared = docs.sparkSession.sparkContext.broadcast((model, ids))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, ids = shared.value
        found = [model(t) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([s for s, _, _ in found], pa.float64()),
                pa.array([int(s >= line) for s, _, _ in found], pa.int32()),
                pa.array([[ids[i] for i in b] for _, b, _ in found], pa.list_(pa.int64())),
                pa.array([c for _, _, c in found], pa.list_(pa.float64())),
            ],
            ["doc_id", "score", "predicted", "nearest", "cosines"],
        )

    return arrow_map(pick(docs, doc_id="long", text="string"), run, "doc_id long, score double, predicted int, nearest array<long>, cosines array<double>")


def score_held_out(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learns from labels whose crc32 of the id as text is not ``held`` modulo ``folds`` and scores all documents."""
    out = score(docs, *learn(docs, labels, folds, held))
    return out.select("doc_id", F.coalesce(crc_of_id(F.col("doc_id")) % folds == held, F.lit(False)).alias("held_out"), "score", "predicted", "nearest", "cosines")
