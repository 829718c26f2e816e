"""Nearest neighbours by product-quantised residuals, ranked again exactly.

A vector (at length 1) is its cell's centre plus a residual, and the residual is cut into parts, each replaced by the nearest of CODES codewords: a code of one byte a part.
A search scans codes only (columns beside the vectors). What a query has in common with each codeword is looked up in a table of parts by codewords, so an
estimated similarity takes one sum over a code. The best candidates by estimate are then ranked by their vectors. Rows are sorted by id, so that Parquet's
statistics skip what holds none of them.

Beside each code stands the length of what the code misses of its vector. No estimate is off by more than that, so ``exact`` searches can leave out all rows whose
estimate is too low even so, and give just what a scan of all vectors gives.

Centres and codewords are placed by a bounded sample (SAMPLE rows); every row is coded. Rows without an embedding aren't indexed; a vector of length 0 has similarity 0 with everything.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codicil.functions.vectors import cosines, matrix, similarity_to

from .ann import _unit, centres_of
from .nearest import SLACK, Best, block_for, block_of, by_blocks, slices

SAMPLE, CODES, ROUNDS = 20_000, 256, 10


def codewords_of(sample: np.ndarray, codes: int, seed: int = 7) -> np.ndarray:
    """Plain k-means; as many centres as there are different rows at most."""
    rows = np.unique(sample, axis=0)
    centres = rows[np.random.RandomState(seed).permutation(len(rows))[:codes]]
    for _ in range(ROUNDS):
        home = _nearest(sample, centres)
        count = np.bincount(home, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, home, sample)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


@dataclass
class Quantizer:
    centres: np.ndarray
    words: list[np.ndarray]  # of each part

    @staticmethod
    def fit(sample: np.ndarray, cells: int, parts: int) -> Quantizer:
        x = _unit(sample)
        centres = centres_of(x, min(cells, len(x)))
        rest = x - centres[(x @ centres.T).argmax(axis=1)]
        return Quantizer(centres, [codewords_of(p, CODES) for p in np.array_split(rest, min(parts, x.shape[1]), axis=1)])

    def code(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell, code and error of each vector."""
        x = _unit(vectors)
        cell = (x @ self.centres.T).argmax(axis=1)
        rest = x - self.centres[cell]
        codes, missed = [], np.zeros(len(x))
        for part, words in zip(np.array_split(rest, len(self.words), axis=1), self.words):
            codes.append(_nearest(part, words).astype(np.uint8))
            missed += ((part - words[codes[-1]]) ** 2).sum(axis=1)
        return cell, np.stack(codes, axis=1), np.sqrt(missed)

    def tables(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each query (at length 1) has in common with the centres, and with the codewords of each part (queries, parts, CODES)."""
        q = _unit(queries)
        if not len(q) or not self.centres.any() and self.centres.shape == (1, 1):  # nothing asked, or nothing indexed
            return np.zeros((len(q), 1)), np.zeros((len(q), len(self.words), CODES))
        if q.shape[1] != self.centres.shape[1]:
            raise ValueError(f"the index holds vectors of {self.centres.shape[1]} dimensions, the query has {q.shape[1]}")
        looked = np.zeros((len(self.words), CODES, len(q))).transpose(2, 0, 1)  # estimates() takes what all queries have in common with a codeword at once
        for i, (part, words) in enumerate(zip(np.array_split(q, len(self.words), axis=1), self.words)):
            looked[:, i, : len(words)] = part @ words.T
        return (self.centres @ q.T).T, looked

    @staticmethod
    def estimates(cell: np.ndarray, codes: np.ndarray, centred: np.ndarray, looked: np.ndarray) -> np.ndarray:
        """Estimated similarities, rows by queries."""
        out = centred.T[cell]
        for part in range(codes.shape[1]):
            out += looked[:, part].T[codes[:, part]]
        return out


def _codes(batch: pa.RecordBatch, parts: int) -> tuple[np.ndarray, np.ndarray]:
    code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, parts)
    return np.asarray(batch.column("cell")), code


@dataclass
class CodeIndex:
    spark: SparkSession
    path: str
    quantizer: Quantizer
    least: int = 1  # candidates that a search ranks exactly at least

    @staticmethod
    def build(vectors: DataFrame, path: str, cells: int = 16, parts: int = 16, sample: int = SAMPLE) -> CodeIndex:
        """vectors: id, embedding and any further columns, which filters may use."""
        rows = vectors.where("embedding is not null")
        picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("embedding").cast("array<double>").alias("e")).toArrow()
        found = matrix(picked.column("e").combine_chunks())
        quantizer = Quantizer.fit(found, cells, parts) if len(found) else Quantizer(np.zeros((1, 1)), [np.zeros((1, 1))])

        @F.arrow_udf("struct<cell: int, code: binary, error: double>")
        def coded(column: pa.Array) -> pa.Array:
            cell, codes, error = quantizer.code(matrix(column)) if len(column) else (np.zeros(0), np.zeros((0, 1)), np.zeros(0))
            return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], ["cell", "code", "error"])

        others = [c for c in vectors.columns if c not in ("embedding", "cell", "code", "error")]
        whole = rows.withColumn("c", coded(F.col("embedding").cast("array<double>"))).select(*others, "c.*", "embedding")
        whole.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)
        return CodeIndex(vectors.sparkSession, path, quantizer)

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def codes(self) -> DataFrame:
        return self._rows().drop("embedding")

    def vectors(self) -> DataFrame:
        return self._rows().select("id", "embedding")

    def search(self, query: Sequence[float], k: int, probes: int = 0, where: Column | None = None, columns: Sequence[str] = ()) -> DataFrame:
        """id, similarity and ``columns`` of (approximately) the k closest of the rows that pass ``where``, ties by id; ``probes``: candidates ranked exactly, beyond the least number."""
        centred, looked = self.quantizer.tables(np.asarray(query, np.float64)[None, :])
        parts = len(self.quantizer.words)

        @F.arrow_udf("double")
        def estimate(cell: pa.Array, code: pa.Array) -> pa.Array:
            batch = pa.RecordBatch.from_arrays([cell, code], ["cell", "code"])
            return pa.array(Quantizer.estimates(*_codes(batch, parts), centred, looked)[:, 0])

        rows = self.codes() if where is None else self.codes().where(where)
        best = rows.withColumn("estimate", estimate("cell", "code")).orderBy(F.desc("estimate"), "id").limit(max(k, probes, self.least)).select("id", *columns)
        near = self.vectors().join(F.broadcast(best), "id").select("id", *columns, similarity_to(F.col("embedding").cast("array<double>"), query).alias("similarity"))
        return near.orderBy(F.desc("similarity"), "id").limit(k)

    def candidates(self, questions: list, count: int) -> DataFrame:
        """question, id, estimate of the ``count`` rows of the largest estimates for each question of a block."""
        best = Window.partitionBy("question").orderBy(F.desc("estimate"), "id")
        parts, quantizer, shared = len(self.quantizer.words), self.quantizer, self._shared(questions)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            centred, looked = quantizer.tables(q)
            most = Best(len(names), count)
            for batch in slices(batches, len(names)):
                near = Quantizer.estimates(*_codes(batch, parts), centred, looked)
                row, turn = np.nonzero(near >= most.floor)
                most.add(turn, np.asarray(batch.column("id"))[row], near[row, turn])
            yield from most.rows(names, ("question", "id", "estimate"))

        rows = self.codes().select(F.col("id").cast("long").alias("id"), "cell", "code").mapInArrow(run, "question long, id long, estimate double")
        return rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= count).drop("place")

    def _shared(self, questions: list):
        names, q = block_of(questions)
        self.quantizer.tables(q[:1])  # vectors of another length are an error
        return self.spark.sparkContext.broadcast((names, q))

    def _ranked(self, found: DataFrame, questions: list, k: int) -> DataFrame:
        """question, id, similarity, rank: the k closest of what was found for each question."""
        shared = self.spark.sparkContext.broadcast({r.question: np.array(list(r.embedding), np.float64) for r in questions})

        @F.arrow_udf("double")
        def exact(question: pa.Array, embedding: pa.Array) -> pa.Array:
            x, asked = matrix(embedding), question.to_numpy(zero_copy_only=False)
            out = np.zeros(len(x))
            for one in np.unique(asked):
                at = asked == one
                out[at] = cosines(x[at], shared.value[one][None, :])[:, 0]
            return pa.array(out)

        rows = self.vectors().select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).hint("merge").join(found.select("question", "id"), "id")  # vectors that compress well look small enough to broadcast
        near = rows.select("question", "id", exact("question", "embedding").alias("similarity"))
        best = Window.partitionBy("question").orderBy(F.desc("similarity"), "id")
        return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def nearest_of_many(self, questions: DataFrame, k: int, count: int | None = None) -> DataFrame:
        """question, id, similarity, rank: (approximately) the k closest of each question (question, embedding), by ``count`` candidates each (the least number, if it isn't given)."""
        most = max(k, count or self.least)
        return by_blocks(questions, block_for(most), lambda block: self._ranked(self.candidates(block, most), block, k))

    def exact_of_many(self, questions: DataFrame, k: int) -> DataFrame:
        """The k closest of each question, exactly: one scan of codes and vectors for each block of questions. A pair is only compared by the vectors if its estimate and what
        that may be off by reach the k-th similarity that the task has found for the question."""
        out = by_blocks(questions, block_for(k), lambda block: self._exact(block, k))
        best = Window.partitionBy("question").orderBy(F.desc("similarity"), "id")
        return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def _exact(self, questions: list, k: int) -> DataFrame:
        parts, quantizer, shared = len(self.quantizer.words), self.quantizer, self._shared(questions)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            centred, looked = quantizer.tables(q)
            best = Best(len(names), k)
            for batch in slices(batches, len(names)):
                may = Quantizer.estimates(*_codes(batch, parts), centred, looked) + np.asarray(batch.column("error"))[:, None] >= best.floor - SLACK
                some = np.flatnonzero(may.any(axis=1))
                if len(some):
                    best.scan(np.asarray(batch.column("id"))[some], matrix(batch.column("embedding"))[some], q, may[some])
            yield from best.rows(names, ("question", "id", "similarity"))

        rows = self._rows().select(F.col("id").cast("long").alias("id"), "cell", "code", "error", F.col("embedding").cast("array<double>").alias("embedding"))
        return rows.mapInArrow(run, "question long, id long, similarity double")

    def measured(self, k: int, recall: float, sample: int = 256) -> CodeIndex:
        """The index with the fewest candidates (k, 2 k, 4 k and so on) that find ``recall`` of the k closest of ``sample`` indexed vectors, a row chosen by a hash of its id."""
        picked = self.vectors().orderBy(F.xxhash64("id", F.lit(1)), "id").limit(sample).select(F.monotonically_increasing_id().alias("question"), "embedding").collect()
        asked = self.spark.createDataFrame(picked, "question long, embedding array<double>")
        true = {(r.question, r.id) for r in self.exact_of_many(asked, k).select("question", "id").collect()}
        rows, count = self.codes().count(), k
        while count < rows:
            found = {(r.question, r.id) for r in self.nearest_of_many(asked, k, count).select("question", "id").collect()}
            if len(found & true) >= recall * len(true):
                break
            count = min(rows, 2 * count)
        self.least = count
        return self
