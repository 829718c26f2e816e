"""Approximate nearest neighbours: an inverted file over cells.

Cells are the centres of a bounded sample; every vector is put in the cell of its nearest centre and the table is written by cell, so that a search
reads only the cells it probes. Filters are applied before ranking; while fewer than ``k`` rows pass, more cells are probed, up to all of them, so a selective
filter still fills the answer. How many cells a recall takes depends on the vectors; probes_for measures it on a sample of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codicil.functions.vectors import cosines, matrix, similarity_to

SAMPLE, ROUNDS = 20_000, 12


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def centres_of(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means."""
    x, r = _unit(sample), np.random.RandomState(seed)
    centres = x[r.permutation(len(x))[:cells]]
    for _ in range(ROUNDS):
        home = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, home, x)
        centres = np.where(np.bincount(home, minlength=len(centres))[:, None] > 0, _unit(total), centres)
    return centres


@dataclass
class IvfIndex:
    spark: SparkSession
    path: str
    centres: np.ndarray
    least: int = 1  # cells that a search probes at least

    @staticmethod
    def build(vectors: DataFrame, path: str, cells: int = 64, sample: int = SAMPLE) -> IvfIndex:
        """vectors: id, embedding and any further columns. At most ``sample`` rows, the first by a hash of their id, place the centres; all rows are indexed."""
        rows = vectors.where("embedding is not null")
        picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("embedding").cast("array<double>").alias("e")).toArrow()
        centres = centres_of(matrix(picked.column("e").combine_chunks()), cells)

        @F.arrow_udf("int")
        def cell(column: pa.Array) -> pa.Array:
            return pa.array((matrix(column) @ centres.T).argmax(axis=1).astype(np.int32))

        placed = rows.withColumn("cell", cell(F.col("embedding").cast("array<double>")))
        # a cell with a great part of the rows is written by several tasks
        placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(4))).write.mode("overwrite").partitionBy("cell").parquet(path)
        return IvfIndex(vectors.sparkSession, path, centres)

    def search(self, query: Sequence[float], k: int, probes: int = 8, where: Column | None = None, columns: Sequence[str] = ()) -> DataFrame:
        """id, similarity and ``columns`` of (approximately) the k closest, ties by id."""
        probes = max(probes, self.least)
        order = np.argsort(-(self.centres @ np.asarray(query, np.float64)), kind="stable").tolist()
        table = self.spark.read.parquet(self.path)
        if where is not None:
            table = table.where(where)
        while probes < len(order) and table.where(F.col("cell").isin(order[:probes])).select("id").limit(k).count() < k:
            probes = min(len(order), 2 * probes)
        rows = table.where(F.col("cell").isin(order[:probes]))
        return rows.select("id", *columns, similarity_to(F.col("embedding").cast("array<double>"), query).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)

    def probes_for(self, k: int, recall: float, sample: int = 256) -> int:
        """The fewest cells whose search finds ``recall`` of the k closest of ``sample`` indexed vectors (by a hash of their id), measured against all rows."""
        table = self.spark.read.parquet(self.path)
        picked = table.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(sample).select(F.monotonically_increasing_id().alias("question"), "embedding").collect()
        if not picked:
            return len(self.centres)
        q = np.array([list(r.embedding) for r in picked], np.float64)
        order = np.argsort(-(q @ self.centres.T), axis=1, kind="stable")
        turn = np.argsort(order, axis=1)
        at = {r.question: i for i, r in enumerate(picked)}
        exact = self.nearest_of_many(self.spark.createDataFrame(picked, "question long, embedding array<double>"), k, len(self.centres)).select("question", "cell").collect()
        found = np.bincount([turn[at[r.question], r.cell] for r in exact], minlength=len(self.centres)).cumsum()
        return int(np.argmax(found >= recall * found[-1])) + 1

    def nearest_of_many(self, questions: DataFrame, k: int, probes: int, block: int = 512) -> DataFrame:
        """question, id, similarity, rank, cell: (approximately) the k closest of each question (question, embedding), from the ``probes`` cells nearest to it.

        Questions are taken in blocks as in the exact search; a batch of rows meets only the questions that probe its cells."""
        parts, held = [], []
        for r in questions.select("question", "embedding").toLocalIterator():
            held.append(r)
            if len(held) == block:
                parts.append(self._block_nearest(held, k, probes))
                held = []
        if held or not parts:
            parts.append(self._block_nearest(held, k, probes))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        best = Window.partitionBy("question").orderBy(F.desc("similarity"), "id")
        return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def _block_nearest(self, questions: list, k: int, probes: int) -> DataFrame:
        q = np.array([list(r.embedding) for r in questions], np.float64)
        asked = np.zeros((len(self.centres), len(questions)), bool)
        if questions:
            order = np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, :probes]
            asked[order.T, np.arange(len(questions))] = True
        shared = self.spark.sparkContext.broadcast((np.array([r.question for r in questions], np.int64), q, asked))

        def run(batches):
            ids, q, asked = shared.value
            for b in batches:
                home = np.asarray(b.column("cell"))
                for cell in np.unique(home).tolist():
                    mine = np.flatnonzero(asked[cell])
                    if not len(mine):
                        continue
                    rows = b.filter(pa.array(home == cell))
                    row = np.asarray(rows.column("id"))
                    near = cosines(matrix(rows.column("embedding")), q[mine])
                    order = np.lexsort((np.broadcast_to(row[:, None], near.shape), -near), axis=0)[:k]
                    n = len(order)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(ids[mine], n)), pa.array(row[order].ravel()), pa.array(np.take_along_axis(near, order, axis=0).ravel()), pa.array(np.full(n * len(mine), cell, np.int32))],
                        ["question", "id", "similarity", "cell"],
                    )

        rows = self.spark.read.parquet(self.path).where(F.col("cell").isin(np.flatnonzero(asked.any(axis=1)).tolist()))
        return rows.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("cell").cast("int").alias("cell")).mapInArrow(run, "question long, id long, similarity double, cell int")
