"""The best rows of many questions in one scan.

Questions are taken in blocks. A task keeps the k best rows of each question of a block over all it reads and gives only those to the shuffle, and compares CELLS pairs
at once, so that a worker's memory depends on neither the rows nor the questions. The driver holds one block: the answers of a block are written to the cluster's shared folder
before the next one is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row

from codicil.functions.vectors import cosines
from codicil.sources.temporary import shared_folder

#: Pairs that are compared at once, those among them whose cosine is taken again, questions of a block, and best rows that a worker holds for a block.
CELLS, PAIRS, BLOCK, HELD = 1 << 19, 1 << 13, 1024, 1 << 18
#: Room for rounding in bounds.
SLACK = 1e-6


def block_for(k: int) -> int:
    """Questions of a block, of which k rows each are held."""
    return max(1, min(BLOCK, HELD // max(k, 1)))


def pair_cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, and so the same for equal vectors wherever they stand; 0 where a norm is 0."""
    norms = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
    dots = np.einsum("ij,ij->i", x, y)
    return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


class Best:
    """The k rows with the largest scores of each of n questions, ties by id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.floor, self.last = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)  # what the k-th has, where there are k
        self.turn, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, turn: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows for the questions at turn."""
        keep = (scores > self.floor[turn]) | ((scores == self.floor[turn]) & (ids < self.last[turn]))
        self.new.append((turn[keep], ids[keep], scores[keep]))
        self.count += int(keep.sum())
        if self.count >= self.n * self.k:
            self.merge()

    def merge(self) -> None:
        turn, ids, scores = (np.concatenate(c) for c in zip((self.turn, self.ids, self.scores), *self.new))
        order = np.lexsort((ids, -scores, turn))
        turn, ids, scores = turn[order], ids[order], scores[order]
        keep = np.arange(len(turn)) - np.searchsorted(turn, turn) < self.k
        self.turn, self.ids, self.scores, self.new, self.count = turn[keep], ids[keep], scores[keep], [], 0
        held = np.bincount(self.turn, minlength=self.n)
        full = held == self.k
        at = (np.cumsum(held) - 1)[full]
        self.floor[full], self.last[full] = self.scores[at], self.ids[at]

    def scan(self, ids: np.ndarray, x: np.ndarray, q: np.ndarray, may: np.ndarray | None = None) -> None:
        """Takes rows by their cosines with the questions; may: the pairs that can be among the best."""
        near = cosines(x, q)
        floor = self.floor
        if len(near) > self.k and (floor == -np.inf).any():  # no row below the k-th of these can be among the best
            floor = np.maximum(floor, np.partition(near, len(near) - self.k, axis=0)[len(near) - self.k])
        worth = near >= floor - SLACK
        row, turn = np.nonzero(worth if may is None else worth & may)
        for at in range(0, len(row), PAIRS):
            r, t = row[at : at + PAIRS], turn[at : at + PAIRS]
            self.add(t, ids[r], pair_cosines(x[r], q[t]))

    def rows(self, names: np.ndarray, columns: tuple[str, str, str], size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        """The question (by names), id and score of what is held."""
        if self.new:
            self.merge()
        for at in range(0, len(self.turn), size):
            part = slice(at, at + size)
            yield pa.RecordBatch.from_arrays([pa.array(names[self.turn[part]]), pa.array(self.ids[part]), pa.array(self.scores[part])], list(columns))


def slices(batches: Iterator[pa.RecordBatch], questions: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to CELLS pairs with so many questions; none if there are none."""
    step = max(1, CELLS // max(questions, 1))
    for b in batches:
        for at in range(0, b.num_rows if questions else 0, step):
            yield b.slice(at, step)


def by_blocks(questions: DataFrame, size: int, answer: Callable[[list[Row]], DataFrame]) -> DataFrame:
    """answer(block) of questions (question, embedding) for one block after the other; those of several blocks are written, each before the next block is read."""
    spark, path, held = questions.sparkSession, None, []
    for r in questions.select("question", "embedding").where("embedding is not null").toLocalIterator():
        if len(held) == size:
            path = path or shared_folder(spark)
            answer(held).write.mode("append").parquet(path)
            held = []
        held.append(r)
    last = answer(held)
    if path is None:
        return last
    last.write.mode("append").parquet(path)
    return spark.read.schema(last.schema).parquet(path)


def block_of(asked: list[Row]) -> tuple[np.ndarray, np.ndarray]:
    """The names and vectors of a block."""
    return np.array([r.question for r in asked], np.int64), np.array([list(r.embedding) for r in asked], np.float64) if asked else np.zeros((0, 1))
