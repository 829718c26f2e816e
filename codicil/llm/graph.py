"""Connected components of a graph given as edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settled


#: Edges (16 bytes each) that one task finishes at once.
ONE_TASK = 1 << 18


def _stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Edges as stars around the smallest node of each of their components."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:  # smaller roots spread along edges, paths are halved
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], least)
        np.minimum.at(new, root[y], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], ["a", "b"])


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _stars(*(np.asarray(batch.column(c)) for c in ("a", "b")))


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [[np.asarray(batch.column(c)) for c in ("a", "b")] for batch in batches]
    if found:
        yield _stars(*(np.concatenate(x) for x in zip(*found)))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of each node with an edge to another; edges: a, b (long).

    The edges of each batch are contracted first. Then large and small stars in turn: first each node links its larger neighbours with its smallest one, then each node links
    its smaller neighbours with the smallest. Every round is written to the shared folder; minima are
    pre-aggregated and hot nodes only stand on the side of a join that can be split. Rounds: about the logarithm of the longest path.
    Once no more than ONE_TASK edges are left, a single task finishes them."""
    now = settled(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_contracted, "a long, b long").distinct())
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if not mark.n or (mark.n, mark.s) == seen:
            return _named(now)
        seen = (mark.n, mark.s)
        if mark.n <= ONE_TASK:
            return _named(settled(now.coalesce(1).mapInArrow(_finished, "a long, b long")))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = settled(moved.unionByName(small.select("a", F.col("m").alias("b"))).where("a != b").distinct())
        forget(now)
        now = then


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
