"""Helpers shared by the training-text operators."""

from __future__ import annotations

import ctypes
import hashlib
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents handled at once inside a Python worker; bounds its memory.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_number(value: Column, name: str) -> Column:
    """value as a long; a value that is no number stops the job, as a row without its id would be taken for another one."""
    found = value.try_cast("long")
    return F.when(value.isNotNull() & found.isNull(), F.raise_error(F.concat(F.lit(f"{name} must be a whole number, got "), value.cast("string"))).cast("long")).otherwise(found)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns, cast (an id that is no number is an error); whatever else the table holds, names that clash included, is left behind."""
    return df.select(*((whole_number(F.col(c), c) if kind == "long" and df.schema[c].dataType != T.LongType() else F.col(c).cast(kind)).alias(c) for c, kind in columns.items()))


class Carried:
    """A table whose columns travel along under names of their own (``kept_0`` and so on), so that no name can clash with an operator's.

    ``rows`` has doc_id, text and the kept columns; ``kept`` their types; back() gives the columns of the table again."""

    def __init__(self, docs: DataFrame):
        self.names, types = docs.columns, [f.dataType for f in docs.schema]
        own = {"doc_id": T.LongType(), "text": T.StringType()}
        at = {c: self.names.index(c) for c in own}
        self.place = {at[c]: c for c, kind in own.items() if types[at[c]] == kind}
        flat = docs.toDF(*(f"kept_{i}" for i in range(len(types))))
        self.kept = {f"kept_{i}": kind.simpleString() for i, kind in enumerate(types) if i not in self.place}
        doc, text = (F.col(f"kept_{at[c]}") for c in own)
        self.rows = flat.select((doc if 'doc_id' in self.place.values() else whole_number(doc, "doc_id")).alias("doc_id"), text.cast("string").alias("text"), *self.kept)

    def back(self, out: DataFrame, **changed: Column) -> DataFrame:
        """The columns of the table from out; ``changed``: others instead of those."""
        found = [changed.get(c, F.col(self.place.get(i, f"kept_{i}"))).alias(f"back_{i}") for i, c in enumerate(self.names)]
        return out.select(*found).toDF(*self.names)


_release: list[Callable[[], None]] = []


def on_release(fn: Callable[[], None]) -> None:
    """Has fn called whenever a task of this worker ends: for what is only remembered to save time within a task."""
    _release.append(fn)


def release() -> None:
    """Gives memory back at the end of a task, as workers live on and share an executor with those of later stages."""
    for fn in _release:
        fn()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such function outside glibc
        pass


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow whose workers give memory back when a task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType, rows: int = SLICE) -> DataFrame:
    """Applies fn to slices of at most ``rows`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                if (out := fn(batch.slice(at, rows))) is not None:
                    yield out

    return map_batches(df, run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts, with '' for null."""
    return [x or "" for x in batch.column(name).to_pylist()]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder in the shared folder of the cluster. Where that is unset, one is made and set if all runs in one JVM (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="codicil-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/codicil-{uuid.uuid4().hex}"


#: Has Spark delete the shuffle files of a query when it ends, not whenever the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor loses nothing of it. Its shuffle files go."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes what settled() wrote for df."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(f))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that spread_join() may take for hot.
HOT_KEYS = 1000


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with table, which has each key once (how: inner or left), so that no task gets all rows of a hot key.

    Keys that more than one in HOT_KEYS of the rows have are hot: there are fewer than HOT_KEYS of them, whatever the size, so that what table has for
    them is broadcast; rows of other keys are shuffled. rows: a written table, as it is read several times; the columns of table are numbers."""
    total = rows.count()
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") * HOT_KEYS > total) & (F.col("n") > 1))
    hot = settled(counts.where(F.col(key).isNotNull()).select(key))
    if hot.isEmpty():
        return rows.join(table, key, how)
    known = settled(table.join(F.broadcast(hot), key, "left_semi"))
    often = rows.join(F.broadcast(hot.join(known, key, how)), key)
    return often.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, how))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor, shift, multiply), on uint64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of well-mixed uint64 keys: the b-th holds the b-th part of the range of keys. buckets: below 2**31."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def packed(keys: np.ndarray, record: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Records (a structured array) by bucket of their key: one (bucket, bytes) for each bucket, so that a shuffle moves
    few large rows instead of many small ones. Equal keys share a bucket."""
    bucket = bucket_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, record = bucket[order], record[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
    return [(int(bucket[a]), record[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]


def buckets_for(spark: SparkSession) -> int:
    """Buckets for packed(): a power of two, about five for each shuffle partition, so that partitions come out fairly even."""
    return 1 << int(np.ceil(np.log2(4 * shuffle_partitions(spark))))


def gathered(df: DataFrame, fn: Callable[[Iterator[tuple[int, int, list[bytes]]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Shuffles rows (kind, bucket, data) by bucket and calls fn for each partition with its (kind, bucket, all data), in that order.

    Spark sorts the partition (and spills, if it has to), so that a worker holds the data of one bucket at a time."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
        key, data = None, []
        for b in batches:
            for i, now in enumerate(zip(b.column("kind").to_pylist(), b.column("bucket").to_pylist())):
                if now != key:
                    if key:
                        yield *key, data
                    key, data = now, []
                data.append(b.column("data")[i].as_py())
        if key:
            yield *key, data

    return map_batches(df.repartition(shuffle_partitions(df.sparkSession), "bucket").sortWithinPartitions("kind", "bucket"), lambda batches: fn(parts(batches)), schema)


PACKED = "kind int, bucket int, data binary"
#: Bytes of packed rows that a task holds before it sends them on.
HELD = 12 << 20


def joined_rows(parts: Iterator[list[tuple[int, int, bytes]]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Packed rows of the same kind and bucket put together, over about HELD bytes at a time."""
    found: dict[tuple[int, int], list[bytes]] = {}
    size = 0
    for rows in parts:
        for kind, bucket, data in rows:
            found.setdefault((kind, bucket), []).append(data)
            size += len(data)
        if size >= HELD:
            yield [(k, b, b"".join(d)) for (k, b), d in found.items()]
            found, size = {}, 0
    if found:
        yield [(k, b, b"".join(d)) for (k, b), d in found.items()]


def packed_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _, _ in rows], pa.int32()), pa.array([b for _, b, _ in rows], pa.int32()), pa.array([d for _, _, d in rows], pa.binary())],
        ["kind", "bucket", "data"],
    )


def hex_sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))
