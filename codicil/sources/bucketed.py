"""Tables as a log of changes over buckets of their key, so that a change writes what it changes and nothing else.

Every change is a folder of new rows, parted by bucket, and perhaps one of delete vectors: keys whose rows in earlier changes no longer count. The log holds one small numbered
file for each version with the changes that make it up; the highest number is the table. A version is taken by creating its file, which fails where another
writer was first, so nothing is ever replaced and a crash leaves the last version whole. Readers of an older version keep its folders until vacuum() is told that
nobody needs them.

Reading puts the rows of all changes together; only in buckets with delete vectors are rows joined with them (by key, later changes only). compact() rewrites the buckets that have
gathered many changes, each into one folder without delete vectors.

Rules: rows whose key is null share a bucket and are never upserted over one another: each stays until it is deleted as null. Where new rows have a key several times, upsert()
keeps one (as store.upsert does), append() and replace() keep all. A change of no rows makes no version."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbered import Conflict, content, drop, file_system, numbers, take

__all__ = ["BucketedTable", "Conflict", "Version"]


@dataclass
class Version:
    number: int = 0
    data: dict[str, list[int]] = field(default_factory=dict)  # buckets of each change with rows
    gone: dict[str, list[int]] = field(default_factory=dict)  # and with delete vectors
    touched: list[int] = field(default_factory=list)  # buckets that this version wrote


class BucketedTable:
    """key: the column that rows are found, replaced and deleted by."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = T.StructType.fromDDL(schema)
        self._key = T.StructType([T.StructField("_key", self.schema[key].dataType)])

    def _fs(self, name: str):
        return file_system(self.spark, f"{self.path}/{name}")

    def versions(self) -> list[int]:
        return numbers(self.spark, self.path)

    def version(self, number: int | None = None) -> Version:
        """The version of that number, the last one without."""
        if number is None:
            number = max(self.versions(), default=0)
        return Version(**json.loads(content(self.spark, self.path, number))) if number else Version()

    def _commit(self, now: Version) -> Version:
        take(self.spark, self.path, now.number, json.dumps(now.__dict__))
        return now

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def _written(self, rows: DataFrame, kind: str, change: str, key: str) -> list[int]:
        """Writes rows by bucket; the buckets that have any."""
        path = f"{self.path}/{kind}/change={change}"
        placed = rows.withColumn("bucket", self.bucket_of(F.col(key)))
        placed.repartition("bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(4))).write.partitionBy("bucket").parquet(path)
        fs, p = self._fs(f"{kind}/change={change}")
        return sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(p) if x.getPath().getName().startswith("bucket="))

    def _scan(self, kind: str, schema: T.StructType, parts: dict[str, list[int]], only: set[int] | None) -> DataFrame:
        """The rows of some changes, with ``change`` and ``bucket``."""
        paths = [f"{self.path}/{kind}/change={c}/bucket={b}" for c, buckets in parts.items() for b in buckets if only is None or b in only]
        whole = T.StructType([*schema, T.StructField("change", T.StringType()), T.StructField("bucket", T.IntegerType())])
        if not paths:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", f"{self.path}/{kind}").parquet(*paths)

    def read(self, number: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version; ``buckets``: of those only."""
        at = self.version(number)
        dirty = {b for own in at.gone.values() for b in own}
        columns = [f.name for f in self.schema]
        clean = self._scan("data", self.schema, at.data, set(range(self.buckets)) - dirty if buckets is None else buckets - dirty).select(*columns)
        if not (dirty if buckets is None else dirty & buckets):
            return clean
        some = dirty if buckets is None else dirty & buckets
        rows = self._scan("data", self.schema, at.data, some)
        gone = self._scan("gone", self._key, at.gone, some).groupBy(F.col("_key").alias("_k"), F.col("bucket").alias("_b")).agg(F.max("change").alias("_c"))
        kept = rows.join(gone, (rows.bucket == gone._b) & rows[self.key].eqNullSafe(gone._k) & (rows.change < gone._c), "left_anti")
        return clean.unionByName(kept.select(*columns))

    def of_keys(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is in keys (one column), read from their buckets alone."""
        name = keys.columns[0]
        touched = {r[0] for r in keys.select(self.bucket_of(F.col(name))).distinct().collect()}
        return self.read(buckets=touched).join(keys.select(F.col(name).alias(self.key)).distinct(), self.key, "left_semi")

    def _change(self, rows: DataFrame | None, gone: DataFrame | None, base: Version | None = None) -> Version:
        at = base or self.version()
        change = f"{at.number + 1:020d}-{uuid.uuid4().hex[:8]}"
        data = self._written(rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)), "data", change, self.key) if rows is not None else []
        # rows of the same change stay: delete vectors count for earlier ones
        lost = self._written(gone.select(F.col(gone.columns[0]).cast(self._key[0].dataType).alias("_key")).distinct(), "gone", change, "_key") if gone is not None else []
        if not data and not lost:
            return at
        held = {b for own in at.data.values() for b in own}
        lost = [b for b in lost if b in held]
        return self._commit(Version(at.number + 1, at.data | ({change: data} if data else {}), at.gone | ({change: lost} if lost else {}), sorted({*data, *lost})))

    def append(self, rows: DataFrame) -> Version:
        return self._change(rows, None)

    def delete(self, keys: DataFrame) -> Version:
        """Without the rows of those keys (one column)."""
        return self._change(None, keys)

    def replace(self, rows: DataFrame, keys: DataFrame) -> Version:
        """The rows of those keys (one column) replaced by others, in one version."""
        return self._change(rows, keys)

    def upsert(self, new: DataFrame, order: str | None = None, created: str | None = None, updated: str | None = None, now: object = None) -> Version:
        """new put in or over the rows of the same key; see store.upsert. Only the buckets of new keys are read (for ``created``) and written."""
        from .store import upsert
        from .temporary import shared_folder

        at = self.version()
        path = f"{shared_folder(self.spark)}/upsert"
        new.write.parquet(path)
        new = self.spark.read.schema(new.schema).parquet(path)
        keys = new.select(self.key).where(F.col(self.key).isNotNull())
        old = self.of_keys(keys) if created else self.spark.createDataFrame([], self.schema)
        rows = upsert(old, new.where(F.col(self.key).isNotNull()), self.key, order, created, updated, now)
        nulls = new.where(F.col(self.key).isNull())
        columns = {f.name: F.lit(now) if f.name in (created, updated) and now is not None else F.current_timestamp() if f.name in (created, updated) else F.col(f.name) for f in self.schema}
        return self._change(rows.unionByName(nulls.select(*(c.cast(self.schema[n].dataType).alias(n) for n, c in columns.items()))), keys, at)

    def compact(self, most: int = 4) -> Version:
        """Rewrites the buckets that have delete vectors or more than ``most`` changes; the others stay as they are."""
        at = self.version()
        count = {b: sum(b in own for own in at.data.values()) for own in at.data.values() for b in own}
        dirty = {b for own in at.gone.values() for b in own} | {b for b, n in count.items() if n > most}
        if not dirty:
            return at
        change = f"{at.number + 1:020d}-{uuid.uuid4().hex[:8]}"
        data = self._written(self.read(at.number, dirty), "data", change, self.key)
        rest = {c: kept for c, own in at.data.items() if (kept := [b for b in own if b not in dirty])}
        return self._commit(Version(at.number + 1, rest | ({change: data} if data else {}), {}, sorted(dirty)))

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the versions before the last ``keep``, and the folders that none of those holds; how many folders went. Nobody may read an older version any more, nor write."""
        numbers = self.versions()
        held = {"data": set(), "gone": set()}
        for n in numbers[-keep:]:
            at = self.version(n)
            for kind, parts in (("data", at.data), ("gone", at.gone)):
                held[kind] |= {f"change={c}/bucket={b}" for c, own in parts.items() for b in own}
        gone = 0
        for kind, kept in held.items():
            fs, p = self._fs(kind)
            for change in fs.listStatus(p) if fs.exists(p) else []:
                for bucket in fs.listStatus(change.getPath()):
                    name = f"{change.getPath().getName()}/{bucket.getPath().getName()}"
                    if bucket.isDirectory() and name not in kept:
                        fs.delete(bucket.getPath(), True)
                        gone += 1
        for n in numbers[:-keep]:
            drop(self.spark, self.path, n)
        return gone
