"""Tables kept as versions: each change writes a new folder beside the old ones and then takes the next number, so that readers see the
table before or after it, and a failed write leaves nothing behind that is read. Folders of older versions stay until vacuum(), so that a plan which reads one can still be retried.

Rows are never changed in place (plain Parquet has no MERGE): what stays is anti-joined and what is new is put beside it. The store may be in any
file system that Spark reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbered import content, drop, file_system, numbers, take


class VersionedTable:
    """A small table that is written whole."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def versions(self) -> list[int]:
        return numbers(self.spark, self.path)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, of the last one without a number."""
        if number is None:
            number = max(self.versions(), default=0)
        if not number:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{content(self.spark, self.path, number)}")

    def write(self, df: DataFrame, after: int | None = None) -> int:
        """Makes df the table; its number. ``after``: the version that df was made from; a Conflict if there is a later one."""
        number = (max(self.versions(), default=0) if after is None else after) + 1
        folder = f"v-{number:020d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{folder}")
        take(self.spark, self.path, number, folder)
        return number

    def append(self, df: DataFrame) -> int:
        at = max(self.versions(), default=0)
        return self.write(self.read(at).unionByName(df), at)

    def compact(self, files: int) -> int:
        """The table in fewer files."""
        at = max(self.versions(), default=0)
        return self.write(self.read(at).coalesce(files), at)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all versions before the last ``keep``, and what writes that failed left; how many folders went. Nobody may read an older version any more, nor write."""
        known = self.versions()
        kept = {content(self.spark, self.path, n) for n in known[-keep:]}
        fs, p = file_system(self.spark, self.path)
        old = [x.getPath() for x in fs.listStatus(p) if x.getPath().getName().startswith("v-") and x.getPath().getName() not in kept] if fs.exists(p) else []
        for x in old:
            fs.delete(x, True)
        for n in known[:-keep]:
            drop(self.spark, self.path, n)
        return len(old)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None, created: str | None = "created_at", updated: str | None = "updated_at", now: object = None) -> DataFrame:
    """old with the rows of new put in or over those of the same key. Where new has a key several times, the row of the largest ``order`` counts
    (without one: the largest row). ``created`` keeps its old value; ``updated`` is set for the rows of new."""
    columns = [c for c in new.columns if c != order]
    best = F.max_by(F.struct(*columns), F.col(order)) if order else F.max(F.struct(*columns))
    last = new.groupBy(F.col(key).alias("_k")).agg(best.alias("_r")).select("_r.*")
    stamp = F.lit(now) if now is not None else F.current_timestamp()
    if updated:
        last = last.withColumn(updated, stamp)
    if created:
        before = old.select(F.col(key).alias("_k"), F.col(created).alias("_created"))
        last = last.join(before, last[key] == before["_k"], "left").withColumn(created, F.coalesce("_created", stamp)).drop("_k", "_created")
    kept = old.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.select(*(F.col(f.name).cast(f.dataType) for f in old.schema)))


def replace_children(old: DataFrame, new: DataFrame, parent: str, parents: DataFrame) -> DataFrame:
    """The children of ``parents`` replaced by new; those of other parents stay."""
    return old.join(parents.select(parent).distinct(), parent, "left_anti").unionByName(new.select(*old.columns))


def cascade(children: DataFrame, parents: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """The children whose parent is still there."""
    return children.join(parents.select(F.col(key).alias(foreign)).distinct(), foreign, "left_semi")


def save_vectors(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """chunks with the vectors (id, embedding) put in."""
    v = vectors.select(F.col("id").alias("_id"), F.col("embedding").alias("_v"))
    out = chunks.join(v, chunks.id == v._id, "left")
    fresh = F.col("_v").isNotNull()
    return out.select(*(
        F.coalesce("_v", "embedding").alias(c) if c == "embedding" else F.when(fresh, F.lit(model)).otherwise(F.col(c)).alias(c) if c == "embedding_model" else F.col(c) for c in chunks.columns
    ))


def reset_vectors(chunks: DataFrame) -> DataFrame:
    kinds = dict(chunks.dtypes)
    return chunks.withColumns({c: F.lit(None).cast(kinds[c]) for c in ("embedding", "embedding_model")})


def forget_vectors(chunks: DataFrame, regulations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks without the vectors of the regulations (regulation_id), one row ``forgotten``: how many had one)."""
    ids = regulations.select("regulation_id").distinct().withColumn("_hit", F.lit(True))
    marked = chunks.join(ids, "regulation_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    kinds = dict(chunks.dtypes)
    out = marked.select(*(F.when(~hit, F.col(c)).cast(kinds[c]).alias(c) if c in ("embedding", "embedding_model") else F.col(c) for c in chunks.columns))
    return out, marked.agg(F.count_if(hit & F.col("embedding").isNotNull()).alias("forgotten"))


#: Kinds of work that an update may leave unfinished.
WORK = ("refetch", "rechunk", "revector")


def work_counts(work: DataFrame) -> dict[str, int]:
    """How much of each kind there is in a journal (kind, id)."""
    return work.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in WORK)).first().asDict()
