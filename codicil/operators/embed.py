"""Embedding of chunks by a model behind the Embedder interface."""

from __future__ import annotations

import math
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import AccumulatorParam
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.functions.vectors import Embedder, EmbeddingDimensionError
from codicil.sources.temporary import shared_folder

BATCH, GIVE_UP_AFTER = 32, 5
#: Chunks to a part that is saved before the next is begun, and how many parts there are at most (each reads what is to be embedded once).
PART, MOST_PARTS = 1_000_000, 16
_SCHEMA = pa.schema([("id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("error", pa.string())])


class TooManyFailures(RuntimeError):
    """So many texts in a row could not be embedded that the model must be down."""


class _FirstReason(AccumulatorParam):
    """Keeps the first reason that reaches the driver."""

    def zero(self, value: str) -> str:
        return ""

    def addInPlace(self, value1: str, value2: str) -> str:
        return value1 or value2


def embed_chunks(chunks: DataFrame, embedder: Callable[[], Embedder], dimensions: int, batch: int = BATCH, give_up_after: int = GIVE_UP_AFTER, gave_up: Accumulator | None = None) -> DataFrame:
    """id, embedding, error of chunks (id, input): texts are sent in batches; one that fails is sent text by text, and what fails alone is reported in error.
    A vector of another length ends the job. After ``give_up_after`` failures in a row a task fails; with ``gave_up`` it ends instead, without trying again, and leaves
    its other chunks out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, failed = embedder(), 0

        def sent(texts: list[str]) -> list[list[float]]:
            vectors = model.embed(texts)
            if len(vectors) != len(texts):
                raise ValueError(f"{len(texts)} texts gave {len(vectors)} vectors")
            for v in vectors:
                if len(v) != dimensions:
                    raise EmbeddingDimensionError(f"expected {dimensions} dimensions, got {len(v)}")
            return vectors

        for b in batches:
            if failed >= give_up_after:
                continue  # the rest is read, as the task's input has to be, but not sent
            ids, texts = b.column("id").to_pylist(), b.column("input").to_pylist()
            rows = []
            for at in range(0, len(ids), batch):
                if failed >= give_up_after:
                    break
                part = list(zip(ids[at : at + batch], texts[at : at + batch]))
                try:
                    rows += [{"id": i, "embedding": v, "error": None} for (i, _), v in zip(part, sent([t for _, t in part]))]
                    failed = 0
                    continue
                except EmbeddingDimensionError:
                    raise
                except Exception:  # noqa: BLE001  tried again one by one
                    pass
                for i, t in part:
                    try:
                        rows.append({"id": i, "embedding": sent([t])[0], "error": None})
                        failed = 0
                    except EmbeddingDimensionError:
                        raise
                    except Exception as e:  # noqa: BLE001
                        failed += 1
                        rows.append({"id": i, "embedding": None, "error": str(e)})
                        if failed >= give_up_after:
                            if gave_up is None:
                                raise TooManyFailures(f"{failed} texts in a row failed: {e}") from e
                            gave_up.add(f"{failed} texts in a row failed: {e}")
                            break
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return chunks.select("id", "input").mapInArrow(run, "id long, embedding array<float>, error string")


def _written(rows: DataFrame, gave_up: Accumulator) -> DataFrame:
    """rows, written and read again; as soon as a task has given up, the job is stopped and no other task asks the model."""
    spark, path, tag, done = rows.sparkSession, shared_folder(rows.sparkSession), f"embed-{uuid.uuid4().hex}", threading.Event()
    context = spark.sparkContext

    def watch() -> None:
        while not done.wait(0.1):
            if gave_up.value:
                context.cancelJobsWithTag(tag)
                return

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        rows.write.parquet(path)
    except Exception as e:
        if gave_up.value:
            raise TooManyFailures(gave_up.value) from e
        raise
    finally:
        done.set()
        context.removeJobTag(tag)
        watcher.join()
    return spark.read.schema(rows.schema).parquet(path)


def embed_and_save(
    chunks: DataFrame, embedder: Callable[[], Embedder], dimensions: int, save: Callable[[DataFrame], None], batch: int = BATCH, give_up_after: int = GIVE_UP_AFTER, part: int = PART, most_parts: int = MOST_PARTS
) -> dict[str, int]:
    """Embeds chunks (id, input) part by part and hands the vectors (id, embedding) of each to ``save``; how many were embedded and how many failed alone.

    A model that is down stops the whole run, not each task by itself: TooManyFailures. What earlier parts saved stays, and the rest is still pending for the next run."""
    n = chunks.count()
    parts = min(most_parts, math.ceil(n / part))
    embedded = failed = 0
    for i in range(parts):
        gave_up = chunks.sparkSession.sparkContext.accumulator("", _FirstReason())
        some = chunks.where(F.pmod(F.xxhash64(F.col("id"), F.lit(5)), F.lit(parts)) == i)
        rows = _written(embed_chunks(some, embedder, dimensions, batch, give_up_after, gave_up), gave_up)
        counts = rows.agg(F.count("embedding").alias("good"), F.count("error").alias("bad")).first()
        embedded, failed = embedded + counts.good, failed + counts.bad
        if counts.good:
            save(rows.where("error is null").select("id", "embedding"))
        if gave_up.value:  # the last tasks gave up together
            raise TooManyFailures(gave_up.value)
    return {"embedded": embedded, "failed": failed}
