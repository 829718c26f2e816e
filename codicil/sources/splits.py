"""Records of CSV files that are read in splits, quoted line breaks and all.

Spark cuts a text file into splits at line breaks, but in CSV a line break may stand inside quotes, and whether it does depends on all quotes before it. So there are two passes.
The first counts, for each split, its quotes and how many records end in it, both if it begins outside quotes and if it begins inside. Summed over the splits before, that tells for each
split whether it begins inside quotes and how many records came before: one row a split, so the table of them is small beside the file (a row for each 128 MB or so).
The second pass cuts each split where lines end outside quotes. What is left at the ends of splits are parts of records, which are put together by their record's number.

A record has a number in its file, 1 for the header; records without a value have none. Quotes inside a value are doubled; a single quote inside a value that isn't quoted is no valid CSV
and would turn what follows inside out.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How from_csv reads one record. The values may hold line breaks, so none of the characters of a text ends a record.
CSV = {"quote": '"', "escape": '"', "nullValue": "\0", "emptyValue": "", "multiLine": "true", "maxCharsPerColumn": "-1"}
_NO_VALUE = re.compile('[,"\r \t]*')


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split (where it begins), line; in the order of each split."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))


def _empty(record: str) -> bool:
    if not _NO_VALUE.fullmatch(record):
        return False
    return not any(any(row) for row in csv.reader([record.rstrip("\r")]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, split, quotes, ends outside quotes if it begins outside (ends0) or inside (ends1)."""
    found: dict[tuple[str, int], list] = {}
    for batch in batches:
        for file, split, line in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "line"))):
            now = found.setdefault((file, split), [0, 0, 0, True])
            alone = not now[0] % 2  # the line begins outside quotes, if the split does
            now[0] += line.count('"')
            after = now[0] % 2
            if not after and not (alone and _empty(line)):
                now[1] += 1
            if after and not (not alone and _empty(line)):
                now[2] += 1
    rows = [(*k, *v[:3]) for k, v in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int64()) for i in range(5)], ["file", "split", "quotes", "ends0", "ends1"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, number, part (the split, or -1 for a whole record), raw of the records and parts of records of each split."""
    out: list[list] = [[], [], [], []]
    key, number, inside, held, begun = None, 0, False, [], False

    def put(part: int) -> None:
        for c, v in zip(out, (key[0], number + 1, part, "\n".join(held))):
            c.append(v)

    for batch in batches:
        for file, split, odd, before, line in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "inside", "before", "line"))):
            if (file, split) != key:
                if held:
                    put(key[1])
                key, number, inside, held, begun = (file, split), before, bool(odd), [], bool(odd)
            if split == 0 and not held and number == 0:
                line = line.lstrip("﻿")
            held.append(line)
            inside ^= line.count('"') % 2 == 1
            if inside:
                continue
            if begun or not (len(held) == 1 and _empty(line)):
                put(split if begun else -1)
                number += 1
            held, begun = [], False
        if len(out[0]) > 2000:
            yield _made(out)
            out = [[], [], [], []]
    if held:
        put(key[1])
    yield _made(out)


def _made(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["file", "number", "part", "raw"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, number, raw (as it stands in the file, without the line break after it) of every record."""
    counts = _lines(spark, path).mapInArrow(_counted, "file string, split long, quotes long, ends0 long, ends1 long")
    counts = counts.groupBy("file", "split").agg(*(F.sum(c).alias(c) for c in ("quotes", "ends0", "ends1")))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    placed = placed.withColumn("before", F.coalesce(F.sum(F.when(F.col("inside") == 0, F.col("ends0")).otherwise(F.col("ends1"))).over(earlier), F.lit(0)))
    # one row for each split of a file
    lines = _lines(spark, path).join(F.broadcast(placed.select("file", "split", "inside", "before")), ["file", "split"])
    pieces = lines.select("file", "split", "inside", "before", "line").mapInArrow(_cut, "file string, number long, part long, raw string")
    parts = pieces.where("part >= 0").groupBy("file", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "raw"))), lambda x: x["raw"]), "\n").alias("raw"))
    whole = pieces.where("part < 0").select("file", "number", "raw").unionByName(parts)
    return whole.withColumn("raw", F.regexp_replace("raw", "\r$", ""))


def header(spark: SparkSession, path: str) -> list[str]:
    """The names of the columns: the first record of the first file."""
    first = records(spark, path).where("number = 1").orderBy("file").select("raw").first()
    return next(csv.reader([first.raw])) if first else []
