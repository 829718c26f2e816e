"""CSV records read in splits: the same rows however the file is cut."""

import csv
import random

import pytest

from codicil.sources.records import COLUMNS, read_records
from codicil.sources.splits import records


def text_of(rows, end):
    import io

    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL).writerows(rows)
    return out.getvalue()


def made(n, seed=3):
    r = random.Random(seed)
    pieces = ["plain", 'with "quotes"', "line\nbreak", "a\n\n\nb", "comma, here", '"', '""\n"', "ñ é 日本", "", " "]
    return [[str(i + 1)] + [r.choice(pieces) for _ in COLUMNS[1:]] for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("bom", ["", "﻿"])
def test_the_same_with_1_and_64_splits(spark, tmp_path, end, bom):
    rows = made(400)
    rows[7][5] = "long " * 3000 + "\n" + "x" * 9000  # longer than several splits
    lines = text_of([COLUMNS], end) + text_of(rows[:200], end) + end + "," * (len(COLUMNS) - 1) + end + text_of(rows[200:], end)
    path = f"{tmp_path}/r.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(bom + lines)
    seen = []
    was = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")}
    try:
        for size in (1 << 30, len(lines.encode()) // 64):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            spark.conf.set("spark.sql.files.minPartitionNum", "1" if size == 1 << 30 else "64")
            parts = spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions()
            assert parts == 1 if size == 1 << 30 else parts > 40
            out = read_records(spark, path)
            assert out.columns == [*COLUMNS, "line"]
            seen.append(sorted([r.line, *(r[c] for c in COLUMNS)] for r in out.collect()))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    assert seen[0] == seen[1]
    assert [r[0] for r in seen[0]] == list(range(2, 402))
    assert [r[1:] for r in seen[0]] == rows


def test_several_files_and_odd_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h\n"one\ntwo"\nthree')
    (tmp_path / "b.csv").write_text("h\n\n\nfour\n")
    (tmp_path / "c.csv").write_text("")
    got = sorted((r.file[-5:], r.number, r.raw) for r in records(spark, str(tmp_path)).collect())
    assert got == [("a.csv", 1, "h"), ("a.csv", 2, '"one\ntwo"'), ("a.csv", 3, "three"), ("b.csv", 1, "h"), ("b.csv", 2, "four")]


def test_a_missing_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="columns missing"):
        read_records(spark, f"{tmp_path}/a.csv")
