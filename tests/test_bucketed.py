"""Tables as a log of changes over buckets."""

import os

import pytest
from pyspark.sql import functions as F

from codicil.sources.bucketed import BucketedTable, Conflict

SCHEMA = "id long, name string, created_at timestamp, updated_at timestamp"


def rows_of(t, number=None):
    return sorted(((r.id, r.name) for r in t.read(number).collect()), key=str)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    t = BucketedTable(spark, f"{tmp_path}/t", SCHEMA, "id", buckets=16)
    t.append(spark.range(1000).select("id", F.concat(F.lit("a"), "id").alias("name"), F.lit("2020-01-01").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at")))
    return t


def test_upsert_writes_only_the_buckets_it_touches(spark, table):
    before = files(table.path)
    new = spark.createDataFrame([(5, "x"), (5, "y"), (2000, "z")], "id long, name string")
    done = table.upsert(new.withColumns({"created_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp")}), created="created_at", updated="updated_at")
    assert before <= files(table.path) and len(done.touched) <= 2
    got = {r.id: r for r in table.read().collect()}
    assert len(got) == 1001 and got[5].name == "y" and got[2000].name == "z" and got[6].name == "a6"
    assert got[5].created_at.year == 2020 and got[2000].created_at.year > 2020 and got[5].updated_at and got[6].updated_at is None
    assert rows_of(table, 1) == sorted(((i, f"a{i}") for i in range(1000)), key=str)  # the version before is still there


def test_one_percent(spark, table):
    new = spark.range(0, 10).select("id", F.lit("n").alias("name"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    assert len(table.upsert(new).touched) <= 10 and table.read().where("name = 'n'").count() == 10 and table.read().count() == 1000


def test_delete_replace_compact_vacuum(spark, table):
    table.delete(spark.createDataFrame([(1,), (2,), (7777,)], "k long"))
    table.replace(spark.createDataFrame([(3, "p", None, None), (3, "q", None, None)], SCHEMA), spark.createDataFrame([(3,), (4,)], "k long"))
    table.append(spark.createDataFrame([(1, "back", None, None)], SCHEMA))
    want = sorted([(i, f"a{i}") for i in range(5, 1000)] + [(0, "a0"), (1, "back"), (3, "p"), (3, "q")], key=str)
    assert rows_of(table) == want
    dirty = {b for own in table.version().gone.values() for b in own}
    done = table.compact()
    assert set(done.touched) == dirty and not done.gone and rows_of(table) == want and rows_of(table, 3) != want
    assert table.vacuum(keep=1) > 0 and table.versions() == [5] and rows_of(table) == want
    assert table.compact().number == 5  # nothing left to do


def test_null_keys_empty_changes_and_conflicts(spark, table):
    at = table.version()
    none = spark.createDataFrame([], SCHEMA)
    assert table.append(none).number == at.number and table.upsert(none).number == at.number
    table.upsert(spark.createDataFrame([(None, "n", None, None), (None, "m", None, None)], SCHEMA))
    assert sorted(r.name for r in table.read().where("id is null").collect()) == ["m", "n"]
    table.delete(spark.createDataFrame([(None,)], "k long"))
    assert table.read().where("id is null").count() == 0
    with pytest.raises(Conflict):
        table._change(none.limit(0), spark.createDataFrame([(1,)], "k long"), at)
    assert table.read().count() == 1000


def test_an_empty_table(spark, tmp_path):
    t = BucketedTable(spark, f"{tmp_path}/e", SCHEMA, "id")
    assert t.read().count() == 0 and t.versions() == [] and t.vacuum() == 0 and t.compact().number == 0
    t.delete(spark.createDataFrame([(1,)], "k long"))
    assert t.read().count() == 0
