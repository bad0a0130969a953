"""The table of versions against joins over whole tables."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import documents as D
from sparkloom.sources.versioned import VersionedTable


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_changes_equal_anti_joins_and_versions_stay(spark):
    start = spark.range(200).selectExpr("id as vector_id", "id div 10 as document_id", "'a' as text")
    table = VersionedTable.create(start)
    put = spark.range(150, 260).selectExpr("id as vector_id", "id div 10 as document_id", "'b' as text")
    gone = spark.createDataFrame([(3,), (17,), (20,), (999,), (None,)], "document_id long")
    states = [start]
    assert table.upsert(put, "vector_id") == 1
    states.append(D.upserted(start, put))
    assert table.delete(gone, "document_id") == 2
    states.append(D.deleted(states[1], gone)[0])
    back = put.where("document_id = 20").withColumn("text", F.lit("c"))
    table.upsert(back, "vector_id")
    states.append(D.upserted(states[2], back))
    for version, state in enumerate(states):
        assert rows(table.read(version)) == rows(state.select(*start.columns))
    assert rows(table.read()) == rows(states[-1].select(*start.columns))
    # a change writes its own rows only
    assert rows(table.changed(1)) == rows(put) and table.changed(2).count() == 0 and table.changed(3).count() == back.count()
    assert table.compact() == 4 and rows(table.read()) == rows(table.read(3))
    assert table.reset() == 5 and rows(table.read()) == [] and table.read().columns == start.columns
    table.upsert(back, "vector_id")
    assert rows(table.read()) == rows(back)
    assert table.expired(2) > 0 and table.versions() == [5, 6] and rows(table.read()) == rows(back)


def test_two_writers_of_one_version(spark):
    table = VersionedTable.create(spark.range(5).selectExpr("id"))
    first, second = VersionedTable(spark, table.path), VersionedTable(spark, table.path)
    stale = second._manifest()
    first.delete(spark.range(1), "id")
    with pytest.raises(Exception, match="exists"):
        second._commit(stale[0] + 1, stale[1], stale[2])
    assert rows(table.read()) == [(i,) for i in range(1, 5)]


def test_null_keys_twice_keys_new_columns_and_empty_tables(spark):
    table = VersionedTable.create(spark.createDataFrame([(1, "x"), (None, "n")], "k int, v string"))
    table.upsert(spark.createDataFrame([(1, "y", 5), (1, "z", 6), (None, "m", 7)], "k int, v string, more int"), "k")
    assert rows(table.read()) == sorted([(1, "y", 5), (1, "z", 6), (None, "m", 7), (None, "n", None)], key=str)
    assert rows(table.read(0)) == sorted([(1, "x"), (None, "n")], key=str)
    empty = VersionedTable.create(spark.createDataFrame([], "k int"))
    empty.delete(spark.createDataFrame([(1,)], "k int"), "k")
    assert rows(empty.read()) == []
