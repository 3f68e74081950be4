"""Versioned tables: whole or not at all, also where a writer fails; scans that resume."""

import os

import pytest
from pyspark.sql import functions as F

from meridia.sources.versions import VersionedTable, overwrite_partitions
from meridia.streaming import scans

ROWS = "key long, source string, v long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None and table.versions() == []
    old = spark.createDataFrame([(1, "a", 1), (2, None, 2)], ROWS)
    assert table.write(old) == 1
    broken = spark.range(100).select(F.col("id").alias("key"), F.lit("b").alias("source"), F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("the disk is gone")).cast("long")).alias("v"))
    with pytest.raises(Exception, match="the disk is gone"):
        table.write(broken)
    assert table.versions() == [1] and rows(table.read()) == rows(old)
    assert any(x.startswith("_staged") for x in os.listdir(tmp_path / "t"))
    table.write(spark.createDataFrame([(9, "z", 9)], ROWS))
    table.prune(1)
    assert table.versions() == [2] and os.listdir(tmp_path / "t") == ["v00000002"] or len(table.versions()) == 1
    assert not any(x.startswith("_staged") for x in os.listdir(tmp_path / "t"))


def test_reruns_change_nothing(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], ROWS)
    new = spark.createDataFrame([(2, "b", 5), (3, "a", 6)], ROWS)
    assert table.upsert(old, "key") == 1
    assert [table.upsert(new, "key") for _ in range(3)] == [2, 2, 2]
    assert rows(table.read()) == [(1, "a", 1), (2, "b", 5), (3, "a", 6)] and rows(table.read(1)) == rows(old)
    assert [table.replace_source(spark.createDataFrame([(7, "a", 7)], ROWS), "source", "a") for _ in range(2)] == [3, 3]
    assert rows(table.read()) == [(2, "b", 5), (7, "a", 7)]
    # a row twice is another content than once
    assert table.write(table.read().unionByName(table.read())) == 4


def test_two_writers_cannot_commit_one_number(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.createDataFrame([(1, "a", 1)], ROWS))
    other = VersionedTable(spark, str(tmp_path / "t"))
    other.versions = lambda: []  # it has looked before the first was there
    with pytest.raises(FileExistsError):
        other.write(spark.createDataFrame([(2, "b", 2)], ROWS))
    assert rows(table.read()) == [(1, "a", 1)]


def test_partitions_are_overwritten_alone(spark, tmp_path):
    at = str(tmp_path / "p")
    spark.createDataFrame([(1, "a", 1), (2, "b", 2)], ROWS).write.partitionBy("source").parquet(at)
    overwrite_partitions(spark.createDataFrame([(5, "b", 5)], ROWS), at, "source")
    assert sorted((r.key, r.source) for r in spark.read.parquet(at).collect()) == [(1, "a"), (5, "b")]


def test_a_scan_goes_on_after_a_restart(spark, tmp_path):
    arrivals, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    table = VersionedTable(spark, str(tmp_path / "t"))
    schema = "key long, attempt long, answer double"

    def arrive(*attempts):
        spark.createDataFrame(list(attempts), schema).write.mode("append").parquet(arrivals)
        scans.scan(spark, arrivals, table, checkpoint)
        return {r.key: (r.done, r.attempts, r.answer) for r in table.read().collect()}

    assert arrive((1, 1, None), (1, 2, None), (2, 1, 5.0), (3, 1, None)) == {1: (False, 2, None), 2: (True, 1, 5.0), 3: (False, 1, None)}
    assert sorted(map(tuple, scans.pending(table).collect())) == [(1, 2), (3, 1)]
    # answers out of order in one arrival: the first counts; what is done stays
    got = arrive((1, 5, 9.0), (1, 3, None), (1, 4, 8.0), (2, 2, 7.0), (4, 1, None))
    assert got == {1: (True, 4, 8.0), 2: (True, 1, 5.0), 3: (False, 1, None), 4: (False, 1, None)}
    versions = table.versions()
    scans.scan(spark, arrivals, table, checkpoint)  # nothing new
    assert table.versions() == versions
