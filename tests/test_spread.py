"""Rows from which much is made are spread over tasks by their number, not by their files' size."""

from pyspark.sql import functions as F

from meridia.operators import joins, shared


def test_tasks_follow_the_rows(spark):
    df = spark.range(shared.ROWS_A_TASK * 3, numPartitions=1)
    sizes = [r["n"] for r in shared.spread(df, "id").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == shared.ROWS_A_TASK * 3 and len(sizes) == 3
    assert shared.spread(df.limit(0), "id").count() == 0


def test_a_sheet_of_many_lines_is_parted(spark, monkeypatch):
    monkeypatch.setattr(joins, "LINES_A_PART", 10)
    k = F.col("id")
    lines = spark.range(80).select(F.lit(1).alias("s"), F.when(k % 2 == 0, "e").otherwise("n").alias("axis"), k.alias("number"), k.cast("double").alias("constant"), F.lit(0.0).alias("tan"))
    met = joins.line_intersections(lines, "s")
    assert "_part" in met._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.i, r.j, r.x, r.y) for r in met.collect()) == [(i, j, float(i), float(j)) for i in range(0, 80, 2) for j in range(1, 80, 2)]
