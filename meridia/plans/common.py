from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def values(spark: SparkSession, schema: str, *rows) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def sql_values(names: str, *rows) -> str:
    """The same rows for the oracle."""
    lit = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names})"
