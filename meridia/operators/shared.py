"""Scratch tables in the cluster's shared folder, joins on keys that may hold a third of all
rows, and connected components that need neither a collect nor a limit of rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset, a temporary folder will
    do for a session of one process (as in tests) and for no other."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="meridia-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes df to a table in the shared folder and reads it back: lineage ends here, and a
    lost executor costs no more than the files' next read. The table's path comes with it."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/meridia/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame) -> DataFrame:
    """As stored, for a table that stays: what comes of it may still be read."""
    return stored(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stored table from which nothing will be read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join (null keys match) whose left rows may crowd on one key.

    ``right`` has one row a key, and is often an aggregate that Spark would leave
    partitioned by the key, so that a crowded key could not be split. The added hash
    key makes both sides exchange for this join, and adaptive execution then splits
    the crowded partition by map output."""
    mixed = F.xxhash64(*keys, F.lit(7))
    a = left.withColumn("_jk", mixed)
    b = right.select(mixed.alias("_rk"), *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = a["_jk"] == b["_rk"]
    for k in keys:
        on = on & a[k].eqNullSafe(b[f"_r_{k}"])
    return a.join(b, on, how).drop("_jk", "_rk", *[f"_r_{k}" for k in keys])


#: Rows of a task from which much more is made than is read.
ROWS_A_TASK = 20_000


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df in tasks of about ROWS_A_TASK rows, by range of ``by``: files of short rows are small,
    and Spark would make a few long tasks of them."""
    return df.repartitionByRange(max(1, -(-df.count() // ROWS_A_TASK)), *by)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node
    reachable. Alternates large-star and small-star steps, each a partial minimum by
    node and a join, until the edges stop changing. Nothing is collected but a count
    and a checksum a round. Self-loops and nulls are ignored."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    spark = edges.sparkSession
    state, path = stored(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi.alias("u"), lo.alias("v")).distinct())

    def mark(df: DataFrame):
        # the sum is taken modulo 2^64 by way of decimal to keep ANSI mode from overflowing
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(state)
    while before[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = skew_join(both.where("v > u"), least, ["u"], "inner").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = skew_join(large, least, ["u"], "inner")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        last = path
        state, path = stored(small)
        now = mark(state)
        discard(spark, last)
        if tuple(now) == tuple(before):
            break
        before = now
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
