"""Greedy decisions in an order, made in rounds over the graph of who must wait for whom.

A node decides as soon as every neighbour before it in the order has; what comes out is
what one pass in that order would give, but all nodes that wait for nobody decide at once,
and no task holds a whole group. Each round is a join on edges still open and partial
aggregates; only a count of what is left reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.operators.shared import discard, materialise, stored


def independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id: the nodes kept where each, in order, is kept unless one kept before it is its
    neighbour. edges (low, high): high comes before low."""
    spark, left = nodes.sparkSession, materialise(edges.distinct())
    open_, path = stored(nodes.select("id").distinct())
    kept, old = None, None
    while open_.limit(1).count():
        waits = left.select(F.col("low").alias("id")).distinct()
        now = materialise(open_.join(waits, "id", "left_anti"))
        kept = now if kept is None else kept.unionByName(now)
        gone = left.join(now.select(F.col("id").alias("high")), "high", "left_semi").select(F.col("low").alias("id")).distinct()
        old, (open_, path) = path, stored(open_.join(now, "id", "left_anti").join(gone, "id", "left_anti"))
        # an edge matters while both its ends are open
        left = materialise(left.join(open_.select(F.col("id").alias("low")), "low", "left_semi").join(open_.select(F.col("id").alias("high")), "high", "left_semi"))
        discard(spark, old)
    return nodes.select("id").limit(0) if kept is None else kept


def first_free_colours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with a colour: each node (id, which comes once), in order, takes the least colour
    from 0 up that no neighbour before it has. edges (low, high): high comes before low. An
    edge is looked at until its high end has told its colour; a node keeps what it was told."""
    c, spark, done = F.col, nodes.sparkSession, None
    waits, edges_at = stored(edges.select("low", "high", F.lit(None).cast("long").alias("colour")))
    open_, open_at = stored(nodes.withColumn("used", F.array().cast("array<long>")))
    while open_.limit(1).count():
        # first told apart, then gathered: sets are made of what differs
        told = waits.select(c("low").alias("id"), "colour").distinct()
        if done is None:
            news = told.select("id", F.array().cast("array<long>").alias("_told"), F.lit(True).alias("_waits"))
        else:
            news = told.groupBy("id").agg(F.collect_set("colour").alias("_told"), F.max(c("colour").isNull()).alias("_waits"))
        met = open_.join(news, "id", "left").withColumn("used", F.when(c("_told").isNull(), c("used")).otherwise(F.array_union("used", "_told")))
        known, known_at = stored(met.select(*nodes.columns, "used", F.coalesce("_waits", F.lit(False)).alias("_waits")))
        free = F.filter(F.sequence(F.lit(0), F.size("used")), lambda k: ~F.array_contains("used", k.cast("long")))
        now = materialise(known.where("not _waits").select(*nodes.columns, F.array_min(free).cast("long").alias("colour")))
        done = now if done is None else done.unionByName(now)
        left = waits.where("colour is null").select("low", "high")
        waits, new_at = stored(left.join(now.select(c("id").alias("high"), "colour"), "high", "left").select("low", "high", "colour"))
        for spent in (edges_at, open_at):
            discard(spark, spent)
        edges_at, open_, open_at = new_at, known.where("_waits").drop("_waits"), known_at
    for spent in (edges_at, open_at):
        discard(spark, spent)
    return nodes.withColumn("colour", F.lit(0).cast("long")).limit(0) if done is None else done
