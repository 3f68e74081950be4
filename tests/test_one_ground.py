"""Points of all thousands of keys on one ground: what is found for a key is found for all."""

import pytest
from pyspark.sql import functions as F

from meridia.plans import registry

QUERIES = {"q_box_overlap": "a_id", "q_point_in_polygon": "id", "q_radius_pairs": "id", "q_knn_runner_up": "id", "q_quartered": "k"}  # by query, the column that names the customer or unit


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("ground"))
    k = F.col("id")
    spark.range(3000).select(k.alias("c_custkey")).coalesce(1).write.parquet(f"{d}/customer.parquet")
    spark.range(2000).select(k.alias("s_suppkey")).coalesce(1).write.parquet(f"{d}/supplier.parquet")
    spark.range(25).select(k.cast("int").alias("n_nationkey")).coalesce(1).write.parquet(f"{d}/nation.parquet")
    return d


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_thousands_share_a_ground(spark, tables, name):
    """The rows of a thousand keys are there three times, once for each thousand."""
    found = registry.queries()[name](spark, tables)
    if name == "q_quartered":
        counts = [r["n"] for r in found.collect()]
        assert len(counts) == 24 and all(n % 3 == 0 and n > 150 for n in counts)
        return
    told = found.where("unit is not null") if name == "q_point_in_polygon" else found
    sizes = {r["k"]: r["n"] for r in told.groupBy(F.floor(F.col(QUERIES[name]) / 1000).alias("k")).agg(F.count("*").alias("n")).collect()}
    assert sorted(sizes) == [0, 1, 2] and len(set(sizes.values())) == 1
