"""Queries that go by way of files: written to the shared folder by a sink, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from meridia.operators.shared import scratch
from meridia.plans.common import t
from meridia.plans.spatial import _CUST, _cust
from meridia.sources import tables
from meridia.sources.versions import VersionedTable
from meridia.streaming import scans

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _path(spark) -> str:
    return f"{scratch(spark)}/meridia/files-{uuid.uuid4().hex}"


#: Rows of a file that is one JSON document: what one task puts together.
FILE_ROWS = 500


def _file(df, key: str):
    """A file's number, of as many as the rows need."""
    return F.pmod(F.xxhash64(key), F.lit(max(1, -(-df.count() // FILE_ROWS))))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(text, '') AS text, nullif(lang, '') AS lang FROM documents")
def q_csv_files(spark, d):
    """Whole texts, with their quotes and line ends, through CSV."""
    at = _path(spark)
    tables.write_csv(t(spark, d, "documents").withColumn("extra", F.lit(1)), at, ["doc_id", "text", "lang"])
    return tables.read_csv(spark, at, ["doc_id", "text", "lang"])


@query(f"SELECT id, x AS lon, y AS lat, CAST(id % 5 AS VARCHAR) AS unit FROM ({_CUST})")
def q_geojson_files(spark, d):
    """Points as features, FILE_ROWS or so to a file, which is one collection."""
    at = _path(spark)
    features = tables.geojson_features(_cust(spark, d).withColumn("unit", F.col("id") % 5), tables.point_geometry("x", "y"), ["id", "unit"])
    # the file is the unit of a collection: features of one bucket on one line
    whole = features.groupBy(_file(features, "id").alias("k")).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value"))
    whole.select("k", "value").write.partitionBy("k").text(at)
    back = tables.read_geojson(spark, [at + "-missing", at], "struct<id:string,unit:string>")
    return back.select(F.col("id").cast("long").alias("id"), "lon", "lat", "unit")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_nationkey AS nation FROM customer")
def q_json_files(spark, d):
    """Records under a key, and the same as a keyed object; both read back and agree."""
    at = _path(spark)
    rows = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), _file(t(spark, d, "customer"), "c_custkey").alias("k"))
    listed = rows.groupBy("k").agg(F.to_json(F.struct(F.collect_list(F.struct("id", "name", "nation")).alias("records"))).alias("value"))
    keyed = rows.groupBy("k").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", F.struct("name", "nation"))))).alias("value"))
    listed.write.partitionBy("k").text(at + "/listed")
    keyed.write.partitionBy("k").text(at + "/keyed")
    one = tables.read_records_json(spark, at + "/listed", "records", "struct<id:string,name:string,nation:int>")
    return one.intersectAll(tables.read_keyed_json(spark, at + "/keyed", "id", "struct<name:string,nation:int>"))


_OLD = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"
_MORE = "SELECT o_orderkey + 5 AS o_orderkey, 'N' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus = 'P'"


@query(f"""WITH o AS ({_OLD}), n AS ({_MORE}), u AS (SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey)
SELECT o_orderkey, o_orderstatus, o_totalprice, 3 AS versions FROM u WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'F', o_totalprice + 1, 3 FROM o WHERE o_orderstatus = 'F'""")
def q_versioned_table(spark, d):
    """A table written, upserted twice with the same rows, and one source's rows replaced."""
    table = VersionedTable(spark, _path(spark))
    orders = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    more = orders.where("o_orderstatus = 'P'").select((F.col("o_orderkey") + 5).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    table.write(orders)
    table.upsert(more, "o_orderkey")
    table.upsert(more, "o_orderkey")
    table.replace_source(orders.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1), "o_orderstatus", "F")
    return table.read().withColumn("versions", F.lit(len(table.versions())))


@query("""WITH a AS (SELECT user_id AS key, event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN value END AS answer FROM events),
f AS (SELECT key, min(event_id) FILTER (WHERE answer IS NOT NULL) AS first, arg_min(answer, event_id) FILTER (WHERE answer IS NOT NULL) AS answer FROM a GROUP BY key)
SELECT f.key, first IS NOT NULL AS done, count(*) FILTER (WHERE first IS NULL OR event_id <= first) AS attempts, f.answer FROM f JOIN a ON f.key = a.key GROUP BY f.key, first, f.answer""")
def q_resumed_scan(spark, d):
    """Events as attempts on users, in two arrivals with a restart between them."""
    at, own = _path(spark), spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "8")
    attempts = t(spark, d, "events").select(F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("long").alias("attempt"), F.when(~F.col("event_type").isin("error", "view"), F.col("value")).alias("answer"))
    middle = attempts.agg(F.floor(F.avg("attempt"))).first()[0] or 0
    table = VersionedTable(own, at + "/table")
    for arrived in (attempts.where(F.col("attempt") < middle), attempts.where(F.col("attempt") >= middle)):
        arrived.write.mode("append").parquet(at + "/arrivals")
        scans.scan(own, at + "/arrivals", table, at + "/checkpoint")
    return spark.read.parquet(f"{table.path}/v{table.versions()[-1]:08d}")
