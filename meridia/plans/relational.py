"""Queries on joins, precedence, aggregates, medians, votes and order."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import text
from meridia.operators import aggregates as agg
from meridia.operators import joins
from meridia.plans.common import t
from meridia.sources import tables

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), 'unverified') AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_left_default(spark, d):
    labels = t(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return joins.left_default(t(spark, d, "documents").select("doc_id"), labels, "doc_id", {"quality": "unverified"})


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def q_semi(spark, d):
    return t(spark, d, "customer").select("c_custkey", "c_name").join(t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)")
def q_anti(spark, d):
    # targets that the cache lacks, and those whose value there is null
    return tables.pending(t(spark, d, "documents").select("doc_id", "source"), t(spark, d, "labels"), "doc_id", "quality")


@query("""SELECT doc_id, coalesce(a, b, c) AS v, CASE WHEN a IS NOT NULL THEN 'label' WHEN b IS NOT NULL THEN 'conversation' ELSE 'document' END AS basis FROM (
SELECT d.doc_id, CAST(l.quality AS VARCHAR) AS a, c.role AS b, d.lang AS c FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN (SELECT conv_id, max(role) AS role FROM conversations WHERE turn = 0 GROUP BY conv_id) c ON d.doc_id = c.conv_id)""")
def q_precedence_merge(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.col("lang").alias("v"))
    labels = t(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("v"))
    conv = t(spark, d, "conversations").where("turn = 0").groupBy(F.col("conv_id").alias("doc_id")).agg(F.max("role").alias("v"))
    conv = conv.join(docs.select("doc_id"), "doc_id", "left_semi")
    return joins.precedence_merge([("label", labels), ("conversation", conv), ("document", docs)], "doc_id", "v")


@query("""SELECT o_custkey, o_orderpriority, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS flagged, max(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END) AS other FROM orders GROUP BY ALL HAVING count(*) = 2 AND count(*) FILTER (WHERE o_orderstatus = 'F') = 1""".replace("GROUP BY ALL", "GROUP BY o_custkey, o_orderpriority"))
def q_edition_pairs(spark, d):
    return joins.flagged_pairs(t(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey", F.col("o_orderstatus") == "F")


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) SELECT o.o_orderkey, f.o_orderkey AS twin, round(o.o_totalprice - f.o_totalprice, 4) AS offset_price FROM orders o JOIN f ON o.o_custkey = f.o_custkey AND f.n = 1 WHERE o.o_orderkey <> f.o_orderkey""")
def q_twin_first(spark, d):
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    first = joins.first_per_key(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("twin"), F.col("o_totalprice").alias("p"))
    return orders.join(first, "o_custkey").where("o_orderkey <> twin").select("o_orderkey", "twin", F.round(F.col("o_totalprice") - F.col("p"), 4).alias("offset_price"))


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS k FROM f WHERE n = 1)
SELECT a.user_id, a.event_type AS source1, b.event_type AS source2, round(abs(a.value - b.value), 6) AS distance FROM r a JOIN r b ON a.user_id = b.user_id AND a.k = 1 AND b.k = 2""")
def q_source_agreement(spark, d):
    labels = t(spark, d, "events").select(F.col("user_id"), F.col("event_type").alias("source"), F.col("value").alias("x"), F.lit(0.0).alias("y"), F.struct("ts", "event_id").alias("o"))
    return joins.source_agreement(labels, "user_id", "source", F.col("o")).select("user_id", "source1", "source2", F.round(F.abs(F.col("x1") - F.col("x2")), 6).alias("distance"))


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, list_sort(list(DISTINCT CAST(value AS INT) % 7)) AS kinds, bool_and(value > 1) AS all_big FROM events GROUP BY user_id".replace("CAST(value AS INT)", "CAST(floor(value) AS INT)"))
def q_dedup_merge(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", "event_type", (F.floor("value").cast("int") % 7).alias("kinds"), (F.col("value") > 1).alias("all_big"))
    return agg.dedup_merge(e, "user_id", "event_id", ["event_type"], ["kinds"], ["all_big"])


_NEW = "SELECT o_orderkey + 5 AS o_orderkey, 'N' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus = 'P'"


def _orders(spark, d):
    old = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.where("o_orderstatus = 'P'").select((F.col("o_orderkey") + 5).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return old, new


@query(f"WITH n AS ({_NEW}) SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice FROM orders o FULL JOIN n ON o.o_orderkey = n.o_orderkey")
def q_upsert(spark, d):
    return joins.upsert(*_orders(spark, d), "o_orderkey")


@query(f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'F', o_totalprice FROM ({_NEW})")
def q_replace_source(spark, d):
    old, new = _orders(spark, d)
    return joins.replace_source(old, new.withColumn("o_orderstatus", F.lit("F")), "o_orderstatus", "F")


@query("SELECT l_returnflag, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first_seen FROM lineitem GROUP BY l_returnflag")
def q_distribution(spark, d):
    return agg.distribution(t(spark, d, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o")), "l_returnflag", "o")


@query("SELECT l_linestatus, count(*) FILTER (WHERE l_discount > 0.05) AS deep, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_linestatus")
def q_conditional_counts(spark, d):
    return t(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count_if(F.col("l_discount") > 0.05).alias("deep"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3, round(sqrt(avg(l_tax * l_tax)), 9) AS rms, max(abs(l_tax)) AS worst, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY l_returnflag")
def q_stats(spark, d):
    p = F.percentile("l_quantity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), p.alias("p"), F.round(F.sqrt(F.avg(F.col("l_tax") * F.col("l_tax"))), 9).alias("rms"), F.max(F.abs("l_tax")).alias("worst"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))
    return out.select("l_returnflag", "n", "mean", F.col("p")[1].alias("median"), F.col("p")[0].alias("q1"), F.col("p")[2].alias("q3"), "rms", "worst", "low", "high")


@query("SELECT l_suppkey, list_sort(list(l_extendedprice))[len(list(l_extendedprice)) // 2 + 1] AS upper_median FROM lineitem GROUP BY l_suppkey")
def q_upper_median(spark, d):
    return agg.upper_median(t(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice")


@query("SELECT class, count(*) AS n FROM (SELECT CAST(1 + len(list_filter((SELECT quantile_cont(c_acctbal, [1/7.0::DOUBLE, 2/7.0::DOUBLE, 3/7.0::DOUBLE, 4/7.0::DOUBLE, 5/7.0::DOUBLE, 6/7.0::DOUBLE]) FROM customer), lambda b: b < c_acctbal)) AS INT) AS class FROM customer) GROUP BY class")
def q_quantile_classes(spark, d):
    return agg.quantile_classes(t(spark, d, "customer").select("c_acctbal"), "c_acctbal").groupBy("class").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY user_id, event_type), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k, sum(n) OVER (PARTITION BY user_id) AS total FROM c) SELECT user_id, event_type AS winner, n AS votes, CAST(total AS BIGINT) AS total FROM r WHERE k = 1")
def q_vote(spark, d):
    return agg.vote(t(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT user_id, event_id AS resolved FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, value DESC, event_id) AS k FROM events) WHERE k = 1")
def q_resolve(spark, d):
    return agg.resolve(t(spark, d, "events"), ["user_id"], "event_id", [F.col("event_type") == "purchase", F.col("value"), -F.col("event_id")])


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS open_lines, count(*) FILTER (WHERE l_linestatus = 'F') AS final_lines FROM lineitem GROUP BY l_returnflag")
def q_crosstab(spark, d):
    p = t(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).count()
    return p.select("l_returnflag", F.coalesce("O", F.lit(0)).alias("open_lines"), F.coalesce("F", F.lit(0)).alias("final_lines"))


@query("SELECT o_orderpriority, n, round(n / sum(n) OVER (), 9) AS share, members FROM (SELECT o_orderpriority, count(*) AS n, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ' | ') AS members FROM orders GROUP BY o_orderpriority)")
def q_group_share(spark, d):
    g = t(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), " | ").alias("members"))
    return agg.share_of_total(g, "n").withColumn("share", F.round("share", 9))


@query("SELECT CAST(sum(l_quantity) AS DOUBLE) AS total, 1600000.0::DOUBLE AS stated, 1600000.0::DOUBLE - sum(l_quantity) AS difference, round((1600000.0::DOUBLE - sum(l_quantity)) / 1600000 * 100, 9) AS percent FROM lineitem")
def q_group_share_reconcile(spark, d):
    return agg.reconcile(t(spark, d, "lineitem").select("l_quantity"), "l_quantity", 1600000.0).withColumn("percent", F.round("percent", 9))


@query("SELECT p_brand, arg_max(p_partkey, struct_pack(a := p_retailprice, b := -p_partkey)) AS dearest, arg_min(p_partkey, struct_pack(a := p_retailprice, b := p_partkey)) AS cheapest FROM part GROUP BY p_brand")
def q_arg_rows(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("dearest"), F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("cheapest"))


@query("SELECT n_nationkey, n_name, coalesce(n, 0) AS n, CASE WHEN area >= 25 THEN 'measured' WHEN area > 0 THEN 'too_little_read' ELSE 'no_sheet' END AS basis, CASE WHEN area >= 25 THEN round(coalesce(n, 0) / area, 9) END AS density FROM (SELECT *, CAST(n_nationkey * 2 AS DOUBLE) AS area FROM nation) LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) ON n_nationkey = c_nationkey")
def q_density_floor(spark, d):
    units = t(spark, d, "nation").select("n_nationkey", "n_name")
    points = t(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return agg.density(units, points, "n_nationkey", (F.col("n_nationkey") * 2).cast("double"), 25).select("n_nationkey", "n_name", "n", "basis", F.round("density", 9).alias("density"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def q_topn(spark, d):
    return t(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)


@query("SELECT p_partkey, p_type, p_size, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'LARGE' THEN 3 ELSE 9 END AS rank FROM part ORDER BY rank, p_size DESC, p_partkey")
def q_enum_sort(spark, d):
    order = F.create_map(*[F.lit(x) for kv in (("ECONOMY", 1), ("SMALL", 2), ("LARGE", 3)) for x in kv])
    rank = F.coalesce(F.try_element_at(order, F.col("p_type")), F.lit(9))
    return t(spark, d, "part").select("p_partkey", "p_type", "p_size", rank.alias("rank")).orderBy("rank", F.desc("p_size"), "p_partkey")


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS k FROM supplier) WHERE k = 1 ORDER BY s_acctbal, s_suppkey LIMIT 10")
def q_spread_sample(spark, d):
    first = joins.first_per_key(t(spark, d, "supplier"), ["s_nationkey"], [F.col("s_acctbal"), F.col("s_suppkey")])
    return first.select("s_suppkey", "s_nationkey", "s_acctbal").orderBy("s_acctbal", "s_suppkey").limit(10)


@query("SELECT n_name, CASE WHEN contains(n_name, ' - ') THEN trim(split_part(n_name, ' - ', 1)) WHEN n_name = 'FRANCE' THEN 'EUROPE' ELSE '' END AS parent FROM nation")
def q_parent_name(spark, d):
    return t(spark, d, "nation").select("n_name", text.parent_name(F.col("n_name"), {"FRANCE": "EUROPE"}).alias("parent"))


@query("SELECT user_id, event_type AS mode, n AS votes FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events WHERE event_type IS NOT NULL GROUP BY user_id, event_type) WHERE k = 1")
def q_mode(spark, d):
    return agg.mode(t(spark, d, "events"), ["user_id"], "event_type")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN year(o_orderdate) END AS year, coalesce(CASE WHEN o_orderkey % 5 > 0 THEN year(o_orderdate) END, 9999) AS place FROM orders ORDER BY place, o_orderkey")
def q_missing_last(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.year("o_orderdate")).alias("year"))
    return rows.withColumn("place", joins.missing_last(F.col("year"), 9999)).orderBy("place", "o_orderkey")
