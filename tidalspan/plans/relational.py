"""Queries over sources, projections, predicates, joins of frames and cuts of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidalspan.functions.predicate import compile_predicate
from tidalspan.operators import relational as R
from tidalspan.operators.base import Chain, Identity, Lambda
from tidalspan.operators.joins import align, as_of, only_times_of, segments, side_by_side
from tidalspan.plans.common import EVENTS, events, scratch, table
from tidalspan.sources import frames as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("S01_in_memory", "SELECT * FROM (VALUES (1::BIGINT, 'a'), (2, 'b'), (3, NULL)) AS v(k, s)")
def in_memory(spark, d):
    return S.Environment(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, s string")).observe()


@query("S02_csv_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_scan(spark, d):
    path = scratch(spark, "csv")
    named = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias(" n_name "), "n_regionkey")
    named.write.option("header", True).option("sep", ";").option("ignoreLeadingWhiteSpace", False).csv(path)
    return S.read_csv(spark, path, ";", "n_nationkey int, n_name string, n_regionkey int")


@query("S03_json_read", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def json_read(spark, d):
    path = scratch(spark, "json")
    rows = table(spark, d, "region").agg(F.to_json(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name")))).alias("value"))
    rows.coalesce(1).write.text(path)
    return S.read_json(spark, path)


@query("S04_parquet_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def parquet_scan(spark, d):
    return S.read_parquet(spark, f"{d}/orders.parquet").where("o_totalprice > 300000").select("o_orderkey", "o_totalprice")


@query("S05_yaml_read", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def yaml_read(spark, d):
    path = scratch(spark, "yaml")
    line = F.concat(F.lit("- {r_regionkey: "), F.col("r_regionkey").cast("string"), F.lit(", r_name: '"), F.col("r_name"), F.lit("'}"))
    table(spark, d, "region").select(line.alias("value")).coalesce(1).write.text(path)
    rows = "\n".join(sorted(r["value"] for r in spark.read.text(path).collect()))
    whole = scratch(spark, "yaml")
    spark.createDataFrame([(rows,)], "value string").coalesce(1).write.text(whole)
    return S.read_yaml(spark, whole).select("r_regionkey", "r_name")


@query("S06_uri_dispatch", "SELECT s_suppkey, s_name FROM supplier")
def uri_dispatch(spark, d):
    return (S.read_uri(spark, f"file:{d}/supplier.parquet") if "://" not in d else S.read_parquet(spark, f"{d}/supplier.parquet")).select("s_suppkey", "s_name")


@query("S08_directory_fan_in", "SELECT 'nation.parquet' AS file, count(*) AS n FROM nation")
def directory(spark, d):
    found = S.read_directory(spark, f"{d}/nation.parquet")
    return found.groupBy(F.element_at(F.split("file", "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("n"))


@query("S09_chained", "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation")
def chained(spark, d):
    a = S.Environment(table(spark, d, "region").select(F.col("r_name").alias("name")))
    return (a + S.Environment(table(spark, d, "nation").select(F.col("n_name").alias("name")))).collect()


@query("S10_joined", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def joined(spark, d):
    orders = table(spark, d, "orders")
    return side_by_side([orders.select("o_orderkey", "o_totalprice"), orders.select("o_orderkey", "o_orderstatus")], "o_orderkey")


@query("S11_micro_batches", f"WITH {EVENTS}, r AS (SELECT *, (row_number() OVER (ORDER BY t, event_id) - 1) // 1000 AS batch FROM e) SELECT batch::BIGINT AS batch, count(*) AS n, round(sum(value), 4) AS total FROM r GROUP BY batch")
def micro_batches(spark, d):
    rows = S.batch_ids(events(spark, d), ["t", "event_id"], 1000)
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("S13_collect", "SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def collected(spark, d):
    n, r = (table(spark, d, t).select(F.col(f"{t[0]}_{t}key").alias("key"), F.col(f"{t[0]}_name").alias("name")) for t in ("nation", "region"))
    return S.collect([n, r, n], 2)


@query("S14_train_test_split", "WITH r AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS k, count(*) OVER () AS c FROM orders) SELECT CASE WHEN k <= floor(c * 0.8) THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM r GROUP BY 1")
def split(spark, d):
    parts = zip(("train", "test"), S.train_test_split(table(spark, d, "orders"), 0.8, "o_orderkey"), strict=True)
    a, b = (df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.lit(p).alias("part"), "n", "total") for p, df in parts)
    return a.unionByName(b)


@query("S14_shuffled_split", "SELECT floor(count(*) * 0.8)::BIGINT AS n_train, (count(*) - floor(count(*) * 0.8))::BIGINT AS n_test, 0::BIGINT AS n_common FROM orders")
def shuffled_split(spark, d):
    a, b = S.train_test_split(table(spark, d, "orders").select("o_orderkey"), 0.8, "o_orderkey", shuffle=True, seed=42)
    both = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2)))
    keyed = both.groupBy("o_orderkey").agg(F.sum("side").alias("s"))
    n = lambda k: F.sum((F.col("s") == k).cast("long"))
    return keyed.agg(n(1).alias("n_train"), n(2).alias("n_test"), n(3).alias("n_common"))


@query("S19_trace_sink", "SELECT n_regionkey::INT AS trace_id, count(*) AS n FROM nation GROUP BY 1")
def trace_sink(spark, d):
    path = scratch(spark, "traces")
    S.save_traces(table(spark, d, "nation").withColumnRenamed("n_regionkey", "trace_id"), path, metadata={"from": "nation"})
    return spark.read.parquet(f"{path}/traces").groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))


@query("P01_select", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, round(sqrt(p_size + p_partkey) / p_retailprice, 8) AS computed FROM part")
def select(spark, d):
    return R.Select(["^p_(?!z).*$", F.round(F.sqrt(F.col("p_size") + F.col("p_partkey")) / F.col("p_retailprice"), 8).alias("computed")]).apply(table(spark, d, "part"))


@query("P02_drop", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def drop(spark, d):
    return R.Drop(["c_name", "c_acctbal"]).apply(table(spark, d, "customer"))


@query("P03_rename", "SELECT c_custkey AS id, c_name AS name FROM customer")
def rename(spark, d):
    return R.Rename({"c_custkey": "id", "c_name": "name"}).apply(table(spark, d, "customer").select("c_custkey", "c_name"))


@query("P04_cast", "SELECT p_partkey::DOUBLE AS p_partkey, (p_size <> 0) AS p_size, p_name, (p_size::BIGINT)::VARCHAR AS size_text FROM part")
def cast(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_size", "p_name", F.col("p_size").alias("size_text"))
    return R.Cast({"p_partkey": "double", "p_size": "boolean", "size_text": "string"}).apply(rows)


@query("P05_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity * l_discount > 4.5 AND l_tax <> 0.08")
def filter_(spark, d):
    return R.Filter("l_quantity * l_discount > 4.5 and l_tax != 0.08").apply(table(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("P06_and", "SELECT p_partkey FROM part WHERE p_size > 20 AND p_retailprice < 1500")
def and_(spark, d):
    return R.And(["p_size > 20", "p_retailprice < 1500"]).apply(table(spark, d, "part")).select("p_partkey")


@query("P07_or", "SELECT p_partkey FROM part WHERE p_size > 40 OR p_retailprice < 1000")
def or_(spark, d):
    return R.Or(["p_size > 40", "p_retailprice < 1000"]).apply(table(spark, d, "part")).select("p_partkey")


@query("P08_not", "SELECT p_partkey FROM part WHERE p_size > 10 AND NOT (p_size = 12 OR p_retailprice < 1200)")
def not_(spark, d):
    return R.And(["p_size > 10", R.Not(R.Or(["p_size == 12", "p_retailprice < 1200"]))]).apply(table(spark, d, "part")).select("p_partkey")


@query("P09_identity", "SELECT r_regionkey, r_name FROM region")
def identity(spark, d):
    return Identity().chain(Identity()).apply(table(spark, d, "region")).select("r_regionkey", "r_name")


@query("P10_lambda", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def lambda_(spark, d):
    return Lambda(lambda df: df.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))).apply(table(spark, d, "nation"))


@query("P11_unnest", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def unnest(spark, d):
    nested = table(spark, d, "supplier").select("s_suppkey", F.struct("s_name", "s_acctbal").alias("rest"))
    return R.Unnest("rest").apply(nested)


@query("P12_explode", "SELECT n_regionkey, n_nationkey, n_name FROM nation")
def explode(spark, d):
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    return R.Explode(["n_nationkey", "n_name"]).apply(rows.select("n_regionkey", F.col("x.n_nationkey").alias("n_nationkey"), F.col("x.n_name").alias("n_name")))


@query("F06_chain", "SELECT id, size FROM (SELECT p_partkey AS id, p_size AS size FROM part) WHERE size > 25")
def chain(spark, d):
    return Chain(R.Select(["p_partkey", "p_size"]), R.Rename({"p_partkey": "id", "p_size": "size"}), R.Filter("size > 25")).apply(table(spark, d, "part"))


@query("D07_predicates", "SELECT count(*) AS n, count(*) FILTER (WHERE p_size < 10 OR p_retailprice > 1500) AS holds FROM part")
def predicates(spark, d):
    holds = compile_predicate("p_size < 10 or p_retailprice > 1500")
    return table(spark, d, "part").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(holds, 1)).alias("holds"))


@query("J01_times_left_join", f"WITH {EVENTS}, r AS (SELECT DISTINCT floor(t / 3600) AS h FROM e), f AS (SELECT floor(t / 3600) AS h, count(*) AS n FROM e WHERE event_type = 'purchase' GROUP BY 1) SELECT r.h::BIGINT AS h, f.n FROM r LEFT JOIN f USING (h)")
def times_left_join(spark, d):
    e = events(spark, d).withColumn("h", F.floor(F.col("t") / 3600))
    return e.select("h").distinct().join(e.where("event_type = 'purchase'").groupBy("h").agg(F.count(F.lit(1)).alias("n")), "h", "left")


@query("J02_align", "SELECT user_id, max(value) FILTER (WHERE event_type = 'click') AS click, max(value) FILTER (WHERE event_type = 'purchase') AS purchase FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id")
def align_(spark, d):
    e = events(spark, d)
    side = lambda kind: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.max("value").alias(kind))
    return align([side("click"), side("purchase")], ["user_id"])


@query("J03_as_of_forward", f"WITH {EVENTS} SELECT a.event_id, min_by(b.event_id, (b.t, b.event_id)) AS next_id FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.t >= a.t WHERE a.event_type = 'click' GROUP BY a.event_id")
def as_of_forward(spark, d):
    e = events(spark, d)
    right = e.where("event_type = 'purchase'").select("user_id", "t", F.col("event_id").alias("next_id"))
    return as_of(e.where("event_type = 'click'"), right, ["user_id"], "t", ["next_id"]).select("event_id", "next_id")


@query("J05_membership", f"WITH {EVENTS} SELECT event_id FROM e WHERE user_id IN (SELECT user_id FROM e WHERE event_type = 'purchase' AND value > 100)")
def membership(spark, d):
    e = events(spark, d)
    return only_times_of(e, e.where("event_type = 'purchase' and value > 100"), ["user_id"]).select("event_id")


@query("J06_as_of_backward", f"WITH {EVENTS} SELECT a.event_id, max_by(b.event_id, (b.t, b.event_id)) AS last_id FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.event_type = 'click' AND b.t <= a.t WHERE a.event_type = 'purchase' GROUP BY a.event_id")
def as_of_backward(spark, d):
    e = events(spark, d)
    right = e.where("event_type = 'click'").select("user_id", "t", F.col("event_id").alias("last_id"))
    return as_of(e.where("event_type = 'purchase'"), right, ["user_id"], "t", ["last_id"], "backward").select("event_id", "last_id")


@query("J07_cross_product", "SELECT r_name, s.status, k.k FROM region, (VALUES ('O'), ('F')) s(status), (SELECT * FROM range(3)) k(k)")
def cross_product(spark, d):
    sides = [spark.createDataFrame([("O",), ("F",)], "status string"), spark.range(3).toDF("k")]
    return R.CrossProduct(*sides).apply(table(spark, d, "region").select("r_name"))


@query("W09_segments", f"WITH {EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM e), g AS (SELECT *, k - row_number() OVER (PARTITION BY user_id ORDER BY t) AS g FROM n WHERE value > 50) SELECT user_id, count(*) AS n, round(min(t), 6) AS start, round(max(t), 6) AS \"end\" FROM g GROUP BY user_id, g")
def gaps_and_islands(spark, d):
    found = segments(events(spark, d).withColumn("high", F.col("value") > 50), "high", ["user_id"], "t")
    return found.select("user_id", "n", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("O03_top_n", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def top_n(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)


@query("U02_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()
