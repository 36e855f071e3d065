"""Inherited relational operators on the star schema and the event table, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixframe.sources.adapters import table


def join_inner(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    met = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return met.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def join_left(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


def join_full(spark, d):
    a = table(spark, d, "supplier").select("s_nationkey", "s_suppkey")
    b = table(spark, d, "customer").where("c_acctbal < 1000").select("c_nationkey", "c_custkey")
    left = a.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_s"))
    right = b.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_c"))
    met = left.join(right, F.col("s_nationkey") == F.col("c_nationkey"), "full")
    return met.select(F.coalesce("s_nationkey", "c_nationkey").alias("nationkey"), F.coalesce("n_s", F.lit(0)).alias("n_s"), F.coalesce("n_c", F.lit(0)).alias("n_c"))


def join_semi(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o.where("o_totalprice > 300000"), c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey", "c_mktsegment")


def join_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


def join_interval(spark, d):
    """Orders by bands of price: a join on a range with few rows on one side."""
    bands = spark.range(10).select(F.col("id").alias("band"), (F.col("id") * 50000).alias("low"), ((F.col("id") + 1) * 50000).alias("high"))
    o = table(spark, d, "orders")
    met = o.join(F.broadcast(bands), (o["o_totalprice"] >= F.col("low")) & (o["o_totalprice"] < F.col("high")))  # ten rows
    return met.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def join_asof(spark, d):
    """Each purchase with the user's last click before it: both streams in one window instead of a range join."""
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "purchase"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(order)
    return e.withColumn("click_id", F.coalesce(last, F.lit(-1))).where("event_type = 'purchase'").select("event_id", "user_id", "click_id")


def aggregate_rollup(spark, d):
    rolled = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    return rolled.select(F.coalesce("l_returnflag", F.lit("all")).alias("l_returnflag"), F.coalesce("l_linestatus", F.lit("all")).alias("l_linestatus"), "n", "qty")


def aggregate_cube(spark, d):
    cubed = table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return cubed.select(F.coalesce("o_orderstatus", F.lit("all")).alias("o_orderstatus"), F.coalesce("o_orderpriority", F.lit("all")).alias("o_orderpriority"), "n")


def aggregate_sets(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("hf_customer")
    return spark.sql("SELECT coalesce(c_mktsegment, 'all') AS c_mktsegment, coalesce(c_nationkey, -1) AS c_nationkey, count(*) AS n FROM hf_customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")


def aggregate_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("supps"))


def window_ranks(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(w).cast("long").alias("rk"), F.lag("o_orderkey", 1, -1).over(w).alias("previous"), F.lead("o_orderkey", 1, -1).over(w).alias("following"))


def window_frame(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean3"))


def top_k(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


def top_per_group(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").withColumn("r", F.row_number().over(w)).where("r <= 3").select("p_brand", "p_partkey", F.col("r").cast("long").alias("r"))


def set_operations(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    tag = lambda df, name: df.select("k", F.lit(name).alias("op"))
    return tag(c.union(s).distinct(), "union").union(tag(c.intersect(s), "intersect")).union(tag(c.subtract(s), "except"))


def tumbling(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def sliding(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("start"), "total")


def sessions(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def text_scan(spark, d):
    doc = table(spark, d, "documents")
    return doc.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text").cast("long")).alias("chars"))


def page_scan(spark, d):
    page = table(spark, d, "pages")
    return page.select("page_id", F.octet_length("html").cast("long").alias("bytes"), F.lower(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)).alias("host"))


QUERIES = {
    "rel_join_inner": (join_inner, "SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "rel_join_left": (join_left, "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    "rel_join_full": (join_full, "WITH a AS (SELECT s_nationkey, count(*) AS n_s FROM supplier GROUP BY 1), b AS (SELECT c_nationkey, count(*) AS n_c FROM customer WHERE c_acctbal < 1000 GROUP BY 1) SELECT coalesce(s_nationkey, c_nationkey) AS nationkey, coalesce(n_s, 0) AS n_s, coalesce(n_c, 0) AS n_c FROM a FULL JOIN b ON s_nationkey = c_nationkey"),
    "rel_join_semi": (join_semi, "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "rel_join_anti": (join_anti, "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "rel_join_interval": (join_interval, "WITH b AS (SELECT unnest(range(0, 10)) AS band) SELECT band, count(*) AS n FROM orders JOIN b ON o_totalprice >= band * 50000 AND o_totalprice < (band + 1) * 50000 GROUP BY 1"),
    "rel_join_asof": (join_asof, "WITH c AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_id FROM events WHERE event_type IN ('click', 'purchase')) SELECT event_id, user_id, coalesce(click_id, -1) AS click_id FROM c WHERE event_type = 'purchase'"),
    "rel_rollup": (aggregate_rollup, "SELECT coalesce(l_returnflag, 'all') AS l_returnflag, coalesce(l_linestatus, 'all') AS l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "rel_cube": (aggregate_cube, "SELECT coalesce(o_orderstatus, 'all') AS o_orderstatus, coalesce(o_orderpriority, 'all') AS o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "rel_grouping_sets": (aggregate_sets, "SELECT coalesce(c_mktsegment, 'all') AS c_mktsegment, coalesce(c_nationkey, -1) AS c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())"),
    "rel_distinct": (aggregate_distinct, "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY 1"),
    "rel_window_ranks": (window_ranks, "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, lag(o_orderkey, 1, -1) OVER w AS previous, lead(o_orderkey, 1, -1) OVER w AS following FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"),
    "rel_window_frame": (window_frame, "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean3 FROM events"),
    "rel_top_k": (top_k, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "rel_top_per_group": (top_per_group, "SELECT p_brand, p_partkey, r FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3"),
    "rel_set_operations": (set_operations, "SELECT k, 'union' AS op FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'intersect' FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'except' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)"),
    "rel_tumbling_window": (tumbling, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "rel_sliding_window": (sliding, "WITH x AS (SELECT date_trunc('day', ts) - to_days(k::INT) AS s, value FROM events, (SELECT unnest([0, 1]) AS k)) SELECT strftime(s, '%Y-%m-%d') AS start, round(sum(value), 4) AS total FROM x GROUP BY 1"),
    "rel_session_window": (sessions, "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS cut FROM events), s AS (SELECT user_id, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), n AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY 1"),
    "rel_text_scan": (text_scan, "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1"),
    "rel_page_scan": (page_scan, "SELECT page_id, strlen(html)::BIGINT AS bytes, lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS host FROM pages"),
}
