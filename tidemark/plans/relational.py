"""Relational questions: groups with nullable measures, deciles, joins, sets, profiles."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import keys, ranks
from .registry import Tables, query

#: A measure that is null for every seventh order, so that null rules are exercised.
NULLED_SQL = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END"


@query(f"""SELECT c_mktsegment, count(*) AS n, count(x) AS known, round(avg(x), 4) AS avg_price, round(avg(x + c_acctbal), 4) AS avg_engagement
FROM (SELECT *, {NULLED_SQL} AS x FROM orders) o JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def seg_engagement(t: Tables):
    o = t.orders.withColumn("x", F.expr(NULLED_SQL)).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count("x").alias("known"), F.round(F.avg("x"), 4).alias("avg_price"), F.round(F.avg(F.col("x") + F.col("c_acctbal")), 4).alias("avg_engagement"))


@query(f"""WITH j AS (SELECT *, {NULLED_SQL} AS x, CASE WHEN c_acctbal >= 5000 THEN 'high' ELSE 'low' END AS side FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT side, count(DISTINCT c_custkey) AS customers, count(*) AS orders, round(avg(x), 4) AS avg_price, round(avg(x) - (SELECT avg(x) FROM j), 4) AS against_all FROM j GROUP BY side""")
def threshold_groups(t: Tables):
    j = t.orders.withColumn("x", F.expr(NULLED_SQL)).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("side", F.when(F.col("c_acctbal") >= 5000, "high").otherwise("low"))
    by = j.groupBy("side").agg(F.count_distinct("c_custkey").alias("customers"), F.count("*").alias("orders"), F.avg("x").alias("a"), F.sum("x").alias("s"), F.count("x").alias("k"))
    every = by.agg((F.sum("s") / F.sum("k")).alias("all"))  # of two rows
    return by.crossJoin(F.broadcast(every)).select("side", "customers", "orders", F.round("a", 4).alias("avg_price"), F.round(F.col("a") - F.col("all"), 4).alias("against_all"))


@query(f"""WITH u AS (SELECT c_custkey, any_value(c_acctbal) AS bal, count(*) AS n, sum({NULLED_SQL}) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
r AS (SELECT *, ntile(10) OVER (ORDER BY total DESC NULLS LAST, c_custkey) AS decile, percent_rank() OVER (ORDER BY total ASC NULLS FIRST) AS pr FROM u)
SELECT c_custkey, n, round(total, 2) AS total, decile::INT AS decile, round(pr * 100, 2) AS percentile FROM r WHERE decile = 1 AND bal < 5000""")
def low_balance_top_decile(t: Tables):
    """Customers of a low balance in the top decile of spending. The ranks come from ranges
    and their offsets, not from a window over one partition."""
    u = t.orders.withColumn("x", F.expr(NULLED_SQL)).groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("x").alias("total"))
    u = u.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    r = ranks.global_ranks(u, F.col("total"), [F.col("c_custkey")], 10)
    return r.filter("tile = 1 AND c_acctbal < 5000").select("c_custkey", "n", F.round("total", 2).alias("total"), F.col("tile").alias("decile"), F.round(F.col("percent_rank") * 100, 2).alias("percentile"))


@query(f"""SELECT * FROM (SELECT o_custkey, count(x) AS known, round(avg(x), 4) AS mean, rank() OVER (ORDER BY avg(x) DESC)::INT AS place FROM (SELECT *, {NULLED_SQL} AS x FROM orders) GROUP BY 1 HAVING count(x) >= 5) ORDER BY place, o_custkey LIMIT 5""")
def top_mean_min_n(t: Tables):
    u = t.orders.withColumn("x", F.expr(NULLED_SQL)).groupBy("o_custkey").agg(F.count("x").alias("known"), F.avg("x").alias("m")).filter("known >= 5")
    top = u.orderBy(F.desc("m"), "o_custkey").limit(5)
    return top.select("o_custkey", "known", F.round("m", 4).alias("mean"), F.rank().over(W.orderBy(F.desc("m"))).alias("place"))


@query("SELECT count(*) AS users FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 2)")
def multi_value_entities(t: Tables):
    return t.events.groupBy("user_id").agg(F.count_distinct("event_type").alias("k")).filter("k >= 2").agg(F.count("*").alias("users"))


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events")
def row_counts(t: Tables):
    one = lambda name: getattr(t, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return keys.union_all(one("orders"), one("customer"), one("events"))


EVENTS_SQL = "(SELECT event_id, nullif(user_id % 7, 0) AS a, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS b, nullif(event_type, 'click') AS c, ts FROM events)"


def _nulled_events(t: Tables):
    return t.events.select("event_id", F.nullif(F.col("user_id") % 7, F.lit(0)).alias("a"), F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("value")).alias("b"), F.nullif("event_type", F.lit("click")).alias("c"), "ts")


@query(f"SELECT count(*) AS n, count_if(a IS NULL) AS null_a, count_if(b IS NULL) AS null_b, count_if(c IS NULL) AS null_c, count_if(a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL) AS complete FROM {EVENTS_SQL}")
def null_profile(t: Tables):
    e = _nulled_events(t)
    missing = lambda c: F.col(c).isNull()
    return e.agg(F.count("*").alias("n"), *[F.count_if(missing(c)).alias(f"null_{c}") for c in "abc"], F.count_if(~missing("a") & ~missing("b") & ~missing("c")).alias("complete"))


@query(f"SELECT c, count(*) AS n, round(avg(b), 6) AS mean FROM {EVENTS_SQL} WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY 1")
def complete_rows(t: Tables):
    return _nulled_events(t).na.drop(subset=["a", "b", "c"]).groupBy("c").agg(F.count("*").alias("n"), F.round(F.avg("b"), 6).alias("mean"))


@query(f"SELECT count_if(a IS NULL AND b IS NULL) AS both, round(count_if(a IS NULL) * count_if(b IS NULL) / count(*), 6) AS expected FROM {EVENTS_SQL}")
def co_missing(t: Tables):
    a, b = F.col("a").isNull(), F.col("b").isNull()
    return _nulled_events(t).agg(F.count_if(a & b).alias("both"), F.round(F.count_if(a) * F.count_if(b) / F.count("*"), 6).alias("expected"))


@query("""SELECT 'orders' AS side, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)
UNION ALL SELECT 'customers', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def orphans(t: Tables):
    a = keys.orphans(t.orders, t.customer.filter("c_custkey % 3 <> 0"), "o_custkey", "c_custkey").agg(F.count("*").alias("n")).select(F.lit("orders").alias("side"), "n")
    b = keys.orphans(t.customer, t.orders, "c_custkey", "o_custkey").agg(F.count("*").alias("n")).select(F.lit("customers").alias("side"), "n")
    return a.union(b)


@query("SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def silent(t: Tables):
    return keys.orphans(t.nation, t.supplier.filter("s_acctbal > 9000"), "n_nationkey", "s_nationkey").select("n_name")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS r FROM lineitem) WHERE r = 1""")
def dedupe_keep_first(t: Tables):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    return keys.keep_first(t.lineitem.select(*cols), cols[:2], cols[2:]).select(*cols[:5])


@query("SELECT n::BIGINT AS size, count(*) AS keys FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1")
def dup_sizes(t: Tables):
    return keys.copies(t.lineitem, ["l_orderkey", "l_linenumber"]).groupBy(F.col("n").alias("size")).agg(F.count("*").alias("keys"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_returnflag) AS labels FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT l_returnflag) > 1")
def label_conflicts(t: Tables):
    return keys.conflicts(t.lineitem, ["l_orderkey", "l_linenumber"], "l_returnflag")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id) - 1 AS others FROM events")
def copies_per_key(t: Tables):
    """Counts join back, so that a hot key is not one window partition."""
    n = t.events.groupBy("user_id").agg((F.count("*") - 1).alias("others"))
    return t.events.join(n, "user_id").select("event_id", "others")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS share FROM orders GROUP BY 1, 2")
def crosstab(t: Tables):
    c = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("o_orderpriority")), 6))


@query("SELECT l_returnflag, count_if(l_linestatus = 'F') AS f, count_if(l_linestatus = 'O') AS o, round(count_if(l_linestatus = 'F') / count(*), 6) AS share_f FROM lineitem GROUP BY 1")
def pivot_share(t: Tables):
    p = t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().na.fill(0)
    return p.select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o"), F.round(F.col("F") / (F.col("F") + F.col("O")), 6).alias("share_f"))


@query("SELECT event_type, round(avg((value > 50)::INT) * 100, 1) AS rate, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 100")
def rate_by_group(t: Tables):
    return t.events.groupBy("event_type").agg(F.round(F.avg((F.col("value") > 50).cast("double")) * 100, 1).alias("rate"), F.count("*").alias("n")).filter("n >= 100")


@query("SELECT p_brand, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, p_brand LIMIT 10")
def frequency_table(t: Tables):
    c = t.part.groupBy("p_brand").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("all"))
    return c.crossJoin(F.broadcast(total)).orderBy(F.desc("n"), "p_brand").limit(10).select("p_brand", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users, min(ts)::DATE AS first, max(ts)::DATE AS last, date_diff('day', min(ts)::DATE, max(ts)::DATE)::INT + 1 AS days, round(avg((value IS NOT NULL)::INT), 6) AS complete FROM events")
def global_profile(t: Tables):
    d = lambda f: F.to_date(f("ts"))
    return t.events.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), d(F.min).alias("first"), d(F.max).alias("last"), (F.datediff(d(F.max), d(F.min)) + 1).alias("days"), F.round(F.avg(F.col("value").isNotNull().cast("double")), 6).alias("complete"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def set_intersection(t: Tables):
    return t.customer.filter("c_acctbal > 9000").select("c_custkey").intersect(t.orders.filter("o_totalprice > 400000").select("o_custkey"))


@query("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders EXCEPT SELECT DISTINCT o_orderpriority, 'F' FROM orders")
def set_difference(t: Tables):
    every = t.orders.select("o_orderpriority", "o_orderstatus").distinct()
    return every.subtract(t.orders.select("o_orderpriority", F.lit("F")).distinct())


@query("""SELECT 'a' AS source, r_name AS name, NULL::INT AS key FROM region UNION ALL SELECT 'b', n_name, n_regionkey FROM nation""")
def union_heterogeneous(t: Tables):
    a = t.region.select(F.lit("a").alias("source"), F.col("r_name").alias("name"))
    b = t.nation.select(F.lit("b").alias("source"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("key"))
    return keys.union_all(a, b).select("source", "name", "key")


@query("""SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice < c_acctbal * 3""")
def residual_join(t: Tables):
    return t.orders.join(t.customer, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") < F.col("c_acctbal") * 3)).select("o_orderkey", "c_custkey")


@query("SELECT c_custkey, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey")
def left_one_to_one(t: Tables):
    o = t.orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("""SELECT e.event_id, count(*) AS near FROM events e JOIN events c ON c.ts BETWEEN e.ts - INTERVAL 2 HOUR AND e.ts + INTERVAL 2 HOUR
WHERE e.event_type = 'purchase' AND c.event_type = 'error' AND e.value > 100 AND c.value > 100 GROUP BY 1""")
def range_join_evidence(t: Tables):
    """Purchases with the errors within two hours of them: an interval join over buckets of
    time, whose number grows with the span of the events."""
    hours, at = 2 * 3_600_000_000, F.unix_micros("ts")
    big = t.events.filter("value > 100")
    e = big.filter("event_type = 'purchase'").select("event_id", (at - hours).alias("lo"), (at + hours).alias("hi"))
    c = big.filter("event_type = 'error'").select(at.alias("at"))
    return keys.interval_join(c, e, "at", "lo", "hi", 2 * hours).groupBy("event_id").agg(F.count("*").alias("near"))


ALIASES = {"STANDARD": "standard", "STANDARD BRASS": "brass", "PROMO": "promo", "TIN": "tin", "SMALL": "small", "ECONOMY": "economy"}


@query("""SELECT p_partkey, CASE WHEN contains(p_type, 'STANDARD BRASS') THEN 'brass' WHEN contains(p_type, 'STANDARD') THEN 'standard' WHEN contains(p_type, 'ECONOMY') THEN 'economy'
WHEN contains(p_type, 'PROMO') THEN 'promo' WHEN contains(p_type, 'SMALL') THEN 'small' WHEN contains(p_type, 'TIN') THEN 'tin' ELSE '' END AS alias FROM part""")
def longest_alias(t: Tables):
    return t.part.select("p_partkey", keys.contains_first(F.col("p_type"), ALIASES).alias("alias"))


@query("SELECT c_custkey, n_name IN ('FRANCE', 'GERMANY') AS listed, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 1000 AND 2000")
def membership(t: Tables):
    c = t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_acctbal").between(1000, 2000))
    return c.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").isin("FRANCE", "GERMANY").alias("listed"), "n_name")


@query("""WITH d AS (SELECT event_type, ts::DATE AS date, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1, 2)
SELECT a.event_type, a.date, a.n, round(a.m, 6) AS mean, count(b.value) AS n_rest, round(avg(b.value), 6) AS mean_rest, round(var_samp(b.value), 4) AS var_rest
FROM d a JOIN events b ON a.event_type = b.event_type AND b.ts::DATE <> a.date GROUP BY 1, 2, 3, 4""")
def part_against_rest(t: Tables):
    r = keys.rest_of_group(t.events.withColumn("date", F.to_date("ts")), ["event_type"], ["date"], "value")
    return r.select("event_type", "date", "n", F.round("mean", 6).alias("mean"), "n_rest", F.round("mean_rest", 6).alias("mean_rest"), F.round("var_rest", 4).alias("var_rest"))


@query("SELECT l_shipmode, l_orderkey, l_extendedprice FROM (SELECT l_returnflag AS l_shipmode, l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3")
def top_per_group(t: Tables):
    return ranks.top_k(t.lineitem, ["l_returnflag"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3).select(F.col("l_returnflag").alias("l_shipmode"), "l_orderkey", "l_extendedprice")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY md5('42|' || event_id::VARCHAR), event_id) AS r FROM events) WHERE r <= 5")
def hash_quota_sample(t: Tables):
    e = t.events.withColumn("date", F.to_date("ts"))
    return ranks.quota_sample(e, ["event_type", "date"], ["event_id"], 5).select("event_id", "user_id", "event_type")


@query("SELECT (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS code, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def category_codes(t: Tables):
    c = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return c.select((F.dense_rank().over(W.orderBy("o_orderpriority")) - 1).alias("code"), "o_orderpriority", "n")


@query("SELECT event_type, CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM events GROUP BY 1, 2")
def bands(t: Tables):
    band = F.when(F.col("value") < 10, "low").when(F.col("value") < 50, "mid").otherwise("high")
    return t.events.groupBy("event_type", band.alias("band")).agg(F.count("*").alias("n"))


@query("SELECT event_type, mode(u) AS usual, k AS times FROM (SELECT event_type, user_id AS u, count(*) AS k, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS r FROM events GROUP BY 1, 2) WHERE r = 1 GROUP BY event_type, k")
def group_mode(t: Tables):
    c = t.events.groupBy("event_type", "user_id").agg(F.count("*").alias("k"))
    best = c.groupBy("event_type").agg(F.max(F.struct("k", (-F.col("user_id")).alias("u"))).alias("b"))
    return best.select("event_type", (-F.col("b.u")).alias("usual"), F.col("b.k").alias("times"))


@query("SELECT o_orderpriority, round(sum(o_totalprice * w) / sum(w), 4) AS weighted FROM (SELECT *, CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey % 10 ELSE 1 END AS w FROM orders) GROUP BY 1")
def weighted_mean(t: Tables):
    w = F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderkey") % 10).otherwise(1)
    return t.orders.groupBy("o_orderpriority").agg(F.round(F.sum(F.col("o_totalprice") * w) / F.sum(w), 4).alias("weighted"))


@query("SELECT event_type, list_sort(list(value))[floor(count(*) * 0.1)::INT + 1] AS p10, list_sort(list(value))[floor(count(*) * 0.5)::INT + 1] AS p50, list_sort(list(value))[floor(count(*) * 0.9)::INT + 1] AS p90 FROM events GROUP BY 1")
def nearest_rank(t: Tables):
    """Percentiles by nearest rank from counts of values, however many a group has."""
    return ranks.quantiles(t.events, ["event_type"], "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, nearest=True)


@query("SELECT event_type, median(value) AS median, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY 1")
def exact_quantiles(t: Tables):
    return ranks.quantiles(t.events, ["event_type"], "value", {"median": 0.5, "p90": 0.9})
