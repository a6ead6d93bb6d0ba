"""Questions on time: series, calendars, windows, shifts, spikes, panels, statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import metrics, ranks, series
from .registry import Tables, query

DAILY = "(SELECT event_type, ts::DATE AS date, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1, 2)"


def _daily(t: Tables):
    return series.daily(t.events, "ts", ["event_type"], mean=F.avg("value"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, quarter(o_orderdate)::INT AS quarter, count(*) AS n, round(count(*) / any_value(day(last_day(o_orderdate))), 6) AS per_day FROM orders GROUP BY 1, 2")
def month_rate(t: Tables):
    d = F.col("o_orderdate")
    return t.orders.groupBy(F.date_format(d, "yyyy-MM").alias("month"), F.quarter(d).alias("quarter"), F.day(F.last_day(d)).alias("days")).agg(F.count("*").alias("n")).select("month", "quarter", "n", F.round(F.col("n") / F.col("days"), 6).alias("per_day"))


@query("SELECT h::INT AS hour, coalesce(n, 0) AS n FROM (SELECT unnest(range(24)) AS h) LEFT JOIN (SELECT hour(ts) AS k, count(*) AS n FROM events GROUP BY 1) ON h = k")
def hour_of_day(t: Tables):
    n = t.events.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return t.spark.range(24).select(F.col("id").cast("int").alias("hour")).join(n, "hour", "left").na.fill(0, ["n"])


@query("SELECT dayofweek(ts)::INT AS weekday, dayname(ts) AS name, count(*) AS n FROM events GROUP BY 1, 2")
def dow_counts(t: Tables):
    return t.events.groupBy((F.dayofweek("ts") - 1).alias("weekday"), F.date_format("ts", "EEEE").alias("name")).agg(F.count("*").alias("n"))


@query("SELECT hour(ts)::INT AS hour, round(avg(n), 6) AS mean_n FROM (SELECT date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY 1) GROUP BY 1")
def mean_of_hourly(t: Tables):
    h = t.events.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.count("*").alias("n"))
    return h.groupBy(F.hour("ts").alias("hour")).agg(F.round(F.avg("n"), 6).alias("mean_n"))


@query("""WITH h AS (SELECT hour(ts) AS hour, count(*) FILTER (event_id % 3 > 0) AS true_n, count(*) FILTER (event_id % 3 = 0) AS day_only FROM events GROUP BY 1)
SELECT hour::INT AS hour, true_n, (true_n + CASE WHEN hour = 0 THEN (SELECT sum(day_only) FROM h) ELSE 0 END)::BIGINT AS naive_n FROM h""")
def padded_hour_artefact(t: Tables):
    """Hours as they are, and as they look where times of day that are unknown read as 0:00."""
    h = t.events.groupBy(F.hour("ts").alias("hour")).agg(F.count_if(F.col("event_id") % 3 > 0).alias("true_n"), F.count_if(F.col("event_id") % 3 == 0).alias("d"))
    total = h.agg(F.sum("d").alias("all"))
    return h.crossJoin(F.broadcast(total)).select("hour", "true_n", (F.col("true_n") + F.when(F.col("hour") == 0, F.col("all")).otherwise(0)).alias("naive_n"))


@query("""WITH n AS (SELECT user_id, ts::DATE AS date, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT user_id, min(date) AS a, max(date) AS b FROM n GROUP BY 1)
SELECT s.user_id, d::DATE AS date, coalesce(n, 0) AS n FROM (SELECT user_id, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM s) s LEFT JOIN n ON s.user_id = n.user_id AND s.d::DATE = n.date""")
def calendar_dense_daily(t: Tables):
    return series.dense(series.daily(t.events, "ts", ["user_id"]), ["user_id"]).select("user_id", "date", "n")


@query(f"SELECT event_type, date, n, round(CASE WHEN count(*) OVER w = 28 THEN avg(n) OVER w END, 6) AS rolling FROM {DAILY} WINDOW w AS (PARTITION BY event_type ORDER BY date ROWS BETWEEN 14 PRECEDING AND 13 FOLLOWING)")
def rolling_28_centered(t: Tables):
    return _daily(t).select("event_type", "date", "n", F.round(series.rolling("n", "date", -14, 13, True, ["event_type"]), 6).alias("rolling"))


@query(f"SELECT event_type, date, round(avg(mean) OVER (PARTITION BY event_type ORDER BY date ROWS 2 PRECEDING), 6) AS trailing FROM {DAILY}")
def trailing_3(t: Tables):
    return _daily(t).select("event_type", "date", F.round(series.rolling("mean", "date", -2, 0, False, ["event_type"]), 6).alias("trailing"))


@query("""WITH d AS (SELECT user_id, ts::DATE AS date, count(*) AS n FROM events WHERE value > 60 GROUP BY 1, 2), g AS (SELECT *, CASE WHEN coalesce(date - lag(date) OVER (PARTITION BY user_id ORDER BY date), 3) > 2 THEN 1 ELSE 0 END AS new FROM d),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY date) AS island FROM g)
SELECT user_id, island::BIGINT AS island, min(date) AS first, max(date) AS last, count(*) AS days, arg_max(date, (n, -date_diff('day', DATE '1970-01-01', date))) AS peak FROM i GROUP BY 1, 2""")
def islands(t: Tables):
    d = series.daily(t.events.filter("value > 60"), "ts", ["user_id"])
    i = series.islands(d, ["user_id"], "date", 2)
    return i.groupBy("user_id", "island").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("days"), F.max_by("date", F.struct("n", -F.unix_date("date"))).alias("peak"))


P_SQL = "(SELECT o_orderkey, (o_orderkey * 7919 % 10007) * (o_orderkey * 7919 % 10007) / 100140049.0 / 20 AS p FROM orders)"


@query(f"""WITH r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r, count(*) OVER () AS m FROM {P_SQL}), k AS (SELECT max(p) AS lim FROM r WHERE p <= 0.05 * r / m)
SELECT o_orderkey, p <= lim AS kept FROM r, k""")
def bh_fdr(t: Tables):
    x = F.col("o_orderkey") * 7919 % 10007
    tests = t.orders.select("o_orderkey", (x * x / 100140049.0 / 20).alias("p"))
    return series.discoveries(tests, "p", 0.05).select("o_orderkey", "kept")


@query("""WITH s AS (SELECT event_type, ts::DATE AS date, count(value) AS n, sum(value) AS s, sum(value * value) AS q FROM events GROUP BY 1, 2),
w AS (SELECT event_type, date, row_number() OVER p AS f, row_number() OVER (PARTITION BY event_type ORDER BY date DESC) AS l,
  sum(n) OVER a AS na, sum(s) OVER a AS sa, sum(q) OVER a AS qa, sum(n) OVER b AS nb, sum(s) OVER b AS sb, sum(q) OVER b AS qb FROM s
  WINDOW p AS (PARTITION BY event_type ORDER BY date), a AS (PARTITION BY event_type ORDER BY date RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), b AS (PARTITION BY event_type ORDER BY date RANGE BETWEEN CURRENT ROW AND INTERVAL 2 DAY FOLLOWING)),
v AS (SELECT *, (qa - sa * sa / na) / (na - 1) AS va, (qb - sb * sb / nb) / (nb - 1) AS vb FROM w WHERE f > 3 AND l > 3 AND na >= 40 AND nb >= 40)
SELECT event_type, date, na::BIGINT AS n_a, nb::BIGINT AS n_b, round((sb / nb - sa / na) / sqrt(va / na + vb / nb), 5) AS t, round((sb / nb - sa / na) / sqrt((va + vb) / 2), 5) AS d FROM v""")
def welch_scan(t: Tables):
    s = series.shift_scan(t.events, "ts", "value", ["event_type"])
    return s.select("event_type", "date", "n_a", "n_b", F.round("t", 5).alias("t"), F.round("d", 5).alias("d"))


@query(f"""WITH m AS (SELECT event_type, median(n) AS med FROM {DAILY} GROUP BY 1), a AS (SELECT d.event_type, date, n, med, abs(n - med) AS dev FROM {DAILY} d JOIN m ON d.event_type = m.event_type), k AS (SELECT event_type, median(dev) AS mad FROM a GROUP BY 1)
SELECT a.event_type, date, n, round((n - med) / (1.4826 * mad), 5) AS z, round(n / med, 5) AS ratio FROM a JOIN k ON a.event_type = k.event_type WHERE (n - med) / (1.4826 * mad) >= 1.5""")
def robust_z_spikes(t: Tables):
    z = series.robust_z(_daily(t), "n", ["event_type"])
    return z.filter("z >= 1.5").select("event_type", "date", "n", F.round("z", 5).alias("z"), F.round(F.col("n") / F.col("median"), 5).alias("ratio"))


@query("""WITH u AS (SELECT event_type, user_id, sum(value) AS v FROM events GROUP BY 1, 2 HAVING sum(value) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v) AS i, row_number() OVER (PARTITION BY event_type ORDER BY v DESC) AS j FROM u)
SELECT event_type, count(*) AS contributors, round(max(v) / sum(v), 6) AS top1_share, round(sum(v) FILTER (j <= 5) / sum(v), 6) AS top5_share, round(2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*), 6) AS gini FROM r GROUP BY 1""")
def gini_concentration(t: Tables):
    u = t.events.groupBy("event_type", "user_id").agg(F.sum("value").alias("v"))
    c = series.concentration(u, ["event_type"], "v")
    return c.select("event_type", "contributors", *[F.round(x, 6).alias(x) for x in ("top1_share", "top5_share", "gini")])


@query("""WITH c AS (SELECT user_id, count(*) AS n, count(DISTINCT ts::DATE) AS days, min(ts::DATE) AS first, max(ts::DATE) AS last FROM events GROUP BY 1), g AS (SELECT min(first) AS a, max(last) AS b FROM c)
SELECT user_id, n, days, first, last, round(days / (date_diff('day', a, b) + 1), 6) AS share, first <= a + 1 AND last >= b - 1 AND days / (date_diff('day', a, b) + 1) >= 0.8 AS balanced FROM c, g""")
def coverage_panel(t: Tables):
    d = F.to_date("ts")
    c = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct(d).alias("days"), F.min(d).alias("first"), F.max(d).alias("last"))
    g = c.agg(F.min("first").alias("a"), F.max("last").alias("b"))
    share = F.col("days") / (F.datediff("b", "a") + 1)
    return c.crossJoin(F.broadcast(g)).select("user_id", "n", "days", "first", "last", F.round(share, 6).alias("share"), ((F.col("first") <= F.date_add("a", 1)) & (F.col("last") >= F.date_sub("b", 1)) & (share >= 0.8)).alias("balanced"))


@query("""WITH s AS (SELECT event_type, ts::DATE AS date, count(*) AS sampled, avg((value > 50)::INT) AS share FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2), c AS (SELECT event_type, ts::DATE AS date, count(*) AS census FROM events GROUP BY 1, 2),
e AS (SELECT s.date, share * census AS est, census * sqrt(share * (1 - share) / greatest(sampled, 1) * greatest(1 - least(sampled / census, 1), 0)) AS se, census, sampled FROM s JOIN c ON s.event_type = c.event_type AND s.date = c.date)
SELECT date, round(sum(est), 4) AS estimated, round(sqrt(sum(se * se)), 4) AS se, sum(census)::BIGINT AS census, sum(sampled)::BIGINT AS sampled FROM e GROUP BY 1""")
def population_estimate(t: Tables):
    """A sample's share carried to the census of its stratum, errors added by squares."""
    d = F.to_date("ts").alias("date")
    s = t.events.filter("event_id % 3 = 0").groupBy("event_type", d).agg(F.count("*").alias("sampled"), F.avg((F.col("value") > 50).cast("double")).alias("share"))
    c = t.events.groupBy("event_type", d).agg(F.count("*").alias("census"))
    left = F.greatest(1 - F.least(F.col("sampled") / F.col("census"), F.lit(1.0)), F.lit(0.0))
    e = s.join(c, ["event_type", "date"]).withColumns({"est": F.col("share") * F.col("census"), "se": F.col("census") * F.sqrt(F.col("share") * (1 - F.col("share")) / F.greatest("sampled", F.lit(1)) * left)})
    return e.groupBy("date").agg(F.round(F.sum("est"), 4).alias("estimated"), F.round(F.sqrt(F.sum(F.col("se") * F.col("se"))), 4).alias("se"), F.sum("census").alias("census"), F.sum("sampled").alias("sampled"))


@query("""WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY 1, 2), g AS (SELECT sum(n) AS t FROM c), ra AS (SELECT a, sum(n) AS x FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS y FROM c GROUP BY 1),
f AS (SELECT coalesce(n, 0) AS n, x * y / t AS e FROM ra CROSS JOIN rb CROSS JOIN g LEFT JOIN c ON c.a = ra.a AND c.b = rb.b)
SELECT round(sum((n - e) * (n - e) / e), 6) AS stat, round(sqrt(sum((n - e) * (n - e) / e) / ((SELECT t FROM g) * (least((SELECT count(*) FROM ra), (SELECT count(*) FROM rb)) - 1))), 6) AS v FROM f""")
def cramers_v(t: Tables):
    """Association of two columns from the counts of their values."""
    c = t.orders.groupBy(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b")).agg(F.count("*").alias("n"))
    x, y = c.groupBy("a").agg(F.sum("n").alias("x")), c.groupBy("b").agg(F.sum("n").alias("y"))
    g = c.agg(F.sum("n").alias("t"), F.least(F.count_distinct("a"), F.count_distinct("b")).alias("k"))
    # Over all cells, empty ones too, (n - e)^2 / e sums to n^2 / e over those that are not empty, less the total.
    s = c.join(x, "a").join(y, "b").agg(F.sum(F.col("n") * F.col("n") / (F.col("x") * F.col("y"))).alias("s")).crossJoin(F.broadcast(g))
    stat = F.col("t") * F.col("s") - F.col("t")
    return s.select(F.round(stat, 6).alias("stat"), F.round(F.sqrt(stat / (F.col("t") * (F.col("k") - 1))), 6).alias("v"))


@query("SELECT round(sum((n - e) * (n - e) / e), 6) AS stat, count(*) - 1 AS dof FROM (SELECT n, avg(n) OVER () AS e FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1))")
def chi2_uniform(t: Tables):
    c = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    e = c.agg(F.avg("n").alias("e"))
    return c.crossJoin(F.broadcast(e)).agg(F.round(F.sum((F.col("n") - F.col("e")) * (F.col("n") - F.col("e")) / F.col("e")), 6).alias("stat"), (F.count("*") - 1).alias("dof"))


@query("""WITH r AS (SELECT event_type, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS r FROM events), g AS (SELECT event_type, count(*) AS k, sum(r) AS s FROM r GROUP BY 1), n AS (SELECT sum(k) AS n FROM g), t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*) AS c FROM events GROUP BY value))
SELECT round((12 / (n * (n + 1)) * sum(s * s / k) - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 4) AS h FROM g, n, t GROUP BY n, t""")
def kruskal_h(t: Tables):
    """Ranks are made on distinct values; groups add n * rank of each value they hold."""
    mid = ranks.mid_ranks(t.events, "value")
    c = t.events.groupBy("event_type", "value").agg(F.count("*").alias("c"))
    g = c.join(mid, "value").groupBy("event_type").agg(F.sum("c").alias("k"), F.sum(F.col("c") * F.col("mid_rank")).alias("s"))
    ties = mid.agg(F.sum("n").cast("double").alias("n"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("t"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))
    return g.agg(F.sum(F.col("s") * F.col("s") / F.col("k")).alias("q")).crossJoin(F.broadcast(ties)).select(F.round(h, 4).alias("h"))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS b FROM lineitem)
SELECT round(corr(a, b), 6) AS rho FROM r""")
def spearman(t: Tables):
    """Correlation of mid-ranks, over counts of the pairs of values."""
    pairs = t.lineitem.groupBy("l_quantity", "l_discount").agg(F.count("*").alias("c"))
    a, b = ranks.mid_ranks(t.lineitem, "l_quantity"), ranks.mid_ranks(t.lineitem, "l_discount")
    x = pairs.join(a.select("l_quantity", F.col("mid_rank").alias("a")), "l_quantity").join(b.select("l_discount", F.col("mid_rank").alias("b")), "l_discount")
    w = lambda e: F.sum(F.col("c") * e)
    s = x.agg(F.sum("c").cast("double").alias("n"), w(F.col("a")).alias("a"), w(F.col("b")).alias("b"), w(F.col("a") * F.col("b")).alias("ab"), w(F.col("a") * F.col("a")).alias("aa"), w(F.col("b") * F.col("b")).alias("bb"))
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    return s.select(F.round((n * F.col("ab") - a * b) / F.sqrt((n * F.col("aa") - a * a) * (n * F.col("bb") - b * b)), 6).alias("rho"))


@query("SELECT event_type, round(corr(n, k), 6) AS trend, round(stddev_samp(n) / avg(n), 6) AS cv FROM (SELECT event_type, n, date_diff('day', DATE '1970-01-01', date) AS k FROM " + DAILY + ") GROUP BY 1")
def composition(t: Tables):
    d = _daily(t).withColumn("k", F.unix_date("date"))
    return d.groupBy("event_type").agg(F.round(metrics.correlation("n", "k"), 6).alias("trend"), F.round(F.stddev_samp("n") / F.avg("n"), 6).alias("cv"))


@query("""WITH m AS (SELECT value AS v, (event_type = 'click')::INT AS a FROM events), n AS (SELECT sum(a) AS x, sum(1 - a) AS y FROM m), c AS (SELECT v, sum(sum(a)) OVER (ORDER BY v) AS ca, sum(sum(1 - a)) OVER (ORDER BY v) AS cb FROM m GROUP BY v)
SELECT round(max(abs(ca / x - cb / y)), 6) AS d FROM c, n""")
def ks_distance(t: Tables):
    """Two-sample distance from counts of distinct values."""
    a = F.col("event_type") == "click"
    c = t.events.groupBy("value").agg(F.count_if(a).alias("a"), F.count_if(~a).alias("b"))
    at = ranks.running(c, [F.col("value")], ["a", "b"])
    n = c.agg(F.sum("a").alias("x"), F.sum("b").alias("y"))
    return at.withColumns({"ca": F.col("before_a") + F.col("a"), "cb": F.col("before_b") + F.col("b")}).crossJoin(F.broadcast(n)).agg(F.round(F.max(F.abs(F.col("ca") / F.col("x") - F.col("cb") / F.col("y"))), 6).alias("d"))


@query("SELECT round(stddev_samp(x), 6) AS sd_before, round(stddev_samp(coalesce(x, m)), 6) AS sd_after, count_if(x IS NULL) AS filled FROM (SELECT CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS x FROM events), (SELECT median(CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END) AS m FROM events)")
def median_imputation_effect(t: Tables):
    """What filling with the median would do to the spread; nothing is stored."""
    x = t.events.select(F.when(F.col("event_id") % 6 == 0, None).otherwise(F.col("value")).alias("x"))
    m = x.agg(F.median("x").alias("m"))
    return x.crossJoin(F.broadcast(m)).agg(F.round(F.stddev_samp("x"), 6).alias("sd_before"), F.round(F.stddev_samp(F.coalesce("x", "m")), 6).alias("sd_after"), F.count_if(F.col("x").isNull()).alias("filled"))


@query("SELECT k::INT AS k, round(5 * (1 - pow(0.8, k)), 6) AS expected FROM (SELECT DISTINCT l_linenumber AS k FROM lineitem)")
def expected_distinct(t: Tables):
    return t.lineitem.select(F.col("l_linenumber").alias("k")).distinct().select("k", F.round(5 * (1 - F.pow(F.lit(0.8), "k")), 6).alias("expected"))


@query("""WITH d AS (SELECT event_type, ts::DATE AS date, count(*) AS n, avg(value) AS m FROM events GROUP BY 1, 2), s AS (SELECT event_type, median(m) AS med FROM d GROUP BY 1), a AS (SELECT d.*, med, abs(m - med) AS dev FROM d JOIN s ON d.event_type = s.event_type), k AS (SELECT event_type, median(dev) AS mad FROM a GROUP BY 1)
SELECT a.event_type, date, round((m - med) / (1.4826 * mad), 5) AS z, CASE WHEN (m - med) / (1.4826 * mad) <= -2.5 THEN 'deep' ELSE 'shallow' END AS kind FROM a JOIN k ON a.event_type = k.event_type WHERE (m - med) / (1.4826 * mad) <= -1.5 AND n >= 25""")
def case_scan(t: Tables):
    """Days on which a group's mean falls far below its own usual level."""
    z = series.robust_z(_daily(t), "mean", ["event_type"]).filter("z <= -1.5 AND n >= 25")
    return z.select("event_type", "date", F.round("z", 5).alias("z"), F.when(F.col("z") <= -2.5, "deep").otherwise("shallow").alias("kind"))


@query("""WITH b AS (SELECT user_id, min(ts::DATE) + 15 AS cut FROM events GROUP BY 1)
SELECT e.user_id, count(*) FILTER (ts::DATE < cut) AS n_before, count(*) FILTER (ts::DATE >= cut) AS n_after, round(avg(value) FILTER (ts::DATE < cut), 6) AS before, round(avg(value) FILTER (ts::DATE >= cut), 6) AS after FROM events e JOIN b ON e.user_id = b.user_id GROUP BY 1""")
def before_after(t: Tables):
    b = t.events.groupBy("user_id").agg(F.date_add(F.min(F.to_date("ts")), 15).alias("cut"))
    early = F.to_date("ts") < F.col("cut")
    return t.events.join(b, "user_id").groupBy("user_id").agg(F.count_if(early).alias("n_before"), F.count_if(~early).alias("n_after"), F.round(F.avg(F.when(early, F.col("value"))), 6).alias("before"), F.round(F.avg(F.when(~early, F.col("value"))), 6).alias("after"))


#: A step of 40 from the given day of a type's series on, over what is left of the value.
STEPS = {"view": 10, "click": 20}


@query("SELECT event_type, (min(ts::DATE) + CASE event_type WHEN 'view' THEN 10 ELSE 20 END)::DATE AS at, CASE event_type WHEN 'view' THEN 10 ELSE 20 END::BIGINT AS position FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def pelt_breaks(t: Tables):
    """Breaks of each type's daily mean, steps planted: an exact search over one short series a group."""
    d = _daily(t)
    first = d.groupBy("event_type").agg(F.min("date").alias("__a"))
    day = F.datediff("date", "__a")
    up = F.lit(False)
    for kind, at in STEPS.items():
        up = up | ((F.col("event_type") == kind) & (day >= at))
    planted = d.join(first, "event_type").withColumn("level", F.col("mean") / 1000 + F.when(up, 40).otherwise(0))
    return series.change_points(planted, ["event_type"], "date", "level", penalty=50.0)


@query("""WITH s AS (SELECT event_type, ts::DATE AS date, count(*) AS n, count(DISTINCT user_id) AS authors, sum(value) AS total FROM events GROUP BY 1, 2), m AS (SELECT event_type, median(total) AS med FROM s GROUP BY 1), v AS (SELECT s.*, med, abs(total - med) AS dev FROM s JOIN m USING (event_type)), k AS (SELECT event_type, median(dev) AS mad FROM v GROUP BY 1),
z AS (SELECT event_type, date, n, authors, (total - med) / (1.4826 * mad) AS z, total / med AS ratio FROM v JOIN k USING (event_type) WHERE (total - med) / (1.4826 * mad) >= 1.8),
u AS (SELECT event_type, ts::DATE AS date, user_id, sum(value) AS x, count(*) AS c FROM events GROUP BY 1, 2, 3),
t AS (SELECT event_type, date, max(x) / sum(x) AS top1 FROM u GROUP BY 1, 2), x AS (SELECT event_type, date, string_agg(user_id || ':' || c, ' ' ORDER BY c DESC, user_id) AS mix FROM (SELECT *, row_number() OVER (PARTITION BY event_type, date ORDER BY c DESC, user_id) AS r FROM u) WHERE r <= 4 GROUP BY 1, 2)
SELECT event_type, date, n, authors, round(z, 4) AS z, round(ratio, 2) AS ratio, round(top1, 6) AS top1_share, mix FROM z JOIN t USING (event_type, date) JOIN x USING (event_type, date)""")
def spike_details(t: Tables):
    """Days far above the median of their type: who was there, how far one contributor makes
    them, and the four most frequent."""
    day = F.to_date("ts").alias("date")
    own = t.events.groupBy("event_type", day, "user_id").agg(F.sum("value").alias("x"), F.count("*").alias("c"))
    d = own.groupBy("event_type", "date").agg(F.sum("c").alias("n"), F.count("*").alias("authors"), F.sum("x").alias("total"), (F.max("x") / F.sum("x")).alias("top1"))
    z = series.robust_z(d, "total", ["event_type"]).filter("z >= 1.8")
    first = ranks.top_k(own, ["event_type", "date"], [F.desc("c"), F.col("user_id")], 4)
    order = F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("k"), "user_id", F.concat_ws(":", F.col("user_id").cast("string"), F.col("c").cast("string")).alias("s"))))
    mix = first.groupBy("event_type", "date").agg(F.array_join(F.transform(order, lambda x: x["s"]), " ").alias("mix"))
    out = z.join(mix, ["event_type", "date"])
    return out.select("event_type", "date", "n", "authors", F.round("z", 4).alias("z"), F.round(F.col("total") / F.col("median"), 2).alias("ratio"), F.round("top1", 6).alias("top1_share"), "mix")


@query("""WITH c AS (SELECT event_type, min(ts::DATE) + 15 AS cut FROM events GROUP BY 1), p AS (SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT ts::DATE) >= 20), e AS (SELECT event_type, ts::DATE AS date, cut, value, user_id IN (SELECT user_id FROM p) AS panel FROM events JOIN c USING (event_type)),
w AS (SELECT *, date >= cut AS after FROM e WHERE date >= cut - 5 AND date < cut + 5), l AS (SELECT event_type, after, value, 'all' AS who FROM w UNION ALL SELECT event_type, after, value, 'panel' FROM w WHERE panel),
a AS (SELECT event_type, who, count(*) FILTER (NOT after) AS n0, count(*) FILTER (after) AS n1, avg(value) FILTER (NOT after) AS m0, avg(value) FILTER (after) AS m1, var_samp(value) FILTER (NOT after) AS v0, var_samp(value) FILTER (after) AS v1 FROM l GROUP BY 1, 2)
SELECT event_type, who, n0 AS n_before, n1 AS n_after, round(m1 - m0, 6) AS delta, round((m1 - m0) / sqrt((v0 + v1) / 2), 6) AS d, round((m1 - m0) / sqrt(v0 / n0 + v1 / n1), 6) AS t FROM a WHERE n0 >= 20 AND n1 >= 20""")
def record_shifts(t: Tables):
    """A break in each type's series, tested on records within five days of it: over all
    users, and over those who were there throughout."""
    day = F.to_date("ts")
    cuts = t.events.groupBy("event_type").agg(F.date_add(F.min(day), 15).alias("cut"))
    panel = t.events.groupBy("user_id").agg(F.count_distinct(day).alias("days")).filter("days >= 20").select("user_id")
    return series.record_shifts(t.events, cuts, panel, ["event_type"], "ts", "value", "user_id")


@query("""WITH d AS (SELECT ts::DATE AS date, count(*) AS n FROM events WHERE event_id % 10 = 0 GROUP BY 1), m AS (SELECT avg(n) AS m, count(*) AS days FROM d),
p AS (SELECT date, n, m, days, 1 - (SELECT sum(exp(i * ln(m) - m - lgamma(i + 1))) FROM (SELECT unnest(range(0, n)) AS i)) AS p FROM d, m)
SELECT date, n, round(p, 6) AS p, round(least(p * days, 1), 6) AS bonferroni, (n - m) / sqrt(m) > 3 AS above FROM p""")
def poisson_days(t: Tables):
    """Daily counts against a Poisson process of their mean: the chance of as many or more,
    and corrected for the number of days."""
    d = series.daily(t.events.filter("event_id % 10 = 0"), "ts")
    return series.poisson_days(d, "n")


@query("""WITH k AS (SELECT user_id, ts::DATE AS date, count(*) AS k FROM events GROUP BY 1, 2), a AS (SELECT count(DISTINCT user_id) * count(DISTINCT date) AS cells, sum(k) AS total FROM k), o AS (SELECT k::INT AS k, count(*) AS observed FROM k GROUP BY 1 UNION ALL SELECT 0, cells - (SELECT count(*) FROM k) FROM a)
SELECT k, observed, round(cells * exp(k * ln(total / cells) - total / cells - lgamma(k + 1)), 4) AS expected FROM o, a""")
def poisson_overlay(t: Tables):
    """How many user-days have k events, and how many a Poisson process would give."""
    k = t.events.groupBy("user_id", F.to_date("ts").alias("date")).agg(F.count("*").alias("k"))
    a = t.events.agg(F.count_distinct("user_id").alias("u")).crossJoin(t.events.agg(F.count_distinct(F.to_date("ts")).alias("d"), F.count("*").alias("total"))).select((F.col("u") * F.col("d")).alias("cells"), "total")
    o = k.groupBy(F.col("k").cast("int").alias("k")).agg(F.count("*").alias("observed"))
    none = a.crossJoin(o.agg(F.sum("observed").alias("seen"))).select(F.lit(0).alias("k"), (F.col("cells") - F.col("seen")).alias("observed"))
    mean = F.col("total") / F.col("cells")
    pmf = F.exp(F.col("k") * F.log(mean) - mean - stats.log_factorial(F.col("k")))
    return o.unionByName(none).crossJoin(F.broadcast(a)).select("k", "observed", F.round(F.col("cells") * pmf, 4).alias("expected"))


@query("""WITH a AS (SELECT ts::DATE AS date, count(*) AS n FROM events WHERE event_type = 'click' AND value > 60 GROUP BY 1), b AS (SELECT ts::DATE AS date, avg(value) AS mean FROM events WHERE event_type = 'error' AND value > 120 GROUP BY 1)
SELECT coalesce(a.date, b.date) AS date, coalesce(n, 0) AS n, round(mean, 6) AS mean, a.date IS NOT NULL AND b.date IS NOT NULL AS both FROM a FULL JOIN b ON a.date = b.date""")
def aligned_series(t: Tables):
    """Two daily series side by side on every day that either has."""
    a = series.daily(t.events.filter("event_type = 'click' AND value > 60"), "ts")
    b = series.daily(t.events.filter("event_type = 'error' AND value > 120"), "ts", mean=F.avg("value")).select("date", "mean")
    return series.aligned(a, b, {"n": 0}).select("date", "n", F.round("mean", 6).alias("mean"), "both")


@query("""WITH c AS (SELECT event_type, ts::DATE AS date, count(*) AS census, sum(value) AS measure FROM events GROUP BY 1, 2), d AS (SELECT event_type, ts::DATE AS date, avg(value) AS mean FROM events WHERE user_id % 3 = 0 GROUP BY 1, 2)
SELECT event_type, date, census, round(measure, 4) AS measure, round(mean, 6) AS mean FROM c LEFT JOIN d USING (event_type, date)""")
def census_with_series(t: Tables):
    """A census measure beside a sampled daily series, where there is one."""
    c = series.daily(t.events, "ts", ["event_type"], measure=F.sum("value")).withColumnRenamed("n", "census")
    d = series.daily(t.events.filter("user_id % 3 = 0"), "ts", ["event_type"], mean=F.avg("value")).drop("n")
    return c.join(d, ["event_type", "date"], "left").select("event_type", "date", "census", F.round("measure", 4).alias("measure"), F.round("mean", 6).alias("mean"))


@query("""WITH x AS (SELECT *, ts::DATE = (SELECT min(ts::DATE) + 12 FROM events) AS on_day FROM events WHERE ts::DATE BETWEEN (SELECT min(ts::DATE) + 5 FROM events) AND (SELECT min(ts::DATE) + 19 FROM events))
SELECT event_type, count(*) FILTER (on_day) AS n_event, count(*) FILTER (NOT on_day) AS n_rest, round(avg(value) FILTER (on_day) - avg(value) FILTER (NOT on_day), 6) AS change, round(avg((value > 60)::INT) FILTER (on_day), 6) AS flagged_event, round(avg((value > 60)::INT) FILTER (NOT on_day), 6) AS flagged_rest,
mode(user_id % 4) FILTER (on_day) IS NOT NULL AS has_version, arg_min('e' || event_id, (-value, event_id)) FILTER (on_day) AS quote FROM x GROUP BY 1""")
def case_profile(t: Tables):
    """A day against the week on either side of it, by type: counts, means, flags, whether it
    has a version, and the strongest record as a quote."""
    day = F.to_date("ts")
    first = t.events.agg(F.min(day).alias("__a"))
    x = t.events.crossJoin(F.broadcast(first)).withColumn("__d", F.datediff(day, "__a")).filter("__d BETWEEN 5 AND 19")
    on = F.col("__d") == 12
    return series.case_profile(x, on, ["event_type"], "value", {"flagged": F.col("value") > 60}, F.col("user_id") % 4, F.concat(F.lit("e"), F.col("event_id").cast("string")), F.col("event_id"))


@query("""WITH l AS (SELECT scope, ts::DATE AS date, value FROM (SELECT 'overall' AS scope, ts, value FROM events UNION ALL SELECT 'type:' || event_type, ts, value FROM events)), s AS (SELECT scope, date, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM l GROUP BY 1, 2), k AS (SELECT scope FROM s GROUP BY 1 HAVING sum(n) >= 500),
w AS (SELECT scope, date, row_number() OVER p AS f, row_number() OVER (PARTITION BY scope ORDER BY date DESC) AS l, sum(n) OVER a AS na, sum(s) OVER a AS sa, sum(q) OVER a AS qa, sum(n) OVER b AS nb, sum(s) OVER b AS sb, sum(q) OVER b AS qb FROM s WHERE scope IN (SELECT scope FROM k)
  WINDOW p AS (PARTITION BY scope ORDER BY date), a AS (PARTITION BY scope ORDER BY date RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), b AS (PARTITION BY scope ORDER BY date RANGE BETWEEN CURRENT ROW AND INTERVAL 2 DAY FOLLOWING)),
v AS (SELECT *, (qa - sa * sa / na) / (na - 1) AS va, (qb - sb * sb / nb) / (nb - 1) AS vb FROM w WHERE f > 3 AND l > 3 AND na >= 40 AND nb >= 40)
SELECT scope, date, na::BIGINT AS n_a, nb::BIGINT AS n_b, round((sb / nb - sa / na) / sqrt(va / na + vb / nb), 5) AS t FROM v""")
def scan_fan_out(t: Tables):
    """The shift scan over the whole and over each type with 500 records, as one table."""
    e = t.events.select("ts", "value", F.explode(F.array(F.lit("overall"), F.concat(F.lit("type:"), "event_type"))).alias("scope"))
    big = e.groupBy("scope").agg(F.count("*").alias("n")).filter("n >= 500").select("scope")
    s = series.shift_scan(e.join(F.broadcast(big), "scope"), "ts", "value", ["scope"])  # a row for each scope
    return s.select("scope", "date", "n_a", "n_b", F.round("t", 5).alias("t"))


@query("""SELECT scope, metric, date, n, round(v, 6) AS v FROM (
SELECT 'overall' AS scope, 'mean' AS metric, ts::DATE AS date, count(*) AS n, avg(value) AS v FROM events GROUP BY 3 UNION ALL
SELECT 'type:' || event_type, 'mean', ts::DATE, count(*), avg(value) FROM events GROUP BY 1, 3 UNION ALL
SELECT 'overall', 'high', ts::DATE, count(*), avg((value > 90)::INT) FROM events GROUP BY 3 UNION ALL
SELECT 'type:' || event_type, 'high', ts::DATE, count(*), avg((value > 90)::INT) FROM events GROUP BY 1, 3)""")
def scope_fan_out(t: Tables):
    """One long table of scopes and measures in place of a loop over them."""
    e = t.events.select(F.to_date("ts").alias("date"), "value", F.explode(F.array(F.lit("overall"), F.concat(F.lit("type:"), "event_type"))).alias("scope"))
    s = e.groupBy("scope", "date").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg((F.col("value") > 90).cast("double")).alias("high"))
    return s.unpivot(["scope", "date", "n"], ["mean", "high"], "metric", "v").select("scope", "metric", "date", "n", F.round("v", 6).alias("v"))


@query("""WITH d AS (SELECT ts::DATE AS date, count(*) AS n FROM events GROUP BY 1)
SELECT round(var_samp(n) / avg(n), 6) AS dispersion, count_if((n - (SELECT avg(n) FROM d)) / sqrt((SELECT avg(n) FROM d)) > 1) AS high, count(*) AS days FROM d""")
def dispersion(t: Tables):
    """Daily counts against a Poisson process of their mean."""
    d = series.daily(t.events, "ts")
    m = d.agg(F.avg("n").alias("m"))
    return d.crossJoin(F.broadcast(m)).agg(F.round(F.var_samp("n") / F.avg("n"), 6).alias("dispersion"), F.count_if((F.col("n") - F.col("m")) / F.sqrt("m") > 1).alias("high"), F.count("*").alias("days"))


@query("""WITH c AS (SELECT event_type, value, count(*) AS n FROM events GROUP BY 1, 2), e AS (SELECT event_type, value, sum(n) OVER (PARTITION BY event_type ORDER BY value) / sum(n) OVER (PARTITION BY event_type) AS f FROM c)
SELECT event_type, g::INT AS at, round(coalesce(max(f) FILTER (value <= g), 0), 6) AS share FROM e, (SELECT unnest(range(0, 101, 10)) AS g) GROUP BY 1, 2""")
def ecdf_grid(t: Tables):
    """The share of values up to each point of a grid, counted by cells of the grid."""
    cell = F.ceil(F.greatest(F.col("value"), F.lit(0.0)) / 10) * 10
    c = t.events.groupBy("event_type", cell.cast("int").alias("cell")).agg(F.count("*").alias("n"))
    grid = t.spark.range(11).select((F.col("id") * 10).cast("int").alias("at"))
    e = c.crossJoin(F.broadcast(grid)).groupBy("event_type", "at").agg(F.sum(F.when(F.col("cell") <= F.col("at"), F.col("n")).otherwise(0)).alias("k"), F.sum("n").alias("all"))
    return e.select("event_type", "at", F.round(F.col("k") / F.col("all"), 6).alias("share"))


@query("""WITH k AS (SELECT user_id, count(DISTINCT event_type) AS k, count(*) AS n FROM events GROUP BY 1)
SELECT k, count(*) AS observed, round(sum(5 * (1 - pow(0.8, n))) / count(*), 6) AS expected FROM k GROUP BY 1""")
def observed_against_model(t: Tables):
    k = t.events.groupBy("user_id").agg(F.count_distinct("event_type").alias("k"), F.count("*").alias("n"))
    return k.groupBy("k").agg(F.count("*").alias("observed"), F.round(F.avg(5 * (1 - F.pow(F.lit(0.8), "n"))), 6).alias("expected"))
