"""Questions on monitored reactions: unification, spikes, shifts, evidence, cases, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, metrics, monitoring, series
from .registry import Tables, query


def reactions(t: Tables):
    """A raw feed made from events: repeated ids and texts, odd times, blank brands."""
    k = F.col("event_id")
    at = F.when(k % 19 == 0, "soon").when(k % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
    said = F.concat(F.lit("order "), (k % 700).cast("string"), F.when(k % 3 == 0, " from Acme Air never came").when(k % 3 == 1, " by acme was late").otherwise(" lost"))
    return t.events.select(
        F.when(k % 2 == 0, "store").otherwise("forum").alias("source"), (k % 8000).cast("string").alias("record_native_id"), at.alias("created_utc"), F.when(k % 5 == 0, "Title").alias("title"),
        F.when(k % 23 == 0, "").otherwise(said).alias("text"), F.concat(F.lit("u"), (F.col("user_id") % 9).cast("string")).alias("author_pseudonym"), F.when(k % 4 == 0, "Zeta").otherwise("").alias("brand"),
    )


UNIFIED = """WITH r AS (SELECT event_id AS k, ts, CASE WHEN event_id % 2 = 0 THEN 'store' ELSE 'forum' END AS source, 'u' || (user_id % 9) AS author, CASE WHEN event_id % 4 = 0 THEN 'Zeta' ELSE '' END AS brand,
CASE WHEN event_id % 23 = 0 THEN CASE WHEN event_id % 5 = 0 THEN 'Title' ELSE '' END ELSE CASE WHEN event_id % 5 = 0 THEN 'Title. ' ELSE '' END || 'order ' || (event_id % 700) || CASE event_id % 3 WHEN 0 THEN ' from Acme Air never came' WHEN 1 THEN ' by acme was late' ELSE ' lost' END END AS body FROM events),
rd AS (SELECT *, substr(sha256(source || '|' || (k % 8000) || '|' || substr(body, 1, 200)), 1, 20) AS id FROM r WHERE length(body) >= 3), w AS (SELECT * FROM rd WHERE k % 19 > 0),
o AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY date_trunc('second', ts), body) = 1),
x AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY source, CASE WHEN source = 'store' THEN author ELSE '' END, regexp_replace(lower(body), '[^a-z0-9 ]', '', 'g') ORDER BY id) = 1)"""


@query(f"""{UNIFIED}
SELECT 'raw' AS step, count(*) AS n FROM r UNION ALL SELECT 'read', count(*) FROM rd UNION ALL SELECT 'in_window', count(*) FROM w UNION ALL SELECT 'once_by_id', count(*) FROM o UNION ALL SELECT 'once_by_text', count(*) FROM x UNION ALL SELECT 'unified', count(*) FROM x""")
def unify_steps(t: Tables):
    steps = monitoring.unify(reactions(t), {"acme": "Acme", "acme air": "Acme Air"}, "1990-01-01", "2090-01-01", ("store",))
    return cleaning.pipeline_counts(**steps)


@query(f"""{UNIFIED}
SELECT source, CASE WHEN brand <> '' THEN brand WHEN contains(lower(body), 'acme air') THEN 'Acme Air' WHEN contains(lower(body), 'acme') THEN 'Acme' ELSE '' END AS brand, length(body) < 15 AS thin, count(*) AS n FROM x GROUP BY ALL""")
def unified_brands(t: Tables):
    steps = monitoring.unify(reactions(t), {"acme": "Acme", "acme air": "Acme Air"}, "1990-01-01", "2090-01-01", ("store",))
    return steps["unified"].groupBy("source", "brand", "thin").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT event_type, ts::DATE AS date, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2), l AS (SELECT event_type, date, 'volume' AS kind, n::DOUBLE AS value FROM d UNION ALL SELECT event_type, date, 'endorsement', total FROM d),
m AS (SELECT event_type, kind, median(value) AS med FROM l GROUP BY 1, 2 HAVING count(*) >= 7), a AS (SELECT l.*, med, abs(value - med) AS dev FROM l JOIN m USING (event_type, kind)), k AS (SELECT event_type, kind, median(dev) AS mad FROM a GROUP BY 1, 2)
SELECT event_type, date, kind, round((value - med) / (1.4826 * mad), 4) AS z, round(value / med, 5) AS ratio FROM a JOIN k USING (event_type, kind) WHERE (value - med) / (1.4826 * mad) >= 1.8""")
def spike_kinds(t: Tables):
    d = series.daily(t.events, "ts", ["event_type"], total=F.sum("value"))
    s = monitoring.spikes(d, ["event_type"], {"volume": "n", "endorsement": "total"}, z=1.8)
    return s.select("event_type", "date", "kind", F.round("z", 4).alias("z"), F.round("ratio", 5).alias("ratio"))


@query("""WITH x AS (SELECT event_type, ts::DATE AS date, value + CASE WHEN event_type = 'click' AND ts::DATE >= (SELECT min(ts::DATE) + 14 FROM events) THEN 60 ELSE 0 END AS v FROM events),
s AS (SELECT event_type, date, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM x GROUP BY 1, 2),
w AS (SELECT event_type, date, row_number() OVER p AS f, row_number() OVER (PARTITION BY event_type ORDER BY date DESC) AS l, sum(n) OVER a AS na, sum(s) OVER a AS sa, sum(q) OVER a AS qa, sum(n) OVER b AS nb, sum(s) OVER b AS sb, sum(q) OVER b AS qb FROM s
  WINDOW p AS (PARTITION BY event_type ORDER BY date), a AS (PARTITION BY event_type ORDER BY date RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), b AS (PARTITION BY event_type ORDER BY date RANGE BETWEEN CURRENT ROW AND INTERVAL 2 DAY FOLLOWING)),
v AS (SELECT *, (qa - sa * sa / na) / (na - 1) AS va, (qb - sb * sb / nb) / (nb - 1) AS vb FROM w WHERE f > 3 AND l > 3 AND na >= 40 AND nb >= 40),
t AS (SELECT event_type, date, (sb / nb - sa / na) / sqrt(va / na + vb / nb) AS t, (sb / nb - sa / na) / sqrt((va + vb) / 2) AS d FROM v),
p AS (SELECT *, 2 * (1 - 1 / (1 + exp(-1.5976 * abs(t) - 0.070565992 * abs(t) ** 3))) AS p FROM t), r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r, count(*) OVER () AS m FROM p),
k AS (SELECT event_type, date, d, p FROM r WHERE p <= (SELECT max(p) FROM r WHERE p <= 0.05 * r / m)), g AS (SELECT *, CASE WHEN coalesce(date - lag(date) OVER (PARTITION BY event_type ORDER BY date), 3) > 2 THEN 1 ELSE 0 END AS new FROM k), i AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY date) AS island FROM g)
SELECT event_type, date, round(d, 6) AS d FROM i QUALIFY row_number() OVER (PARTITION BY event_type, island ORDER BY abs(d) DESC, p, date) = 1""")
def pooled_shift_scan(t: Tables):
    """Shifts of the mean over all types, one of them planted, pooled for the false-discovery
    rate; t is read as normal, since each side has 40 records or more."""
    first = t.events.agg(F.min(F.to_date("ts")).alias("__a"))
    up = (F.col("event_type") == "click") & (F.datediff(F.to_date("ts"), "__a") >= 14)
    planted = t.events.crossJoin(F.broadcast(first)).withColumn("value", F.col("value") + F.when(up, 60).otherwise(0))
    s = series.shift_scan(planted, "ts", "value", ["event_type"])
    p = s.withColumn("p", 2 * (1 - 1 / (1 + F.exp(-1.5976 * F.abs("t") - 0.070565992 * F.pow(F.abs("t"), F.lit(3))))))
    return monitoring.pooled_shifts(p, ["event_type"], "p", q=0.05).select("event_type", "date", F.round("d", 6).alias("d"))


@query("""WITH e AS (SELECT event_id AS event, event_type AS brand, date_diff('day', DATE '1970-01-01', ts::DATE) AS day, value / 100 AS dominance FROM events WHERE value > 98), i AS (SELECT upper(event_type) || '!' AS entity, date_diff('day', DATE '1970-01-01', ts::DATE) AS day FROM events WHERE value < 0.5),
a AS (SELECT event_type AS brand, date_diff('day', DATE '1970-01-01', ts::DATE) AS day, count(*) AS views FROM events GROUP BY 1, 2), n AS (SELECT event, count(*) AS k FROM e JOIN i ON lower(regexp_replace(entity, '[^A-Za-z0-9 ]', '', 'g')) = regexp_replace(brand, '[^a-z0-9 ]', '', 'g') AND abs(i.day - e.day) <= 2 GROUP BY 1),
u AS (SELECT brand, avg(views) AS usual FROM a GROUP BY 1), l AS (SELECT event, any_value(e.brand) AS brand, avg(views) AS here FROM e JOIN a ON e.brand = a.brand AND abs(a.day - e.day) <= 2 GROUP BY 1)
SELECT e.event, coalesce(k, 0) AS n_incidents, round(here / usual, 6) AS lift, (coalesce(k, 0) > 0)::INT + coalesce((here / usual >= 1.05)::INT, 0) + (dominance >= 0.99)::INT AS verdict FROM e LEFT JOIN n USING (event) LEFT JOIN l USING (event) LEFT JOIN u ON u.brand = e.brand""")
def evidence_verdict(t: Tables):
    day = F.unix_date(F.to_date("ts")).alias("day")
    e = t.events.filter("value > 98").select(F.col("event_id").alias("event"), F.col("event_type").alias("brand"), day, (F.col("value") / 100).alias("dominance"))
    i = t.events.filter("value < 0.5").select(F.concat(F.upper("event_type"), F.lit("!")).alias("entity"), day)
    a = t.events.groupBy(F.col("event_type").alias("brand"), day).agg(F.count("*").alias("views"))
    return monitoring.evidence(e, i, a, share=0.99, ratio=1.05).select("event", "n_incidents", F.round("lift", 6).alias("lift"), "verdict")


@query("""WITH d AS (SELECT event_type, ts::DATE AS date, count(*) AS n, avg(value) AS mean, count(*) FILTER (value < 10) AS ka, count(*) FILTER (user_id % 10 = 0) AS kb FROM events GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER w - n AS n0, sum(ka) OVER w - ka AS ka0, sum(kb) OVER w - kb AS kb0 FROM d WINDOW w AS (PARTITION BY event_type)), q AS (SELECT * FROM r WHERE n >= 25), m AS (SELECT event_type, median(mean) AS med FROM q GROUP BY 1), v AS (SELECT q.*, med, abs(mean - med) AS dev FROM q JOIN m USING (event_type)), k AS (SELECT event_type, median(dev) AS mad FROM v GROUP BY 1),
z AS (SELECT *, (mean - med) / (1.4826 * mad) AS z, (ka / n - ka0 / n0) / sqrt(ka0 / n0 * (1 - ka0 / n0) / n) AS za, (kb / n - kb0 / n0) / sqrt(kb0 / n0 * (1 - kb0 / n0) / n) AS zb FROM v JOIN k USING (event_type))
SELECT event_type, date, n, round(z, 4) AS z, round(za, 4) AS z_outage, round(zb, 4) AS z_delay, CASE WHEN za < 2 AND zb < 2 THEN 'no_signature' WHEN za >= 3 THEN 'outage' WHEN zb >= 3 THEN 'delay' ELSE 'mixed' END AS signature FROM z WHERE z <= -1.5""")
def case_signatures(t: Tables):
    c = monitoring.cases(t.events, "event_type", "ts", "value", {"outage": F.col("value") < 10, "delay": F.col("user_id") % 10 == 0})
    return c.select("event_type", "date", "n", *[F.round(x, 4).alias(x) for x in ("z", "z_outage", "z_delay")], "signature")


CAMPAIGNS = {"spring": ("er", (3, 4, 5)), "winter": ("in", (12, 1, 2))}


@query("""WITH p AS (SELECT p_name, month(o_orderdate) AS m FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey), t AS (SELECT count(*) AS n, count(*) FILTER (m IN (3, 4, 5)) AS s, count(*) FILTER (m IN (12, 1, 2)) AS w FROM p)
SELECT 'spring' AS campaign, count(*) AS n, count(*) FILTER (m IN (3, 4, 5)) AS in_season, round(count(*) * (SELECT s / n FROM t), 4) AS expected FROM p WHERE contains(p_name, 'er')
UNION ALL SELECT 'winter', count(*), count(*) FILTER (m IN (12, 1, 2)), round(count(*) * (SELECT w / n FROM t), 4) FROM p WHERE contains(p_name, 'in')""")
def campaign_seasons(t: Tables):
    """Mentions in season against what the season's volume would give."""
    month = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("p_name", F.month("o_orderdate").alias("m")).agg(F.count("*").alias("k"))
    rules = F.array(*[F.struct(F.lit(c).alias("campaign"), F.lit(w).alias("w"), F.array(*[F.lit(x) for x in ms]).alias("season")) for c, (w, ms) in CAMPAIGNS.items()])
    each = month.select("*", F.explode(rules).alias("r")).select("p_name", "m", "k", "r.*").withColumn("in", F.array_contains("season", F.col("m")))
    hit = F.contains("p_name", F.col("w"))
    s = each.groupBy("campaign").agg(F.sum(F.when(hit, F.col("k")).otherwise(0)).alias("n"), F.sum(F.when(hit & F.col("in"), F.col("k")).otherwise(0)).alias("in_season"), F.sum(F.when(F.col("in"), F.col("k")).otherwise(0)).alias("s"), F.sum("k").alias("all"))
    return s.select("campaign", "n", "in_season", F.round(F.col("n") * F.col("s") / F.col("all"), 4).alias("expected"))


@query("""WITH s AS (SELECT lang, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY 1), m AS (SELECT 'src' || i AS source, unnest(CASE WHEN i % 2 = 0 THEN ['en', 'fr'] ELSE ['de'] END) AS lang FROM (SELECT unnest(range(20)) AS i))
SELECT round(avg((EXISTS (SELECT 1 FROM m WHERE m.source = d.source AND m.lang = d.lang))::INT), 6) AS observed, round(avg((SELECT sum(share) FROM m JOIN s USING (lang) WHERE m.source = d.source)), 6) AS expected FROM documents d""")
def match_against_chance(t: Tables):
    """How often a document's language is one of its source's, against independence."""
    m = t.spark.range(20).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"), F.explode(F.when(F.col("id") % 2 == 0, F.array(F.lit("en"), F.lit("fr"))).otherwise(F.array(F.lit("de")))).alias("lang"))
    c = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("all"))
    share = c.groupBy("lang").agg(F.sum("n").alias("k")).crossJoin(F.broadcast(total)).select("lang", (F.col("k") / F.col("all")).alias("share"))
    chance = m.join(share, "lang").groupBy("source").agg(F.sum("share").alias("chance"))
    hits = c.join(m.withColumn("hit", F.lit(1)), ["source", "lang"], "left").join(chance, "source", "left")
    return hits.agg(F.round(F.sum(F.coalesce("hit", F.lit(0)) * F.col("n")) / F.sum("n"), 6).alias("observed"), F.round(F.sum(F.col("chance") * F.col("n")) / F.sum(F.when(F.col("chance").isNotNull(), F.col("n"))), 6).alias("expected"))


@query("""SELECT CASE WHEN value < 1 THEN '<1h' WHEN value < 6 THEN '1-6h' WHEN value < 24 THEN '6-24h' WHEN value < 72 THEN '1-3d' ELSE '3d+' END AS band, count(*) AS n, round(avg(user_id % 5 + 1), 6) AS stars FROM events GROUP BY 1 HAVING count(*) >= 50""")
def severity_buckets(t: Tables):
    v = F.col("value")
    band = F.when(v < 1, "<1h").when(v < 6, "1-6h").when(v < 24, "6-24h").when(v < 72, "1-3d").otherwise("3d+")
    return t.events.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("user_id") % 5 + 1), 6).alias("stars")).filter("n >= 50")


@query("SELECT event_type, count(*) AS n, round(avg((event_id % 3 = 0)::INT) * 100, 1) AS reply_rate, round(avg(value) FILTER (event_id % 3 = 0) - avg(value) FILTER (event_id % 3 > 0), 6) AS gap FROM events GROUP BY 1 HAVING count(*) >= 100")
def reply_behaviour(t: Tables):
    r = F.col("event_id") % 3 == 0
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(r.cast("double")) * 100, 1).alias("reply_rate"), F.round(F.avg(F.when(r, F.col("value"))) - F.avg(F.when(~r, F.col("value"))), 6).alias("gap")).filter("n >= 100")


@query("""WITH d AS (SELECT ts::DATE AS date, avg(value) AS every, avg(value) FILTER (user_id % 10 < 7) AS sure, avg((user_id % 10 < 7)::INT) AS covered FROM events GROUP BY 1)
SELECT round(avg(covered), 6) AS coverage, round(corr(every, sure), 6) AS r, round(stddev_samp(every), 6) AS sd_every, round(stddev_samp(sure), 6) AS sd_sure FROM d""")
def gated_daily(t: Tables):
    """The daily mean of confident records alone beside that of all."""
    sure = F.col("user_id") % 10 < 7
    d = t.events.groupBy(F.to_date("ts").alias("date")).agg(F.avg("value").alias("every"), F.avg(F.when(sure, F.col("value"))).alias("sure"), F.avg(sure.cast("double")).alias("covered"))
    return d.agg(F.round(F.avg("covered"), 6).alias("coverage"), F.round(metrics.correlation("every", "sure"), 6).alias("r"), F.round(F.stddev_samp("every"), 6).alias("sd_every"), F.round(F.stddev_samp("sure"), 6).alias("sd_sure"))


@query("""SELECT CASE WHEN n_chars < 200 THEN 0 WHEN n_chars < 600 THEN 1 WHEN n_chars < 1500 THEN 2 ELSE 3 END AS bucket, count(*) AS n, round(avg((quality <> (n_chars > 700)::INT)::INT), 6) AS error_rate, round(avg(contains(text, '!')::INT), 6) AS loud FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) >= 20""")
def error_profile(t: Tables):
    c = F.col("n_chars")
    bucket = F.when(c < 200, 0).when(c < 600, 1).when(c < 1500, 2).otherwise(3)
    j = t.documents.join(t.labels, "doc_id")
    return j.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") != (c > 700).cast("int")).cast("double")), 6).alias("error_rate"), F.round(F.avg(F.contains("text", F.lit("!")).cast("double")), 6).alias("loud")).filter("n >= 20")


@query("""WITH p AS (SELECT doc_id, sum(CASE WHEN quality = 1 THEN 1 ELSE -1 END) OVER () AS s, quality, toxic FROM labels)
SELECT quality, toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, CASE WHEN quality = 0 AND toxic = 1 THEN 'contradiction' ELSE 'plain' END AS verdict FROM p GROUP BY 1, 2""")
def label_verdicts(t: Tables):
    c = t.labels.groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("all"))
    return c.crossJoin(F.broadcast(total)).select("quality", "toxic", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"), F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "contradiction").otherwise("plain").alias("verdict"))
