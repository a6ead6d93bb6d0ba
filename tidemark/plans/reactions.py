"""Questions on labelled reactions: relevance, kinds of delay and of reaction, what the
residual holds, entities in texts, evidence from headlines and incidents.

The tables hold no complaints, so events are given texts from PHRASES. The SQL does not
evaluate the patterns: it reads the labels written beside each phrase.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..operators import monitoring
from .registry import SQL, Tables, query

#: Text; what makes it relevant first; kind of delay; kind of reaction; rival named; airports; cities; flags.
PHRASES = [
    ("late night food is not good", None, "late_delivery", "unmarked", "", "", "", ""),
    ("incurred late-payment or overdraft fees", None, "late_delivery", "unmarked", "", "", "", ""),
    ("can't wait to see how the results will be", None, "", "unmarked", "", "", "", ""),
    ("chocolate and translate", None, "", "unmarked", "", "", "", ""),
    ("my parcel is 3 days late", "3 days late", "long_wait", "unmarked", "", "", "", ""),
    ("still waiting for my refund", "still waiting", "refund_delay", "unmarked", "", "", "", "refund_demand"),
    ("the app is down for hours", "app is down", "outage", "unmarked", "", "", "", ""),
    ("Order never arrived, worst courier ever", "never arriv", "never_arrived", "anger", "", "", "", "anger staff_blamed"),
    ("Missing items again and again, want my money back", "missing", "missing_items", "refund_demand", "", "", "", "refund_demand repeat_incident"),
    ("stuck in transit since Monday, tracking not updated", "stuck", "stuck_in_transit", "unmarked", "", "", "", ""),
    ("they cancelled my order, switching to Zeta Foods", "cancel", "cancelled", "churn_threat", "zeta foods", "", "", "churn_threat"),
    ("refund not received, I will complain to consumer court", "refund", "never_arrived", "escalation", "", "", "", "escalation"),
    ("no response from support for 2 weeks, still pending", "2 weeks, still pending", "support_delay", "unmarked", "", "", "", ""),
    ("took 45 minutes, late delivery as usual", "45 minutes, late", "long_wait", "resigned", "", "", "", ""),
    ("Always on time, great service", None, "", "unmarked", "", "", "", ""),
    ("never on time, driver was rude at JFK", "never on time", "unspecified_delay", "unmarked", "", "JFK", "", "staff_blamed"),
    ("outage in Mumbai, site down since morning", "outage", "outage", "unmarked", "", "", "Mumbai", ""),
    ("Was delayed but the issue was resolved quickly, good recovery", "delay", "late_delivery", "escalation", "", "", "", "recovery"),
    ("flight delayed at LHR and again at ORD", "delay", "late_delivery", "unmarked", "", "LHR ORD", "", ""),
    ("lovely app, delivery was quick", None, "", "unmarked", "", "", "", ""),
    ("great job guys, order is late, lol", "late", "late_delivery", "sarcasm_humour", "", "", "", ""),
    ("fyi the eta keeps changing", "eta", "unspecified_delay", "informational", "", "", "", ""),
    ("charged the amount twice and no refund, better off with acme air", "refund", "refund_delay", "unmarked", "acme air", "", "", "money_lost"),
    ("", None, "", "unmarked", "", "", "", ""),
    ("slow slow slow in New York, going back to Acme", "slow", "late_delivery", "unmarked", "acme", "", "New York", ""),
]
BRANDS = ["acme", "acme air", "zeta", "orbit"]


def _sql(rest: str) -> str:
    """Labelled reactions r, of one phrase in each event, for the given query."""
    q = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {', '.join(map(q, p))})" for i, p in enumerate(PHRASES))
    brands = "[" + ", ".join(map(q, BRANDS)) + "]"
    return f"""WITH p(i, text, cause, delay_type, reaction_type, rival, airports, cities, flags) AS (VALUES {values}),
r AS (SELECT event_id, ts, {brands}[user_id % {len(BRANDS)} + 1] AS brand, CASE WHEN event_id % 11 > 0 THEN (1 + event_id * 7 % 5)::DOUBLE END AS rating, value, p.*, cause IS NOT NULL AS relevant
FROM events JOIN p ON event_id % {len(PHRASES)} = i) {rest}"""


def reactions(t: Tables):
    """Events as reactions: event_id, ts, brand, rating (null for some), value, text."""
    of = lambda values, i: F.element_at(F.array(*[F.lit(x) for x in values]), (i + 1).cast("int"))
    k = F.col("event_id")
    rating = F.when(k % 11 > 0, (1 + k * 7 % 5).cast("double"))
    return t.events.select("event_id", "ts", of(BRANDS, F.col("user_id") % len(BRANDS)).alias("brand"), rating.alias("rating"), "value", of([p[0] for p in PHRASES], k % len(PHRASES)).alias("text"))


def labelled(t: Tables):
    """reactions with relevant, delay_type, reaction_type and rival."""
    r = reactions(t).withColumn("relevant", lexicon.relevant(F.col("text")))
    said = F.col("text")
    return r.withColumns({"delay_type": lexicon.delay_type(said, F.col("relevant"))["label"], "reaction_type": lexicon.reaction_type(said)["label"], "rival": lexicon.competitor(said)})


@query(_sql("SELECT delay_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share, round(avg(rating), 4) AS mean_rating, round(avg(value), 4) AS mean_value FROM r WHERE relevant GROUP BY 1"))
def delay_types(t: Tables):
    """Measures of the relevant reactions by kind of delay."""
    return monitoring.crossed(labelled(t).filter("relevant"), "delay_type", {"mean_rating": "rating", "mean_value": "value"})


@query(_sql("SELECT reaction_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share, round(avg(rating), 4) AS mean_rating, round(avg(value), 4) AS mean_value FROM r WHERE relevant GROUP BY 1"))
def reaction_types(t: Tables):
    return monitoring.crossed(labelled(t).filter("relevant"), "reaction_type", {"mean_rating": "rating", "mean_value": "value"})


@query(_sql("SELECT delay_type, reaction_type, count(*) AS n FROM r WHERE relevant GROUP BY 1, 2"))
def delay_by_reaction(t: Tables):
    return labelled(t).filter("relevant").groupBy("delay_type", "reaction_type").agg(F.count("*").alias("n"))


@query(_sql("""SELECT count(*) AS n, count(*) FILTER (relevant) AS selected, round(avg(relevant::INT), 4) AS share, round(avg(rating) FILTER (relevant), 4) AS mean_rating,
round(avg((coalesce(rating, 0) = 5)::INT) FILTER (relevant), 4) AS five_star_share, round(avg(rating) FILTER (NOT relevant), 4) AS baseline, round(avg(rating) FILTER (NOT relevant) - avg(rating) FILTER (relevant), 4) AS contrast FROM r"""))
def relevance_audit(t: Tables):
    """What the relevance rule selects, against ratings it does not read."""
    return monitoring.against_ratings(labelled(t), "relevant", "rating")


@query(_sql("SELECT event_id, brand, rating, delay_type, text FROM r WHERE relevant ORDER BY sha256(event_id || '|42'), event_id LIMIT 120"))
def relevance_sample(t: Tables):
    """120 selected reactions to be judged by hand: those of the smallest salted hash."""
    r = labelled(t).filter("relevant").withColumn("draw", F.sha2(F.concat(F.col("event_id").cast("string"), F.lit("|42")), 256))
    return r.orderBy("draw", "event_id").limit(120).select("event_id", "brand", "rating", "delay_type", "text")


@query(_sql("""SELECT 'trigger' AS kind, cause AS name, count(*) AS n FROM r WHERE delay_type = 'unspecified_delay' GROUP BY 2
UNION ALL SELECT 'theme', x, (SELECT count(*) FROM r WHERE delay_type = 'unspecified_delay' AND regexp_matches(text, y)) FROM
(VALUES ('mentions a refund', '(?i)\\brefund'), ('mentions support or a complaint', '(?i)support|customer (?:care|service)|complain'), ('mentions a cancellation', '(?i)\\bcancel'), ('mentions something missing', '(?i)\\bmissing\\b'), ('states a duration', '(?i)\\b\\d+\\s*(?:hour|hr|min|minute|day|week)s?\\b'), ('mentions a return', '(?i)\\breturn')) v(x, y)"""))
def residual_profile(t: Tables):
    """Of relevant reactions without a kind of delay: what made them relevant, and themes."""
    r = labelled(t).filter("delay_type = 'unspecified_delay'")
    top = r.groupBy(lexicon.relevance_trigger(F.col("text")).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(12)
    counts = r.agg(*[F.count_if(F.rlike("text", F.lit(f"(?i){p}"))).alias(k) for k, p in lexicon.THEMES.items()])
    themes = counts.unpivot([], list(lexicon.THEMES), "name", "n")
    return top.select(F.lit("trigger").alias("kind"), "name", "n").unionByName(themes.select(F.lit("theme").alias("kind"), "name", "n"))


@query(_sql("""SELECT 'rival' AS kind, (SELECT min(b) FROM (SELECT unnest(['acme', 'acme air', 'orbit', 'zeta']) AS b) WHERE contains(rival, b)) AS name, count(*) AS n FROM r WHERE relevant AND length(rival) > 2 GROUP BY rival
HAVING name IS NOT NULL UNION ALL SELECT 'airport', x, count(*) FROM (SELECT unnest(string_split(airports, ' ')) AS x FROM r WHERE relevant AND airports <> '') GROUP BY 2
UNION ALL SELECT 'city', cities, count(*) FROM r WHERE relevant AND cities <> '' GROUP BY 2 UNION ALL SELECT 'flag', x, count(*) FROM (SELECT unnest(string_split(flags, ' ')) AS x FROM r WHERE relevant AND flags <> '') GROUP BY 2""").replace(
    "GROUP BY rival\nHAVING", "GROUP BY 2 HAVING"
))
def entity_counts(t: Tables):
    """Brands named as the alternative (the first known name, in order, that the text's
    holds), airports, cities and flags in relevant reactions."""
    r = labelled(t).filter("relevant")
    known = r.select(F.col("brand").alias("name")).distinct()
    rivals = monitoring.first_contained(r.filter(F.length("rival") > 2).select("rival"), "rival", known, "name")
    each = lambda kind, words: r.select(F.lit(kind).alias("kind"), F.explode(words).alias("name"))
    named = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    flags = F.filter(F.array(*[F.when(c, k.removeprefix("flag_")) for k, c in lexicon.reaction_flags(F.col("text")).items()]), lambda x: x.isNotNull())
    out = rivals.select(F.lit("rival").alias("kind"), "name").unionByName(each("airport", named(lexicon.AIRPORTS))).unionByName(each("city", F.transform(named(f"(?i){lexicon.CITIES}"), F.initcap))).unionByName(each("flag", flags))
    return out.groupBy("kind", "name").agg(F.count("*").alias("n"))


@query(_sql("SELECT CASE WHEN rating <= 2 THEN 'Negative' WHEN rating = 3 THEN 'Neutral' WHEN rating IS NOT NULL THEN 'Positive' END AS label, CASE WHEN rating <= 2 THEN -1 WHEN rating = 3 THEN 0 WHEN rating IS NOT NULL THEN 1 END AS sign, count(*) AS n FROM r GROUP BY ALL"))
def star_classes(t: Tables):
    label = lexicon.star_label(F.col("rating"))
    return reactions(t).groupBy(label.alias("label"), lexicon.sign(label).alias("sign")).agg(F.count("*").alias("n"))


POSTS = ["Just tried the app. Absolutely loving it! #Deal @Nike", "Comparing Apple and Google. Mixed feelings about it", "What? Returning it ASAP. So happy", "My new phone review: Worth every penny, Thrilled", "Not bad. Fed up", "Any advice on Samsung? Not worth the money. Frustrated", "plain post", "Just unboxed it. Highly recommend, but Had issues with it"]
#: Verdict, positive emotion, negative emotion, opener, brands named.
POST_LABELS = [("positive", 0, 0, "Just tried", 1), ("neutral", 0, 0, "Comparing", 2), ("negative", 1, 0, "What", 0), ("positive", 1, 0, "My new phone review", 0), ("neutral", 0, 1, None, 0), ("negative", 0, 1, "Any advice", 1), ("none", 0, 0, None, 0), ("none", 0, 0, "Just unboxed", 0)]
PRODUCT_BRANDS = ["Apple", "Google", "Samsung", "Nike"]


def _posts_sql(rest: str) -> str:
    values = ", ".join(f"({i}, '{v}', {p}, {n}, {'NULL' if o is None else repr(o)}, {b})" for i, (v, p, n, o, b) in enumerate(POST_LABELS))
    return f"WITH p(i, verdict, pos, neg, opener, named) AS (VALUES {values}), r AS (SELECT value, event_id % 9 = 8 AS missing, p.* FROM events JOIN p ON event_id % {len(POSTS)} = i) {rest}"


def posts(t: Tables):
    said = F.element_at(F.array(*[F.lit(x) for x in POSTS]), (F.col("event_id") % len(POSTS) + 1).cast("int"))
    return t.events.select("event_id", "value", F.when(F.col("event_id") % 9 != 8, said).alias("text"))


@query(_posts_sql("SELECT verdict, count(*) AS n, sum((pos = 1 AND verdict = 'negative' OR neg = 1 AND verdict = 'positive')::INT)::BIGINT AS contradictory, sum(greatest(pos, neg))::BIGINT AS emotional, sum(named)::BIGINT AS brands_named, round(avg(value), 4) AS mean_value FROM r WHERE NOT missing GROUP BY 1"))
def text_verdicts(t: Tables):
    """Posts by the verdict in their text, and how many have an emotion against it."""
    x = F.col("text")
    plus, minus = lexicon.emotions(x)
    against = (plus & lexicon.any_of(x, lexicon.NEGATIVE_VERDICTS)) | (minus & lexicon.any_of(x, lexicon.POSITIVE_VERDICTS))
    named = sum((F.contains(x, F.lit(b)).cast("int") for b in PRODUCT_BRANDS), F.lit(0))
    r = posts(t).filter(x.isNotNull()).select("value", lexicon.verdict(x).alias("verdict"), against.alias("against"), (plus | minus).alias("feels"), named.alias("named"))
    return r.groupBy("verdict").agg(F.count("*").alias("n"), F.count_if("against").alias("contradictory"), F.count_if("feels").alias("emotional"), F.sum("named").alias("brands_named"), F.round(F.avg("value"), 4).alias("mean_value"))


@query(_posts_sql("SELECT opener, count(*) AS n FROM r WHERE NOT missing AND opener IS NOT NULL GROUP BY 1"))
def openers(t: Tables):
    return posts(t).select(lexicon.opener(F.col("text")).alias("opener")).filter("opener IS NOT NULL").groupBy("opener").agg(F.count("*").alias("n"))


HEADLINES = [("acme delivery delays leave customers waiting", True), ("acme asks court to delay trial", False), ("zeta app outage hits users", True), ("zeta widens its lead", False), ("orbit drivers strike over pay, deliveries halted", True), ("traffic delays orbit parcels", False), ("acme air grounded, passengers stranded", True), ("nothing fails here but shares of the app", False)]


@query(f"""WITH h(i, says, fails) AS (VALUES {", ".join(f"({i}, '{x}', {str(y).lower()})" for i, (x, y) in enumerate(HEADLINES))}), n AS (SELECT event_id, ts::DATE AS day, ['acme', 'acme air', 'zeta', 'orbit'][user_id % 4 + 1] AS asked, says, fails FROM events JOIN h ON event_id % 8 = i WHERE value < 40),
e AS (SELECT event_id AS event, ts::DATE AS day, ['acme', 'acme air', 'zeta', 'orbit'][user_id % 4 + 1] AS brand FROM events WHERE value > 98),
m AS (SELECT e.event, regexp_matches(says, '\\b' || brand || '\\b') AS names, fails, asked = brand AS own FROM e JOIN n ON abs(date_diff('day', e.day, n.day)) <= 2)
SELECT e.event, count(names) AS headlines, count(*) FILTER (names) AS naming, count(*) FILTER (names AND fails) AS failing, count(*) FILTER (names AND fails AND own) AS own_query,
CASE WHEN count(*) FILTER (names AND fails AND own) > 0 THEN 'own query' WHEN count(*) FILTER (names AND fails) > 0 THEN 'named' ELSE 'none' END AS tier FROM e LEFT JOIN m ON m.event = e.event GROUP BY 1""")
def headline_evidence(t: Tables):
    """Headlines within two days of an event: those that name its brand, those that also
    report a failing service, and those that the brand's own query returned."""
    brand = F.element_at(F.array(*[F.lit(x) for x in BRANDS]), (F.col("user_id") % len(BRANDS) + 1).cast("int"))
    day = F.to_date("ts").alias("day")
    says = F.element_at(F.array(*[F.lit(x) for x, _ in HEADLINES]), (F.col("event_id") % len(HEADLINES) + 1).cast("int"))
    news = t.events.filter("value < 40").select(day, brand.alias("asked"), says.alias("says"))
    events = t.events.filter("value > 98").select(F.col("event_id").alias("event"), day, brand.alias("brand"))
    return monitoring.headline_evidence(events, news, lexicon.reports_failure)


@query("""WITH i AS (SELECT event_id, ts, CASE WHEN event_id % 5 > 0 THEN ts END AS started, CASE WHEN event_id % 10 > 0 THEN ts + INTERVAL 3 HOUR END AS observed, ['ORD', 'Zeta Foods', 'acme air', 'Stripe', 'LHR'][event_id % 5 + 1] AS entity, ['airline', 'platform_service', 'airline', 'payments', 'airline'][event_id % 5 + 1] AS sector, CASE WHEN event_id % 5 = 3 THEN 'direct' END AS tier FROM events WHERE value < 2),
l AS (SELECT event_id AS k, coalesce(started, observed) AS started, entity, sector, tier FROM i WHERE coalesce(started, observed) IS NOT NULL),
e AS (SELECT event_id AS event, ts, ['acme', 'acme air', 'zeta', 'doordash'][user_id % 4 + 1] AS brand, ['ecommerce', 'airline', 'food_delivery', 'food_delivery'][user_id % 4 + 1] AS domain FROM events WHERE value > 98),
j AS (SELECT e.event, l.k, l.started, entity, regexp_matches(lower(entity), '\\b' || brand || '\\b') AND length(brand) > 3 AS by_name, (domain = 'airline' AND sector = 'airline') AS by_sector, coalesce(tier = 'direct', false) AND domain <> 'airline' AS by_chain FROM e JOIN l ON l.started BETWEEN e.ts - INTERVAL 2 DAY AND e.ts + INTERVAL 2 DAY)
SELECT event, k AS incident, entity, CASE WHEN by_name THEN 'entity' WHEN by_sector THEN 'sector' ELSE 'supply_chain_tier' END AS matched_on, by_name OR by_sector AS corroborates FROM j WHERE by_name OR by_sector OR by_chain QUALIFY row_number() OVER (PARTITION BY event ORDER BY (NOT (by_name OR by_sector))::INT, k) <= 8""")
def incident_evidence(t: Tables):
    """Incidents within two days of an event that bear on its brand by name (as a word, so
    that ORD is no part of doordash), by sector, or as a vendor's; at most eight, those that
    corroborate first."""
    of = lambda i, *values: F.element_at(F.array(*[F.lit(x) for x in values]), (i + 1).cast("int"))
    k = F.col("event_id")
    raw = t.events.filter("value < 2").select(k.alias("incident"), F.when(k % 5 > 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise("n/a").alias("started_utc"), F.when(k % 10 > 0, F.date_format(F.col("ts") + F.expr("INTERVAL 3 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("observed_utc"), of(k % 5, "ORD", "Zeta Foods", "acme air", "Stripe", "LHR").alias("entity"), of(k % 5, "airline", "platform_service", "airline", "payments", "airline").alias("sector"), F.when(k % 5 == 3, "direct").alias("tier"))
    events = t.events.filter("value > 98").select(k.alias("event"), "ts", of(F.col("user_id") % 4, "acme", "acme air", "zeta", "doordash").alias("brand"), of(F.col("user_id") % 4, "ecommerce", "airline", "food_delivery", "food_delivery").alias("domain"))
    return monitoring.incident_evidence(events, monitoring.incidents(raw), lexicon.SECTORS, lexicon.CHAIN_DOMAINS, "incident")


@query("""WITH a AS (SELECT event_type AS hint, ts::DATE AS date, count(*) AS views FROM events GROUP BY 1, 2), e AS (SELECT DISTINCT event_type AS brand, ts::DATE AS day FROM events WHERE value > 99.5),
j AS (SELECT brand, day, views, abs(date_diff('day', day, date)) <= 2 AS near FROM e JOIN a ON contains(lower(hint), lower(string_split(brand, ' ')[1])))
SELECT brand, day, round(avg(views) FILTER (near), 1) AS here, round(median(views) FILTER (NOT near), 1) AS usual, round(avg(views) FILTER (near) / greatest(median(views) FILTER (NOT near), 1), 2) AS ratio, avg(views) FILTER (near) / greatest(median(views) FILTER (NOT near), 1) >= 1.25 OR avg(views) FILTER (near) / greatest(median(views) FILTER (NOT near), 1) <= 0.8 AS corroborates FROM j GROUP BY 1, 2 HAVING count(*) FILTER (NOT near) >= 5 AND count(*) FILTER (near) > 0""")
def attention_evidence(t: Tables):
    """Attention within two days of an event against its usual level, for hints that hold the brand's first word."""
    views = t.events.groupBy(F.col("event_type").alias("hint"), F.to_date("ts").alias("date")).agg(F.count("*").alias("views"))
    events = t.events.filter("value > 99.5").select(F.col("event_type").alias("brand"), F.to_date("ts").alias("day")).distinct()
    return monitoring.attention_evidence(events, views)


@query(_sql("""SELECT brand, count(*) AS n, round(avg((event_id % 3 = 0)::INT), 4) AS reply_rate, round(avg(rating), 4) AS mean_rating, round(avg(rating) FILTER (event_id % 3 = 0) - avg(rating) FILTER (event_id % 3 > 0), 6) AS difference,
round((avg(rating) FILTER (event_id % 3 = 0) - avg(rating) FILTER (event_id % 3 > 0)) / sqrt(var_samp(rating) FILTER (event_id % 3 = 0) / count(rating) FILTER (event_id % 3 = 0) + var_samp(rating) FILTER (event_id % 3 > 0) / count(rating) FILTER (event_id % 3 > 0)), 6) AS t FROM r WHERE relevant GROUP BY 1 HAVING count(*) >= 100"""))
def reply_welch(t: Tables):
    """Reply rate by brand, and whether replies go with other ratings."""
    return monitoring.replies(labelled(t).filter("relevant").withColumn("replied", F.col("event_id") % 3 == 0), "brand", "replied", "rating", 100)


@query(_sql("""SELECT round(corr(rh, rr), 6) AS rho, count(*) AS n FROM (SELECT avg(i) OVER (PARTITION BY h) AS rh, avg(j) OVER (PARTITION BY rating) AS rr FROM (SELECT h, rating, row_number() OVER (ORDER BY h) AS i, row_number() OVER (ORDER BY rating) AS j
FROM (SELECT CASE i WHEN 4 THEN 72.0 WHEN 12 THEN 336.0 WHEN 13 THEN 0.75 END AS h, rating FROM r WHERE relevant) WHERE h < 1440 AND rating IS NOT NULL))"""))
def severity_against_stars(t: Tables):
    """Rank correlation of the stated delay, below 60 days, with the rating."""
    r = labelled(t).filter("relevant").select(text.longest_hours(F.col("text")).alias("h"), "rating").filter("h < 1440 AND rating IS NOT NULL")
    from ..operators import metrics

    return metrics.rank_correlation(r.withColumn("h", F.log1p("h")), "h", "rating").select(F.round("rho", 6).alias("rho"), "n")


@query(f"""WITH h AS ({SQL["headline_evidence"]}), i AS ({SQL["incident_evidence"]}), a AS ({SQL["attention_evidence"]}), ic AS (SELECT event, count(*) FILTER (corroborates) AS corroborating FROM i GROUP BY 1),
v AS (SELECT e.event_id AS event, coalesce(corroborating, 0) AS incidents, tier, coalesce(a.corroborates, false) AS attention, (coalesce(corroborating, 0) > 0)::INT + (tier <> 'none')::INT + coalesce(a.corroborates, false)::INT AS strength
FROM events e JOIN h ON h.event = e.event_id LEFT JOIN ic ON ic.event = e.event_id LEFT JOIN a ON a.brand = e.event_type AND a.day = e.ts::DATE AND e.value > 99.5)
SELECT strength, tier, count(*) AS n, sum(incidents)::BIGINT AS incidents, ['internal only', 'weak', 'two sources', 'three sources'][strength + 1] AS verdict FROM v GROUP BY 1, 2""")
def event_verdicts(t: Tables):
    """Events by how many independent sources bear them out: incidents, headlines, attention."""
    events = t.events.filter("value > 98").select(F.col("event_id").alias("event"), F.when(F.col("value") > 99.5, F.col("event_type")).alias("brand"), F.to_date("ts").alias("day"))
    return monitoring.verdicts(events, headline_evidence(t), incident_evidence(t), attention_evidence(t))
