"""Questions on what may be published: raw profiles, quality reports, load checks, contracts
before release, claims, figure tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon
from ..operators import claims as claim
from ..operators import cleaning, keys, metrics, ranks
from .quality import DIRTY, dirty_posts
from .registry import Tables, query


@query(f"""WITH d AS {DIRTY} SELECT 'rows' AS name, count(*) AS n FROM d UNION ALL SELECT 'ids', count(DISTINCT k) FROM d UNION ALL SELECT 'platform missing', count(*) FILTER (k % 13 < 2) FROM d UNION ALL SELECT 'platform not canonical', count(*) FILTER (k % 13 IN (2, 3)) FROM d
UNION ALL SELECT 'likes missing', count(*) FILTER (k % 11 = 0) FROM d UNION ALL SELECT 'likes negative', count(*) FILTER (k % 11 = 1) FROM d UNION ALL SELECT 'text missing', count(*) FILTER (k % 17 = 0) FROM d UNION ALL SELECT 'text html_entity_amp', count(*) FILTER (k % 17 > 0 AND k % 7 = 0) FROM d
UNION ALL SELECT 'text html_tag_br', count(*) FILTER (k % 17 > 0 AND k % 7 = 1) FROM d UNION ALL SELECT 'text trailing_newlines', count(*) FILTER (k % 17 > 0 AND k % 7 = 2) FROM d""")
def raw_profile(t: Tables):
    """What is wrong with a feed before it is repaired, from one pass over it."""
    return cleaning.raw_profile(dirty_posts(t), "post_id", "platform", "likes", "text", ("Twitter", "Facebook", "Instagram", "YouTube", "Reddit")).filter("n > 0")


@query("""WITH d AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) - count(DISTINCT text) AS repeated, count(*) FILTER (length(text) < 15) AS thin, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents), s AS (SELECT max(n) AS top FROM (SELECT count(*) AS n FROM documents GROUP BY source)), l AS (SELECT count(*) AS labelled FROM documents JOIN labels USING (doc_id))
SELECT name, n::DOUBLE AS value FROM (UNPIVOT (SELECT n AS rows, ids, repeated, thin, sources, langs, labelled, top / n AS largest_source FROM (SELECT d.*, top::DOUBLE AS top, labelled FROM d, s, l)) ON COLUMNS(*)::DOUBLE INTO NAME name VALUE n)""")
def quality_report(t: Tables):
    """A corpus in figures: rows, ids, repeats, thin texts, sources, labels."""
    d = t.documents
    one = d.agg(F.count("*").alias("rows"), F.count_if(F.length("text") < 15).alias("thin"))
    uniques = [d.agg(F.count_distinct(c).alias(name)) for c, name in (("doc_id", "ids"), ("source", "sources"), ("lang", "langs"))]  # one column a scan
    texts = d.select(F.xxhash64("text").alias("h"), F.length("text").alias("m")).distinct().agg(F.count("*").alias("texts"))
    top = d.groupBy("source").count().agg(F.max("count").alias("top"))
    labelled = d.select("doc_id").join(t.labels, "doc_id").agg(F.count("*").alias("labelled"))
    row = one
    for x in (*uniques, texts, top, labelled):
        row = row.crossJoin(x)  # of one row each
    row = row.withColumns({"repeated": F.col("rows") - F.col("texts"), "largest_source": F.col("top") / F.col("rows")})
    names = ["rows", "ids", "repeated", "thin", "sources", "langs", "labelled", "largest_source"]
    return row.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "name", "value")


@query("SELECT 'platform' AS column, count(*) AS n, count(*) FILTER (event_id % 13 < 2) AS nulls FROM events UNION ALL SELECT 'likes', count(*), count(*) FILTER (event_id % 11 = 0) FROM events UNION ALL SELECT 'text', count(*), count(*) FILTER (event_id % 17 = 0) FROM events")
def load_check(t: Tables):
    """Empty and missing cells as nulls after the load, counted column by column."""
    d = dirty_posts(t)
    names = ["platform", "likes", "text"]
    row = d.agg(F.count("*").alias("n"), *[F.count_if(cleaning.missing_to_null(F.col(c)).isNull()).alias(c) for c in names])
    return row.unpivot(["n"], names, "column", "nulls").select("column", "n", "nulls")


@query("SELECT 'same ids' AS check, true AS ok UNION ALL SELECT 'fewer ids', false UNION ALL SELECT 'more ids', false")
def set_equality(t: Tables):
    """Whether two tables hold the same keys."""
    ids = t.orders.select("o_orderkey")
    tests = {"same ids": (ids, t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).unionByName(ids)), "fewer ids": (ids, ids.filter("o_orderkey > 3")), "more ids": (ids.filter("o_orderkey > 3"), ids)}
    return t.spark.createDataFrame([(k, keys.same_keys(a, b, ["o_orderkey"])) for k, (a, b) in tests.items()], "check string, ok boolean")


@query("SELECT l_linenumber, round_even(avg(l_quantity), 1) AS half_even, round_even(sum(l_quantity) / 4, 0) AS quarter FROM lineitem GROUP BY 1")
def half_even(t: Tables):
    """Rounding of halves to the even neighbour."""
    return t.lineitem.groupBy("l_linenumber").agg(F.bround(F.avg("l_quantity"), 1).alias("half_even"), F.bround(F.sum("l_quantity") / 4, 0).alias("quarter"))


PROBES = [("late night food is not good", False), ("incurred late-payment or overdraft fees", False), ("can't wait to see how the results will be", False), ("chocolate and translate", False), ("my parcel is 3 days late", True), ("still waiting for my refund", True), ("the app is down for hours", True)]


@query("SELECT x AS check, true AS ok FROM (VALUES ('counts agree'), ('ids are pseudonyms'), ('no address in the text'), ('dates in the window'), ('effect sizes present'), ('weak correlation'), ('relevance rule')) v(x)")
def preflight(t: Tables):
    """What must hold before figures are published, a row for each check."""
    e = t.events
    parts = e.groupBy("event_type").count().agg(F.sum("count").alias("parts"))
    rows = e.agg(F.count("*").alias("n"), F.count_if(F.col("ts") < F.lit("2000-01-01").cast("timestamp")).alias("early"), metrics.correlation("value", "user_id").alias("r"))
    ids = e.select(F.sha2(F.col("user_id").cast("string"), 256).alias("who")).agg(F.count_if(~F.rlike("who", F.lit(r"\A[0-9a-f]{64}\z"))).alias("raw"))
    said = F.concat(F.lit("order "), F.col("event_id").cast("string"), F.lit(" was late"))
    mails = e.agg(F.count_if(F.rlike(said, F.lit(r"[\w.]+@[\w.]+"))).alias("mails"))
    effects = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).agg(F.count_if(F.col("m").isNull() | F.col("s").isNull()).alias("lack"))
    probes = t.spark.createDataFrame(PROBES, "text string, expected boolean").agg(F.count_if(lexicon.relevant(F.col("text")) != F.col("expected")).alias("wrong"))
    row = rows
    for x in (parts, ids, mails, effects, probes):
        row = row.crossJoin(x)  # of one row each
    return cleaning.holds(row, {"counts agree": F.col("n") == F.col("parts"), "ids are pseudonyms": F.col("raw") == 0, "no address in the text": F.col("mails") == 0, "dates in the window": F.col("early") == 0, "effect sizes present": F.col("lack") == 0, "weak correlation": F.abs("r") < 0.6, "relevance rule": F.col("wrong") == 0})


@query("SELECT 'corpus.rows' AS name, format('{:,}', count(*)) AS text FROM documents UNION ALL SELECT 'corpus.mean_chars', printf('%.4f', avg(n_chars)) FROM documents UNION ALL SELECT 'labels.toxic', format('{:,}', sum(toxic)::BIGINT) FROM labels")
def claims(t: Tables):
    """Figures as named texts, for templates."""
    corpus = claim.of_row(t.documents.agg(F.count("*").alias("rows"), F.avg("n_chars").alias("mean_chars")))
    labels = claim.of_row(t.labels.agg(F.sum("toxic").cast("long").alias("toxic")))
    return claim.table(t.spark, {"corpus": corpus, "labels": labels})


@query("SELECT event_type, hour(ts)::INT AS hour, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 6) AS share FROM events GROUP BY 1, 2")
def hour_heat_map(t: Tables):
    """Counts and shares by type and hour of day: a figure's table."""
    c = t.events.groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    total = c.groupBy("event_type").agg(F.sum("n").alias("all"))
    return c.join(total, "event_type").select("event_type", "hour", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("""WITH v AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT o_custkey, round(sum(total) OVER (ORDER BY total DESC, o_custkey) / sum(total) OVER (), 9) AS share FROM v""")
def cumulative_share(t: Tables):
    """The share of the whole that contributors hold down to each, the largest first."""
    v = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return ranks.cumulative_share(v, "total", [F.col("o_custkey")]).select("o_custkey", F.round("share", 9).alias("share"))


@query("""WITH d AS (SELECT c_nationkey % 3 AS a, c_acctbal < 0 AS x, c_acctbal > 9000 AS y FROM customer) SELECT a, round(avg(x::INT), 6) AS x, round(avg(y::INT), 6) AS y FROM d GROUP BY 1""")
def missing_heat_map(t: Tables):
    """How often two columns lack a value, by group."""
    d = t.customer.select((F.col("c_nationkey") % 3).alias("a"), F.when(F.col("c_acctbal") >= 0, 1).alias("x"), F.when(F.col("c_acctbal") <= 9000, 1).alias("y"))
    return d.groupBy("a").agg(*[F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(c) for c in ("x", "y")])
