"""Questions on data quality: repairs, change logs, contracts, dictionaries, round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cleaning, keys
from ..session import shared_dir
from ..sources import files
from .registry import Tables, query

PLATFORMS = ("Twitter", "Facebook", "Instagram", "YouTube", "Reddit")


def dirty_posts(t: Tables):
    """A corrupted feed made from events: mixed case, missing tokens, flipped signs, suffixes."""
    k = F.col("event_id")
    pick = F.element_at(F.array(*[F.lit(p) for p in PLATFORMS]), (k % 5 + 1).cast("int"))
    platform = F.when(k % 13 == 0, "").when(k % 13 == 1, "NULL").when(k % 13 == 2, F.upper(pick)).when(k % 13 == 3, F.concat(F.lit(" "), F.lower(pick))).otherwise(pick)
    likes = F.when(k % 11 == 0, "NULL").when(k % 11 == 1, F.concat(F.lit("-"), (k % 300 + 1).cast("string"), F.lit(".0"))).otherwise((k % 300).cast("string"))
    text = F.when(k % 17 == 0, "N/A").otherwise(F.concat(F.lit("post  no "), k.cast("string"), F.when(k % 7 == 0, "&amp;").when(k % 7 == 1, "<br>").when(k % 7 == 2, "\n\n").otherwise("")))
    return t.events.select(F.format_string("p%010d", k).alias("post_id"), platform.alias("platform"), likes.alias("likes"), text.alias("text"))


DIRTY = """(SELECT event_id AS k, ['Twitter', 'Facebook', 'Instagram', 'YouTube', 'Reddit'][event_id % 5 + 1] AS pick FROM events)"""


@query(f"""WITH d AS (SELECT k, CASE WHEN k % 13 < 2 THEN NULL ELSE pick END AS platform, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 11 = 1 THEN k % 300 + 1 ELSE k % 300 END AS likes, CASE WHEN k % 17 = 0 THEN NULL ELSE 'post no ' || k END AS text FROM {DIRTY})
SELECT 'p' || lpad(k::VARCHAR, 10, '0') AS post_id, platform, likes::BIGINT AS likes, text FROM d""")
def cleaned_posts(t: Tables):
    clean, _ = cleaning.post_cleaner(PLATFORMS).run(dirty_posts(t))
    return clean.select("post_id", "platform", F.col("likes").cast("bigint").alias("likes"), "text")


@query(f"""WITH d AS {DIRTY}
SELECT 'platform' AS column, 'missing_token_to_null' AS rule, count(*) AS n FROM d WHERE k % 13 < 2
UNION ALL SELECT 'platform', 'canonical_case', count(*) FROM d WHERE k % 13 IN (2, 3)
UNION ALL SELECT 'likes', 'missing_token_to_null', count(*) FROM d WHERE k % 11 = 0
UNION ALL SELECT 'likes', 'sign_flip_abs', count(*) FROM d WHERE k % 11 = 1
UNION ALL SELECT 'text', 'missing_token_to_null', count(*) FROM d WHERE k % 17 = 0
UNION ALL SELECT 'text', 'strip_suffix_artifact', count(*) FROM d WHERE k % 17 > 0 AND k % 7 < 3
UNION ALL SELECT 'text', 'collapse_whitespace', count(*) FROM d WHERE k % 17 > 0""")
def change_log(t: Tables):
    _, log = cleaning.post_cleaner(PLATFORMS).run(dirty_posts(t))
    return log.groupBy("column", "rule").agg(F.count("*").alias("n"))


@query("""SELECT 'price is positive' AS check, count(*) FILTER (NOT coalesce(o_totalprice > 0, false)) AS violations, count(*) FILTER (NOT coalesce(o_totalprice > 0, false)) = 0 AS ok FROM orders
UNION ALL SELECT 'status is F', count(*) FILTER (o_orderstatus <> 'F'), count(*) FILTER (o_orderstatus <> 'F') = 0 FROM orders
UNION ALL SELECT 'date in window', count(*) FILTER (o_orderdate < '1992-01-01'), count(*) FILTER (o_orderdate < '1992-01-01') = 0 FROM orders""")
def contracts(t: Tables):
    return cleaning.contracts(t.orders, {"price is positive": F.col("o_totalprice") > 0, "status is F": F.col("o_orderstatus") == "F", "date in window": F.col("o_orderdate") >= F.lit("1992-01-01").cast("timestamp")})


@query("""SELECT 'doc_id' AS column, count(*) AS n, count(doc_id) AS known, count(DISTINCT doc_id) AS distinct, min(doc_id::VARCHAR) AS example FROM documents UNION ALL SELECT 'lang' AS column, count(*) AS n, count(lang) AS known, count(DISTINCT lang) AS distinct, min(lang::VARCHAR) AS example FROM documents UNION ALL SELECT 'source' AS column, count(*) AS n, count(source) AS known, count(DISTINCT source) AS distinct, min(source::VARCHAR) AS example FROM documents UNION ALL SELECT 'n_chars' AS column, count(*) AS n, count(n_chars) AS known, count(DISTINCT n_chars) AS distinct, min(n_chars::VARCHAR) AS example FROM documents""")
def data_dictionary(t: Tables):
    return cleaning.profile(t.documents.drop("text")).select("column", "n", "known", "distinct", "example")


@query("SELECT 'customers with orders' AS name, true AS same UNION ALL SELECT 'halved', false")
def round_trip(t: Tables):
    """Customers with their orders as nested JSON, read back, against both tables."""
    parent, child = t.customer, t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderstatus").join(t.customer.select("c_custkey"), "c_custkey", "left_semi")
    path = f"{shared_dir(t.spark)}/round-trip-{uuid.uuid4().hex}"
    same = files.nested_round_trip(parent, child, "c_custkey", "orders", path)
    half = keys.same_rows(child, child.filter("o_orderkey % 2 = 0"))
    return t.spark.createDataFrame([("customers with orders", same), ("halved", half)], "name string, same boolean")


@query("SELECT (SELECT count(*) FROM orders) - (SELECT count(*) FROM (SELECT count(*) FROM lineitem GROUP BY l_orderkey)) AS without_lines, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice < c_acctbal) AS cheap")
def integrity(t: Tables):
    a = keys.orphans(t.orders, t.lineitem, "o_orderkey", "l_orderkey").agg(F.count("*").alias("without_lines"))
    b = t.orders.join(t.customer, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") < F.col("c_acctbal"))).agg(F.count("*").alias("cheap"))
    return a.crossJoin(b)  # of one row each


@query("""WITH a AS (SELECT count(*) AS n FROM events), b AS (SELECT count(*) AS n FROM events WHERE value > 20), c AS (SELECT count(DISTINCT user_id) AS n FROM events WHERE value > 20)
SELECT 'raw' AS step, n FROM a UNION ALL SELECT 'kept', n FROM b UNION ALL SELECT 'users', n FROM c""")
def step_counts(t: Tables):
    kept = t.events.filter("value > 20")
    return cleaning.pipeline_counts(raw=t.events, kept=kept, users=kept.select("user_id").distinct())
