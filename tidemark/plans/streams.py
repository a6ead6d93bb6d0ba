"""Questions on streams: windows by event time, sessions, waves of arrivals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import paged
from ..streaming import windows
from ..streaming.census import Census
from ..streaming.ledger import Ledger
from .registry import Tables, query

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(t: Tables):
    return windows.events_stream(t.spark, t.folder, EVENTS)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(t: Tables):
    w = windows.drained(windows.tumbling(_stream(t), "ts", "1 day", ["event_type"]))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT start, sum(n)::BIGINT AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start, 1 AS n FROM events) GROUP BY 1")
def stream_sliding(t: Tables):
    w = windows.drained(windows.sliding(_stream(t), "ts", "2 days", "1 day"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(t: Tables):
    w = windows.drained(windows.sessions(_stream(t), "ts", "6 hours", ["user_id"]))
    return w.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_first_sights(t: Tables):
    """Each event once, however often it arrives: the stream is read twice over."""
    twice = _stream(t).unionByName(_stream(t))
    return windows.drained(windows.first_sights(twice, "ts", ["event_id"], "60 days"), "append").groupBy("event_type").agg(F.count("*").alias("n"))


def _waves(t: Tables) -> Ledger:
    ledger = Ledger(t.spark, f"{shared_dir(t.spark)}/tidemark-ledger-{uuid.uuid4().hex}", ["key"], ["event_id"])
    e = t.events.select("event_id", (F.col("event_id") % 4000).alias("key"), "ts")
    for k in range(3):
        ledger.record(e.filter(F.col("event_id") % 3 == k), k, f"2030-01-0{k + 1} 00:00:00")
    return ledger


@query("""WITH n AS (SELECT event_id % 4000 AS key, min(event_id % 3) AS wave FROM events GROUP BY 1)
SELECT w AS wave, n, coalesce(sum(n) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, first, last FROM (SELECT wave::INT AS w, count(*) AS n, min(key::VARCHAR) AS first, max(key::VARCHAR) AS last FROM n GROUP BY 1)""")
def wave_manifest(t: Tables):
    """What each of three waves added to the archive."""
    return _waves(t).manifest().select(F.col("_wave").alias("wave"), "n", F.col("before").cast("long").alias("before"), "first", "last")


@query("""WITH b AS (SELECT event_id % 3 AS wave, event_id % 4000 AS key, min(event_id) AS event_id FROM events GROUP BY 1, 2), n AS (SELECT b.*, TIMESTAMP '2030-01-01' + to_days(wave::INT) AS stamp, ts FROM b JOIN events USING (event_id) QUALIFY row_number() OVER (PARTITION BY key ORDER BY wave) = 1),
h AS (SELECT wave, (epoch(stamp)::BIGINT - epoch(date_trunc('second', ts))::BIGINT) / 3600.0::DOUBLE AS hours, ts < stamp - INTERVAL 1 DAY AS late FROM n)
SELECT wave::INT AS wave, count(*) AS n, round(list_sort(list(hours))[floor(count(*) * 0.1)::INT + 1], 6) AS p10, round(list_sort(list(hours))[floor(count(*) * 0.5)::INT + 1], 6) AS p50, round(list_sort(list(hours))[floor(count(*) * 0.9)::INT + 1], 6) AS p90, CASE WHEN wave > 0 THEN avg(late::INT) END AS late FROM h GROUP BY wave""")
def wave_ledger(t: Tables):
    """Three waves with overlapping keys, their arrival latency and share of late records."""
    s = _waves(t).summary("ts")
    return s.select(F.col("_wave").alias("wave"), "n", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")], "late")


@query("""WITH s AS (SELECT event_type, ts::DATE AS date, event_id, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY md5('42|' || event_id::VARCHAR), event_id) AS r FROM events)
SELECT event_type, date, count(*) AS n, round(sum(value), 4) AS total, count(*) FILTER (r <= 20) AS sampled, (sum(event_id) FILTER (r <= 20))::BIGINT AS ids FROM s JOIN events USING (event_id, event_type) GROUP BY 1, 2""")
def stream_census(t: Tables):
    """Counts and sums of every stratum beside a sample of at most 20 rows of each."""
    path = f"{shared_dir(t.spark)}/tidemark-census-{uuid.uuid4().hex}"
    c = Census(t.spark, path, ["event_type", "date"], ["event_id"], ["value"], "ts", F.col("date").cast("timestamp") + F.expr("INTERVAL 1 DAY"), k=20)
    c.follow(_stream(t).withColumn("date", F.to_date("ts"))).awaitTermination()
    census, sample = c.read()
    s = sample.groupBy("event_type", "date").agg(F.count("*").alias("sampled"), F.sum("event_id").alias("ids"))
    return census.join(s, ["event_type", "date"]).select("event_type", "date", "n", F.round("total_value", 4).alias("total"), "sampled", "ids")


#: The edge of the window that the paged queries go back to.
EDGE = "2024-01-08T00:00:00.000"


def _enumerated(t: Tables):
    """The events as pages of a feed for each type, newest first, and the stream of them."""
    path = f"{shared_dir(t.spark)}/tidemark-pages-{uuid.uuid4().hex}"
    paged.land(t.events.select("event_id", "event_type", "ts", "user_id", "value"), "event_type", "ts", ["event_id"], path)
    body = F.from_json("body", "event_id long, ts timestamp, user_id long, value double")
    return paged.stream(t.spark, path, edge=EDGE, time="ts", batch=16, most=1 << 62).select("feed", "token", body.alias("x")).select("feed", "token", "x.*")


@query(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('millisecond', ts) DESC, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events),
p AS (SELECT event_type, (r - 1) // 200 AS page, min(date_trunc('millisecond', ts)) AS oldest, max((n - 1) // 200) AS last FROM e GROUP BY ALL), s AS (SELECT event_type, min(page) FILTER (oldest < TIMESTAMP '{EDGE}' OR page = last) AS stop FROM p GROUP BY 1)
SELECT e.event_type AS feed, max(stop + 1)::INT AS pages, max(CASE WHEN p.page = last THEN 'token_exhausted' ELSE 'reached_window_edge' END) AS stop, count(*) FILTER (e.ts >= TIMESTAMP '{EDGE}') AS n, (sum(event_id) FILTER (e.ts >= TIMESTAMP '{EDGE}'))::BIGINT AS ids FROM e JOIN s USING (event_type) JOIN p ON p.event_type = e.event_type AND p.page = s.stop GROUP BY 1""")
def paged_enumeration(t: Tables):
    """Every feed followed from its newest page to the edge of the window: pages read, why it
    stopped, and what it gave."""
    rows, ends = windows.followed(_enumerated(t))
    said = t.spark.createDataFrame([(x["feed"], x["pages"], x["stop"]) for x in paged.audit(ends[0])], "feed string, pages int, stop string")  # a row for each feed
    return rows.groupBy("feed").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).join(F.broadcast(said), "feed", "right").select("feed", "pages", "stop", F.coalesce("n", F.lit(0)).alias("n"), "ids")


@query(f"""WITH e AS (SELECT event_type, ts::DATE AS date, event_id, user_id, value, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY md5('42|' || event_id::VARCHAR)) AS r FROM events WHERE ts >= TIMESTAMP '{EDGE}')
SELECT event_type AS feed, date, count(*) AS n, round(avg(value), 6) AS mean, count(*) FILTER (r <= 5) AS kept, (sum(user_id) FILTER (r <= 5))::BIGINT AS users FROM e GROUP BY 1, 2""")
def paged_census(t: Tables):
    """Counted while paging: every row of the window is in the census, a quota of each day is kept."""
    path = f"{shared_dir(t.spark)}/tidemark-paged-{uuid.uuid4().hex}"
    c = Census(t.spark, path, ["feed", "date"], ["event_id"], ["value"], "ts", F.col("date"), kept=["user_id"], k=5, late=None)
    run = c.follow(_enumerated(t).withColumn("date", F.to_date("ts")), processingTime="0 seconds")
    windows.finished(run)
    census, sample = c.read()
    kept = sample.groupBy("feed", "date").agg(F.count("*").alias("kept"), F.sum("user_id").alias("users"))
    return census.join(kept, ["feed", "date"]).select("feed", "date", "n", F.round(F.col("total_value") / F.col("known_value"), 6).alias("mean"), "kept", "users")
