"""The census in the state store and the paged source: restarts, killed batches, late rows."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators.ranks import quota_sample
from tidemark.sources import paged
from tidemark.streaming import windows
from tidemark.streaming.census import Census

SCHEMA = "id long, g string, at timestamp, v double, note string"


def days(spark, first, last, step=1):
    """An hour a row, in strata of a day and a letter."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600)
    rows = spark.range(first, last, step).withColumns({"g": F.when(F.col("id") % 3 == 0, "a").otherwise("b"), "at": at, "v": F.when(F.col("id") % 7 > 0, F.col("id") * 1.0), "note": F.concat(F.lit("n"), F.col("id"))})
    return rows


def census(spark, path, **options):
    end = F.col("day").cast("timestamp") + F.expr("INTERVAL 1 DAY")
    return Census(spark, path, ["g", "day"], ["id"], ["v"], "at", end, **{"kept": ["note"], "k": 3, "salts": 2, "late": "1 hour"} | options)


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path).withColumn("day", F.to_date("at"))


def counted(c):
    got, sample = c.read()
    return {(r.g, r.day): (r.n, r.known_v, r.total_v) for r in got.collect()}, sorted((r.g, str(r.day), r.id, r.note) for r in sample.collect())


def expected(df, k=3):
    df = df.withColumn("day", F.to_date("at"))
    got = df.groupBy("g", "day").agg(F.count("*"), F.count("v"), F.coalesce(F.sum("v"), F.lit(0.0)))
    sample = quota_sample(df, ["g", "day"], ["id"], k)
    return {(r[0], r[1]): tuple(r[2:]) for r in got.collect()}, sorted((r.g, str(r.day), r.id, r.note) for r in sample.collect())


def land(df, path, parts):
    """Files that are read one a batch, oldest first."""
    for k, part in enumerate(parts):
        df.filter(part).coalesce(1).write.mode("append").parquet(path)


def test_batches_and_restarts_change_nothing(spark, tmp_path):
    rows, src = days(spark, 0, 200), str(tmp_path / "in")
    land(rows, src, ["id < 50", "id between 50 and 119"])
    c = census(spark, str(tmp_path / "c"))
    c.follow(source(spark, src)).awaitTermination()
    assert counted(c) == expected(rows.filter("id < 120"))
    land(rows, src, ["id between 120 and 125", "id > 125"])
    again = census(spark, str(tmp_path / "c"))  # as a new driver would
    run = again.follow(source(spark, src))
    run.awaitTermination()
    assert counted(again) == expected(rows)
    assert spark.read.parquet(again.closed).count() > 0  # days that the watermark has passed have left the state
    first = next(p for p in run.recentProgress if p["numInputRows"] == 6)
    assert first["stateOperators"][0]["numRowsUpdated"] <= 2 * 6 * 2  # what a batch writes: its own strata, in their parts


def test_late_rows_are_dropped_and_state_ends(spark, tmp_path):
    rows, src = days(spark, 0, 100), str(tmp_path / "in")
    land(rows, src, ["id < 60"])
    c = census(spark, str(tmp_path / "c"))
    c.follow(source(spark, src)).awaitTermination()
    land(rows, src, ["id >= 60"])
    c.follow(source(spark, src)).awaitTermination()
    late = rows.filter("id < 5").withColumn("id", F.col("id") + 1000)
    late.coalesce(1).write.mode("append").parquet(src)
    run = c.follow(source(spark, src))
    run.awaitTermination()
    assert counted(c) == expected(rows)
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in run.recentProgress) == 5


def test_without_a_watermark_any_order_will_do(spark, tmp_path):
    rows, src = days(spark, 0, 90), str(tmp_path / "in")
    land(rows, src, ["id >= 40", "id < 40"])
    c = census(spark, str(tmp_path / "c"), late=None)
    c.follow(source(spark, src)).awaitTermination()
    assert counted(c) == expected(rows)
    with pytest.raises(FileNotFoundError):
        census(spark, str(tmp_path / "none")).read()


# ---- pages


def feeds(spark):
    rows = [(f, i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i), "x\ny" if i % 5 else None) for f, n in (("a", 95), ("b", 40), ("c", 3)) for i in range(n)]
    return spark.createDataFrame(rows, "f string, id long, at timestamp, text string")


def ids(df):
    return sorted((r.feed, json.loads(r.body)["id"]) for r in df.collect())


def test_pages_to_the_edge(spark, tmp_path):
    df = feeds(spark)
    paged.land(df, "f", "at", ["id"], str(tmp_path / "p"), size=10)
    pages = paged.LandedPages(str(tmp_path / "p"))
    assert pages.feeds() == ["a", "b", "c"] and pages.head("a", "0") == paged.Head("1", "2024-01-04T13:00:00.000", 10)
    assert pages.head("c", "0").next is None and len(list(pages.rows("c", "0"))) == 3
    edge = "2024-01-02T06:00:00.000"  # the 30th hour
    rows, ends = windows.followed(paged.stream(spark, str(tmp_path / "p"), edge=edge, time="at", batch=3))
    assert ids(rows) == [(f, i) for f, n in (("a", 95), ("b", 40)) for i in range(30, n)]
    said = {x["feed"]: (x["pages"], x["stop"], x["complete"]) for x in paged.audit(ends[0])}
    assert said == {"a": (7, "reached_window_edge", True), "b": (2, "reached_window_edge", True), "c": (1, "token_exhausted", False)}
    body = {json.loads(r.body)["id"]: json.loads(r.body).get("text") for r in rows.filter("feed = 'b'").collect()}
    assert body[31] == "x\ny" and body[35] is None


def test_a_cap_of_pages(spark, tmp_path):
    paged.land(feeds(spark), "f", "at", ["id"], str(tmp_path / "p"), size=10)
    rows, ends = windows.followed(paged.stream(spark, str(tmp_path / "p"), time="at", most=4))
    assert rows.filter("feed = 'a'").count() == 40 and {x["feed"]: x["stop"] for x in paged.audit(ends[0])} == {"a": "page_cap", "b": "token_exhausted", "c": "token_exhausted"}


def test_killed_and_resumed(spark, tmp_path):
    """A batch fails after its offsets are planned; the next run reads it again, each row once."""
    paged.land(feeds(spark), "f", "at", ["id"], str(tmp_path / "p"), size=10)

    def run(broken):
        s = paged.stream(spark, str(tmp_path / "p"), time="at", batch=2)
        if broken:
            s = s.withColumn("token", F.when((F.col("feed") == "a") & (F.col("token") == "5"), F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("token")))
        return s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()

    with pytest.raises(Exception, match="killed"):
        windows.finished(run(True))
    part = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < part.count() < 138
    for _ in range(2):  # a third run finds nothing more
        windows.finished(run(False))
        assert ids(spark.read.parquet(str(tmp_path / "out"))) == sorted((f, i) for f, n in (("a", 95), ("b", 40), ("c", 3)) for i in range(n))


def test_batches_of_a_long_feed_are_few(spark, tmp_path):
    paged.land(feeds(spark), "f", "at", ["id"], str(tmp_path / "p"), size=2)
    reader = paged.PagedReader({"path": str(tmp_path / "p"), "time": "at", "batch": "1"})
    start, tokens, n = reader.initialOffset(), [], 0
    while any(not x["stop"] for x in start.values()):
        end = reader.latestOffset()
        parts = reader.partitions(start, end)
        assert parts == paged.PagedReader({"path": str(tmp_path / "p"), "time": "at"}).partitions(start, end)  # as a restarted query reads it
        tokens += [t for p in parts if p.feed == "a" for t in p.tokens]
        start, n = end, n + 1
    assert tokens == [str(i) for i in range(48)] and n == 7  # 1, 1, 2, 4, ... of 48 pages
