"""The least items of time spans, against all pairs; and no row for each pair."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from tidemark.functions import lexicon
from tidemark.operators import keys, monitoring


def test_equals_all_pairs(spark):
    r = random.Random(2)
    points = [(r.choice("ab"), r.randint(0, 40), r.randint(0, 60)) for _ in range(150)]
    spans = [(i, r.choice("abc"), lo, lo + r.randint(-1, 25)) for i in range(60) for lo in [r.randint(-5, 45)]]
    got: dict[int, list[int]] = {}
    p, s = spark.createDataFrame(points, "g string, at long, item long"), spark.createDataFrame(spans, "s long, g string, lo long, hi long")
    for x in keys.first_within(p, s, ["g"], "at", "lo", "hi", "s", "item", 4).collect():
        got.setdefault(x.s, []).append(x.item)
    want = {i: sorted({x for h, at, x in points if h == g and lo <= at <= hi})[:4] for i, g, lo, hi in spans}
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in want.items() if v}
    assert keys.first_within(p.limit(0), s, ["g"], "at", "lo", "hi", "s", "item", 4).count() == 0


def test_evidence_of_a_crowd_makes_no_pairs(spark, monkeypatch):
    """Every event has all 2000 incidents near it: eight of each, and never millions of rows."""
    monkeypatch.delattr(keys, "interval_join")
    day = datetime.datetime(2024, 1, 1)
    events = spark.range(2000).select(F.col("id").alias("event"), F.lit(day).alias("ts"), F.lit("acme air").alias("brand"), F.lit("airline").alias("domain"))
    found = spark.range(2000).select(F.col("id").alias("incident"), F.lit(day).alias("started"), F.lit("LHR").alias("entity"), F.lit("airline").alias("sector"), F.lit(None).cast("string").alias("tier"))
    out = monitoring.incident_evidence(events, found, lexicon.SECTORS, lexicon.CHAIN_DOMAINS, "incident")
    got = out.groupBy("event").agg(F.sort_array(F.collect_list("incident")).alias("x")).collect()
    assert len(got) == 2000 and all(r.x == list(range(8)) for r in got)
