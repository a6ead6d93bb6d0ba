"""Containment of many names in texts, against brute force and by its plan."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.operators import monitoring
from tidemark.operators.containment import contained


def rows(df):
    return sorted((r.k, r.name) for r in df.collect())


def test_equal_to_brute_force(spark):
    r = random.Random(1)
    texts = [None, "", "a", "ab\nab", "é" * 70 + "xyz", *("".join(r.choice("abcdé \n😀") for _ in range(r.randint(0, 300))) for _ in range(60))]
    names = ["", None, "a", "ab", "\n", "éé", "😀", texts[7][60:130], texts[8][:5], "never there", *("".join(r.choice("abcdé ") for _ in range(r.randint(1, 9))) for _ in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, says string").repartition(3)
    known = spark.createDataFrame([(x,) for x in names + names[3:9]], "name string")
    want = sorted((i, n) for i, x in enumerate(texts) if x is not None for n in {n for n in names if n} if n in x)
    assert len(want) > 500
    for k, most in ((4, 500_000), (4, 0), (2, 500_000), (1, 0)):
        assert rows(contained(df, "k", "says", known, "name", k, most)) == want
    assert contained(df, "k", "says", known.limit(0), "name").count() == 0
    assert contained(df.limit(0), "k", "says", known, "name").count() == 0


def test_a_hundred_thousand_names(spark):
    r = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = list({"".join(r.choice(letters) for _ in range(r.randint(6, 14))) for _ in range(100_000)})
    held = r.sample(names, 300)
    texts = [" ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(40)) + x for x in held]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, says string")
    known = spark.createDataFrame([(x,) for x in names], "name string")
    found = contained(df, "k", "says", known, "name")
    got = rows(found)
    # Every planted name; the rest is checked by a search of its own.
    sizes = {len(x) for x in names}
    all_names = set(names)
    want = sorted({(i, x[a : a + n]) for i, x in enumerate(texts) for n in sizes for a in range(len(x) - n + 1) if x[a : a + n] in all_names})
    assert got == want and {(i, x) for i, x in enumerate(held)} <= set(got)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_evidence_compares_no_rows_with_all_names(spark):
    events = spark.createDataFrame([(1, "2024-01-05 00:00:00", "acme", "airline"), (2, "2024-01-05 00:00:00", "ord", "food_delivery")], "event int, ts string, brand string, domain string").withColumn("ts", F.col("ts").cast("timestamp"))
    found = spark.createDataFrame([(1, "2024-01-06 00:00:00", "Acme Air", "rail", None), (2, "2024-01-04 00:00:00", "doordash", "x", "direct"), (3, "2024-01-04 00:00:00", None, "airline", None)], "k int, started string, entity string, sector string, tier string").withColumn("started", F.col("started").cast("timestamp"))
    out = monitoring.incident_evidence(events, found, {"airline": ["airline"]}, ["food_delivery"], "k")
    assert sorted((r.event, r.k, r.matched_on, r.corroborates) for r in out.collect()) == [(1, 1, "entity", True), (1, 3, "sector", True), (2, 2, "supply_chain_tier", False)]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_attention_leaves_the_days_near_out(spark):
    days = [(f"Acme {h}", f"2024-01-{d:02d}", 10.0 * d + h) for d in range(1, 15) for h in (0, 1)]
    views = spark.createDataFrame([*days, (None, "2024-01-01", 9.0)], "hint string, date string, views double").withColumn("date", F.to_date("date"))
    events = spark.createDataFrame([("Acme Air", "2024-01-07"), ("Acme Air", "2024-01-07"), ("Acme Air", "2024-03-01"), ("Nobody", "2024-01-07")], "brand string, day string").withColumn("day", F.to_date("day"))
    got = [tuple(r) for r in monitoring.attention_evidence(events, views).collect()]
    rest = sorted(20.0 * d + 1 for d in range(1, 15) if abs(d - 7) > 2)
    usual = (rest[4] + rest[3]) / 2 if len(rest) % 2 == 0 else rest[4]
    usual = (rest[(len(rest) - 1) // 2] + rest[len(rest) // 2]) / 2
    assert got == [("Acme Air", events.first().day, 141.0, usual, round(141.0 / usual, 2), 141.0 / usual >= 1.25 or 141.0 / usual <= 0.8)]
