"""Rules for reactions against Python's own pattern engine; posts, features, governance,
sources and streams on small rows."""

from __future__ import annotations

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import lexicon, posts, rules, stats, text
from tidemark.operators import claims, cleaning, features, keys, metrics, monitoring, ranks, series
from tidemark.plans.governance import PROBES
from tidemark.plans.reactions import HEADLINES, PHRASES
from tidemark.sources import files
from tidemark.sources.http import Fetcher


def test_relevance_probes(spark):
    df = spark.createDataFrame([*PROBES, (None, False), ("", False)], "text string, expected boolean")
    assert df.filter(lexicon.relevant(F.col("text")) != F.col("expected")).count() == 0


def test_rules_equal_python_patterns(spark):
    """The phrases and mixtures of them, each rule list searched by another engine."""
    r = random.Random(2)
    words = " ".join(p[0] for p in PHRASES).split()
    said = [p[0] for p in PHRASES] + [" ".join(r.choice(words) for _ in range(r.randint(1, 14))) for _ in range(300)] + ["Ärger: DELAY!", "é3 days, late", "no\nfood"]

    def first(x, ordered):
        return next(((n, m[0][:60]) for n, p in ordered if (m := re.search(p, x, re.I))), ("", ""))

    relevance, x = re.compile("|".join(lexicon.RELEVANCE), re.I), F.col("text")
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, text string").withColumn("relevant", lexicon.relevant(x))
    got = df.select("i", "relevant", lexicon.relevance_trigger(x).alias("t"), lexicon.delay_type(x, F.col("relevant")).alias("d"), lexicon.reaction_type(x).alias("r"), lexicon.competitor(x).alias("c"), *[c.alias(k) for k, c in lexicon.reaction_flags(x).items()]).collect()
    for row in got:
        s = said[row.i]
        hit = relevance.search(s)
        assert row.relevant == bool(hit) and row.t == (hit[0].lower()[:24] if hit else None), s
        d, e = first(s, lexicon.DELAY_TYPES)
        assert (row.d.label, row.d.evidence) == (d or ("unspecified_delay" if hit else ""), e), s
        n, e = first(s, lexicon.REACTION_TYPES)
        assert (row.r.label, row.r.evidence) == (n or "unmarked", e), s
        rival = re.search(lexicon.COMPETITOR_SWITCH, s, re.I)
        assert row.c == (rival[1].strip().lower()[:24] if rival else ""), s
        assert all(row[f"flag_{k}"] == bool(re.search(p, s, re.I)) for k, p in lexicon.REACTION_FLAGS.items()), s


def test_labels_beside_the_phrases(spark):
    x = F.col("text")
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PHRASES)], "i int, text string").withColumn("relevant", lexicon.relevant(x))
    for r in df.select("i", lexicon.relevance_trigger(x).alias("t"), lexicon.delay_type(x, F.col("relevant"))["label"].alias("d"), lexicon.reaction_type(x)["label"].alias("r"), lexicon.competitor(x).alias("c")).collect():
        assert (r.t, r.d, r.r, r.c) == PHRASES[r.i][1:5]


def test_stars_and_verdicts(spark):
    got = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.5, 3.0, 4.0, None)], "x double").select(lexicon.star_label(F.col("x")).alias("l"), lexicon.sign(lexicon.star_label(F.col("x"))).alias("s")).collect()
    assert [tuple(r) for r in got] == [("Negative", -1), ("Negative", -1), ("Positive", 1), ("Neutral", 0), ("Positive", 1), (None, None)]
    said = ["Absolutely loving it", "Loving it. Not worth the money", "Fed up. Worth every penny", None, "Worth every penny Returning it ASAP Not bad"]
    plus, minus = lexicon.emotions(F.col("x"))
    got = spark.createDataFrame([(x,) for x in said], "x string").select(lexicon.verdict(F.col("x")).alias("v"), plus.alias("p"), minus.alias("m")).collect()
    assert [tuple(r) for r in got] == [("positive", False, False), ("negative", True, False), ("positive", False, True), (None, None, None), ("neutral", False, False)]


def test_headlines_and_incidents(spark):
    df = spark.createDataFrame(HEADLINES, "text string, expected boolean")
    assert df.filter(lexicon.reports_failure(F.col("text")) != F.col("expected")).count() == 0
    raw = spark.createDataFrame([(1, None, "2024-01-01T00:00:00Z", "ORD", "airline", None), (2, "bad", None, "x", "y", None), (3, "2024-01-02T00:00:00Z", None, "doordash help", "tech", "direct")], "incident int, started_utc string, observed_utc string, entity string, sector string, tier string")
    found = monitoring.incidents(raw)
    assert sorted(r.incident for r in found.collect()) == [1, 3]
    events = spark.createDataFrame([(7, "2024-01-02 12:00:00", "DoorDash", "food_delivery")], "event int, ts string, brand string, domain string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = monitoring.incident_evidence(events, found, lexicon.SECTORS, lexicon.CHAIN_DOMAINS, "incident").collect()
    assert [(r.incident, r.matched_on, r.corroborates) for r in got] == [(3, "entity", True)]  # ORD is no part of doordash


def brute_marked(words, window=4):
    out, left = [], 0
    for w in words:
        out.append(w + "_neg" if left and w not in posts.NEGATORS else w)
        left = window if w in posts.NEGATORS else 0 if w[-1:] in set(".,;:!?") else max(0, left - 1)
    return out


def test_negation_is_marked_as_by_counting(spark):
    r = random.Random(4)
    rows = [[r.choice(["not", "never", "without", "good", "bad,", "ok.", "day", "", "not,"]) for _ in range(r.randint(1, 15))] for _ in range(300)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, w array<string>")
    assert all(x.m == brute_marked(rows[x.i]) for x in df.select("i", posts.mark_negation(F.col("w")).alias("m")).collect())
    long = spark.range(1).select(F.array_repeat(F.lit("word"), 200_000).alias("w"))
    assert long.select(F.size(posts.mark_negation(F.col("w")))).first()[0] == 200_000


def test_damage_is_undone(spark):
    said = ['"a ""b"" c"', "\\u0041 \\ud83d\\ude00", '""', "&lt;3 \\\\\"x\\\\\"", None, "ﬁ"]
    got = spark.createDataFrame([(x,) for x in said], "x string").select(posts.undamaged("x").alias("y")).collect()
    assert [r.y for r in got] == ['a "b" c', "A 😀", "", '<3 "x', None, "fi"]


def test_features(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "c"]), (3, [])], "k int, w array<string>")
    got = {(r.k, r.term): r.weight for r in features.tfidf(df, "k", F.col("w"), least=2).collect()}
    assert got == {(1, "a"): 1.0, (2, "a"): 1.0}
    assert df.select(features.word_ngrams(F.col("w"), 1, 2)).collect()[0][0] == ["a", "b", "a", "a b", "b a"]
    s = {(r.k, r.feature): r.weight for r in features.scaled(df, "k", {"n": F.size("w"), "zero": F.lit(0)}).collect()}
    assert s == {(1, "n"): 1.0, (2, "n"): pytest.approx(2 / 3)}
    p = features.scored(spark.createDataFrame([(1.0, 1.0), (0.0, 2.0)], "a double, b double"), {"x": F.col("a"), "y": F.col("b")}).collect()
    assert [r.label for r in p] == ["x", "y"] and p[1].confidence == round(1 / (1 + math.exp(-2)), 4)


def test_candidates_under_folds(spark):
    r = random.Random(6)
    rows = [(i, f"{'good fine nice' if i % 2 else 'bad poor sad'} {r.randint(0, 9)} w{r.randint(0, 20)}", i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, text string, label int")
    vectors = features.hashed(ranks.folds(df, "text", "label", 2), "id", features.tfidf(df, "id", F.split("text", " "), least=2), 64)
    pick = {k: v for k, v in features.classifiers("label").items() if k in ("majority", "linear_svc", "soft_vote")}
    got = {x.name: x.accuracy for x in features.cross_validated(vectors.select("label", "fold", "features"), "label", "fold", pick).collect()}
    assert got["linear_svc"] > 0.9 and got["soft_vote"] > 0.9 and got["majority"] <= 0.6
    arms = {x.name: x.accuracy for x in features.leakage(vectors.drop("fold"), "id", "text", "label", features.classifiers("label")["logistic"]).collect()}
    assert set(arms) == {"grouped", "by_row", "permuted"} and arms["grouped"] > 0.9 > arms["permuted"]


def test_permuted_keeps_the_labels(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "k int, label int")
    got = {r.k: r.label for r in features.permuted(df, "label", "k").collect()}
    assert sorted(got.values()) == sorted(i % 3 for i in range(50)) and any(got[i] != i % 3 for i in range(50))


def test_rules_are_mined_class_by_class(spark):
    said = [("the app is down", "tech"), ("app crash", "tech"), ("my app", "tech"), ("app ban", "tech"), ("ban me", "safe"), ("a ban here", "safe"), ("banned", "safe"), ("hello", "talk"), ("well", "talk")]
    df = spark.createDataFrame(said, "text string, topic string").withColumn("chunks", text.letter_substrings(F.col("text"), 2, 8))
    found = rules.peel(df, "text", "chunks", "topic", ["tech", "safe"])
    assert found == {"tech": ["ap"], "safe": ["an"]}
    r = rules.fidelity(df, F.col("text"), F.col("topic"), list(found.items()), "talk").first()
    assert (r.n, r.fidelity, r.mismatches, r.artefact_share) == (9, 1.0, 0, 1.0)


def test_running_sums_and_quantiles_equal_brute_force(spark):
    r = random.Random(8)
    rows = [(r.choice("ab") if r.random() < 0.9 else None, r.randint(0, 30), r.randint(1, 5)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, w int").repartition(7)
    got = ranks.running(df.groupBy("v").agg(F.sum("w").alias("w")), [F.col("v")], ["w"]).collect()
    assert all(x.before_w == sum(w for _, v, w in rows if v < x.v) for x in got)
    at = ranks.numbered_within(df.withColumn("i", F.monotonically_increasing_id()), ["g"], [F.col("v"), F.col("i")]).collect()
    for g in ("a", "b", None):
        own = sorted((x.position, x.v) for x in at if x.g == g)
        assert [p for p, _ in own] == list(range(1, len(own) + 1)) and [v for _, v in own] == sorted(v for h, v, _ in rows if h == g)
    q = {x.g: (x.m, x.n) for x in ranks.quantiles(df, ["g"], "v", {"m": 0.5}).join(ranks.quantiles(df, ["g"], "v", {"n": 0.9}, nearest=True), "g").collect()}
    for g in ("a", "b"):
        own = sorted(v for h, v, _ in rows if h == g)
        k = (len(own) - 1) / 2
        assert q[g] == ((own[math.floor(k)] + own[math.ceil(k)]) / 2, own[math.floor(len(own) * 0.9)])
    assert ranks.quantiles(df.limit(0), [], "v", {"m": 0.5}).count() <= 1
    share = [x.share for x in ranks.cumulative_share(df, "w", [F.col("v"), F.col("g")]).collect()]
    assert max(share) == pytest.approx(1.0)


def test_rank_correlation_with_ties(spark):
    rows = [(1, 2), (2, 1), (2, 3), (3, 3), (None, 1), (4, None), (1, 2)]
    r = metrics.rank_correlation(spark.createDataFrame(rows, "x int, y int"), "x", "y").first()

    def mid(values):
        return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]

    a, b = (mid([p[i] for p in rows if None not in p]) for i in (0, 1))
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    want = sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
    assert r.n == 5 and r.rho == pytest.approx(want)


def test_exact_distance_test():
    assert stats.ks_exact_p(0.274, 10) == pytest.approx(1 - 0.6284796154565, abs=1e-6)
    assert stats.ks_exact_p(1.0, 3) == pytest.approx(0.0, abs=1e-12) and stats.ks_exact_p(0.5 / 4, 4) == pytest.approx(1.0)
    assert abs(stats.ks_exact_p(0.12, 140) - stats.ks_p(0.12, 140)) < 0.02


def test_record_shifts_need_enough_records(spark):
    rows = [(d, "a", u, float(d >= 10) + u % 2) for d in range(20) for u in range(10)] + [(d, "b", 1, 1.0) for d in range(20)]
    df = spark.createDataFrame(rows, "d int, k string, u int, v double").withColumn("ts", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))
    cuts = spark.createDataFrame([("a", "2024-01-11"), ("b", "2024-01-11")], "k string, cut string").withColumn("cut", F.col("cut").cast("date"))
    panel = spark.createDataFrame([(u,) for u in range(5)], "u int")
    got = {(r.k, r.who): (r.n_before, r.n_after, r.delta) for r in series.record_shifts(df, cuts, panel, ["k"], "ts", "v", "u").collect()}
    assert got == {("a", "all"): (50, 50, 1.0), ("a", "panel"): (25, 25, 1.0)}


def test_claims(spark, tmp_path):
    m = {"n": 12345, "sub": {"p": 0.12345, "ok": True, "none": None}, "list": ["x", 2]}
    assert claims.render("{{ n }} {{sub.p}} {{ sub.ok }} {{list.1}} {{sub.none}}", m) == "12,345 0.1235 true 2 n/a"
    with pytest.raises(KeyError, match="b, c"):
        claims.render("{{ c }} {{ n }} {{ b }}", m)
    claims.write_report(spark, m, path := str(tmp_path / "r"))
    assert claims.read_report(spark, path) == json.loads(json.dumps(m))


def test_profiles_and_sets(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "k int, v string")
    got = {r.column: (r.kind, r.n, r.known, r.distinct, r.example) for r in cleaning.profile(df).collect()}
    assert got == {"k": ("int", 3, 3, 2, "1"), "v": ("string", 3, 2, 2, "a")}
    assert keys.same_keys(df, df.filter("v IS NOT NULL"), ["k"]) and not keys.same_keys(df, df.filter("k > 1"), ["k"])


def test_feeds_and_answers(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<feed><entry><id>1</id><title>T</title><content>C</content><author><name>N</name></author><updated>2024</updated><link href="u"/></entry></feed>')
    assert tuple(files.atom_entries(spark, str(tmp_path / "a.xml")).first()) == ("1", "T", "C", "N", "2024", "u")
    (tmp_path / "r.xml").write_text("<rss><channel><item><title>T</title><description>D</description><link>https://status.x.com/1</link><pubDate>P</pubDate></item></channel></rss>")
    assert tuple(files.rss_items(spark, str(tmp_path / "r.xml")).first()) == ("https://status.x.com/1", "T", "D", None, "P", "https://status.x.com/1")
    assert files.status_incidents(spark, str(tmp_path / "r.xml"), {"status.x.com": "direct"}).first().tier == "direct"
    (tmp_path / "f.xml").write_text("<all><Ground_Delay><ARPT>ORD</ARPT><Reason>wind</Reason><Avg>1 hour</Avg><Max></Max></Ground_Delay><Airport><ARPT>LHR</ARPT><Reason>snow</Reason><Start>s</Start></Airport></all>")
    got = {r.entity: (r.kind, r.delay, r.detail) for r in files.airport_delays(spark, str(tmp_path / "f.xml")).collect()}
    assert got == {"ORD": ("ground_delay", "1 hour", "wind"), "LHR": ("closure", None, "snow | s")}
    said = {"hits": [{"objectID": "7", "title": "t", "comment_text": "c", "points": 3}, {"objectID": "8", "num_comments": 2}]}
    df = spark.createDataFrame([(json.dumps(said),)], "body string")
    assert [(r.id, r.text, r.engagement) for r in files.answers(df, "body", "hackernews").collect()] == [("7", "c", 3), ("8", None, 2)]


def test_enumeration_stops_at_the_edge():
    pages = {None: ([{"created": "5"}, {"created": "4"}], "b"), "b": ([{"created": "3"}, {"created": "1"}], "c"), "c": ([{"created": "0"}], None)}
    asked = []
    got = list(files.enumerated(lambda t: asked.append(t) or pages[t], None, "2"))
    assert [r["created"] for r in got] == ["5", "4", "3"] and asked == [None, "b"]
    assert list(files.enumerated(lambda t: ([], "x"), None, "2")) == []


def test_fetcher_keeps_waits_and_tries_again(tmp_path):
    now, naps, answers = [1e9], [], [(503, {}, b""), (429, {"Retry-After": "7"}, b""), (200, {}, b'{"a": 1}')]
    f = Fetcher(str(tmp_path), open=lambda u, h, t: answers.pop(0), clock=lambda: now[0], sleep=lambda s: (naps.append(s), now.__setitem__(0, now[0] + s)), gap=0.5)
    assert f.get_json("https://h/x") == {"a": 1} and naps == [1.0, 7.0]
    f.fresh = 1e12
    assert f.get("https://h/x") == b'{"a": 1}' and answers == []
    answers += [(404, {}, b"")]
    assert f.get("https://h/y") is None
    answers += [(500, {}, b"")] * 4
    assert f.get("https://h/z") is None and answers == []
    with open(tmp_path / "ledger.jsonl") as log:
        assert [(r["outcome"], r["tries"]) for r in map(json.loads, log)] == [("200", 3), ("kept", 0), ("404", 1), ("500", 4)]


def test_files_landed_digested_and_shrunk(spark, tmp_path):
    import hashlib

    (tmp_path / "p1").write_text("a\n\nb\n")
    assert [tuple(r) for r in files.landed(spark, str(tmp_path / "p1")).collect()] == [("p1", 0, "a"), ("p1", 1, "b")]
    assert files.digests(spark, str(tmp_path / "p1")).first().sha256 == hashlib.sha256(b"a\n\nb\n").hexdigest()
    df = spark.createDataFrame([(i, "x" * 50, "u", i % 2 == 0) for i in range(20)], "id int, text string, url string, topic boolean")
    size = lambda d: d.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 1)).first()[0]
    full = size(df)
    topic = files.within_budget(df, full - 1, "text", [F.desc("id")], ["url"], on_topic=F.col("topic"))
    assert topic.count() == 10 and topic.columns == df.columns
    few = files.within_budget(df, 200, "text", [F.desc("id")], ["url"], cuts=[10], on_topic=F.col("topic"))
    assert size(few) <= 200 and [r.id for r in few.orderBy(F.desc("id")).collect()] == list(range(18, 18 - 2 * few.count(), -2))
    assert files.write_table(df.withColumn("m", F.expr("make_interval(1)")), str(tmp_path / "t")) == "csv"
    assert files.write_table(df, str(tmp_path / "u")) == "parquet"
    assert tuple(files.nullified(spark.createDataFrame([("", float("nan"), 1)], "a string, b double, c int")).first()) == (None, None, 1)


def test_census_goes_on_after_a_restart(spark, tmp_path):
    from tidemark.streaming.census import Census

    df = spark.range(90).withColumns({"g": F.col("id") % 3, "v": F.col("id") * 1.0, "at": F.timestamp_seconds("id")})
    census = lambda: Census(spark, str(tmp_path / "c"), ["g"], ["id"], ["v"], "at", F.col("at"), k=5, late=None)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("id long, g long, v double, at timestamp").parquet(str(tmp_path / "in"))
    with pytest.raises(FileNotFoundError):
        census().read()
    for k in range(3):
        df.filter(F.col("id") % 3 == k).write.mode("append").parquet(str(tmp_path / "in"))
        census().follow(stream).awaitTermination()  # a new object each time
    census().follow(stream).awaitTermination()  # and again, with nothing new
    assert census().read()[0].agg(F.sum("n"), F.sum("total_v")).first()[:] == (90, sum(range(90)))


def test_statements_leave_no_views(spark):
    from tidemark.plans.named import run

    spark.range(3).createOrReplaceTempView("orders")
    run(spark, "/root/testdata/sf0.001", "SELECT count(*) AS n FROM orders").collect()
    assert spark.table("orders").count() == 3
    spark.catalog.dropTempView("orders")


def test_calibrated_margins_sum_to_one(spark):
    r = random.Random(3)
    rows = [(i, i % 3, *[(1.5 if i % 3 == c else -0.5) + r.gauss(0, 1) for c in range(3)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, label int, m0 double, m1 double, m2 double")
    got = features.calibrated(df, "label", {0: "m0", 1: "m1", 2: "m2"}).collect()
    assert all(sum(x.p) == pytest.approx(1.0) for x in got)
    assert sum(max(range(3), key=lambda c, p=x.p: p[c]) == x.label for x in got) > 100


def test_interval_join_with_equal_columns(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 5), (3, "x", 11)], "k int, g string, at int")
    b = spark.createDataFrame([("x", 4, 6), ("y", 6, 9), ("x", 10, 30)], "g string, lo int, hi int")
    got = keys.interval_join(a, b, "at", "lo", "hi", 4, ["g"]).select("k", "lo").collect()
    assert sorted(map(tuple, got)) == [(1, 4), (3, 10)]


def test_holdout_does_not_leak(spark):
    rows = [(i, f"t{i % 40}", "ab"[i % 2]) for i in range(120)]
    d = ranks.holdout(spark.createDataFrame(rows, "id int, text string, label string"), "text", "label", 0.25)
    assert ranks.leaks(d, "text", "held").count() == 0
    assert {x.label: x.n for x in d.filter("held").groupBy("label").agg(F.count_distinct("text").alias("n")).collect()} == {"a": 5, "b": 5}
    best = metrics.best_threshold(spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.9)], "y int, s double"), "y", "s", 0, 100).first()
    assert best.tau == 11


def test_hashtags_of_any_length(spark):
    from tidemark.functions import posts

    long = "#" + "Word" * 250 + "_end"
    cases = {long: "# " + "word " * 250 + "end", "a #Good_FridayNow b#x": "a # good friday now b # x", "# alone #": "# alone #", "##Two": "# # two", "#ÉtéBon": "# étébon", None: "", "no tags": "no tags"}
    got = spark.createDataFrame([(x,) for x in cases], "x string").select("x", posts.normalise(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == cases
