"""Operators on small rows with nulls, ties and empty inputs; statistics against known values."""

from __future__ import annotations

import itertools
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import lexicon, posts, rules, stats, text
from tidemark.operators import cleaning, keys, metrics, ranks, series
from tidemark.sources import files
from tidemark.streaming import windows
from tidemark.streaming.ledger import Ledger


def one(spark, value, *exprs):
    return spark.createDataFrame([(value,)], "x string").select(*exprs).first()


# ---- sources and sinks


def test_csv_keeps_every_cell_as_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines, ""quoted"""\n2,NULL\n3,\n', encoding="utf-8")
    got = files.csv_text(spark, str(tmp_path / "a.csv"), ["id", "text"]).collect()
    assert [tuple(r) for r in got] == [("1", 'two\nlines, "quoted"'), ("2", "NULL"), ("3", "")]
    back = files.typed(files.csv_text(spark, str(tmp_path / "a.csv"), ["id", "text"]), {"id": "int", "text": "int"}).collect()
    assert [tuple(r) for r in back] == [(1, None), (2, None), (3, None)]
    with pytest.raises(ValueError, match="missing columns: b, c"):
        files.require(spark.range(1), ["id", "b", "c"])


def test_json_lines_and_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": 2, "v": "x"}\n')
    schema = "k int, v string"
    assert files.json_lines(spark, str(tmp_path / "a.jsonl"), schema).count() == 2
    assert files.json_lines(spark, str(tmp_path / "none.jsonl"), schema).count() == 0
    both = files.sources(spark, {"a": str(tmp_path / "a.jsonl"), "b": str(tmp_path / "none.jsonl")}, schema)
    assert {r.source for r in both.collect()} == {"a"}
    with pytest.raises(FileNotFoundError):
        files.sources(spark, {"b": str(tmp_path / "none.jsonl")}, schema)


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>One</title><link>u</link></item><item><title>Two &amp; more</title></item></channel></rss>")
    got = files.xml_items(spark, str(tmp_path / "a.xml"), "item", "title string, link string").orderBy("title").collect()
    assert [tuple(r) for r in got] == [("One", "u"), ("Two & more", None)]
    answers = spark.createDataFrame([('{"items": [{"up": 1}, {"up": null, "down": 2}]}',)], "body string")
    items = files.json_items(answers, "body", "items", "up: int, down: int")
    assert sorted(r[0] for r in items.select(files.engagement("up", "down")).collect()) == [1, 2]


def test_nested_round_trip_and_tables(spark, tmp_path):
    users = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    posts = spark.createDataFrame([(1, "x", 1.5), (1, "y", None)], "id int, text string, score double")
    assert files.nested_round_trip(users, posts, "id", "posts", str(tmp_path / "n"))
    files.write_csv(users, str(tmp_path / "c"), ["id"], gzip=True)
    assert files.csv_typed(spark, str(tmp_path / "c"), "id int, name string").count() == 2
    assert files.parquet_or_csv(spark, str(tmp_path / "none"), str(tmp_path / "c"), "id int, name string").count() == 2


def test_budget_ladder(spark):
    df = spark.createDataFrame([(i, "x" * 1000, "u" * 50) for i in range(40)], "id int, text string, url string")
    size = lambda d: sum(len(json.dumps(r.asDict(), separators=(",", ":"))) + 1 for r in d.collect())
    full = size(df)
    for limit in (full, full - 100, full // 2, full // 4, 3000, 5):
        out = files.within_budget(df, limit, "text", [F.desc("id")], droppable=["url"])
        assert size(out) <= limit
    assert "url" not in files.within_budget(df, full - 100, "text", [F.desc("id")], droppable=["url"]).columns
    assert files.within_budget(df, 3000, "text", [F.desc("id")]).agg(F.max("id")).first()[0] == 39


def test_replay_source(spark, tmp_path):
    from tidemark.sources.replay import ReplaySource

    (tmp_path / "p1.json").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "p2.json").write_text('\n{"a": 3}\n')
    spark.dataSource.register(ReplaySource)
    got = spark.read.format("replay").option("path", str(tmp_path)).load().orderBy("page", "position").collect()
    assert [tuple(r) for r in got] == [("p1.json", 0, '{"a": 1}'), ("p1.json", 1, '{"a": 2}'), ("p2.json", 0, '{"a": 3}')]


# ---- keys, ranks and sets


def test_keys(spark):
    a = spark.createDataFrame([(1, "x", 3), (1, "x", 1), (2, "y", None), (None, "z", 5)], "k int, v string, o int")
    first = {r.k: r.o for r in keys.keep_first(a, ["k"], ["o", "v"]).collect()}
    assert first == {1: 1, 2: None, None: 5}
    assert {r.k for r in keys.orphans(a, spark.createDataFrame([(1,)], "p int"), "k", "p").collect()} == {2, None}
    assert keys.same_rows(a, a.orderBy("o")) and not keys.same_rows(a, a.filter("k = 1")) and not keys.same_rows(a, a.union(a))
    assert keys.unseen(a, a.filter("k = 1"), ["k"]).count() == 2


def test_interval_join_equals_brute_force(spark):
    r = random.Random(1)
    xs = [(i, r.randint(-50, 50)) for i in range(80)]
    spans = [(i, a, a + r.randint(-2, 30)) for i in range(60) for a in [r.randint(-60, 50)]]
    left, right = spark.createDataFrame(xs, "i int, at int"), spark.createDataFrame(spans, "j int, lo int, hi int")
    got = {(x.i, x.j) for x in keys.interval_join(left, right, "at", "lo", "hi", 7).collect()}
    assert got == {(i, j) for i, x in xs for j, lo, hi in spans if lo <= x <= hi}


def test_global_ranks_equal_windows(spark):
    df = spark.createDataFrame([(i, None if i % 9 == 0 else float(i % 7)) for i in range(53)], "id int, v double")
    got = ranks.global_ranks(df, F.col("v"), [F.col("id")], 10)
    df.createOrReplaceTempView("ranked")
    want = spark.sql("SELECT id, ntile(10) OVER (ORDER BY v DESC, id) AS tile, percent_rank() OVER (ORDER BY v) AS pr FROM ranked")
    assert {(r.id, r.tile, round(r.percent_rank, 9)) for r in got.collect()} == {(r.id, r.tile, round(r.pr, 9)) for r in want.collect()}


def test_folds_keep_texts_together(spark):
    df = spark.createDataFrame([(f"t{i % 30}", i % 2) for i in range(90)], "text string, label int")
    f = ranks.folds(df, "text", "label", 5)
    assert f.groupBy("text").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert f.select("fold").distinct().count() == 5


def test_quota_sample(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    a = ranks.quota_sample(df, ["g"], ["id"], 5)
    assert a.groupBy("g").count().filter("count <> 5").count() == 0
    assert keys.same_rows(a, ranks.quota_sample(df.repartition(7), ["g"], ["id"], 5))


# ---- series


def test_dense_and_islands(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-02"), ("a", "2024-01-05"), ("b", "2024-01-09")], "k string, d string")
    s = series.daily(df, "d", ["k"])
    assert series.dense(s, ["k"]).count() == 6
    assert series.islands(s, ["k"], "date", 2).agg(F.max("island")).first()[0] == 2


def brute_breaks(x, least, pen):
    n, best = len(x), (np.inf, ())
    cost = lambda a: float(((a - a.mean()) ** 2).sum())
    for k in range(0, n // least):
        for cut in itertools.combinations(range(least, n - least + 1), k):
            edges = [0, *cut, n]
            if all(b - a >= least for a, b in zip(edges, edges[1:], strict=False)):
                c = sum(cost(x[a:b]) for a, b in zip(edges, edges[1:], strict=False)) + pen * k
                if c < best[0] - 1e-9:
                    best = (c, cut)
    return best[1]


def test_change_points_are_optimal(spark):
    r = np.random.default_rng(3)
    rows, want = [], {}
    for g in range(5):
        x = np.concatenate([r.normal(m, 1, 6) for m in r.choice([0, 4, 9], 3)]).round(3)
        rows += [(g, i, float(v)) for i, v in enumerate(x)]
        want[g] = list(brute_breaks(x, 4, 6.0))
    got = series.change_points(spark.createDataFrame(rows, "g int, i int, v double"), ["g"], "i", "v", penalty=6.0).collect()
    assert {g: sorted(r.position for r in got if r.g == g) for g in want} == want


def test_robust_z_falls_back(spark):
    df = spark.createDataFrame([("flat", 1.0)] * 5 + [("flat", 9.0)] + [("same", 2.0)] * 3, "k string, x double")
    z = {(r.k, r.x): r.z for r in series.robust_z(df, "x", ["k"]).collect()}
    assert z["same", 2.0] == 0 and z["flat", 9.0] > 2


def test_discoveries_equal_the_procedure(spark):
    r = random.Random(4)
    p = [round(r.random() ** 3, 3) for _ in range(60)]
    got = {x.i: x.kept for x in series.discoveries(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p", 0.1).collect()}
    order = sorted(p)
    limit = max((v for k, v in enumerate(order, 1) if v <= 0.1 * k / len(p)), default=-1)
    assert got == {i: v <= limit for i, v in enumerate(p)}


def test_concentration(spark):
    c = series.concentration(spark.createDataFrame([("a", v) for v in (1.0, 1.0, 1.0, 1.0)] + [("b", 10.0), ("b", 0.0)], "k string, v double"), ["k"], "v")
    got = {r.k: r for r in c.collect()}
    assert abs(got["a"].gini) < 1e-12 and got["a"].top1_share == 0.25 and got["b"].contributors == 1


# ---- statistics


def test_p_values():
    assert stats.chi2_p(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.t_p(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.normal_p(1.959963984540054) == pytest.approx(0.05, abs=1e-9)
    assert stats.binomial_p(7, 10, 0.5) == pytest.approx(0.34375, abs=1e-9)
    assert stats.poisson_tail(3, 2.0) == pytest.approx(0.3233235838, abs=1e-9)
    assert stats.ks_p(0.1, 100) == pytest.approx(0.27, abs=0.01)
    assert stats.wilson(105, 120) == pytest.approx((0.8040, 0.9229), abs=1e-3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0.01, 50), min_size=2, max_size=6), st.integers(1, 400))
def test_distributions_stay_in_range(values, n):
    s, dof, p = stats.chi2_fit([v * n for v in values])
    assert s >= 0 and dof == len(values) - 1 and 0 <= p <= 1
    assert 0 <= stats.beta_p(values[0], values[1], 0.3) <= 1
    assert stats.beta_p(values[0], values[1], 0.3) + stats.beta_p(values[1], values[0], 0.7) == pytest.approx(1, abs=1e-9)


def test_tables_and_ranks():
    s, dof, p, v = stats.chi2_table([[10, 20], [30, 40]])
    assert (round(s, 4), dof, round(v, 4)) == (0.4464, 1, 0.0891) and 0 < p < 1
    h, p, e = stats.kruskal([(3, 6.0), (3, 15.0)], [1] * 6)
    assert h == pytest.approx(3.857142857) and p == pytest.approx(0.0495, abs=1e-3) and e == pytest.approx(h / 5)
    assert stats.welch_p(10, 0.0, 1.0, 10, 0.0, 1.0)[2] == pytest.approx(1.0)


def test_metrics_against_closed_forms(spark):
    r = random.Random(8)
    rows = [(r.randint(0, 2), r.randint(0, 2), r.random()) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, p int, s double")
    m = metrics.summary(metrics.confusion(df, "y", "p")).first()
    y, p = np.array([x[0] for x in rows]), np.array([x[1] for x in rows])
    po, pe = (y == p).mean(), sum((y == k).mean() * (p == k).mean() for k in range(3))
    assert m.accuracy == pytest.approx(po) and m.kappa == pytest.approx((po - pe) / (1 - pe))
    f1 = [2 * ((y == k) & (p == k)).sum() / ((y == k).sum() + (p == k).sum()) for k in range(3)]
    assert m.macro_f1 == pytest.approx(np.mean(f1))
    s = np.array([x[2] for x in rows])
    pos, neg = s[y == 1], s[y != 1]
    assert metrics.auc(df, F.col("y") == 1, "s").first().auc == pytest.approx((pos[:, None] > neg).mean())


# ---- text and rules


def test_text_functions(spark):
    x = F.col("x")
    assert one(spark, "　\t a b \n", text.strip(x))[0] == "a b"
    assert one(spark, "Oslo, Norway, North", *text.split_last(x))[:] == ("Oslo, Norway", "North")
    assert one(spark, "Singapore", *text.split_last(x))[:] == ("Singapore", "Singapore")
    assert one(spark, "abc\n", text.whole(x, "[a-z]+"))[0] is False
    assert one(spark, "&lt;b&gt; ﬁ", text.html_unescape(x), text.nfkc(x))[:] == ("<b> ﬁ", "&lt;b&gt; fi")
    assert one(spark, r"café 😀", text.decode_escapes(x))[0] == "café 😀"
    assert one(spark, "took 3 days, or 50 hours, not 900 weeks", text.longest_hours(x))[0] == 72.0
    assert one(spark, "no time", text.longest_hours(x))[0] is None
    assert one(spark, "RT @bob: Sooooo bad!!! #NotGood https://a.b/c 12,5 :)", text.normalise(x))[0] == "soo bad! not good url num happy"
    assert one(spark, "i do not like this one at all. really good", F.array_join(posts.mark_negation(F.split(x, " "), suffix="_NEG"), " "))[0] == "i do not like_NEG this_NEG one_NEG at_NEG all. really good"
    assert one(spark, "aba", text.substrings(x, 2, 3))[0] == ["ab", "ba", "aba"]
    assert one(spark, None, text.strip(x), text.nfkc(x), text.word_count(x))[:2] == (None, None)
    assert set(text.surface(x)) == {"chars", "words", "exclamations", "questions", "caps_runs", "elongations", "hashtags", "mentions", "urls", "digits", "upper_share"}


def test_rules(spark):
    x = F.col("x")
    found = one(spark, "My order never came, REFUND me", rules.first_match(x, [("refund", r"\brefund\b"), ("late", "never")], "none"))[0]
    assert (found.label, found.evidence) == ("refund", "REFUND")
    assert one(spark, None, rules.first_match(x, [("a", "b")], "none"))[0].label == "none"
    t = [("a", ["cat"]), ("b", ["dog"])]
    assert one(spark, "concatenate dog", rules.switch(x, t, "z"), rules.deciding(x, t), rules.misfire(x, t))[:] == ("a", "cat", True)
    assert one(spark, "a cat", rules.misfire(x, t))[0] is False


@pytest.mark.parametrize(
    ("said", "delay", "reaction"),
    [
        ("My parcel never arrived, I want a refund", "never_arrived", "refund_demand"),
        ("app is down again and again", "outage", "resigned"),
        ("waiting 3 hours, worst ever", "long_wait", "anger"),
        ("fyi all fine", "unspecified_delay", "informational"),
        ("It was late but the order was resolved quickly", "late_delivery", "recovery_acknowledged"),
        ("late, but it was never fixed", "late_delivery", "unmarked"),
    ],
)
def test_lexicon(spark, said, delay, reaction):
    from tidemark.functions import lexicon

    x = F.col("x")
    got = one(spark, said, lexicon.delay_type(x, F.lit(True)).alias("d"), lexicon.reaction_type(x).alias("r"))
    assert (got.d.label, got.r.label) == (delay, reaction)


def test_topics_and_competitors(spark):
    from tidemark.functions import lexicon

    x = F.col("x")
    assert one(spark, "The UI is ugly", lexicon.topic(x))[0] == "Feature_Feedback"
    assert one(spark, "hello", lexicon.topic(x))[0] == "Community_Discussion"
    assert one(spark, "I am switching to Blue Dart", lexicon.competitor(x))[0] == "blue dart"


def test_trigger_mining_finds_the_planted_rule(spark):
    r = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = []
    for _ in range(200):
        w = [r.choice(words) for _ in range(4)]
        rows.append((w, "hit" if "omega" in w or "beta" in w else "miss"))
    df = spark.createDataFrame(rows, "chunks array<string>, label string").withColumn("chunks", F.array_distinct("chunks"))
    assert set(rules.mine_triggers(df, "chunks", "label", "hit")) == {"omega", "beta"}


# ---- cleaning


def test_timestamps_are_routed(spark):
    r = lambda v: one(spark, v, cleaning.route_timestamp(F.col("x")))[0]
    assert (str(r("2024-05-01T10:20:30").at), r("2024-05-01T10:20:30").format) == ("2024-05-01 10:20:30", "iso")
    assert r("1714558830").format == "epoch" and str(r("1714558830").date) == "2024-05-01"
    assert (r("31-12-2024").at, str(r("31-12-2024").date)) == (None, "2024-12-31")
    assert r("31-13-2024").date is None and r("May").format == "unknown"


def test_cleaner_logs_every_change(spark):
    raw = spark.createDataFrame([("1", "twitter ", "-5.0", "a  b<br>"), ("2", "NULL", "7", "N/A"), ("3", "Reddit", "", "fine"), ("4", "other", "x", None)], "post_id string, platform string, likes string, text string")
    clean, log = cleaning.post_cleaner(["Twitter", "Reddit"]).run(raw)
    got = {r.post_id: (r.platform, r.likes, r.text) for r in clean.collect()}
    assert got == {"1": ("Twitter", "5", "a b"), "2": (None, "7", None), "3": ("Reddit", None, "fine"), "4": ("other", "x", None)}
    assert {(r.post_id, r.column, r.rule) for r in log.collect()} == {
        ("1", "platform", "canonical_case"), ("1", "likes", "sign_flip_abs"), ("1", "text", "strip_suffix_artifact"), ("1", "text", "collapse_whitespace"),
        ("2", "platform", "missing_token_to_null"), ("2", "text", "missing_token_to_null"), ("3", "likes", "missing_token_to_null"),
    }
    first, odd = cleaning.drop_copies(raw.union(raw).withColumn("line", F.monotonically_increasing_id()), "post_id", "line")
    assert first.count() == 4 and first.agg(F.sum("copies_removed")).first()[0] == 4 and odd.count() == 0


def test_contracts(spark):
    df = spark.createDataFrame([(1,), (None,), (-2,)], "x int")
    got = {r.check: (r.violations, r.ok) for r in cleaning.contracts(df, {"positive": F.col("x") > 0, "small": F.col("x").isNull() | (F.col("x") < 9)}).collect()}
    assert got == {"positive": (2, False), "small": (0, True)}
    assert cleaning.demand(df, {"any": F.lit(True)}).count() == 3
    with pytest.raises(Exception, match="contract broken: positive"):
        cleaning.demand(df, {"positive": F.col("x") > 0}).collect()


# ---- streams


def test_ledger_repeats_nothing(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), ["k"], ["k"])
    wave = lambda *ks: spark.createDataFrame([(k, "2024-01-01 00:00:00") for k in ks], "k int, at string").withColumn("at", F.col("at").cast("timestamp"))
    ledger.record(wave(1, 2, 2), 0, "2024-01-02 00:00:00")
    ledger.record(wave(2, 3), 1, "2024-01-03 00:00:00")
    ledger.record(wave(2, 3), 1, "2024-01-03 00:00:00")  # a wave that is run again
    s = {r._wave: r for r in ledger.summary("at").collect()}
    assert (s[0].n, s[1].n, s[0].p50, s[1].p50, s[0].late, s[1].late) == (2, 1, 24.0, 48.0, None, 1.0)


def test_stream_as_waves(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(10).withColumn("k", F.col("id") % 4).write.parquet(src)
    ledger = Ledger(spark, str(tmp_path / "l"), ["k"], ["id"])
    ledger.follow(spark.readStream.schema("id long, k long").parquet(src), lambda k: "2024-01-01", str(tmp_path / "c")).awaitTermination()
    assert sorted(r.id for r in ledger.seen().collect()) == [0, 1, 2, 3]
    assert windows.drained(spark.readStream.schema("id long, k long").parquet(src).groupBy("k").count()).count() == 4


# ---- monitoring


def test_evidence_needs_name_and_nearness(spark):
    from tidemark.operators import monitoring

    e = spark.createDataFrame([(1, "DoorDash", 10, 0.5), (2, "Acme", 10, 0.1), (3, "Acme", 50, 0.0)], "event int, brand string, day int, dominance double")
    i = spark.createDataFrame([("ORD", 10), ("acme!", 12), ("Acme", 13)], "entity string, day int")
    a = spark.createDataFrame([("Acme", d, 10.0 if d < 40 else 100.0) for d in range(8, 53)], "brand string, day int, views double")
    got = {r.event: (r.n_incidents, r.verdict) for r in monitoring.evidence(e, i, a).collect()}
    assert got == {1: (0, 1), 2: (1, 1), 3: (0, 1)}


def test_pooled_shifts_keep_the_strongest_of_a_run(spark):
    from tidemark.operators import monitoring

    rows = [("a", "2024-01-01", 0.2, 0.001), ("a", "2024-01-02", -0.9, 0.001), ("a", "2024-01-09", 0.3, 0.001), ("b", "2024-01-01", 0.5, 0.9)]
    df = spark.createDataFrame(rows, "s string, date string, d double, p double").withColumn("date", F.to_date("date"))
    assert sorted((r.s, str(r.date)) for r in monitoring.pooled_shifts(df, ["s"], "p").collect()) == [("a", "2024-01-02"), ("a", "2024-01-09")]


def test_unify_counts_and_brands(spark):
    from tidemark.operators import monitoring

    rows = [
        ("store", "1", "2024-05-01T10:00:00Z", None, "acme air is late", "u1", ""),
        ("store", "1", "2024-05-01T10:00:00Z", None, "acme air is late", "u1", ""),
        ("store", "2", "Wed, 01 May 2024 10:00:00 GMT", "", "Acme air is LATE!", "u2", None),
        ("forum", "3", "2024-05-01T10:00:00Z", "Hi", "acme again", "u1", ""),
        ("forum", "4", "2024-05-02T10:00:00Z", "Hi", "Acme again.", "u2", ""),
        ("forum", "5", "whenever", "Hi", "no time", "u2", ""),
        ("forum", "6", "2024-05-01T10:00:00Z", None, "", "u2", ""),
    ]
    df = spark.createDataFrame(rows, "source string, record_native_id string, created_utc string, title string, text string, author_pseudonym string, brand string")
    steps = monitoring.unify(df, {"acme": "Acme", "acme air": "Acme Air"}, "2024-01-01", "2025-01-01", ("store",))
    assert {k: v.count() for k, v in steps.items()} == {"raw": 7, "read": 6, "in_window": 5, "once_by_id": 4, "once_by_text": 3, "unified": 3}
    assert sorted(r.brand for r in steps["unified"].collect()) == ["Acme", "Acme Air", "Acme Air"]


# ---- the registry


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 80


def test_substring_df_counts_whole_texts(spark, tmp_path):
    import __spark_entry__ as e

    r = random.Random(1)
    values = [" ".join("".join(r.choice("abcé1-") for _ in range(r.randint(1, 12))) for _ in range(r.randint(0, 60))) for _ in range(12)]
    rows = [(i, x, i % 2) for i, x in enumerate([*values, *(f"{v} Überlang" for v in values[:4]), None])]
    spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q) for i, _, q in rows[1:]], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = [({c for n in range(2, 9) for k in range(len(x or "") - n + 1) if (c := x[k : k + n]).isalpha()}, q) for _, x, q in rows[1:]]
    want = {c: (sum(c in s for s, _ in seen), sum(c in s and q for s, q in seen)) for c in set().union(*(s for s, _ in seen))}
    got = e.queries()["substring_df_whole"](spark, str(tmp_path)).collect()
    assert {x.chunk: (x.df, x.in_class) for x in got} == {c: v for c, v in want.items() if v[0] >= 3}
    assert any(len(x.chunk) == 8 for x in got)
