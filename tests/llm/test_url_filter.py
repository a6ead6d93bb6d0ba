"""URL filter: host, path and rule against brute force, trees on held-out URLs."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import url_filter
from tidemark.llm.queries import URL_RULES

RULES = [url_filter.Rule("org/", "allow"), url_filter.Rule("example.org/es/", "block"), url_filter.Rule("net/x", "block")]
NONE = url_filter.Model()


def brute(url, rules):
    """host, path, rule, verdict, by cutting the text."""
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, None
    rest = url[at + 3 :]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    rest = rest[:end]
    cut = rest.find("/") if "/" in rest else len(rest)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.text), r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_parts_and_rules_equal_brute_force(spark):
    r = random.Random(1)
    rules = [*URL_RULES, *RULES, url_filter.Rule("a.org/b", "block"), url_filter.Rule("org/bc/d", "allow")]
    bits = ["http", "://", "://", "/", "?", "#", ".", "Example.ORG", "example.org", "org", "com", "xorg", "/es/", "/fr/", "/de/x", "/en/1", "net", "a.org/b", "/bc/d", "É", " ", "%2F", "\n"]
    urls = [None, "", "http://A.Example.ORG/es/1?q#f", "https://example.org/es", "x://net?y", "https://b.net/x#y", "no scheme/x", "a://b://c/d", "http://xorg/", "://org/", "http://com", "http://a.com/fr/", "http://" + "a." * 50_000 + "org/es/", "http://a.org/bc/d" + "x" * 200_000]
    urls += ["".join(r.choice(bits) for _ in range(r.randint(1, 9))) for _ in range(3000)]
    urls += ["http://" + "".join(r.choice(bits[3:]) for _ in range(r.randint(1, 6))) for _ in range(3000)]
    rows = [(i, u, "z") for i, u in enumerate(urls)] + [(None, urls[3], "z"), (5, urls[5], "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.url_filter(df, rules, NONE).collect()
    assert len(got) == len(rows) and sum(x.page_id == 5 for x in got) == 2
    for x in got:
        host, path, rule, verdict = brute(urls[3 if x.page_id is None else x.page_id], rules)
        assert (x.host, x.path, x.rule) == (host, path, rule)
        assert x.verdict == (verdict or "allow")
    listed = {x.page_id: x.listed for x in url_filter.url_rules(df, rules).collect()}
    assert all(listed[i] == brute(u, rules)[3] for i, u in enumerate(urls))
    assert url_filter.url_filter(df.limit(0), rules, NONE).count() == 0


def test_ties_between_rules():
    book = url_filter.RuleBook([url_filter.Rule("x.org/a", "allow"), url_filter.Rule("org/abc", "block"), url_filter.Rule("org/abc", "allow")])
    r = book.find("y.x.org", "/abc")
    assert (r.text, r.verdict) == ("x.org/a", "allow")
    assert book.find("y.org", "/abc").verdict == "allow"
    assert url_filter.RuleBook([]).find("a", "/") is None


def test_trees_learn_on_held_out_urls(spark):
    r = random.Random(3)

    def url():
        bad = r.random() < 0.4
        host = f"{r.choice(['www', 'blog', 'm'])}.{r.choice(['buy-now', 'win7'] if bad and r.random() < 0.8 else ['river', 'stone'])}.{r.choice(['com', 'net'])}"
        return f"http://{host}/{r.choice('abc')}/{r.randint(1, 9 if not bad else 10**9)}" + ("?a=1&b=2&c=3" if bad and r.random() < 0.7 else ""), "block" if bad else "allow"

    rows = [url() for _ in range(3000)]
    train = spark.createDataFrame([*rows[:2000], (None, "block"), ("http://x/", None)], "url string, verdict string")
    model = url_filter.train(train)
    test = spark.createDataFrame([(i, *x) for i, x in enumerate(rows[2000:])], "page_id long, url string, said string")
    got = url_filter.url_filter(test, [], model).join(test, "page_id").filter("verdict = said").count()
    assert got / 1000 > 0.93
    # The statistics are those of all labelled URLs, whatever the sample.
    less = url_filter.train(train, sample=300)
    counted = lambda m: sorted(map(tuple, m.stats.collect()))
    assert counted(less) == counted(model) and len(less.trees.trees) == len(model.trees.trees)
    got = url_filter.url_filter(test, [], less).join(test, "page_id").filter("verdict = said").count()
    assert got / 1000 > 0.9
    assert url_filter.train(train.limit(0)).trees.trees == []
    only = url_filter.train(train.filter("verdict = 'block'"))
    assert url_filter.url_filter(test, [], only).filter("verdict = 'allow'").count() == 0


def test_statistics_join_alike_beyond_a_broadcast(spark):
    rows = [(i, f"http://h{i % 7}.com/{'abc'[i % 3]}/x") for i in range(50)]
    pages = url_filter._parts(spark.createDataFrame(rows, "page_id long, url string"), "url", "page_id")
    labelled = spark.createDataFrame([(u, i % 2 == 0) for i, u in rows[:20]], "url string, block boolean")
    stats = url_filter.statistics(labelled)
    one, two = (sorted(map(tuple, url_filter.with_statistics(pages, stats, limit).select("page_id", *url_filter.COUNTS).collect())) for limit in (1 << 20, 0))
    assert one == two and len(one) == 50
    assert {x[0]: x.n for x in stats.collect()}["0 com"] == 20


def test_what_is_unknown_stays_near_the_prior_and_follows_what_is_known(spark):
    """Labels by rules: an unlisted top-level domain with a path part that is always blocked
    elsewhere, one that is always allowed, and one that is unknown."""
    r = random.Random(5)
    name = lambda: "".join(r.choice("aeilnorst") for _ in range(r.randint(4, 9)))
    rules = [url_filter.Rule("org/", "allow"), url_filter.Rule("org/es/", "block"), url_filter.Rule("com/es/", "block"), url_filter.Rule("com/fr/", "allow")]
    urls = [f"http://{name()}.{r.choice(['org', 'com', 'net'])}/{r.choice(['es', 'fr', 'en'])}/{r.randint(1, 9999)}" for _ in range(2500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labelled = url_filter.labelled_by_rules(pages, rules)
    model = url_filter.train(labelled)
    odd = [(i, f"http://{name()}.net/{part}/{r.randint(1, 9999)}") for i, part in enumerate(["es", "fr", "xx"] * 100)]
    got = {x.page_id: x.score for x in url_filter.url_filter(spark.createDataFrame(odd, "page_id long, url string"), rules, model).collect()}
    es, fr, xx = ([got[i] for i in range(k, 300, 3)] for k in range(3))
    prior = labelled.agg(F.avg((F.col("verdict") == "block").cast("double"))).first()[0]
    assert min(es) > 0.5 > max(fr) and abs(np.mean(xx) - prior) < 0.2
    held = {x["group"]: x for x in url_filter.held_out(labelled)}
    assert sum(x["rows"] for x in held.values()) == labelled.count()
    assert held["com/es/"]["accuracy"] == 1 and held["com/es/"]["prior_accuracy"] == 0
