"""Top-k search, fill-in-middle and importance resampling against brute force, on nulls,
ties, repeats, empty tables, long rows and columns with clashing names."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fill_in_middle, importance, topk_search

# ---- op11


def found(spark, rows, k=3, scale=1, every=2, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, e array<double>").withColumn("block", F.lit("mine")).withColumn("v", F.lit(3)).repartition(3)
    index, blocks = topk_search.build_index(df, "vec_id", "e", scale, sizes.get("block", topk_search.BLOCK))
    out = topk_search.search(index, blocks, df.filter(F.col("vec_id") % every == 0), "vec_id", "e", scale, k, sizes.get("chunk", topk_search.CHUNK))
    return sorted((x.query_id, x.rank, x.vec_id, x.score) for x in out.collect())


def brute(rows, k=3, scale=1, every=2):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        best = {}
        for own, a in good:
            for i, b in good if own == q else ():
                if i != q:
                    score = min(max(sum(x * y for x, y in zip(a, b, strict=False)), -(2**63)), 2**63 - 1)
                    best[i] = max(best.get(i, score), score)
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(ranked)]
    return sorted(out)


def test_search_with_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.5]), (1, [1.0, 2.5]), (2, [1.0, 2.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (None, [9.0, 9.0]), (8, []), (9, [3.0]), (10, [-1.0, -7.0, 2.0]), (2, [-4.0, 9.0]), (2, [1.0, 2.5]), (9, [3.0]), (12, [1e300, 1.0])]
    assert found(spark, rows) == brute([(i, v if i != 12 else [float(2**63 - 1), 1.0]) for i, v in rows])
    assert found(spark, []) == []
    assert found(spark, [(2, [1.0])]) == []


@pytest.mark.parametrize("block", [50, 400])
def test_search_in_blocks(spark, block):
    """Many blocks and chunks; a third of the rows one vector; integers with many ties."""
    r = random.Random(block)
    rows = [(i, [float(r.randint(-3, 3)) for _ in range(6)] if r.random() < 0.67 else [1.0, -2.0, 0.0, 3.0, 1.0, 1.0]) for i in range(300)]
    assert found(spark, rows, k=5, every=3, block=block, chunk=20) == brute(rows, k=5, every=3)


def test_search_of_real_numbers(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=40)]) for i in range(150)]
    assert found(spark, rows, k=4, scale=64, every=5) == brute(rows, k=4, scale=64, every=5)


def test_processing_stops_on_proof():
    """The leaders are far ahead: few postings are processed, and the result is exact."""
    r = np.random.default_rng(2)
    m = r.integers(-9, 10, (4000, 32))
    m[7:30] = m[5]  # copies of the query's vector
    block = topk_search.Block(np.arange(4000), m.astype(np.int8), np.argsort(m, 0, kind="stable").T)
    ids, scores, taken = block.search(5, m[5], 20)
    assert ids.tolist() == list(range(7, 27)) and set(scores) == {int(m[5] @ m[5])}
    assert taken < 0.8 * m.size
    flat = topk_search.Block(np.arange(50), np.ones((50, 4), np.int8), np.tile(np.arange(50), (4, 1)))
    assert flat.search(0, np.ones(4, int), 60)[0].tolist() == list(range(1, 50))  # no proof is possible


# ---- op12


def by_rule(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(units), hashlib.sha256(f"{seed}:{doc_id if doc_id is not None else ''}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    r = random.Random(4)
    odd = [None, "", "\n", "a", "a\n", "é\n\n日本\n😀", "a<P>b\n", "<S\n>", "x\r\ny z\n", "\x00\n\x00", "<P\n>S>\n<", "x" * 200_000 + "\n", "\n" * 3000]
    rows = [(i, x) for i, x in enumerate([*odd, *("".join(r.choice("ab\né<>PSM😀") for _ in range(r.randint(0, 80))) for _ in range(150))])]
    rows += [(None, "no\nid\n"), (3, "other\ntext\n"), (3, "other\ntext\n"), (-5, "a\nb")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit(1)).withColumn("form", F.lit("mine")).withColumn("a b", F.array(F.lit(2)))
    for rate, spm in ((100, 50), (60, 0)):
        out = fill_in_middle.fill_in_middle(df, 7, rate, spm)
        assert out.columns == ["doc_id", "text", "a b", *fill_in_middle.RESULTS]
        got = out.withColumn("again", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()
        have = collections.Counter((x.doc_id, x.text, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in got)
        assert have == collections.Counter((i, x, *by_rule(i, x, rate, spm)) for i, x in rows)
        assert all(x.again == (x.text or "") for x in got)
        assert {x.form for x in got} == ({"plain", "psm", "spm"} if spm else {"plain", "psm"})
    assert fill_in_middle.fill_in_middle(df.limit(0), 7).count() == 0


def test_characters_that_no_unit_matches_stay(spark):
    df = spark.createDataFrame([(i, "--ab--cd-") for i in range(20)], "doc_id long, text string")
    got = fill_in_middle.fill_in_middle(df, 1, pattern="[a-z]+").withColumn("again", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()
    assert {x.n for x in got} == {5} and {x.again for x in got} == {"--ab--cd-"}


# ---- op13

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def resampled(docs, target, most, buckets, min_words, percent, seed=2024):
    def features(text):
        words = WORD.findall((text or "").translate(FOLD))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    s, t = (collections.Counter(b for x in side for b in features(x)[1]) for side in ([x for _, x in docs], target))
    alls, allt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (alls + buckets)) / ((s[b] + 1) * (allt + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        words, f = features(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((x for x in rows if x[4] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    drawn = percent * len(able) // 100
    return sorted([(*x[:4], k + 1 if k < drawn else None) for k, x in enumerate(able)] + [(*x[:4], None) for x in rows if x[4] < min_words], key=str)


@pytest.mark.parametrize("most", [1, 3])
def test_resampling(spark, most):
    r = random.Random(most)
    words = ["Ab", "cd", "ÉÈ", "x1", "日本", "ﬀ", "I", "İ", *map(str, range(40))]
    docs = [(i, r.choice([" ", "_", "\n", "\xa0 "]).join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(200)]
    docs += [(500, None), (501, ""), (502, "!?"), (None, "ab cd " * 9), (7, docs[7][1]), (7, "cd " * 30), (503, "w" * 300_000)]
    target = ["ab cd x1 " * 5, None, "日本 éè 3 4 5"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("mine")).withColumn("bucket", F.lit(0)).repartition(3)
    out = importance.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), 2024, most, 97, 5, 30)
    assert out.columns == ["doc_id", "bucket", *importance.RESULTS]
    assert sorted(((x.doc_id, x.n_features, x.weight, x.score, x["rank"]) for x in out.collect()), key=str) == resampled(docs, target, most, 97, 5, 30)


def test_resampling_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, "a a")], "doc_id long, text string")
    assert importance.resample(none, some, 1).count() == 0
    got = importance.resample(some, none, 1, min_words=0, percent=50, buckets=11).collect()
    assert sorted(((x.doc_id, x.n_features, x.weight, x.score, x["rank"]) for x in got), key=str) == resampled([(1, "a b c"), (2, "a a")], [], 1, 11, 0, 50, seed=1)
