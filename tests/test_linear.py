"""Linear models fitted together against closed runs in numpy; calibration, saving, pages of
candidates."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import linear
from tidemark.operators.calibrated import CalibratedLinear, CalibratedLinearModel, sigmoids


def made(spark, n=240, size=12, classes=3, seed=1):
    r = np.random.default_rng(seed)
    truth = r.normal(size=(classes, size))
    x = r.normal(size=(n, size)) * (r.random((n, size)) < 0.4)
    x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    y = (x @ truth.T + 0.3 * r.normal(size=(n, classes))).argmax(1)
    y[: n // 20] = (y[: n // 20] + 1) % classes  # some are wrong
    rows = [(i, int(c), int(i % 4), [int(j) for j in np.flatnonzero(v)], [float(v[j]) for j in np.flatnonzero(v)]) for i, (c, v) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, "id int, class int, fold int, idx array<int>, val array<double>").repartition(3), x, y, np.arange(n) % 4


def plain(x, t, loss, reg, steps=40_000):
    """Gradient descent in one piece on the same objective, to the end."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    free = np.r_[np.ones(x.shape[1] - 1), 0]
    rate = 1 / (2 * 2 * np.linalg.norm(x, 2) ** 2 / len(x) + reg)
    v = w
    for k in range(steps):
        slope = linear.LOSSES[loss](t * (x @ v))[1] * t @ x / len(x) + reg * free * v
        new = v - rate * slope
        if np.abs(slope).max() < 1e-9:
            break
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


@pytest.mark.parametrize("loss", ["modified_huber", "squared_hinge", "logistic"])
def test_coefficients_equal_a_closed_run(spark, loss):
    rows, x, y, fold = made(spark)
    problems = [linear.Problem(loss, 0.01), linear.Problem(loss, 0.1, 2)]
    w = linear.fit(rows, problems, 3, x.shape[1], steps=200, flat=1e-7)
    for i, p in enumerate(problems):
        use = fold != (-1 if p.without is None else p.without)
        for c in range(3):
            want = plain(x[use], np.where(y[use] == c, 1.0, -1.0), loss, p.reg)
            assert np.abs(w[i, c] - want).max() < 2e-4, (loss, i, c)


def test_modified_huber_by_its_definition():
    m = np.array([-3.0, -1.0, 0.0, 0.5, 1.0, 2.0])
    loss, slope = linear.modified_huber(m)
    assert loss.tolist() == [12.0, 4.0, 1.0, 0.25, 0.0, 0.0] and slope.tolist() == [-4.0, -4.0, -2.0, -1.0, 0.0, 0.0]
    near = (linear.modified_huber(m + 1e-6)[0] - linear.modified_huber(m - 1e-6)[0]) / 2e-6
    assert np.allclose(near, slope, atol=1e-5)


def test_weights_of_rows_and_empty_rows(spark):
    rows, x, y, _ = made(spark, n=60)
    twice = rows.unionByName(rows.filter("id < 20"))
    heavy = rows.withColumn("w", F.when(F.col("id") < 20, 2.0).otherwise(1.0))
    p = [linear.Problem("logistic", 0.05)]
    assert np.abs(linear.fit(twice, p, 3, 12) - linear.fit(heavy, p, 3, 12)).max() < 1e-3
    none = spark.createDataFrame([(0, 0, 0, [], []), (1, 1, 0, [], [])], rows.schema)
    w = linear.fit(none, p, 2, 12)
    assert np.abs(w[..., :-1]).max() == 0
    with pytest.raises(ValueError, match="weights"):
        linear.fit(rows, p * 100, 3, 10_000_000)


def test_candidates_share_passes_and_equal_their_own_fits(spark):
    rows, x, y, fold = made(spark)
    names = {"a": ("modified_huber", 0.01), "b": ("logistic", 0.1)}
    got = {(r.name, r["class"], r.said): r.n for r in linear.cross_validated(rows, names, 3, 12, 4).collect()}
    for name, (loss, reg) in names.items():
        said = np.zeros(len(y), int)
        for k in range(4):
            w = np.array([plain(x[fold != k], np.where(y[fold != k] == c, 1.0, -1.0), loss, reg, 4000) for c in range(3)])
            said[fold == k] = (np.c_[x, np.ones(len(x))][fold == k] @ w.T).argmax(1)
        want = {(name, int(a), int(b)): int(((y == a) & (said == b)).sum()) for a in range(3) for b in range(3) if ((y == a) & (said == b)).any()}
        mine = {k: v for k, v in got.items() if k[0] == name}
        assert sum(abs(mine.get(k, 0) - want.get(k, 0)) for k in {*mine, *want}) <= 4  # rows on the edge


def test_vocabulary_and_sparse_rows(spark):
    f = spark.createDataFrame([(1, "b", 0.5), (1, "a", 1.0), (2, "c", 2.0), (1, "b", 0.25), (3, "zz", 9.0)], "k int, feature string, weight double")
    known, n = linear.vocabulary(f.filter("feature <> 'zz'"))
    assert n == 3 and sorted(tuple(r) for r in known.collect()) == [("a", 0), ("b", 1), ("c", 2)]
    out = {r.k: (r.idx, r.val) for r in linear.sparse(spark.createDataFrame([(1,), (2,), (3,)], "k int"), "k", f, known).collect()}
    assert out == {1: ([0, 1], [1.0, 0.75]), 2: ([2], [2.0]), 3: ([], [])}


def test_sigmoid_is_the_most_likely(spark):
    r = np.random.default_rng(5)
    m = r.normal(size=400)
    hit = r.random(400) < 1 / (1 + np.exp(-2.5 * m + 0.7))
    both = spark.createDataFrame([(float(x), bool(h)) for x, h in zip(m, hit, strict=True)], "m double, hit boolean").withColumns({"n": -F.col("m"), "never": F.lit(False)})
    (a, b), (c, d), (_, e) = sigmoids(both, [("m", "hit"), ("n", "hit"), ("m", "never")])
    assert abs(a + c) < 1e-6 and abs(b - d) < 1e-6 and e > 4
    t = np.where(hit, (hit.sum() + 1) / (hit.sum() + 2), 1 / ((~hit).sum() + 2))

    def loss(a, b):
        z = a * m + b
        return (t * z + np.logaddexp(0, -z)).sum()

    assert a < 0 and all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))


def test_estimator_is_saved_and_loaded(spark, tmp_path):
    rows, x, y, _ = made(spark, n=300)
    named = rows.select("id", F.element_at(F.array(*[F.lit(c) for c in ("no", "so", "yes")]), F.col("class") + 1).alias("truth"), F.col("id").cast("string").alias("text"), "idx", "val")
    est = CalibratedLinear(labelCol="truth", reg=0.01, folds=3)
    est.save(str(tmp_path / "e"))
    assert CalibratedLinear.load(str(tmp_path / "e")).getOrDefault("folds") == 3
    model = est.fit(named)
    model.save(str(tmp_path / "m"))
    again = CalibratedLinearModel.load(str(tmp_path / "m"))
    seen = {r.id: r for r in model.transform(named).collect()}
    for r in again.transform(named).collect():
        assert r.p == seen[r.id].p and r.label == seen[r.id].label and again.uid == model.uid
        assert abs(sum(r.p) - 1) < 1e-9 and r.confidence == round(max(r.p), 4)
    right = np.mean([r.label == r.truth for r in seen.values()])
    sure = np.mean([max(r.p) for r in seen.values()])
    assert right > 0.75 and abs(right - sure) < 0.15
    odd = spark.createDataFrame([(1, [], []), (2, [3, 500], [1.0, 1.0])], "id int, idx array<int>, val array<double>")
    assert model.transform(odd).count() == 2  # rows without features, and with some that are not known


def test_scores_of_many_models_at_once(spark):
    from tidemark.operators import metrics

    rows = [("a", 0, 0, 5), ("a", 0, 1, 2), ("a", 1, 1, 3), ("a", 2, 1, 4), ("b", 0, 2, 1), ("b", 1, 1, 1)]
    df = spark.createDataFrame(rows, "name string, actual int, predicted int, n long")
    got = {r.name: (r.n, r.accuracy, r.macro_f1) for r in metrics.by_name(df, "name").collect()}
    for name in ("a", "b"):
        one = metrics.summary(df.filter(F.col("name") == name)).first()
        assert got[name] == pytest.approx((one.n, one.accuracy, one.macro_f1))


def test_predicted_labels_of_documents(spark, tmp_path):
    """Toxic documents are told from others, on documents that were not labelled too."""
    import random

    import __spark_entry__ as e

    r = random.Random(3)
    word = lambda kind: r.choice({"bad": ["vile", "rotten"], "good": ["careful", "precise"], "poor": ["spam", "click"]}.get(kind, [f"w{i}" for i in range(60)]))
    docs, labels = [], []
    for i in range(160):
        toxic, quality = i % 4 // 2, i % 2
        text = " ".join(word("") for _ in range(20)) + " " + " ".join(word("bad") for _ in range(3 * toxic)) + " " + " ".join(word("good" if quality else "poor") for _ in range(3))
        docs.append((i, text))
        if i < 100:
            labels.append((i, quality, toxic))
    docs += [(900, None), (901, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {x.doc_id: x for x in e.queries()["predicted_labels"](spark, str(tmp_path)).collect()}
    names = ["clean low", "clean high", "toxic low", "toxic high"]
    assert len(got) == 162 and np.mean([got[i].label == names[i % 4] for i in range(100, 160)]) > 0.9
    assert all(got[i].confidence == round(got[i].p, 4) for i in got)
