"""Calibrated linear classification as a pyspark.ml estimator: fitted on all rows, with
probabilities from margins that were made out of fold; saved and loaded like any other."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks
from .linear import STEPS, Problem, fit, margins


def sigmoids(rows: DataFrame, curves: list[tuple[str, str]], steps: int = 30) -> list[tuple[float, float]]:
    """For each (margin, hit) pair of columns the a, b of the most likely 1 / (1 + exp(a m + b)),
    targets drawn in by the counts of both classes: Newton's method with backtracking, all
    curves in the same job a step."""
    k = len(curves)
    counts = rows.agg(*[F.count_if(h).alias(f"p{i}") for i, (_, h) in enumerate(curves)], F.count("*").alias("n")).first()
    hits = np.array([counts[f"p{i}"] for i in range(k)], float)
    high, low = (hits + 1) / (hits + 2), 1 / (counts.n - hits + 2)

    def sums(at: np.ndarray) -> np.ndarray:
        out = []
        for i, (margin, h) in enumerate(curves):
            m, t = F.col(margin), F.when(F.col(h), float(high[i])).otherwise(float(low[i]))
            z = float(at[i, 0]) * m + float(at[i, 1])
            p = 1 / (1 + F.exp(z))
            s = p * (1 - p)
            out += [F.sum(x) for x in (t * z + F.when(z > 0, F.log1p(F.exp(-z))).otherwise(-z + F.log1p(F.exp(z))), (t - p) * m, t - p, s * m * m, s * m, s)]
        return np.array([x or 0.0 for x in rows.agg(*[c.alias(f"s{j}") for j, c in enumerate(out)]).first()]).reshape(k, 6)

    at = np.stack([np.zeros(k), np.log((counts.n - hits + 1) / (hits + 1))], 1)
    now = sums(at)
    for _ in range(steps):
        if np.abs(now[:, 1:3]).max() < 1e-6:
            break
        _, ga, gb, haa, hab, hbb = now.T
        haa, hbb = haa + 1e-12, hbb + 1e-12
        det = haa * hbb - hab * hab
        move = np.stack([-(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det], 1)
        size = np.ones((k, 1))
        while True:
            new = sums(at + size * move)
            bad = (new[:, :1] > now[:, :1] + 1e-4 * size * (now[:, 1:3] * move).sum(1, keepdims=True) + 1e-12) & (size > 0)
            if not bad.any():
                break
            size = np.where(bad, np.where(size > 1e-6, size / 2, 0), size)
        if not size.any():
            break
        at, now = at + size * move, new
    return [(float(a), float(b)) for a, b in at]


class Settings(Params):
    loss = Param(Params._dummy(), "loss", "modified_huber, squared_hinge or logistic", TypeConverters.toString)
    reg = Param(Params._dummy(), "reg", "strength of the regularisation", TypeConverters.toFloat)
    folds = Param(Params._dummy(), "folds", "folds whose margins calibrate", TypeConverters.toInt)
    labelCol = Param(Params._dummy(), "labelCol", "the class, a text", TypeConverters.toString)
    groupCol = Param(Params._dummy(), "groupCol", "rows with an equal value share a fold", TypeConverters.toString)
    steps = Param(Params._dummy(), "steps", "steps of the optimiser", TypeConverters.toInt)

    def __init__(self, **settings):
        super().__init__()
        self._setDefault(loss="modified_huber", reg=1e-3, folds=5, labelCol="label", groupCol="text", steps=STEPS)
        self._set(**settings)


class CalibratedLinear(Settings, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """One class against the rest, fitted once on all rows; probabilities by a sigmoid a
    class from margins of folds that each model had not seen, normalised to one."""

    def _fit(self, df: DataFrame):
        get = self.getOrDefault
        names = sorted(r[0] for r in df.select(get("labelCol")).distinct().collect() if r[0] is not None)  # a row a class
        known = df.filter(F.col(get("labelCol")).isNotNull())
        label = F.array_position(F.array(*[F.lit(x) for x in names]), F.col(get("labelCol"))) - 1
        rows = ranks.folds(known.select(F.col(get("groupCol")).alias("text"), label.cast("int").alias("class"), "idx", "val"), "text", "class", get("folds")).drop("text").persist()
        size = (rows.agg(F.max(F.array_max("idx"))).first()[0] or 0) + 1
        problems = [Problem(get("loss"), get("reg")), *(Problem(get("loss"), get("reg"), k) for k in range(get("folds")))]
        w = fit(rows, problems, len(names), size, get("steps"))
        apart = margins(rows, w[1:], by_fold=True).select("class", "margins").persist()
        each = apart.select(*[F.get("margins", F.lit(c)).alias(f"m{c}") for c in range(len(names))], *[(F.col("class") == c).alias(f"h{c}") for c in range(len(names))])
        curves = sigmoids(each, [(f"m{c}", f"h{c}") for c in range(len(names))])
        rows.unpersist()
        apart.unpersist()
        return CalibratedLinearModel(names, w[0], curves)


class CalibratedLinearModel(Model, MLReadable, MLWritable):
    """Adds p (a probability for each of `names`), label and confidence."""

    def __init__(self, names: list[str], weights: np.ndarray, curves: list[tuple[float, float]]):
        super().__init__()
        self.names, self.weights, self.curves = names, weights, curves

    def _transform(self, df: DataFrame) -> DataFrame:
        size = self.weights.shape[1] - 1
        inside = df.withColumns({"__i": F.col("idx"), "__v": F.col("val")}).withColumns({"idx": F.filter("__i", lambda i: i < size), "val": F.transform(F.filter(F.arrays_zip("__i", "__v"), lambda x: x["__i"] < size), lambda x: x["__v"])})
        out = margins(inside, self.weights, "__m").withColumns({"idx": F.col("__i"), "val": F.col("__v")}).drop("__i", "__v")
        raw = F.array(*[1 / (1 + F.exp(F.lit(a) * F.get("__m", F.lit(c)) + F.lit(b))) for c, (a, b) in enumerate(self.curves)])
        out = out.withColumn("__q", raw).drop("__m")
        total = F.aggregate("__q", F.lit(0.0), lambda s, x: s + x)
        out = out.withColumn("p", F.transform("__q", lambda x: F.when(total > 0, x / total).otherwise(1.0 / len(self.names)))).drop("__q")
        best = F.array_max("p")
        return out.withColumns({"label": F.element_at(F.array(*[F.lit(x) for x in self.names]), F.array_position("p", best).cast("int")), "confidence": F.round(best, 4)})

    def write(self):
        return Writer(self)

    @classmethod
    def read(cls):
        return Reader()


class Writer(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        rows = [(i, x, *self.model.curves[i], self.model.weights[i].tolist()) for i, x in enumerate(self.model.names)]
        self.sparkSession.createDataFrame(rows, "class int, name string, a double, b double, weights array<double>").write.parquet(f"{path}/data")


class Reader(MLReader):
    def load(self, path: str):
        rows = self.sparkSession.read.parquet(f"{path}/data").orderBy("class").collect()  # a row a class
        model = CalibratedLinearModel([r.name for r in rows], np.array([r.weights for r in rows]), [(r.a, r.b) for r in rows])
        model._resetUid(DefaultParamsReader.loadMetadata(path, self.sparkSession)["uid"])
        return model
