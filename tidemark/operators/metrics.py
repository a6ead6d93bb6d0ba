"""Classification metrics, calibration and correlation from counts and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ranks


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(counts: DataFrame) -> DataFrame:
    """class, support, precision, recall, f1 from confusion counts."""
    each = counts.select(F.explode(F.array(F.struct(F.col("actual").alias("class"), F.col("n").alias("act"), F.lit(0).cast("long").alias("pred")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("act"), F.col("n").alias("pred")))).alias("x"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    sums = each.groupBy("x.class").agg(F.sum("x.act").alias("support"), F.sum("x.pred").alias("claimed"), (F.sum("hit") / 2).alias("hits"))
    p, r = F.coalesce(F.try_divide("hits", "claimed"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    return sums.select("class", "support", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def summary(counts: DataFrame) -> DataFrame:
    """n, accuracy, macro_f1, weighted_f1, kappa, mcc: one row."""
    k = class_metrics(counts)
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    a = counts.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("a"))
    p = counts.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("p"))
    margins = a.join(p, "class", "full").select(F.coalesce("a", F.lit(0)).cast("double").alias("a"), F.coalesce("p", F.lit(0)).cast("double").alias("p"))
    margins = margins.agg(F.sum(F.col("a") * F.col("p")).alias("ap"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    f = k.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    row = total.crossJoin(margins).crossJoin(f)
    n, hit = F.col("n").cast("double"), F.col("hit").cast("double")
    return row.select(
        "n",
        (hit / n).alias("accuracy"),
        "macro_f1",
        "weighted_f1",
        F.coalesce(F.try_divide(hit / n - F.col("ap") / (n * n), 1 - F.col("ap") / (n * n)), F.lit(0.0)).alias("kappa"),
        F.coalesce(F.try_divide(hit * n - F.col("ap"), F.sqrt((n * n - F.col("pp")) * (n * n - F.col("aa")))), F.lit(0.0)).alias("mcc"),
    )


def by_name(counts: DataFrame, name: str) -> DataFrame:
    """name, n, accuracy, macro_f1 of the confusion counts of many models at once."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    side = lambda c: F.struct(F.col(c).alias("class"), F.when(F.lit(c == "actual"), F.col("n")).otherwise(0).alias("act"), F.when(F.lit(c == "actual"), hit).otherwise(0).alias("hit"))
    each = counts.select(name, "n", F.explode(F.array(side("actual"), side("predicted"))).alias("x"))
    per = each.groupBy(name, "x.class").agg(F.sum("n").alias("both"), F.sum("x.act").alias("act"), F.sum("x.hit").alias("hit"))
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("both")), F.lit(0.0))
    return per.groupBy(name).agg(F.sum("act").alias("n"), (F.sum("hit") / F.sum("act")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def pairs_confused(counts: DataFrame) -> DataFrame:
    """actual, predicted, n, share of the actual class, for what was confused."""
    share = F.col("n") / F.sum("n").over(W.partitionBy("actual"))
    return counts.withColumn("share", share).filter("actual <> predicted")


def auc(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """auc by the rank sum, ties at their mean rank: one row."""
    counts = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.count_if(positive).alias("p"))
    sums = ranks.running(counts, [F.col("s")], ["n"]).withColumn("r", F.col("before_n") + (F.col("n") + 1) / 2).agg(F.sum(F.col("p") * F.col("r")).alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return sums.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))


def calibration(df: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """bin, n, confidence, accuracy, gap."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    out = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg(correct.cast("double")).alias("accuracy"))
    return out.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def threshold_grid(df: DataFrame, actual: str, score: str, lo: int, hi: int) -> DataFrame:
    """tau (lo..hi hundredths), n, hits of the rule score >= tau against a 0/1 label: scores
    are counted by hundredth first, and the few counts are cumulated for every threshold."""
    cell = df.groupBy(F.floor(F.round(F.col(score) * 100, 6)).cast("int").alias("cell"), F.col(actual).cast("int").alias("y")).agg(F.count("*").alias("n"))
    taus = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("tau"))
    said = (F.col("cell") >= F.col("tau")).cast("int")
    return cell.crossJoin(F.broadcast(taus)).groupBy("tau").agg(F.sum("n").alias("n"), F.sum(F.when(said == F.col("y"), F.col("n")).otherwise(0)).alias("hits"))


def correlation(x: str, y: str) -> Column:
    """Pearson's r, null where either side is constant."""
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho and n over the rows that have both: Pearson's r of mid ranks, from counts of pairs."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("k"))
    rank = lambda c: ranks.mid_ranks(pairs, c, weight="k").select(c, F.col("mid_rank").alias(f"r{c}"))
    j = pairs.join(rank("x"), "x").join(rank("y"), "y")
    w = F.col("k")
    m = j.agg(F.sum(w).alias("n"), *[F.sum(w * c).alias(name) for name, c in {"sx": F.col("rx"), "sy": F.col("ry"), "xx": F.col("rx") * F.col("rx"), "yy": F.col("ry") * F.col("ry"), "xy": F.col("rx") * F.col("ry")}.items()])
    n = F.col("n")
    spread = (n * F.col("xx") - F.col("sx") * F.col("sx")) * (n * F.col("yy") - F.col("sy") * F.col("sy"))
    return m.select(F.when(spread > 0, (n * F.col("xy") - F.col("sx") * F.col("sy")) / F.sqrt(spread)).alias("rho"), n.alias("n"))


def best_threshold(df: DataFrame, actual: str, score: str, lo: int, hi: int, keys: list[str] | None = None) -> DataFrame:
    """keys, tau (hundredths): the least of the thresholds with the most hits of score >= tau
    against a 0/1 label; scores are counted by hundredth first."""
    keys = keys or []
    cell = df.groupBy(*keys, F.floor(F.round(F.col(score) * 100, 6)).cast("int").alias("cell"), F.col(actual).cast("int").alias("y")).agg(F.count("*").alias("n"))
    taus = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("tau"))
    hit = (F.col("cell") >= F.col("tau")).cast("int") == F.col("y")
    hits = cell.crossJoin(F.broadcast(taus)).groupBy(*keys, "tau").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("hits"))
    return hits.groupBy(*keys).agg(F.min_by("tau", F.struct(-F.col("hits"), "tau")).alias("tau"))
