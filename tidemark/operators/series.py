"""Daily series, calendars, windows of days, islands and false-discovery control."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ranks


def daily(df: DataFrame, at: str, keys: list[str] | None = None, **measures: Column) -> DataFrame:
    return df.groupBy(*(keys or []), F.to_date(at).alias("date")).agg(F.count("*").alias("n"), *[m.alias(k) for k, m in measures.items()])


def dense(series: DataFrame, keys: list[str] | None = None, fill: tuple[str, ...] = ("n",)) -> DataFrame:
    """The series with a row for every day between the first and last of each key; the
    `fill` columns are 0 where there was none."""
    keys = keys or []
    span = series.groupBy(*keys).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.filter("a IS NOT NULL").select(*keys, F.explode(F.sequence("a", "b")).alias("date"))
    return days.join(series, [*keys, "date"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in fill})


def rolling(value: str, order: str, lo: int, hi: int, full: bool, keys: list[str] | None = None) -> Column:
    """Mean over rows lo..hi; null before the window is full, if asked for."""
    w = W.partitionBy(*(keys or [])).orderBy(order).rowsBetween(lo, hi)
    mean = F.avg(value).over(w)
    return F.when(F.count(F.lit(1)).over(w) == hi - lo + 1, mean) if full else mean


def around(stats: DataFrame, keys: list[str], lo: int, hi: int, end: str) -> DataFrame:
    """stats (date, n, s, q: count, sum, sum of squares) with the sums over the calendar
    days date+lo .. date+hi."""
    w = W.partitionBy(*keys).orderBy("__d").rangeBetween(lo, hi)
    out = stats.withColumn("__d", F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long"))
    return out.withColumns({f"{c}_{end}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in ("n", "s", "q")}).drop("__d")


def welch(n1: Column, s1: Column, q1: Column, n2: Column, s2: Column, q2: Column) -> dict[str, Column]:
    """t, df and Cohen's d of second less first, from counts, sums and sums of squares."""
    v = lambda n, s, q: F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))
    v1, v2, e = v(n1, s1, q1), v(n2, s2, q2), None
    e = v1 / n1 + v2 / n2
    gap = s2 / n2 - s1 / n1
    return {
        "t": F.when(e > 0, gap / F.sqrt(e)),
        "df": F.when(e > 0, e * e / (v1 * v1 / (n1 * n1 * (n1 - 1)) + v2 * v2 / (n2 * n2 * (n2 - 1)))),
        "d": gap / F.greatest(F.sqrt((v1 + v2) / 2), F.lit(1e-9)),
    }


def shift_scan(df: DataFrame, at: str, value: str, keys: list[str], half: int = 3, least: int = 40) -> DataFrame:
    """Each observed day (but the first and last `half`) as a cut: `half` days before
    against the day and the days after it, by daily sums."""
    x = F.col(value).cast("double")
    stats = df.filter(x.isNotNull()).groupBy(*keys, F.to_date(at).alias("date")).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    both = around(around(stats, keys, -half, -1, "a"), keys, 0, half - 1, "b")
    first, last = F.row_number().over(W.partitionBy(*keys).orderBy("date")), F.row_number().over(W.partitionBy(*keys).orderBy(F.col("date").desc()))
    both = both.withColumns({"__f": first, "__l": last}).filter((F.col("__f") > half) & (F.col("__l") > half) & (F.col("n_a") >= least) & (F.col("n_b") >= least))
    return both.select(*keys, "date", "n_a", "n_b", *[c.alias(k) for k, c in welch(*[F.col(c) for c in ("n_a", "s_a", "q_a", "n_b", "s_b", "q_b")]).items()])


def discoveries(tests: DataFrame, p: str, q: float) -> DataFrame:
    """Benjamini-Hochberg: tests with kept. Counts of equal p-values are cumulated, so the
    ordered table is one of distinct p-values."""
    counts = tests.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("__n"))
    ranked = ranks.running(counts, [F.col("__p")], ["__n"]).withColumn("__r", F.col("before___n") + F.col("__n"))
    total = counts.agg(F.sum("__n").alias("__m"))
    limit = ranked.crossJoin(total).filter(F.col("__p") <= q * F.col("__r") / F.col("__m")).agg(F.max("__p").alias("__limit"))
    return tests.crossJoin(F.broadcast(limit)).withColumn("kept", F.coalesce(F.col(p) <= F.col("__limit"), F.lit(False))).drop("__limit")


def islands(df: DataFrame, keys: list[str], date: str, gap: int) -> DataFrame:
    """df with island: the number of its run of rows no more than `gap` days apart."""
    w = W.partitionBy(*keys).orderBy(date)
    df = df.withColumn("__new", (F.coalesce(F.datediff(F.col(date), F.lag(date).over(w)), F.lit(gap + 1)) > gap).cast("int"))
    return df.withColumn("island", F.sum("__new").over(w).cast("long")).drop("__new")


def robust_z(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """df with median, mad and z = (x - median) / scale; scale: 1.4826 mad, else the
    population deviation, else 1. Medians are exact, a row for each key."""
    med = df.groupBy(*keys).agg(F.median(value).alias("median"), F.stddev_pop(value).alias("__sd"))
    on = df.join(med, keys) if keys else df.crossJoin(F.broadcast(med))
    mad = on.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    on = on.join(mad, keys) if keys else on.crossJoin(F.broadcast(mad))
    scale = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).when(F.col("__sd") > 0, F.col("__sd")).otherwise(1.0)
    return on.withColumn("z", (F.col(value) - F.col("median")) / scale).drop("__sd")


def concentration(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, contributors, top1_share, top5_share, gini of the positive values."""
    own = df.filter(F.col(value) > 0)
    ranked = ranks.numbered_within(own, keys, [F.col(value), F.hash(*df.columns)], "__i")
    ranked = ranked.join(ranked.groupBy(*keys).agg(F.max("__i").alias("__n")), keys).withColumn("__j", F.col("__n") - F.col("__i") + 1)
    total, n = F.sum(value), F.count("*")
    return ranked.groupBy(*keys).agg(
        n.alias("contributors"),
        (F.max(value) / total).alias("top1_share"),
        (F.sum(F.when(F.col("__j") <= 5, F.col(value))) / total).alias("top5_share"),
        (2 * F.sum(F.col("__i") * F.col(value)) / (n * total) - (n + 1) / n).alias("gini"),
    )


def change_points(df: DataFrame, keys: list[str], order: str, value: str, least: int = 4, penalty: float | None = None, most: int = 4) -> DataFrame:
    """keys, at (first position after a break), cost-optimal breaks of each series under
    squared error: the exact optimum that pruned search finds. A series is one group of
    daily values; it is the unit that one task holds."""
    import numpy as np

    kinds = dict(df.dtypes)

    def breaks(x: np.ndarray) -> list[int]:
        n = len(x)
        if n < 2 * least:
            return []
        pen = penalty if penalty is not None else 2 * x.var() * np.log(n)
        s, q = np.append(0, np.cumsum(x)), np.append(0, np.cumsum(x * x))
        best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        best[0] = -pen
        for j in range(least, n + 1):
            i = np.array([k for k in range(0, j - least + 1) if k == 0 or k >= least])
            cost = best[i] + q[j] - q[i] - (s[j] - s[i]) ** 2 / (j - i) + pen
            k = int(cost.argmin())
            best[j], back[j] = cost[k], i[k]
        out, j = [], n
        while back[j]:
            j = back[j]
            out.append(j)
        return sorted(out)[:most]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.dropna(subset=[value]).sort_values(order)
        at = breaks(group[value].to_numpy(float))
        out = group.iloc[at][[*keys, order]].rename(columns={order: "at"})
        out["position"] = np.array(at, "int64")
        return out

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"at {kinds[order]}", "position long"]))


def record_shifts(df: DataFrame, cuts: DataFrame, panel: DataFrame, keys: list[str], at: str, value: str, who: str, half: int = 5, least: int = 20) -> DataFrame:
    """keys, who (all or panel), n_before, n_after, delta, d, t: records `half` days before a
    cut (keys, cut) against those from it on, over everybody and over the panel alone, as a
    new contributor would look like a change of mind. One pass, by sums."""
    date, x = F.to_date(at), F.col(value).cast("double")
    near = df.join(F.broadcast(cuts), keys).withColumn("__d", F.datediff(date, "cut")).filter(F.col("__d").between(-half, half - 1) & x.isNotNull())
    near = near.join(panel.select(who, F.lit(True).alias("__in")), who, "left")
    each = near.select(*keys, (F.col("__d") >= 0).alias("__after"), x.alias("__x"), F.explode(F.when(F.col("__in"), F.array(F.lit("all"), F.lit("panel"))).otherwise(F.array(F.lit("all")))).alias("who"))
    part = lambda yes, v: F.when(F.col("__after") == yes, v)
    sums = {f"{k}{int(yes)}": f(part(yes, v)) for yes in (False, True) for k, f, v in (("n", F.count, F.col("__x")), ("s", F.sum, F.col("__x")), ("q", F.sum, F.col("__x") * F.col("__x")))}
    own = each.groupBy(*keys, "who").agg(*[c.alias(k) for k, c in sums.items()]).filter((F.col("n0") >= least) & (F.col("n1") >= least))
    w = welch(*[F.col(c) for c in ("n0", "s0", "q0", "n1", "s1", "q1")])
    return own.select(*keys, "who", F.col("n0").alias("n_before"), F.col("n1").alias("n_after"), F.round(F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0"), 6).alias("delta"), F.round(w["d"], 6).alias("d"), F.round(w["t"], 6).alias("t"))


def poisson_days(daily_counts: DataFrame, n: str) -> DataFrame:
    """date, n, p (the chance of as many or more under the mean), bonferroni, above (three
    deviations): a row for each day. Tails are evaluated for each distinct count."""
    from ..functions.stats import poisson_tail

    @F.pandas_udf("double")
    def tail(k: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series([poisson_tail(int(a), b) for a, b in zip(k, mean, strict=True)], dtype="float64")

    m = daily_counts.agg(F.avg(n).alias("__m"), F.count("*").alias("__days"))
    out = daily_counts.crossJoin(F.broadcast(m)).withColumn("__p", tail(F.col(n), F.col("__m")))
    return out.select("date", F.col(n).alias("n"), F.round("__p", 6).alias("p"), F.round(F.least(F.col("__p") * F.col("__days"), F.lit(1.0)), 6).alias("bonferroni"), ((F.col(n) - F.col("__m")) / F.sqrt("__m") > 3).alias("above"))


def aligned(a: DataFrame, b: DataFrame, fill: dict[str, int]) -> DataFrame:
    """Both series on every date that either has, with `both`; missing values of `fill` as given."""
    j = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), "date", "full")
    return j.withColumn("both", F.coalesce(F.col("__a") & F.col("__b"), F.lit(False))).drop("__a", "__b").na.fill(fill)


def case_profile(df: DataFrame, on: Column, keys: list[str], value: str, flags: dict[str, Column], version: Column, quote: Column, tie: Column) -> DataFrame:
    """keys, n_event, n_rest, change of the mean, the share of each flag on either side,
    has_version, and as quote the record of the largest value on the event's side."""
    x = F.col(value).cast("double")
    out = [F.count_if(on).alias("n_event"), F.count_if(~on).alias("n_rest"), F.round(F.avg(F.when(on, x)) - F.avg(F.when(~on, x)), 6).alias("change")]
    for name, flag in flags.items():
        out += [F.round(F.avg(F.when(c, flag.cast("int"))), 6).alias(f"{name}_{side}") for side, c in (("event", on), ("rest", ~on))]
    best = F.min_by(F.when(on, quote), F.when(on, F.struct((-x).alias("a"), tie.alias("b"))))
    return df.groupBy(*keys).agg(*out, F.count(F.when(on, version)).cast("boolean").alias("has_version"), best.alias("quote"))
