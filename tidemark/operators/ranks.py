"""Ranks over a whole table without a single-partition window, and ranks within groups."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_dir


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with positions 1.. in a total order. Ranges of the order are sorted apart, and
    the offsets of the ranges (a row each) are added. The sorted rows are checkpointed,
    since ranges are drawn from a sample and must not be drawn anew between both uses."""
    shared_dir(df.sparkSession)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()).checkpoint()
    rows = rows.withColumn("__p", F.shiftright("__m", 33))
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    at = F.col("__before") + F.col("__m") - F.shiftleft(F.col("__p"), 33) + 1
    return rows.join(F.broadcast(offsets), "__p").withColumn(name, at.cast("long")).drop("__m", "__p", "__before")


def running(df: DataFrame, order: list[Column], values: list[str]) -> DataFrame:
    """df with before_<value>: the sum of a value over all rows before, in a total order.
    Ranges of the order are summed apart, and the offsets of the ranges (a row each) added."""
    shared_dir(df.sparkSession)
    rows = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).checkpoint()
    within = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("__range").agg(*[F.sum(v).alias(f"__sum_{v}") for v in values])
    earlier = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # over a row for each range
    offsets = sums.select("__range", *[F.coalesce(F.sum(f"__sum_{v}").over(earlier), F.lit(0)).alias(f"__sum_{v}") for v in values])
    out = rows.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values})
    return out.join(F.broadcast(offsets), "__range").withColumns({f"before_{v}": F.col(f"before_{v}") + F.col(f"__sum_{v}") for v in values}).drop("__range", *[f"__sum_{v}" for v in values])


def numbered_within(df: DataFrame, group: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """df with positions 1.. in a total order within each group: numbered as a whole, less
    what comes before the group. However large a group, no task sorts it alone."""
    rows = numbered(df, [*map(F.col, group), *order], "__spot")
    sizes = rows.groupBy(*group).agg(F.min("__spot").alias("__first"))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    starts = sizes.select("__first", *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)])
    return rows.join(starts, reduce(and_, same)).withColumn(name, F.col("__spot") - F.col("__first") + 1).drop("__spot", "__first", *[f"__g{i}" for i in range(len(group))])


def global_ranks(df: DataFrame, value: Column, ties: list[Column], tiles: int, descending: bool = True) -> DataFrame:
    """df with tile (as ntile(tiles) in descending or ascending order, ties by the given
    columns) and percent_rank (ascending by the value, nulls first)."""
    df = df.withColumn("__v", value)
    order = [F.col("__v").desc() if descending else F.col("__v").asc(), *ties]
    rows = numbered(df, order, "__at")
    # Of equal values the rank counts those below: all rows less the last position of the value (descending).
    ends = rows.groupBy("__v").agg(F.max("__at").alias("__last"), F.min("__at").alias("__first"), F.count("*").alias("__same"))
    total = rows.agg(F.count("*").alias("__all"))
    out = rows.join(ends.withColumnRenamed("__v", "__w"), F.col("__v").eqNullSafe(F.col("__w"))).crossJoin(F.broadcast(total))
    below = F.col("__all") - F.col("__last") if descending else F.col("__first") - 1
    size, extra = F.floor(F.col("__all") / tiles), F.col("__all") % tiles
    tile = F.when(F.col("__at") <= extra * (size + 1), F.floor((F.col("__at") - 1) / (size + 1))).otherwise(extra + F.floor((F.col("__at") - 1 - extra * (size + 1)) / F.greatest(size, F.lit(1)))) + 1
    rank = F.when(F.col("__all") > 1, below / (F.col("__all") - 1)).otherwise(F.lit(0.0))
    return out.withColumns({"tile": tile.cast("int"), "percent_rank": rank}).drop("__v", "__w", "__at", "__last", "__first", "__same", "__all")


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k rows a group before the shuffle."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("__r") <= k).drop("__r")


def mid_ranks(df: DataFrame, value: str, group: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """value, n, mid_rank: the average rank of each distinct value (of each group), over
    counts of values; a row counts `weight` times."""
    group = group or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    ranked = running(counts, [F.col(c) for c in (*group, value)], ["n"])
    if group:
        ranked = ranked.join(ranked.groupBy(*group).agg(F.min("before_n").alias("__first")), group).withColumn("before_n", F.col("before_n") - F.col("__first")).drop("__first")
    return ranked.withColumn("mid_rank", F.col("before_n") + (F.col("n") + 1) / 2).drop("before_n")


def quota_sample(df: DataFrame, strata: list[str], unique: list[str], k: int, seed: str = "42") -> DataFrame:
    """At most k rows of each stratum, drawn by salted hash: uniform, repeatable, and the
    same however the rows are dealt out."""
    draw = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in unique]))
    return top_k(df.withColumn("__d", draw), strata, [F.col("__d"), *[F.col(c) for c in unique]], k).drop("__d")


def folds(df: DataFrame, text: str, label: str, k: int, seed: str = "42") -> DataFrame:
    """df with fold 0..k-1; equal texts share a fold and labels spread evenly over folds."""
    units = df.groupBy(text).agg(F.min(label).alias("__l"))
    units = numbered_within(units.withColumn("__h", F.md5(F.concat(F.lit(seed), F.col(text)))), ["__l"], [F.col("__h"), F.col(text)], "__at")
    return df.join(units.select(text, ((F.col("__at") - 1) % k).cast("int").alias("fold")), text)


def quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float], nearest: bool = False) -> DataFrame:
    """group and the exact quantiles of a value, interpolated as percentile does or, with
    `nearest`, the value at place floor(n * share) from 0; from counts of distinct values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    ranked = running(counts, [F.col(c) for c in (*group, value)], ["n"])
    whole = ranked.groupBy(*group).agg(F.min("before_n").alias("__first"), F.sum("n").alias("__all"))
    ranked = (ranked.join(whole, group) if group else ranked.crossJoin(F.broadcast(whole))).withColumn("__lo", F.col("before_n") - F.col("__first"))
    holds = lambda at: F.max(F.when((at >= F.col("__lo")) & (at < F.col("__lo") + F.col("n")), F.col(value)))
    out = {}
    for name, q in shares.items():
        if nearest:
            out[name] = holds(F.floor(F.col("__all") * q))
        else:
            at = (F.col("__all") - 1) * q
            low, up = holds(F.floor(at)), holds(F.ceil(at))
            out[name] = low + (up - low) * F.max(at - F.floor(at))
    return ranked.groupBy(*group).agg(*[c.alias(k) for k, c in out.items()])


def cumulative_share(df: DataFrame, value: str, ties: list[Column]) -> DataFrame:
    """df with share: what rows hold of the sum of a value, from the largest down to each."""
    total = df.agg(F.sum(value).alias("__all"))
    rows = running(df, [F.col(value).desc(), *ties], [value]).crossJoin(F.broadcast(total))
    return rows.withColumn("share", F.try_divide(F.col(f"before_{value}") + F.col(value), F.col("__all"))).drop(f"before_{value}", "__all")


def holdout(df: DataFrame, text: str, label: str, share: float, seed: str = "42") -> DataFrame:
    """df with held: a share of the distinct texts of each label, drawn by hash; equal texts
    are on one side, so nothing leaks."""
    units = df.groupBy(text).agg(F.min(label).alias("__l"))
    units = numbered_within(units.withColumn("__h", F.md5(F.concat(F.lit(seed), F.col(text)))), ["__l"], [F.col("__h"), F.col(text)], "__k")
    total = units.groupBy("__l").agg(F.max("__k").alias("__n"))
    return df.join(units.join(total, "__l").select(text, (F.col("__k") <= share * F.col("__n")).alias("held")), text)


def leaks(df: DataFrame, text: str, part: str) -> DataFrame:
    """The texts that stand in more than one part of a split: none, if it is sound."""
    return df.groupBy(text).agg(F.count_distinct(part).alias("parts")).filter("parts > 1")
