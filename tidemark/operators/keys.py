"""Joins, duplicates and set comparisons by key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_dir
from . import ranks


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child without a parent; a null key is an orphan."""
    return child.join(parent.select(F.col(parent_key).alias("__k")).distinct(), F.col(child_key) == F.col("__k"), "left_anti")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in a total order. Aggregates before the shuffle,
    so a hot key reaches its reducer as one row for each task."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__r"))
    return best.select(*keys, "__r.*").select(*df.columns)


def copies(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: the keys that stand twice or more."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def conflicts(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """keys, n, labels: repeated keys whose label differs between the copies."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels")).filter("n > 1 AND labels > 1")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equality as multisets of rows, by one hash sum a side and no shuffle of rows."""
    if a.columns != b.columns:
        return False

    def digest(df: DataFrame):
        h = [F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), F.lit(s)) for s in (1, 2)]
        return df.select(*[x.cast("decimal(38,0)").alias(f"h{i}") for i, x in enumerate(h)]).agg(F.count("*"), F.sum("h0"), F.sum("h1")).first()

    return digest(a) == digest(b)


def interval_join(left: DataFrame, right: DataFrame, at: str, lo: str, hi: str, width: int, on: Sequence[str] = ()) -> DataFrame:
    """Rows of left (a number `at`) with the rows of right whose [lo, hi] holds it and whose
    `on` columns are equal. Both sides meet in buckets of the given width, an equi join, so no
    side must be small; each interval is repeated for the buckets that it touches."""
    spread = right.filter(F.col(lo) <= F.col(hi)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return left.withColumn("__b", F.floor(F.col(at) / width)).join(spread, [*on, "__b"]).filter((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))).drop("__b")


def first_within(points: DataFrame, spans: DataFrame, on: Sequence[str], at: str, lo: str, hi: str, span: str, item: str, k: int) -> DataFrame:
    """span, item: for each of spans (span, on, lo, hi) the k least distinct items of those
    points (on, at, item) whose `on` is equal and whose `at` is within [lo, hi], without a row
    for each pair. Points are numbered by (on, at), so a span is a run of numbers, which two
    runs of 2 ** j numbers cover; of every such run the k least are known from its halves. So
    a span meets 2 k items, however many points it holds, and points cost a row for each j."""
    shared_dir(points.sparkSession)
    # Items by their place in order, which is all that the runs carry.
    items = ranks.numbered(points.select(F.col(item).alias("__item")).distinct(), [F.col("__item")], "__i").checkpoint()
    own = points.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*on, at]])).join(items, F.col(item) == F.col("__item"))
    asked = spans.filter(F.col(lo) <= F.col(hi)).select(*on, lo, hi).distinct()
    edge = lambda c, order: asked.select(*on, F.col(c).alias("__t"), F.lit(order).alias("__o"), F.lit(0).alias("__n"), F.lit(None).cast("long").alias("__i"), F.col(lo).alias("__lo"), F.col(hi).alias("__hi"))
    rows = edge(lo, 0).unionByName(edge(hi, 2)).unionByName(own.select(*on, F.col(at).alias("__t"), F.lit(1).alias("__o"), F.lit(1).alias("__n"), "__i"), allowMissingColumns=True)
    rows = ranks.running(rows, [*map(F.col, on), F.col("__t"), F.col("__o"), F.col("__i"), F.col("__lo"), F.col("__hi")], ["__n"]).checkpoint()
    both = rows.filter("__o <> 1").groupBy(*on, "__lo", "__hi").agg(F.min("before___n").alias("__a"), F.max("before___n").alias("__b")).filter("__a < __b")
    both = both.withColumn("__j", F.length(F.bin(F.col("__b") - F.col("__a"))) - 1).checkpoint()
    last = both.agg(F.max("__j")).first()[0]
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__x")))), 1, k)  # of two rows
    runs = level = rows.filter("__o = 1").select(F.col("before___n").alias("__p"), F.array("__i").alias("__x"), F.lit(0).alias("__j"))
    for j in range(1, (last or 0) + 1):
        later = level.select((F.col("__p") - (1 << (j - 1))).alias("__p"), "__x").filter("__p >= 0")
        halves = level.select("__p", "__x").unionByName(later).groupBy("__p").agg(least.alias("__x"), F.count("*").alias("__n"))
        level = halves.filter("__n = 2").select("__p", "__x", F.lit(j).alias("__j")).checkpoint()
        runs = runs.unionByName(level)
    ends = F.explode(F.array("__a", F.col("__b") - F.pow(F.lit(2), F.col("__j")).cast("long"))).alias("__p")
    met = both.select(*on, "__lo", "__hi", "__j", ends).join(runs, ["__j", "__p"]).groupBy(*on, "__lo", "__hi").agg(least.alias("__x"))
    known = met.select(*on, F.col("__lo").alias(lo), F.col("__hi").alias(hi), F.explode("__x").alias("__i")).join(items, "__i")
    return spans.select(span, *on, lo, hi).join(known, [*on, lo, hi]).select(span, F.col("__item").alias(item))


def contains_first(text: Column, names: dict[str, str], default: str = "") -> Column:
    """The value of the first name, longest names first, that the text contains."""
    ordered = sorted(names.items(), key=lambda x: -len(x[0]))
    return F.coalesce(*[F.when(F.contains(text, F.lit(name)), F.lit(value)) for name, value in ordered], F.lit(default))


def union_all(*frames: DataFrame) -> DataFrame:
    """By name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unseen(batch: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of batch whose key is not in seen, once each."""
    return batch.dropDuplicates(keys).join(seen.select(*keys), keys, "left_anti")


def rest_of_group(df: DataFrame, group: list[str], part: list[str], value: str) -> DataFrame:
    """For each part of a group, count, mean and variance of the part and of the rest of
    its group, from sums alone: no join of a table with itself."""
    x = F.col(value).cast("double")
    own = df.groupBy(*group, *part).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    w = W.partitionBy(*group)
    out = own.withColumns({f"{k}_rest": F.sum(k).over(w) - F.col(k) for k in ("n", "s", "q")})
    for end in ("", "_rest"):
        n, s, q = F.col("n" + end), F.col("s" + end), F.col("q" + end)
        out = out.withColumns({"mean" + end: F.try_divide(s, n), "var" + end: F.when(n > 1, (q - s * s / n) / (n - 1))})
    return out.drop("s", "q", "s_rest", "q_rest")


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """Whether two tables hold the same set of keys, nulls included: by hash sums of the
    distinct keys, without a join."""
    return same_rows(a.select(*keys).distinct(), b.select(*keys).distinct())
