"""Waves: batches that are appended to an archive of what was seen before, each record
once, with the wave and time of its first sight. The archive is Parquet, a folder a wave,
so a wave that is repeated replaces its own rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ranks
from ..operators.keys import keep_first, unseen
from ..sources.files import exists


class Ledger:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str]):
        self.spark, self.path, self.keys, self.order = spark, path, keys, order

    def seen(self, before: int | None = None) -> DataFrame | None:
        if not exists(self.spark, f"{self.path}/_wave=*"):
            return None
        df = self.spark.read.option("basePath", self.path).parquet(f"{self.path}/_wave=*")
        return df if before is None else df.filter(F.col("_wave") < before)

    def record(self, batch: DataFrame, wave: int, stamp: str) -> None:
        """Append what earlier waves don't hold; of repeated keys the first in order."""
        new = keep_first(batch, self.keys, self.order)
        if (old := self.seen(wave)) is not None:
            new = unseen(new, old, self.keys)
        new.withColumn("_first_seen", F.lit(stamp).cast("timestamp")).write.mode("overwrite").parquet(f"{self.path}/_wave={wave}")

    def summary(self, created: str) -> DataFrame:
        """_wave, n, p10, p50, p90 (hours from creation to first sight, by nearest rank), and
        late: the share created before the stamp of the wave before."""
        df = self.seen().withColumn("hours", (F.unix_timestamp("_first_seen") - F.unix_timestamp(created)) / 3600.0)
        stamps = df.groupBy("_wave").agg(F.max("_first_seen").alias("stamp"), F.count("*").alias("n"))
        prior = stamps.select((F.col("_wave") + 1).alias("_wave"), F.col("stamp").alias("prior"))
        late = df.join(F.broadcast(prior), "_wave", "left").groupBy("_wave").agg(F.avg(F.when(F.col("prior").isNotNull(), (F.col(created) < F.col("prior")).cast("double"))).alias("late"))
        spread = ranks.quantiles(df, ["_wave"], "hours", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, nearest=True).join(stamps.select("_wave", "n"), "_wave")
        return spread.join(late, "_wave")

    def manifest(self) -> DataFrame:
        """_wave, stamp, n (new records), before (records of all earlier waves), and the first
        and last key of each wave: what a wave added, a row for each."""
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in self.keys])
        own = self.seen().groupBy("_wave").agg(F.max("_first_seen").alias("stamp"), F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
        earlier = W.orderBy("_wave").rowsBetween(W.unboundedPreceding, -1)  # over a row for each wave
        return own.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))

    def follow(self, stream: DataFrame, stamp, checkpoint: str):
        """Record each micro-batch of a stream as a wave; stamp: batch number -> time."""
        return stream.writeStream.foreachBatch(lambda df, k: self.record(df, k, stamp(k))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
