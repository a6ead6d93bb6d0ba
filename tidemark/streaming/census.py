"""A running census of a stream beside a uniform sample of fixed size for each stratum.

Both are state of the stream itself (transformWithState): a value for the counts and sums
of a stratum and a list for its sample, in Spark's state store, so that a batch reads and
writes the strata that its rows belong to and no others, and a restarted query goes on
from the last batch that was committed. When the watermark has passed the end of a stratum
(of a day, say) a timer hands its row on and clears its state; rows that come later still
are dropped by the watermark. Strata that are open can be read from the checkpoint at any
time, by Spark's own reader of state.

The sample is the k rows of smallest salted hash: uniform over the stratum, whatever order
its rows come in, and the same however the stream is cut into batches. A stratum may hold
a large part of all rows: it is kept in `salts` parts, whose counts add up and whose
samples merge.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from ..sources.files import exists

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Counting(StatefulProcessor):
    """Of one part of a stratum: the counts so far, the sample, and the end as a timer."""

    def __init__(self, group: list[str], measures: list[str], kept: list[str], k: int, counts: str, sample: str):
        self.group, self.measures, self.kept, self.k = group, measures, kept, k
        self.counts_schema, self.sample_schema = counts, sample

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", self.counts_schema)
        self.sample = handle.getListState("sample", self.sample_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        held = self.counts.get() if self.counts.exists() else None
        n, sums, edge = (held[0], list(held[1:-1]), held[-1]) if held else (0, [0, 0.0] * len(self.measures), None)
        near, end = [], None
        for part in rows:
            n += len(part)
            for i, m in enumerate(self.measures):
                known = part[m].dropna()
                sums[2 * i], sums[2 * i + 1] = sums[2 * i] + len(known), sums[2 * i + 1] + float(known.sum())
            end = part["tm_end"].iloc[0]
            near.append(part if edge is None else part[part["tm_draw"] < edge])
        drawn = pd.concat(near)[["tm_draw", *self.kept]]
        if len(drawn):
            old = pd.DataFrame(list(self.sample.get()), columns=drawn.columns) if held else drawn[:0]
            both = (pd.concat([old, drawn]) if len(old) else drawn).sort_values(["tm_draw", *self.kept], kind="stable")[: self.k]
            self.sample.put([tuple(x) for x in both.astype(object).itertuples(index=False)])
            edge = both["tm_draw"].iloc[-1] if len(both) == self.k else None
        self.counts.update((n, *sums, edge))
        if end is not None and not pd.isna(end) and not held:
            self.handle.registerTimer(int(end))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        held, drawn = self.counts.get(), list(self.sample.get())
        self.counts.clear()
        self.sample.clear()
        names = [*self.group, "n", *(f"{c}_{m}" for m in self.measures for c in ("known", "total"))]
        out = pd.DataFrame([[*key, *held[:-1]]], columns=names)
        out["sample"] = [[dict(zip(("tm_draw", *self.kept), x, strict=True)) for x in drawn]]
        yield out

    def close(self) -> None:
        pass


class Census:
    """strata: columns; at: the event time; end: when a stratum ends, a time made from the
    strata; unique and kept: columns of the sampled rows, of which the first decide the draw."""

    def __init__(self, spark: SparkSession, path: str, strata: Sequence[str], unique: Sequence[str], measures: Sequence[str], at: str, end: Column, kept: Sequence[str] = (), k: int = 80, salts: int = 8, late: str | None = "1 day", seed: str = "42"):
        self.spark, self.path, self.strata, self.unique, self.measures = spark, path, list(strata), list(unique), list(measures)
        self.at, self.end, self.kept, self.k, self.salts, self.late, self.seed = at, end, [*unique, *(c for c in kept if c not in unique)], k, salts, late, seed

    @property
    def closed(self) -> str:
        return f"{self.path}/closed"

    @property
    def checkpoint(self) -> str:
        return f"{self.path}/checkpoint"

    def _schemas(self, stream: DataFrame) -> tuple[StructType, str, str]:
        """Of the rows handed on, the counts and the sample."""
        kinds = dict(stream.dtypes)
        sample = ", ".join(["tm_draw string", *(f"{c} {kinds[c]}" for c in self.kept)])
        counts = ", ".join(["n long", *(f"{x} {kind}" for m in self.measures for x, kind in ((f"known_{m}", "long"), (f"total_{m}", "double")))])
        group = ", ".join(f"{c} {kinds[c]}" for c in self.strata)
        return StructType.fromDDL(f"{group}, tm_salt int, {counts}, sample array<struct<{sample.replace(' ', ':').replace(',:', ',')}>>"), f"{counts}, edge string", sample

    def counted(self, stream: DataFrame) -> DataFrame:
        """The stream of strata that have ended, in parts."""
        if lost := [c for c, kind in stream.dtypes if c in self.kept and kind.startswith(("struct", "array", "map"))]:
            raise ValueError(f"sampled columns must be plain: {', '.join(lost)}")
        out, counts, sample = self._schemas(stream)
        draw = F.md5(F.concat_ws("|", F.lit(self.seed), *[F.col(c).cast("string") for c in self.unique]))
        salt = F.pmod(F.xxhash64(F.lit("salt"), *self.unique), F.lit(self.salts)).cast("int")
        timed = stream.withWatermark(self.at, self.late) if self.late else stream
        rows = timed.withColumns({"tm_draw": draw, "tm_salt": salt, "tm_end": F.unix_millis(self.end) if self.late else F.lit(None).cast("long"), **{m: F.col(m).cast("double") for m in self.measures if m not in self.kept}})
        group = [*self.strata, "tm_salt"]
        processor = _Counting(group, self.measures, self.kept, self.k, counts, sample)
        return rows.select(*dict.fromkeys([*group, "tm_draw", "tm_end", self.at, *self.measures, *self.kept])).groupBy(*group).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime" if self.late else "None")

    def follow(self, stream: DataFrame, **trigger):
        """Start counting; by default to the end of what is there."""
        had = self.spark.conf.get(PROVIDER)
        self.spark.conf.set(PROVIDER, ROCKSDB)  # the only store with several states a key
        try:
            run = self.counted(stream).writeStream.outputMode("append").format("parquet").option("path", self.closed).option("checkpointLocation", self.checkpoint)
            return run.trigger(**(trigger or {"availableNow": True})).start()
        finally:
            self.spark.conf.set(PROVIDER, had)

    def read(self) -> tuple[DataFrame, DataFrame]:
        """The census (strata, n, known_ and total_ of each measure) and the sample, of the
        strata that have ended and of those that are open."""
        if not exists(self.spark, f"{self.checkpoint}/state"):
            raise FileNotFoundError(f"no batch has been counted under {self.path}")
        state = lambda name: self.spark.read.format("statestore").option("stateVarName", name).load(self.checkpoint)
        key = [F.col(f"key.{c}").alias(c) for c in self.strata]
        counts = state("counts").select(*key, "value.*").drop("edge")
        drawn = state("sample").select(*key, "list_element.*")
        if exists(self.spark, f"{self.closed}/_spark_metadata"):
            done = self.spark.read.parquet(self.closed)
            counts = done.select(*counts.columns).unionByName(counts)
            drawn = done.select(*self.strata, F.explode("sample").alias("x")).select(*self.strata, "x.*").unionByName(drawn)
        census = counts.groupBy(*self.strata).agg(*[F.sum(c).alias(c) for c in counts.columns if c not in self.strata])
        drawn = drawn.groupBy(*self.strata).agg(F.slice(F.array_sort(F.collect_list(F.struct("tm_draw", *self.kept))), 1, self.k).alias("x"))  # k rows a part
        return census, drawn.select(*self.strata, F.explode("x").alias("x")).select(*self.strata, "x.*").drop("tm_draw")


def fraction(n: Column, census: Column) -> Column:
    return F.least(F.try_divide(n, census), F.lit(1.0))
