"""Event-time windows over streams, run to the end of what is there."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def events_stream(spark: SparkSession, folder: str, schema: str, name: str = "events") -> DataFrame:
    """The files of a table as a stream; its zone-less times as instants."""
    df = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return df.withColumns({c: F.col(c).cast("timestamp") for c, k in df.dtypes if k == "timestamp_ntz"})


def tumbling(stream: DataFrame, at: str, width: str, keys: list[str], late: str = "1 day") -> DataFrame:
    w = F.window(at, width)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(stream: DataFrame, at: str, width: str, step: str, late: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(stream: DataFrame, at: str, gap: str, keys: list[str], late: str = "1 day") -> DataFrame:
    w = F.session_window(at, gap)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_sights(stream: DataFrame, at: str, keys: list[str], late: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def drained(result: DataFrame, mode: str = "complete") -> DataFrame:
    """The result once all that is there has been read: each batch is written to the
    shared folder, and the last complete one, or all appended ones, are returned."""
    spark = result.sparkSession
    base = f"{shared_dir(spark)}/tidemark-stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def put(df: DataFrame, k: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/batch={k}")
        last.append(k)

    run = result.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    if not last:
        return spark.createDataFrame([], result.schema)
    paths = [f"{base}/out/batch={last[-1]}"] if mode == "complete" else [f"{base}/out/batch={k}" for k in last]
    return spark.read.schema(result.schema).parquet(*paths)


def finished(run) -> list:
    """Wait until a running query has read all that its sources have, and stop it; where
    each source ended. For sources that bound their batches themselves."""
    try:
        run.processAllAvailable()
        ends = [[x["endOffset"] for x in json.loads(p.json)["sources"]] for p in run.recentProgress]
        return next((x for x in reversed(ends) if any(x)), [])
    finally:
        run.stop()


def followed(stream: DataFrame) -> tuple[DataFrame, list]:
    """The rows of a stream, batch by batch through a sink that counts each batch once, and
    where its sources ended."""
    base = f"{shared_dir(stream.sparkSession)}/tidemark-stream-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(processingTime="0 seconds").start()
    ends = finished(run)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out"), ends
