"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch sent to a Python worker; whole texts are never cut.
ARROW_BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession, limit: int = ARROW_BATCH_BYTES) -> None:
    """Bound the Arrow batches handed to Python workers, so that a worker's memory
    depends on a few long texts and not on ten thousand of them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; set here
    only where the session has none (tests on one machine)."""
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(conf)
        return conf.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    import tempfile

    own = tempfile.mkdtemp(prefix="tidemark-")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: a reliable checkpoint, which
    cuts the lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return what was written; unlike
    `cut` its columns can be read apart from each other."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _made.append(path)
    _places[id(out)] = weakref.ref(out, lambda _, k=id(out): _places.pop(k, None)), path
    return out


#: Where the frames that `stored` returned are kept, and all places that it has written to.
_places: dict[int, tuple[weakref.ref, str]] = {}
_made: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete the tables that were stored in the block, but those of the frames that are put
    into the list; whatever was made of the others must be stored when the block ends."""
    begin, keep = len(_made), []
    yield keep
    spared = {_places[id(df)][1] for df in keep if id(df) in _places}
    for path in [x for x in _made[begin:] if x not in spared]:
        _delete(spark, path)
        _made.remove(path)


def discard(*frames: DataFrame) -> None:
    """Delete stored tables. Only those that all that was made of them is stored too: what
    is recomputed for a lost executor goes back to stored tables and no further."""
    for df in frames:
        ref, path = _places.get(id(df), (None, ""))
        if ref and ref() is df:
            _delete(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text"):
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fits(frame: DataFrame, limit: int) -> bool:
    """Whether the rows take less than the limit, by a count of their bytes: for broadcasts."""
    used = frame.select(F.sum(F.length(F.to_json(F.struct("*"))) + 64).alias("n")).first()
    return (used.n or 0) < limit
