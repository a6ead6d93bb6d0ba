"""A streaming data source that follows a paginated interface: newest first, one chain of
page tokens for each feed, back to the edge of a window.

spark.readStream.format("paged").option("path", ...).option("edge", ...).load() gives
(feed, token, position, body). The offset is, for each feed, the token of its next page,
the pages that lie behind it and why it has stopped, if it has. A batch takes `batch` pages
of each feed or as many as lie behind it, up to LARGEST, so that the batches of a long feed
are few; a partition is a run of at most TOGETHER of them. What the driver reads of a page is
its head (the next token and its oldest time), the rows are read by executors. A batch that
was not committed is read again by its tokens, so that a sink which counts a batch once
has each row once. Rows before the edge of the window are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.ranks import numbered_within

#: Rows of a page, pages of each feed in the first batch, pages of a feed in all.
PAGE, BATCH, MOST = 200, 8, 10_000
#: Pages of each feed in a batch, and of a partition, at the most.
LARGEST, TOGETHER = 2048, 64
FIRST = "0"


@dataclass
class Head:
    """What a page says besides its rows: the token of the page after it (None at the end),
    the least time of its rows, and how many there are."""

    next: str | None
    oldest: str | None
    n: int


class LandedPages:
    """Pages that were landed in a folder any executor can reach: path/feed=F/token=T/."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _store(self):
        import pyarrow.fs as fs

        return fs.FileSystem.from_uri(self.path)

    def feeds(self) -> list[str]:
        import pyarrow.fs as fs

        store, place = self._store()
        return sorted(x.base_name.partition("=")[2] for x in store.get_file_info(fs.FileSelector(place)) if x.base_name.startswith("feed="))

    def _lines(self, feed: str, token: str) -> Iterator[str]:
        """The page's lines as they come; nothing is held but a block of the file."""
        import pyarrow.fs as fs

        store, place = self._store()
        for x in sorted(store.get_file_info(fs.FileSelector(f"{place}/feed={feed}/token={token}")), key=lambda x: x.path):
            if x.is_file and not x.base_name.startswith(("_", ".")):
                with store.open_input_stream(x.path) as f:
                    rest = b""
                    while block := f.read(1 << 20):
                        *lines, rest = (rest + block).split(b"\n")
                        yield from (y.decode() for y in lines)
                    if rest:
                        yield rest.decode()

    def head(self, feed: str, token: str) -> Head:
        return Head(**json.loads(next(self._lines(feed, token))))

    def rows(self, feed: str, token: str) -> Iterator[str]:
        lines = self._lines(feed, token)
        next(lines)
        return lines


@dataclass
class Page(InputPartition):
    feed: str
    tokens: list[str]


class PagedSource(DataSource):
    """Options: path; edge (an ISO time: the window begins there) and time (the field of a row
    that holds its time); batch, most; pages ("module:Class", made with the path) in place
    of landed pages."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "feed string, token string, position int, body string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        kind = LandedPages
        if "pages" in options:
            module, _, name = options["pages"].partition(":")
            kind = getattr(import_module(module), name)
        self.pages = kind(options["path"])
        self.edge, self.time = options.get("edge", ""), options.get("time", "created")
        self.batch, self.most = int(options.get("batch", BATCH)), int(options.get("most", MOST))
        self.at: dict | None = None
        self.walked: dict[str, tuple[dict, list[str]]] = {}  # of each feed the last walk of latestOffset

    def initialOffset(self) -> dict:
        return {feed: {"next": FIRST, "pages": 0, "stop": ""} for feed in self.pages.feeds()}

    def _after(self, feed: str, at: dict) -> dict:
        """Where a feed stands behind its next page."""
        head = self.pages.head(feed, at["next"])
        stop = "empty_page" if not head.n else "token_exhausted" if head.next is None else "reached_window_edge" if head.oldest is not None and head.oldest < self.edge else "page_cap" if at["pages"] + 1 >= self.most else ""
        return {"next": head.next if head.next is not None else "", "pages": at["pages"] + 1, "stop": stop}

    def _walk(self, feed: str, at: dict, pages: int) -> tuple[list[str], dict]:
        """The tokens of at most so many pages from here on, and where they end."""
        tokens = []
        while pages > 0 and not at["stop"]:
            tokens.append(at["next"])
            at, pages = self._after(feed, at), pages - 1
        return tokens, at

    def latestOffset(self) -> dict:
        start = self.initialOffset() if self.at is None else self.at
        end = {}
        for feed, at in start.items():
            tokens, end[feed] = self._walk(feed, at, max(self.batch, min(at["pages"], LARGEST)))
            self.walked[feed] = (at, tokens)
        self.at = end
        return end

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Also of a batch that is read again; a restarted query calls this first, with the
        last batch that was planned, and goes on from its end."""
        if self.at is None:
            self.at = end
        out = []
        for feed, at in start.items():
            n = end[feed]["pages"] - at["pages"]
            begin, tokens = self.walked.get(feed, (None, []))
            if begin != at or len(tokens) != n:
                tokens = self._walk(feed, at, n)[0]
            out += [Page(feed, tokens[i : i + TOGETHER]) for i in range(0, n, TOGETHER)]
        return out

    def read(self, partition: Page):
        for token in partition.tokens:
            for i, body in enumerate(self.pages.rows(partition.feed, token)):
                if not self.edge or str(json.loads(body).get(self.time) or "") >= self.edge:
                    yield partition.feed, token, i, body

    def commit(self, end: dict) -> None:
        pass


def land(df: DataFrame, feed: str, time: str, ties: list[str], path: str, size: int = PAGE) -> None:
    """Write df as the pages that such an interface would give: newest first, `size` rows a
    page, its head before them. Feeds are numbered in ranges, so none is in one task."""
    spot = numbered_within(df.withColumn("__feed", F.col(feed).cast("string")), ["__feed"], [F.col(time).desc(), *map(F.col, ties)], "__at")
    stamp = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    rows = spot.select("__feed", F.floor((F.col("__at") - 1) / size).alias("page"), F.col("__at").alias("at"), stamp.alias("time"), F.to_json(F.struct(*[stamp.alias(c) if c == time else F.col(c) for c in df.columns])).alias("value"))
    pages = rows.groupBy("__feed", "page").agg(F.count("*").cast("int").alias("n"), F.min("time").alias("oldest"))
    last = pages.groupBy("__feed").agg(F.max("page").alias("last"))
    following = F.when(F.col("page") < F.col("last"), (F.col("page") + 1).cast("string"))
    heads = pages.join(last, "__feed").select("__feed", "page", F.lit(0).cast("long").alias("at"), F.to_json(F.struct(following.alias("next"), "oldest", "n"), {"ignoreNullFields": "false"}).alias("value"))
    lines = rows.select("__feed", "page", "at", "value").unionByName(heads).select(F.col("__feed").alias("feed"), F.col("page").cast("string").alias("token"), "at", "value")
    # In the order of the folders, or the writer would sort by them alone.
    lines.repartition("feed", "token").sortWithinPartitions("feed", "token", "at").drop("at").write.partitionBy("feed", "token").text(path)


def stream(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """The rows of all feeds under a path, as a stream."""
    spark.dataSource.register(PagedSource)
    return spark.readStream.format("paged").options(path=path, **options).load()


def audit(offset: dict) -> list[dict]:
    """Of an offset of the source: a row for each feed, with why it stopped and whether its
    whole window has been seen."""
    return [{"feed": f, "pages": x["pages"], "stop": x["stop"], "complete": x["stop"] == "reached_window_edge"} for f, x in sorted(offset.items())]
