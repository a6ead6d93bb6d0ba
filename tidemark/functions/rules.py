"""Ordered rules: labels with evidence, flags, substring switches, trigger mining."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, str]]


def first_match(text: Column, rules: Rules, default: str = "", span: int = 60) -> Column:
    """struct(label, evidence): of the first rule whose pattern is found, with what was found."""
    found = [(name, F.regexp_substr(text, F.lit(f"(?iu){pattern}"))) for name, pattern in rules]
    none = F.struct(F.lit(default).alias("label"), F.lit("").alias("evidence"))
    return F.coalesce(*[F.when(hit.isNotNull(), F.struct(F.lit(name).alias("label"), F.substring(hit, 1, span).alias("evidence"))) for name, hit in found], none)


def flags(text: Column, rules: Mapping[str, str]) -> dict[str, Column]:
    return {f"flag_{name}": F.rlike(text, F.lit(f"(?iu){pattern}")) for name, pattern in rules.items()}


def any_of(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def switch(text: Column, triggers: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first class of which any trigger is a substring."""
    return F.coalesce(*[F.when(any_of(text, words), F.lit(name)) for name, words in triggers], F.lit(default))


def deciding(text: Column, triggers: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The trigger that decided: the first in order that the text holds, else null."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for _, words in triggers for w in words])


def misfire(text: Column, triggers: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Whether the class that wins has triggers in the text, but none as a word of its own."""
    out = F.lit(False)
    for _, words in reversed(triggers):
        present = any_of(text, words)
        alone = F.lit(False)
        for w in words:
            alone = alone | F.rlike(text, F.lit(rf"\b\Q{w}\E\b"))
        out = F.when(present, ~alone).otherwise(out)
    return out


#: Candidates whose gain is counted in one job, to begin with.
EVALUATED = 64


class Cover:
    """A greedy cover by lazy evaluation. A chunk's gain (rows of the target that it holds and
    that are not yet covered) can only fall, so an old one bounds the new one: candidates
    wait in a heap by their last known gain, and a round counts anew only those that could
    still be the best. Postings are sorted by chunk, so that a count reads the few row groups
    that hold its candidates; covered rows are a bitmap in blocks, a bit a row."""

    def __init__(self, rows: DataFrame, chunks: str, label: str, target: str, precision: float, least: int):
        from ..session import shared_dir

        self.spark = rows.sparkSession
        path = f"{shared_dir(self.spark)}/tidemark-cover-{uuid.uuid4().hex}"
        rows = rows.select(F.monotonically_increasing_id().alias("row"), F.array_distinct(chunks).alias("chunks"), (F.col(label) == target).alias("hit")).checkpoint()
        each = rows.select("row", "hit", F.explode("chunks").alias("chunk"))
        stats = each.groupBy("chunk").agg(F.count("*").alias("df"), F.count_if("hit").alias("in")).filter((F.col("df") >= least) & (F.col("in") >= precision * F.col("df")) & (F.col("in") > 0))
        self.stats = stats.withColumn("purity", F.col("in") / F.col("df")).checkpoint()
        posts = each.filter("hit").join(self.stats, "chunk").select("chunk", F.bitmap_bucket_number("row").alias("block"), F.bitmap_bit_position("row").alias("bit"))
        posts.repartitionByRange("chunk").sortWithinPartitions("chunk").write.parquet(path)
        self.posts = self.spark.read.parquet(path)
        self.covered = self.spark.createDataFrame([], "block long, bits binary")
        #: Entries (-gain, -purity, -df, chunk, round of the count), and how many have been fetched.
        self.heap: list[tuple] = []
        self.fetched = 0

    def _page(self, size: int) -> None:
        """Put the next candidates by their whole count into the heap."""
        order = [F.col("in").desc(), F.col("purity").desc(), F.col("df").desc(), F.col("chunk")]
        page = self.stats.orderBy(*order).offset(self.fetched).limit(size).collect()
        self.fetched += len(page)
        self.frontier = page[-1]["in"] if len(page) == size else 0
        for r in page:
            heapq.heappush(self.heap, (-r["in"], -r.purity, -r.df, r.chunk, 0))

    def _held(self, chunks: list[str]) -> DataFrame:
        """The postings of some chunks, each with whether its row is covered."""
        bits = F.conv(F.hex(F.substring("bits", (F.shiftright("bit", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        own = self.posts.filter(F.col("chunk").isin(chunks)).join(self.covered, "block", "left")
        return own.withColumn("old", F.coalesce(F.getbit(bits, (F.col("bit") % 8).cast("int")) == 1, F.lit(False)))

    def best(self, k: int) -> str | None:
        """The chunk of most gain in round k: ties go to the purest, the most frequent, the first."""
        size = EVALUATED
        if not self.fetched:
            self._page(size)
        while True:
            while self.frontier and (not self.heap or -self.heap[0][0] <= self.frontier):
                self._page(size)
                size *= 2
            if not self.heap or not self.heap[0][0]:
                return None
            if self.heap[0][4] == k:
                return heapq.heappop(self.heap)[3]
            # All that could be the best: those that are old, down to the first that is new.
            old = []
            while self.heap and self.heap[0][4] != k and len(old) < size:
                old.append(heapq.heappop(self.heap))
            counted = {r.chunk: r.gain for r in self._held([x[3] for x in old]).groupBy("chunk").agg(F.count_if(~F.col("old")).alias("gain")).collect()}
            for _, purity, df, chunk, _ in old:
                heapq.heappush(self.heap, (-counted.get(chunk, 0), purity, df, chunk, k))

    def take(self, chunk: str) -> None:
        """Cover the rows of a chunk."""
        new = self._held([chunk]).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
        self.covered = self.covered.unionByName(new).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits")).checkpoint()


def mine_triggers(rows: DataFrame, chunks: str, label: str, target: str, precision: float = 0.95, least: int = 3, most: int = 12) -> list[str]:
    """A greedy cover of the target class by chunks of high precision. Counting runs in Spark;
    a page of candidates comes to the driver at a time."""
    cover, out = Cover(rows, chunks, label, target, precision, least), []
    while len(out) < most and (chunk := cover.best(len(out) + 1)) is not None:
        out.append(chunk)
        cover.take(chunk)
    return out


def peel(rows: DataFrame, text: str, chunks: str, label: str, classes: Sequence[str], **options) -> dict[str, list[str]]:
    """Triggers of each class in order of priority; texts that hold a trigger of a class are
    out of the search for the next."""
    found: dict[str, list[str]] = {}
    for name in classes:
        found[name] = mine_triggers(rows, chunks, label, name, **options)
        rows = rows.filter(~any_of(F.col(text), found[name]))
    return found


def fidelity(rows: DataFrame, text: Column, truth: Column, triggers: Sequence[tuple[str, Sequence[str]]], default: str) -> DataFrame:
    """How far the ordered triggers explain a label: n, fidelity, mismatches, the share of
    texts that a trigger decides, and of those that only a part of a word decides: one row."""
    said = switch(text, triggers, default)
    off = misfire(text, triggers)
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    per = F.try_divide(F.count_if(off), F.count_if(said != default))
    return rows.agg(F.count("*").alias("n"), share(said == truth).alias("fidelity"), F.count_if(said != truth).alias("mismatches"), share(said != default).alias("trigger_rate"), share(off).alias("artefact_rate"), F.round(per, 6).alias("artefact_share"))
