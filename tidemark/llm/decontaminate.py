"""Benchmark decontamination on DataFrame functions alone, as a prefix-filtered set join.

A document is contaminated by an item where a window of the item's words (WINDOW
consecutive ones, or all of a shorter item) occurs in it. The words of each window are
ordered by rarity, counted over the whole corpus. To hold a window a document must hold
its rarest word, so that one word is the prefix that is joined. A joined word fixes the
window's place in the document; windows that would reach over either end are dropped
(length and positional bounds), and what remains is verified word by word.

The windows of a benchmark are broadcast where they take less than BROADCAST_BYTES. Beyond
that the documents' words are shuffled as hashes, and the texts once to the candidates.

Defined results: a null text has no words; an item without words has no windows; equal
windows of several items count for each; ids may be null; rows with an equal (or null) id
and an equal text are judged alike and all returned; columns of the input that have the
name of a result (n_words, n_hit, items, contaminated) are replaced, others are kept; a
very long text is one row, held by a task as its words; with an empty benchmark no word is
hit; without documents there are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, stored, whole_text
from .quality_rules import let

WINDOW = 13
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII but digits and letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def pieces(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with an empty one first or last where the
    text begins or ends with a gap (stripping it would be a second pass)."""
    return F.split(F.translate(text, UPPER, LOWER), GAPS)


def count_words(pieces: Column) -> Column:
    """Of `pieces`, without the empty ones; a text without words is one or two of them."""
    empty = lambda at: (F.element_at(pieces, at) == "").cast("int")
    return F.size(pieces) - empty(1) - F.when(F.size(pieces) > 1, empty(-1)).otherwise(0)


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """item, words (array): the distinct windows of every item."""
    rows = items.select(F.col(id_col).alias("item"), F.filter(pieces(whole_text(text_col)), lambda w: w != "").alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1)))
    return rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, size))).alias("words")).distinct()


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """id, t (hash of the text), item, start, length: every occurrence of a window."""
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), pieces(text).alias("all"))
    every = windows(items, size=size)
    small = lambda x: F.broadcast(x) if fits(x, broadcast_bytes) else x
    # Words are joined by hash; what is joined is verified word by word below. The outer
    # form of explode keeps Spark from computing the words a second time, for a filter.
    each = every.select(F.explode("words").alias("word")).select(F.xxhash64("word").alias("key")).distinct()
    seen = rows.select(F.explode_outer("all").alias("word")).select(F.xxhash64("word").alias("key")).join(small(each), "key").groupBy("key").agg(F.count("*").alias("seen"))
    # The rarest word of each window, and its place there: the prefix. Written tables keep no
    # partitions by word, so that a common word's rows can be split.
    seen = stored(seen, "seen")
    spread = every.select("item", "words", F.posexplode("words").alias("place", "word")).withColumn("key", F.xxhash64("word"))
    prefix = (
        spread.join(small(seen), "key", "left")
        .groupBy("item", "words")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "word", "place", "key")).alias("least"))
        .filter("least.seen > 0")  # a window with a word that no document has occurs nowhere
        .select(F.col("least.key").alias("key"), "item", F.col("least.place").alias("place"), "words")
    )
    prefix = stored(prefix, "prefix")
    start, n = F.col("at") - F.col("place"), F.size("words")
    within = (start >= 0) & (start + n <= F.col("count"))
    found = [F.col("item"), start.alias("start"), n.alias("length")]
    same = F.slice("all", F.col("start") + 1, F.col("length")) == F.col("words")
    if fits(prefix, broadcast_bytes):  # no text moves: a word is joined where its text is
        at = rows.select("id", "t", "all", F.size("all").alias("count"), F.posexplode_outer("all").alias("at", "word")).withColumn("key", F.xxhash64("word"))
        near = at.join(F.broadcast(prefix), "key").filter(within).select("id", "t", "all", "words", *found)
        return near.filter(same).select("id", "t", "item", "start", "length")
    # Words alone are shuffled; then the texts, once, to what is left.
    at = rows.select("id", "t", F.size("all").alias("count"), F.posexplode_outer("all").alias("at", "word")).select("id", "t", "count", "at", F.xxhash64("word").alias("key"))
    near = stored(at.join(prefix, "key").filter(within).select(F.col("id").alias("i"), F.col("t").alias("h"), "words", *found).distinct(), "near")
    return near.join(rows, F.col("i").eqNullSafe(F.col("id")) & (F.col("h") == F.col("t"))).filter(same).select("id", "t", "item", "start", "length")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, share: int = 20, keep_text: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurrence), items (sorted ids as strings)
    and contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    found = hits(docs, items, id_col, text_col, size, broadcast_bytes).distinct()
    per = found.groupBy("id", "t").agg(F.sort_array(F.collect_set(F.struct("start", F.col("length").alias("n")))).alias("spans"), F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    # Spans in order of their start: each adds what reaches beyond all before it.
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda s, x: F.struct(
            F.greatest(s["end"], x["start"] + x["n"]).alias("end"),
            (s["hit"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(s["end"], x["start"]))).alias("hit"),
        ),
    )["hit"]
    per = per.select(F.col("id").alias("__id"), F.col("t").alias("__t"), covered.cast("long").alias("__hit"), F.col("items").alias("__items"))
    text = whole_text(text_col)
    rows = docs.withColumns({"n_words": let(pieces(text), count_words).cast("long"), "__hash": F.xxhash64(text)})
    if not keep_text:
        rows = rows.drop(text_col)
    out = rows.join(per, rows[id_col].eqNullSafe(per["__id"]) & (rows["__hash"] == per["__t"]), "left")
    out = out.withColumns({"n_hit": F.coalesce("__hit", F.lit(0)).cast("long"), "items": F.coalesce("__items", F.array().cast("array<string>"))})
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    return out.drop("__id", "__t", "__hit", "__items", "__hash")
