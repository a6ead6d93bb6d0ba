"""Importance resampling towards a target distribution, by hashed n-grams.

A block of texts (an Arrow batch) has an integer dictionary of its distinct words; an
n-gram is a tuple of word ids. Each distinct tuple of the block is written out as bytes
and hashed once, and its bucket is joined back to every place that holds it by the tuple's
number. Dictionaries belong to blocks, as one for the corpus would have to meet every word
of every text in a shuffle; what is shuffled here is a count for each bucket and task.

The counts of `buckets` buckets in the corpus and in the target give each bucket's gain,
an integer, and the second pass over the texts sums the gains of a document's features. A
Gumbel draw from the id's hash is added, and the best scores among the documents with
enough words are drawn without replacement. Texts are read twice, written nowhere.
Ranks are counted in ranges of the score that are sorted apart, so no task sorts all rows.

Defined results: a null or empty text has no words, weight 0 and is never drawn where
MIN_WORDS is above 0; with fewer words than an n-gram takes there is none; a null id has
the empty string for its digits and comes after others of its score; rows that repeat an
id and a text count each, have equal scores and each take a rank; of equal scores the
smaller id is drawn first; an empty corpus gives no rows, an empty target counts no
feature anywhere; a text of any length is one row, its word ids one task's; columns of
the documents with the name of a result (n_features, n_words, weight, score, rank) are
replaced, others are kept.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ranks import numbered
from .common import small_batches, stored

BUCKETS, MIN_WORDS, PERCENT = 10_000, 20, 10
RESULTS = ("n_features", "n_words", "weight", "score", "rank")

#: Bytes of words stay, A-Z in lower case; all other ASCII parts words.
_FOLD = bytes(x + 32 if 0x41 <= x <= 0x5A else x if 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or x >= 0x80 else 0x20 for x in range(256))


def _runs(lengths: np.ndarray, n: int) -> np.ndarray:
    """Places at which a run of n words begins that stays within its text."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(ends))
    return at[at + n <= ends]


def block_features(texts: list[str | None], orders: range, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: words of each text, the text that each feature stands in, its bucket."""
    ids: dict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    found = [list(map(ids.__getitem__, (x or "").encode().translate(_FOLD).split())) for x in texts]
    lengths = np.array([len(x) for x in found], np.int64)
    words, flat = list(ids), np.fromiter(chain.from_iterable(found), np.int64, int(lengths.sum()))
    text_of = np.repeat(np.arange(len(found)), lengths)
    rows, hashed = [], []
    for n in orders:
        begin = _runs(lengths, n)
        # The tuple's number, a word at a time, so that it never leaves 64 bits.
        number = flat[begin]
        for k in range(1, n):
            number = np.unique(number, return_inverse=True)[1] * len(words) + flat[begin + k]
        _, first, number = np.unique(number, return_index=True, return_inverse=True)
        tuples = flat[begin[first, None] + np.arange(n)]
        crcs = np.fromiter((zlib.crc32(b" ".join([words[i] for i in t])) % buckets for t in tuples.tolist()), np.int64, len(tuples))
        rows.append(text_of[begin])
        hashed.append(crcs[number])
    return lengths, np.concatenate(rows), np.concatenate(hashed)


def bucket_counts(docs: DataFrame, text_col: str, orders: range, buckets: int) -> np.ndarray:
    """Features in each bucket, summed by task before the shuffle: `buckets` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(block_features(b.column("text").to_pylist(), orders, buckets)[2], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of (share of a bucket in the target / in the corpus)), each with one more."""
    size = len(corpus)
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (s.sum() + size)) / ((s + 1) * (t.sum() + size))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, orders: range, text_col: str = "text") -> DataFrame:
    """docs without their texts, with n_features, n_words, weight (the gains of all features)."""
    small_batches(docs.sparkSession)
    rest = docs.drop(*RESULTS)
    kept = [x for x in rest.schema.fields if x.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, rows, hashed = block_features(b.column("__text").to_pylist(), orders, len(gain))
            counts, sums = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            np.add.at(counts, rows, 1)
            np.add.at(sums, rows, gain[hashed])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts), pa.array(words), pa.array(sums)], [*b.schema.names[:-1], *RESULTS[:3]])

    schema = StructType([*kept, *StructType.fromDDL("n_features long, n_words long, weight long")])
    return rest.select(*[rest[x.name] for x in kept], rest[text_col].alias("__text")).mapInArrow(run, schema)


def gumbel(id_col: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of the id's hash."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, seed: int, most: int = 1, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """docs without their texts, with n_features (runs of 1 to `most` words), n_words,
    weight, score and rank: 1, 2, 3 ... for the `percent` per cent of the documents of
    min_words words or more that are drawn, else null."""
    small_batches(docs.sparkSession)
    orders = range(1, most + 1)
    gain = gains(bucket_counts(docs, text_col, orders, buckets), bucket_counts(target, target_col, orders, buckets))
    out = stored(weigh(docs, gain, orders, text_col).withColumn("score", F.col("weight") + gumbel(id_col, seed)), "weighed")
    long = F.col("n_words") >= min_words
    drawn = out.filter(long).count() * percent // 100
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked = numbered(out.filter(long), order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(out.filter(~long).withColumn("rank", F.lit(None).cast("long")))
