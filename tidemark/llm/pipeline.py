"""The corpus pipeline: quality rules, line dedup, near duplicates, benchmark
decontamination, and byte-level BPE with its decoding, over all documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as
Parquet to the shared folder and reads again as the next stage's docs. All stages but the
last return the columns of documents, and further columns as they are (those with the name
of an operator's result excepted); n_chars follows where a text has changed.

Defined results, for every stage: a null or empty text is an empty document, which the
quality rules reject; ids may be null or repeated: rows with one id and several texts are
judged text by text, but by near_duplicates, which takes them for one document; a table
without rows gives none. Whole texts are read, however long; one is held by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, line_dedup, ngram_join, quality_rules
from .common import discard, stored, swept, table

#: Patience alignment has no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def _changed(out: DataFrame, changed: str, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.expr(changed), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; frequent lines of a host go from those that stay, but from the
    first that passes the base rules. A null text is rejected, a null host is one host,
    repeated rows count once and stay or go together."""
    return _changed(quality_rules.quality_rules(docs, strip=True).filter("kept"), "lost_words > 0", docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go; a document left with a rest goes.
    A null text and a row with a null id stay as they are; rows with an equal id are not
    aligned with each other."""
    return _changed(line_dedup.line_dedup(docs).filter("kept"), "n_removed > 0", docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 the one with the least id stays.
    Texts without words and rows with a null id stay; rows with an equal id stay or go together."""
    found = ngram_join.jaccard_components(docs, n=5, num=80, den=100).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go. A null text has no words and stays; each row is judged by
    its text alone."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep_text=True).filter("NOT contaminated").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of every document that is left, a
    row for each of its rows; a null text has no ids."""
    import public_tokenizers

    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", benchmark), ("byte_level_bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with swept(spark) as keep:
            docs = stored(stage(spark, before, sf_dir), name)
            keep.append(docs)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
