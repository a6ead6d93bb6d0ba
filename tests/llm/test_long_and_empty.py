"""Every operator on a text of ten million characters in one line, and on tables without rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, decontaminate, ngram_join, pipeline, quality_rules, sharding, token_counts

P = pytest.importorskip("public_tokenizers")
WORDS = [f"w{i}" for i in range(5000)]


@pytest.fixture(scope="module")
def long():
    r = random.Random(1)
    return " ".join(r.choice(WORDS) for _ in range(1_800_000))


@pytest.fixture(scope="module")
def docs(spark, long):
    assert len(long) > 10_000_000
    rows = [(0, long, "s"), (1, "short text", "s"), (2, long + " and more", "s"), (None, "", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_token_counts(docs, long):
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    got = {x.doc_id: x.n_tokens for x in token_counts.token_counts(docs.filter("doc_id < 2"), model).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    assert got == {0: len(sp.encode(long)), 1: len(sp.encode("short text"))}


def test_byte_bpe(docs, long):
    got = byte_bpe.round_trip(docs.filter("doc_id = 0"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).first()
    assert got.decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()


def test_ngram_join(docs):
    got = {x.doc_id: x.component_id for x in ngram_join.jaccard_components(docs, 3, 90, 100).collect()}
    assert got == {0: 0, 1: 1, 2: 0, None: None}


def test_quality_rules(docs):
    got = {x.doc_id: x for x in quality_rules.quality_rules(docs).collect()}
    assert (got[0].n_words, got[0].kept, got[2].n_words) == (1_800_000, True, 1_800_002)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decontamination(spark, docs, long, limit):
    item = " ".join(long.split()[900_000:900_020])
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {x.doc_id: (x.n_hit, x.contaminated) for x in decontaminate.decontaminate(docs, bench, broadcast_bytes=limit).collect()}
    assert got == {0: (20, False), 1: (0, False), 2: (20, False), None: (0, False)}


def test_sharding(docs, long):
    got = {x.doc_id: (x.size, x.text_crc32) for x in sharding.shard(docs, 2).collect()}
    assert got[0] == (len(long) + 16, zlib.crc32(long.encode())) and got[None] == (16, 0)


def test_the_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra array<int>").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"] and out.count() == 0


def test_stages_on_nulls_repeats_and_extra_columns(spark, tmp_path):
    r = random.Random(3)
    said = [" ".join(r.choice(WORDS) for _ in range(80)) for _ in range(4)]
    rows = [(1, said[0]), (1, said[1]), (2, said[0]), (None, said[2]), (None, said[2]), (3, None), (4, ""), (5, said[3])]
    docs = spark.createDataFrame([(i, x, "en", None, len(x or "")) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit("mine"))
    spark.createDataFrame([(0, " ".join(said[3].split()[:40]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = docs
    seen = []
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        seen.append(sorted(((x.doc_id or 0, x.text) for x in out.collect()), key=str))
    both = [(0, said[2])] * 2
    assert seen[0] == sorted([*both, (1, said[0]), (1, said[1]), (2, said[0]), (5, said[3])], key=str)  # texts without words are rejected
    assert seen[1] == sorted([*both, (1, said[0]), (1, said[1]), (5, said[3])], key=str)  # 2 has lost its only line to 1
    assert seen[2] == seen[1]
    assert seen[3] == sorted([*both, (1, said[0]), (1, said[1])], key=str)  # half of 5 is an item
    assert {x.row for x in out.collect()} == {"mine"}


def fewest_cut(sizes, shards):
    """The least number of cut links over all assignments with shard sizes at most one apart."""
    n = sum(sizes)
    quota = sorted((n // shards + (s < n % shards) for s in range(shards)), reverse=True)
    spreads = [sorted({tuple(c) for c in itertools.product(range(k + 1), repeat=shards) if sum(c) == k}) for k in sizes]
    best = {tuple([0] * shards): 0}
    for options in spreads:
        new = {}
        for used, cost in best.items():
            for o in options:
                to = tuple(a + b for a, b in zip(used, o, strict=True))
                if all(a <= b for a, b in zip(to, quota, strict=True)):
                    k = sum(o)
                    c = cost + (k * k - sum(x * x for x in o)) // 2
                    if c < new.get(to, 1 << 30):
                        new[to] = c
        best = new
    return min(best.values())


def cuts(out):
    """Cut links, cut groups, and the sizes of the shards of a result."""
    cells = collections.Counter((x.group, x.shard) for x in out)
    groups = collections.Counter(x.group for x in out)
    links = {name: (k * k - sum(c * c for (g, _), c in cells.items() if g == name)) // 2 for name, k in groups.items()}
    return sum(links.values()), sum(1 for x in links.values() if x), collections.Counter(x.shard for x in out)


def test_cut_links_against_all_assignments(spark):
    """Small tables, where edges weigh most: at most one group more is cut than in the best of
    all assignments, and sizes are at most one apart."""
    r = random.Random(9)
    for _ in range(6):
        sizes = [r.randint(1, 5) for _ in range(7)]
        rows = [(i, f"text {g}") for i, g in enumerate(g for g, k in enumerate(sizes) for _ in range(k))]
        out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
        links, groups, count = cuts(out)
        least = fewest_cut(sizes, 3)
        assert least <= links and (links == least or groups <= 1 + (least > 0)), (sizes, links, groups, least)
        assert max(count.values()) - min(count.values()) <= 1
        for s in range(3):
            assert sorted(x.slot for x in out if x.shard == s) == list(range(count[s]))


def test_propagation_moves_minorities(spark, monkeypatch):
    """Groups of three in few shards, every document linked: hardly a group is cut, no quota is
    broken, and most documents stay where most of their group began; packing alone moves more."""
    df = spark.range(900).selectExpr("id AS doc_id", "concat('t', cast(id / 3 AS int)) AS text")
    out = sharding.shard(df, 4)
    links, groups, count = cuts(out.collect())
    assert groups <= 3 and max(count.values()) - min(count.values()) <= 1
    moved = sharding.moved_share(out, 4)
    monkeypatch.setattr(sharding, "propagate", lambda cells, quota: cells.withColumn("shard", F.col("origin")))
    assert moved < sharding.moved_share(sharding.shard(df, 4), 4) - 0.1


def test_flows_stay_within_quotas():
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(50):
        n = int(r.integers(2, 8))
        flows = r.integers(0, 50, (n, n)) * (1 - np.eye(n, dtype=int))
        load = flows.sum(1) + r.integers(0, 30, n)
        quota = np.maximum(1, load + r.integers(-10, 10, n))
        x = sharding.allowed(flows, load, quota)
        assert (0 <= x).all() and (x <= flows).all() and (load + x.sum(0) - x.sum(1) <= np.maximum(quota, load) + n).all()
    swap = np.array([[0, 9], [7, 0]])  # full shards exchange
    assert sharding.allowed(swap, np.array([20, 20]), np.array([20, 20])).tolist() == [[0, 7], [7, 0]]
