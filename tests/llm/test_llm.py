"""Each operator against a library or a brute-force version, on texts with nulls, empty
and long texts, ties, repeated rows, empty tables and extra columns."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, chat_format, decontaminate, line_dedup, ngram_join, quality_rules, sharding, token_counts, token_files

P = pytest.importorskip("public_tokenizers")
PIECES, RANKS, WORDS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = [None, "", " ", "a  b", "  a", "a ", "\n", "\x00a", "▁x", "é", "<s> </s>", "<|endoftext|>x", "x" * 300, "the" * 200, " " * 30, "日本語 テスト", "😀😀 x", "a\xa0\xa0b", "it's I'LL", "\x1c a\x1d"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n=60, seed=1):
    r = random.Random(seed)
    return [*ODD, *("".join(r.choice("abehtonr  ▁\né😀-=.'s") for _ in range(r.randint(0, 60))) for _ in range(n))]


def frame(spark, values, first=0):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(first + i, x, "en", "src", len(x or "")) for i, x in enumerate(values)]
    df = spark.createDataFrame([*rows, rows[1], (None, "no id", "en", None, 5)] if rows else [], SCHEMA)
    return df.withColumn("t", F.lit(1)).withColumn("at", F.lit("x")).withColumn("key", F.lit(None).cast("string")).withColumn("g", F.lit(2))


def prose(r, n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


VOCABULARY = [f"w{i}" for i in range(900)]


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    values = texts()
    got = {r.doc_id: r for r in token_counts.token_counts(frame(spark, values), PIECES).collect() if r.doc_id is not None}
    for i, x in enumerate(values):
        assert (got[i].n_tokens, got[i].n_bytes) == (len(sp.encode(x or "")), len((x or "").encode()))
    assert token_counts.token_counts(frame(spark, []), PIECES).count() == 0


def test_byte_bpe_equals_the_library_and_comes_back(spark):
    import tiktoken

    values = texts()
    codec = byte_bpe.ByteBPE(RANKS, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    df = frame(spark, values)
    coded = byte_bpe.encode(df, RANKS, P.PATTERN)
    ids = {r.doc_id: r.ids for r in coded.collect() if r.doc_id is not None}
    back = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(coded, RANKS, P.PATTERN).collect() if r.doc_id is not None}
    trip = {r.doc_id: r for r in byte_bpe.round_trip(df, RANKS, P.PATTERN, keep_ids=True).collect() if r.doc_id is not None}
    for i, x in enumerate(values):
        want = enc.encode_ordinary(x or "")
        assert ids[i] == trip[i].ids == want and back[i] == (x or "").encode()
        assert trip[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert trip[i].decoded_sha256 == hashlib.sha256(back[i]).hexdigest()
    long = "ab" * 30_000  # one pre-token
    assert codec.encode(long).tolist() == enc.encode_ordinary(long)
    assert byte_bpe.round_trip(frame(spark, []), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_token_files_come_back(spark, tmp_path, bits):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    values = texts(40)
    df = frame(spark, values)
    token_files.write_ids(df, path := str(tmp_path / "ids"), WORDS, 2, bits=bits)
    got = token_files.read_ids(spark, path).collect()
    sums = {(r.doc_id, r.start): r for r in token_files.read_checksums(spark, path).collect()}
    at = 0
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect())
    for (i, x), r in zip(rows, sorted(got, key=lambda r: r.start), strict=True):
        want = tok.encode(x, add_special_tokens=False).ids + [2]
        assert (r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids) == (i, at, len(want), want)
        assert sums[r.doc_id, at].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    token_files.write_ids(frame(spark, []), path := str(tmp_path / "none"), WORDS, 2)
    assert token_files.read_ids(spark, path).count() == 0


def brute_quality(x):
    x = x or ""
    w = [y for y in re.split("[\x20\x09-\x0d]+", x) if y]
    tri = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [y for y in x.split("\n") if re.search("[^\x20\x09-\x0d]", y)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered)


def test_quality_base_statistics(spark):
    values = [*texts(), "a a a a", "a b c a b c", "x # y\nx # y\n\n \nx # y", "1 2 3 " * 50]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, values)).collect() if r.doc_id is not None}
    for i, x in enumerate(values):
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_quality(x)


def test_frequent_lines_deplete(spark):
    r = random.Random(5)
    common = prose(r, 60)
    rows = [(i, f"{common}\n{prose(r, 40)}" if i % 2 else prose(r, 90), "host") for i in range(100)]
    rows += [(100 + i, prose(r, 80) + "\n" + prose(random.Random(9), 80), "other") for i in range(10)]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x for x in quality_rules.quality_rules(df).collect()}
    assert got[1].kept and got[1].lost_words == 0  # the first keeps its line
    assert not got[3].kept and got[3].lost_words == 60
    assert all(got[i].kept for i in (0, 2, 100, 109))
    stripped = {x.doc_id: x for x in quality_rules.quality_rules(df, strip=True).collect()}
    assert stripped[5].text == rows[5][1].split("\n")[1] and stripped[0].text == rows[0][1]
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_a_frequent_line_stays_in_the_first_document_that_passes(spark):
    r = random.Random(15)
    banner = prose(r, 60)
    rows = [(0, banner + "\n" + "again and again " * 100, "host"), (1, "short", "host"), *((i, f"{prose(r, 80)}\n{banner}", "host") for i in range(2, 32))]
    got = {x.doc_id: x for x in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), strip=True).collect()}
    assert got[0].base_failed and got[0].lost_words == 60
    assert got[2].kept and got[2].text == rows[2][1] and got[2].lost_words == 0
    assert all(got[i].kept and got[i].text == rows[i][1].split("\n")[0] for i in range(3, 32))


def test_frequent_lines_have_a_limit_at_every_size(spark):
    r = random.Random(12)
    banner, copy = prose(r, 60), prose(r, 70)
    rows = [(i, f"{banner}\n{prose(r, 40)}" if i % 20 == 0 else prose(r, 90), "host") for i in range(800)]
    rows += [(800 + i, copy, "other") for i in range(30)] + [(830 + i, prose(r, 70), "other") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x for x in quality_rules.quality_rules(df, most=30).collect()}
    assert [got[i].lost_words for i in (0, 20, 780, 1)] == [0, 60, 60, 0] and not got[20].kept
    # Copies count as documents.
    assert [got[i].lost_words for i in (800, 801, 829, 830)] == [0, 70, 70, 0]
    assert all(got[i].kept for i in got if i in (0, 800) or i < 800 and i % 20 or i >= 830)


def brute_lines(rows):
    first, df, docs = {}, collections.Counter(), {}
    for i, t in sorted(rows):
        docs[i] = [b" ".join(x.split()) for x in (t or "").lower().encode().split(b"\n") if x.split()]
        for x in set(docs[i]):
            df[x] += 1
            first.setdefault(x, i)
    out = {}
    for i, ls in docs.items():
        out[i] = set()
        for o in {first[x] for x in ls} - {i}:
            own, theirs = collections.defaultdict(list), collections.defaultdict(list)
            for k, x in enumerate(ls):
                if first[x] == o:
                    own[x].append(k)
            for k, x in enumerate(docs[o]):
                if x in own:
                    theirs[x].append(k)
            out[i] |= line_dedup.common_blocks([(x, theirs[x], own[x], x.count(b" ") + 1, df[x]) for x in own])
    return docs, out


def test_line_dedup_deletes_what_repeats_from_the_later(spark):
    r = random.Random(7)
    passage = [prose(r, 30), prose(r, 25), prose(r, 12)]
    short = prose(r, 6)
    values = ["\n".join([prose(r, 40), *passage, prose(r, 30)]), "\n".join([prose(r, 50), *passage, short, prose(r, 9), *passage]), "\n".join([prose(r, 70), short]), "\n".join([prose(r, 80), passage[0].upper() + "  "])]
    values += [values[0], None, "", "\n\n", *("\n".join(prose(r, r.randint(1, 12)) for _ in range(r.randint(1, 30))) for _ in range(20))]
    df = frame(spark, values, first=1)
    got = {x.doc_id: x for x in line_dedup.line_dedup(df).collect()}
    assert got[1].n_removed == 0 and got[1].text == values[0]
    assert got[2].text.split("\n") == [values[1].split("\n")[0], short, values[1].split("\n")[5]]
    assert got[3].n_removed == 0 and got[4].n_removed == 1 and got[4].kept
    assert not got[5].kept and got[6].text is None and got[6].kept
    docs, want = brute_lines([(i + 1, x) for i, x in enumerate(values)])
    for i, gone in want.items():
        assert got[i].n_removed == len(gone)
        if gone:
            assert got[i].text.lower().encode().split(b"\n") == [x for k, x in enumerate(docs[i]) if k not in gone] or got[i].n_removed == len(docs[i])
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def test_line_dedup_aligns_blocks_whoever_owns_their_lines(spark):
    r = random.Random(8)
    ten = lambda: prose(r, 10)
    block = [ten() for _ in range(4)]
    values = ["\n".join([x, prose(r, 40)]) for x in block] + ["\n".join([prose(r, 40), *block]) for _ in range(2)]
    got = {x.doc_id: x for x in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")).collect()}
    assert [got[i].n_removed for i in range(6)] == [0, 0, 0, 0, 0, 4] and got[5].kept
    one = [ten() for _ in range(40)]
    two = [ten() if i % 5 == 4 else x for i, x in enumerate(one)]
    got = {x.doc_id: x for x in line_dedup.line_dedup(spark.createDataFrame([(1, "\n".join(one)), (2, "\n".join(two)), (3, "\n".join(two))], "doc_id long, text string")).collect()}
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 32, 40] and got[2].kept and not got[3].kept
    # The rest of 2 is short, but 3 has lost the line that it alone still holds.
    values = [one[0] + "\n" + one[1], "\n".join([one[0], one[1], one[2]]), "\n".join([one[0], one[1], one[2], prose(r, 30)])]
    got = {x.doc_id: x for x in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")).collect()}
    assert [got[i].n_removed for i in range(3)] == [0, 2, 3] and got[1].kept and got[1].text == one[2]


def test_line_dedup_keys_cover_every_run():
    r = random.Random(3)
    for _ in range(200):
        words = [r.randint(1, 12) for _ in range(r.randint(1, 12))]
        lines = [(i, bytes([i]), w) for i, w in enumerate(words)]
        keys = line_dedup.keys_of(lines)
        for a in range(len(words)):
            for b in range(a, len(words)):
                run = [x for x in keys if x[0] == 0 and set(x[1:]) <= set(range(a, b + 1))]
                assert set(b"".join(x[1:] for x in run)) == (set(range(a, b + 1)) if sum(words[a : b + 1]) >= 20 else set())


def test_common_blocks_in_another_order():
    left, right = ["p", "f1", "f2", "f3"], ["f1", "f2", "f3", "p"]
    for df in (2, 1000):
        assert line_dedup.common_blocks([(x, [left.index(x)], [right.index(x)], 60 if x == "p" else 3, df) for x in left]) == {3}
    r = random.Random(6)
    for _ in range(300):
        words = {x: r.choice([2, 6, 11, 25]) for x in "abcdef"}
        a, b = ([r.choice("abcdefxyz") for _ in range(r.randint(1, 14))] for _ in range(2))
        both = set(a) & set(b) & set(words)
        got = line_dedup.common_blocks([(x, [i for i, y in enumerate(a) if y == x], [i for i, y in enumerate(b) if y == x], words[x], 2) for x in both])
        left = [j for j in range(len(b)) if j not in got]
        for d in range(-len(a), len(b)):
            run = []
            for j in [j for j in left if 0 <= j - d < len(a) and b[j] in both and a[j - d] == b[j]] + [10**6]:
                if run and j - run[-1] > line_dedup.GAP + 1:
                    assert sum(words[b[k]] for k in run) < 20
                    run = []
                run.append(j)


def test_patience_alignment():
    assert line_dedup.patience(list("abcde"), list("xbcdy"), set()) == [(1, 0 + 1), (2, 2), (3, 3)]
    assert line_dedup.patience(list("aaab"), list("aab"), set()) == [(0, 0), (1, 1), (3, 2)]
    assert line_dedup.patience([], list("ab"), set()) == []


def brute_components(rows, n, num, den):
    sets = {}
    for i, t in rows:
        if w := (t or "").encode().lower().split():
            sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets.get(i, ())), find(i)) for i, _ in rows}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, n, num):
    r = random.Random(n)
    values = [None, "", "one", "One", "one two", "a b c", "A B C"]
    for size in (4, 8, 15, 30, 60, 150, 400):
        for _ in range(3):
            base = prose(r, size).split()
            for _ in range(8):
                copy = list(base)
                for _ in range(r.randint(0, max(1, size // 40))):
                    copy[r.randrange(len(copy))] = r.choice(VOCABULARY)
                values.append(" ".join(copy[: len(copy) - r.randint(0, max(1, size // 20))]))
    passage = prose(r, 60)
    values += [f"{passage} {prose(r, r.randint(5, 15))}" for _ in range(60)]
    df = frame(spark, values).dropDuplicates(["doc_id"])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(df, n, num).collect()}
    assert got.pop(None)[1] is None
    assert got == brute_components(list(enumerate(values)), n, num, 100)
    assert ngram_join.jaccard_components(frame(spark, []), n, num).count() == 0


def test_parity_blocks_bound_the_difference():
    """Any two sets within the threshold share a key."""
    r = np.random.default_rng(0)
    for num in (80, 90):
        bands = ngram_join.Bands(num, 100)
        for size in (10, 19, 20, 50, 200, 1000):
            for _ in range(40):
                a = r.integers(0, 2**63, size, dtype=np.uint64)
                most = size * (100 - num) // (100 + num) * 2
                k = int(r.integers(0, most // 2 + 1))
                b = np.append(a[k:], r.integers(0, 2**63, int(r.integers(0, most - k + 1)), dtype=np.uint64))
                both = len(np.intersect1d(a, b))
                if 100 * both >= num * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                    assert np.intersect1d(bands.keys(np.unique(a)), bands.keys(np.unique(b))).size


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_hits(docs, items, size=13):
    cut = lambda x: WORD.findall("".join(c.lower() if c < "\x80" else c for c in x or ""))
    found = collections.defaultdict(set)
    for i, x in items:
        if w := cut(x):
            for k in range(max(1, len(w) - size + 1)):
                found[tuple(w[k : k + size])].add(i)
    out = {}
    for i, x in docs:
        w, hit, own = cut(x), set(), set()
        for n in {len(k) for k in found}:
            for k in range(len(w) - n + 1):
                if items_of := found.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    own |= items_of
        out[i] = (len(w), len(hit), sorted(map(str, own)))
    return out


def test_many_documents_that_share_a_passage_and_are_not_alike(spark):
    """Their pairs are not listed: the rarest n-grams set them apart."""
    r = random.Random(21)
    shared = [prose(r, 20) for _ in range(3)]
    values = [" ".join([shared[0], prose(r, 4), shared[1], prose(r, 4), shared[2], prose(r, 4)]) for _ in range(2000)]
    values += [values[7], values[9] + " more", " ".join(values[11].split()[:-1])]
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    seen = []
    held, ngram_join.rare_groups = ngram_join.rare_groups, lambda *x: seen.append(held(*x)) or seen[-1]
    try:
        got = {x.doc_id: x.component_id for x in ngram_join.jaccard_components(df, 3, 90, 100).collect()}
    finally:
        ngram_join.rare_groups = held
    assert {i: c for i, c in got.items() if i != c} == {2000: 7, 2001: 9, 2002: 11}
    assert len(seen) == 1 and seen[0].count() < 40_000


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination_equals_brute_force(spark, limit):
    r = random.Random(11)
    items = [(0, prose(r, 40)), (1, prose(r, 13)), (2, "Short, item"), (3, "É"), (4, ""), (5, None), (6, "the"), (20, prose(r, 14))]
    values = [*texts(30), items[0][1].upper(), f"{prose(r, 30)}, {items[1][1]}! {items[1][1]}", "a short item. É é The the", " ".join(items[0][1].split()[:12]), "-" + items[7][1] + "-", f"{items[0][1]} {prose(r, 2000)}"]
    df = frame(spark, values)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x for x in decontaminate.decontaminate(df, bench, broadcast_bytes=limit).collect() if x.doc_id is not None}
    want = brute_hits(list(enumerate(values)), items)
    assert {i: (x.n_words, x.n_hit, list(x["items"])) for i, x in got.items()} == want
    assert all(x.contaminated == (x.n_hit > 0 and 20 * x.n_hit >= x.n_words) for x in got.values())
    assert decontaminate.decontaminate(df, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(frame(spark, []), bench).count() == 0


def test_documents_without_an_id_are_judged(spark):
    r = random.Random(13)
    item, banner = prose(r, 20), prose(r, 60)
    df = spark.createDataFrame([(None, item + " end"), (None, prose(r, 30)), (1, item)], "doc_id long, text string")
    got = {x.text: x for x in decontaminate.decontaminate(df, spark.createDataFrame([(0, item)], "item_id long, text string"), keep_text=True).collect()}
    assert {k: x.n_hit for k, x in got.items()} == {t: 20 if t.startswith(item) else 0 for t in got} and got[item + " end"].contaminated
    rows = [(i if i % 2 else None, f"{banner}\n{prose(r, 40)}", "host") for i in range(60)]
    lost = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("doc_id", "lost_words").count().collect()
    assert {(x.doc_id, x.lost_words): x["count"] for x in lost} == {(1, 0): 1, (None, 60): 30} | {(i, 60): 1 for i in range(3, 60, 2)}


def test_chat_comes_back(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "a\\</s>[\\INST]\\"), (2, 0, "system", None), (2, 1, "user", "[SYS] \n"), (2, 2, "assistant", ""), (3, 1, "user", "b"), (3, 0, "assistant", "a"), (4, 0, "tool[/ROLE] x", "[ROLE]"), (4, 0, "tool[/ROLE] x", "[ROLE]"), (None, None, None, None), (5, 0, "user", "x" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat_format.chat_format(df).select("conv_id", "valid", "formatted", "segments", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss"))
    for r in out.collect():
        own = sorted(((t if t is not None else -1, a or "", b or "") for c, t, a, b in rows if c == r.conv_id))
        assert [tuple(t) for t in r.turns] == [(a, b) for _, a, b in own]
        assert r.loss == "".join(b for _, a, b in own if a == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
        assert r.valid == (r.conv_id in (1, 2))
    assert chat_format.chat_format(df.limit(0)).count() == 0


def test_shards_are_even_and_keep_copies_together(spark):
    r = random.Random(2)
    copies = [prose(r, 5) for _ in range(15)]
    values = [*ODD[:6], *(x for x in copies for _ in range(r.randint(2, 6))), *("hot" for _ in range(120)), *(prose(r, 4) for _ in range(150))]
    df = frame(spark, values)
    got = sharding.shard(df, shards=7).collect()
    assert len(got) == len(values) + 2
    count = collections.Counter(x.shard for x in got)
    assert set(count) == set(range(7)) and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(x.slot for x in got if x.shard == s) == list(range(count[s]))
    text = dict(enumerate(values))
    for x in got:
        if x.doc_id is not None:
            raw = (text[x.doc_id] or "").encode()
            assert (x.size, x.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    where = collections.defaultdict(collections.Counter)
    for x in got:
        where[x.group][x.shard] += 1
    linked = [v for v in where.values() if 1 < sum(v.values()) < 40]
    assert sum(len(v) == 1 for v in linked) >= 0.7 * len(linked)
    assert sharding.shard(frame(spark, []), 7).count() == 0


def test_shards_cut_next_to_no_group(spark):
    # A third of all rows is one group, the rest in pairs: no room is free anywhere.
    values = [*("hot" for _ in range(800)), *(f"pair {i // 2}" for i in range(1600))]
    out = sharding.shard(spark.createDataFrame([(i, x) for i, x in enumerate(values)], "doc_id long, text string"), shards=40).cache()
    rows = out.collect()
    count = collections.Counter(x.shard for x in rows)
    assert set(count.values()) == {60} and len(count) == 40
    assert len({x.shard for x in rows if x.doc_id < 800}) == 14
    r = sharding.cut_share(out).first()
    assert (r.groups, r.cut_groups <= 81) == (801, True)
    where = collections.defaultdict(set)
    for x in rows:
        where[x.group].add(x.shard)
    assert r.cut_groups == sum(len(v) > 1 for v in where.values())


def test_large_groups_take_as_few_shards_as_will_do():
    pieces, left = sharding.allot({1: {0: 5, 3: 20}, 2: {1: 13}}, [10, 10, 10, 9])
    assert [s for _, s in pieces[1]][0] == 3 and len(pieces[1]) == 3 and len(pieces[2]) == 2
    assert pieces[1][-1][0] == 25 and pieces[2][-1][0] == 13 and sum(left) == 1
    assert sharding.allot({1: {0: 5}}, [2, 2, 1, 0]) == ({1: [(2, 0), (4, 1), (5, 2)]}, [0, 0, 0, 0])


def test_pipeline_runs_on_odd_documents(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    bench = [prose(r, 30), prose(r, 20)]
    good = [prose(r, 120) for _ in range(6)]
    near = good[0].split()
    near[60] = "changed"
    values = [*ODD, *good, good[1], " ".join(near), bench[0] + " " + prose(r, 60)]
    frame(spark, values).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    n = len(ODD)
    assert sorted(got) == list(range(n, n + 6))
    enc = byte_bpe.ByteBPE(RANKS, P.PATTERN)
    assert all(got[n + i].ids == enc.encode(x).tolist() for i, x in enumerate(good))


def test_rank_file_is_whole():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    assert all(bytes([i]) in ranks for i in range(256))
    assert pa.__version__
