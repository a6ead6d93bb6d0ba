"""Token files: ids against the library over all characters, blocks, damage, long texts."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from tidemark.llm import token_files

P = pytest.importorskip("public_tokenizers")
WORDS = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return token_files.WordEncoder(WORDS), Tokenizer.from_file(WORDS)


def differing(both, values):
    ours, library = both
    flat, n = ours.texts(pa.array(values, pa.string()), 2)
    ends = np.append(0, np.cumsum(n))
    found = library.encode_batch_fast(values, add_special_tokens=False)
    return [x for x, a, b, e in zip(values, ends, ends[1:], found, strict=False) if flat[a:b].tolist() != [*e.ids, 2]]


def test_every_character_before_a_stop_or_comma(both):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    assert differing(both, [" ".join(f"{c}. {c}, T{c}." for c in points[k : k + 2000]) for k in range(0, len(points), 2000)]) == []


def test_random_mixes_of_marks_capitals_and_special_tokens(both):
    r = random.Random(1)
    pool = [*"abHTWYJI .,.\n'<|>st01", *map(chr, (0x307, 0x331, 0x308, 0x30A, 0x30C, 0x130, 0x958, 0x9DC, 0xA33, 0xE9, 0xC9, 0xDF, 0x1E96, 0xD7, 0xF7, 0x3A3, 0xA0, 0x2028, 0x1100, 0x1161, 0x1C, 0x85, 0x2126)), "<|endoftext|>", "<|startoftext|>", "'ll", "é."]
    assert differing(both, ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(20_000)]) == []
    assert differing(both, ["İ. Tamam", "H̱", "", " ", "a" * 3000, "x " * 401]) == []


def test_other_tokenizers_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer, normalizers

    other = Tokenizer.from_file(WORDS)
    other.normalizer = normalizers.NFKC()
    other.save(path := str(tmp_path / "other.json"))
    ours = token_files.WordEncoder(path)
    assert not ours.by_words
    assert differing((ours, other), ["A b", "", "ﬁ. x"]) == []


def test_parts_hold_whole_texts():
    values = pa.array(["a" * 5, "b" * 3, "", "c" * 20, "d"])
    assert list(token_files.parts(values, 8)) == [(0, 3), (3, 4), (4, 5)]
    assert list(token_files.parts(values[:0])) == []


@pytest.mark.parametrize("bits", [False, True])
def test_blocks_are_planes_and_are_read_alone(bits):
    ids = np.random.default_rng(0).integers(0, 49_408, 1000).astype(np.uint32)
    blob = token_files.pack(ids, block=64, bits=bits)
    chunk = token_files.Chunk.of(blob)
    assert (chunk.count, chunk.block, chunk.planes, len(chunk.index)) == (1000, 64, 16 if bits else 2, 16)
    for k in range(16):
        at, end = int(chunk.at[k]), int(chunk.at[k + 1])
        alone = blob[: int(chunk.at[0])] + bytes(at - int(chunk.at[0])) + blob[at:end] + bytes(len(blob) - end)  # all other blocks are zeros
        assert (token_files.read_block(alone, k) == ids[64 * k : 64 * k + 64]).all()
        first = zstandard.ZstdDecompressor().decompress(blob[at : at + int(chunk.index[k, 1])])
        part = ids[64 * k : 64 * k + 64]
        assert first == (np.packbits((part & 1).astype(np.uint8), bitorder="little") if bits else (part & 255).astype(np.uint8)).tobytes()
    assert (token_files.unpack(blob) == ids).all()
    assert blob != token_files.pack(ids, block=128, bits=bits)
    for odd in (np.zeros(0, np.uint32), np.array([2**32 - 1, 0], np.uint32), np.zeros(7, np.uint32)):
        assert (token_files.unpack(token_files.pack(odd, block=4, bits=bits)) == odd).all()


def test_damage_is_seen():
    blob = token_files.pack(np.arange(1000, dtype=np.uint32), block=100)
    for at in (1, 40, len(blob) - 3):
        bad = bytearray(blob)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_files.unpack(bytes(bad))
    with pytest.raises(ValueError):
        token_files.unpack(blob[:-1])


def test_a_very_long_text(spark, both, tmp_path):
    r = random.Random(2)
    long = " ".join(r.choice(["alpha", "Beta.", "ga-mma,", "é", f"{r.random()}"]) for _ in range(400_000))
    df = spark.createDataFrame([(1, "short"), (0, long), (2, "x" * 100_000)], "doc_id long, text string")
    token_files.write_ids(df, path := str(tmp_path / "ids"), WORDS, 2)
    got = {x.doc_id: x for x in token_files.read_ids(spark, path).collect()}
    assert got[0].ids == [*both[1].encode(long, add_special_tokens=False).ids, 2]
    assert [got[i].start for i in range(3)] == [0, got[0].n_tokens, got[0].n_tokens + got[1].n_tokens]
