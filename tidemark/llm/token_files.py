"""Token ids as binary files, by plane shuffling.

A chunk holds the ids of whole documents, end to end, cut into blocks of a fixed number of
ids. Each block is transposed into bit or byte planes (all first bits, all second bits, ...
or all low bytes, all next bytes, ...) and each plane is compressed by zstandard on its
own; the chunk's header indexes the planes of every block, so that `read_block` reads one
block without the others. A chunk is one row of a Parquet folder: its blob beside the chunk
index (shard, chunk, first position, documents and their lengths), which can be read
without the blobs. Spark's writer commits the files, so lost executors leave no part of a
file behind.

Blob: 'TMPL', version u8, plane kind u8 (0 bit, 1 byte), planes u16, block size u32,
ids u64; then for each block the crc32 of its ids as u32 and each plane's length as u32;
then the planes, block by block; all little-endian.

Defined results: a null or empty text has the end id alone; rows with equal or null
id are each a document (null ids first, ties by text); other columns are not read; a very
long text is encoded whole by one task, in a few hundred bytes of memory a word; an empty
table gives an empty folder and no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, whole_text

HEAD = struct.Struct("<4sBBHIQ")
#: Ids of a chunk, more or less (a chunk ends with a document), and of a block.
CHUNK_IDS, BLOCK_IDS = 1 << 19, 1 << 16
#: Bytes of an Arrow batch, and of the texts that are encoded at once, but for a longer text:
#: what a worker holds.
BATCH = PART = 4 << 20
#: Words that are encoded as one text.
RUN = 200
#: What a tokenizers file must say for its texts to be cut into words: fixed values.
STEPS = ["NFC", "Replace", "Lowercase"]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters, lower and upper case, that NFC and lower-casing turn into one letter each and
#: that compose with no letter or punctuation beside them.
LOWER, UPPER = "a-zß-öø-ÿ", "A-ZÀ-ÖØ-Þ"


def _planes(ids: np.ndarray, n: int, bits: bool) -> list[bytes]:
    """The n planes of a block."""
    if bits:
        return [np.packbits((ids >> np.uint32(k) & np.uint32(1)).astype(np.uint8), bitorder="little").tobytes() for k in range(n)]
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [raw[:, k].tobytes() for k in range(n)]


def pack(ids: np.ndarray, block: int = BLOCK_IDS, bits: bool = False, level: int = 3) -> bytes:
    """ids as a blob."""
    import zstandard

    coder = zstandard.ZstdCompressor(level=level)
    most = int(ids.max()).bit_length() if len(ids) else 0
    n = max(1, most if bits else -(-most // 8))
    index, data = [], []
    for k in range(0, len(ids), block):
        part = ids[k : k + block]
        planes = [coder.compress(x) for x in _planes(part, n, bits)]
        index += [zlib.crc32(part.astype("<u4").tobytes()), *map(len, planes)]
        data += planes
    return b"".join([HEAD.pack(b"TMPL", 2, 0 if bits else 1, n, block, len(ids)), struct.pack(f"<{len(index)}I", *index), *data])


@dataclass
class Chunk:
    """The header and index of a blob."""

    bits: bool
    planes: int
    block: int
    count: int
    index: np.ndarray  # block -> crc32 of its ids, lengths of its planes
    at: np.ndarray  # block -> where its planes begin

    @classmethod
    def of(cls, blob: bytes) -> Chunk:
        magic, version, kind, n, block, count = HEAD.unpack_from(blob)
        if magic != b"TMPL" or version != 2:
            raise ValueError("not a chunk of token ids")
        blocks = -(-count // block)
        index = np.frombuffer(blob, "<u4", blocks * (n + 1), HEAD.size).reshape(blocks, n + 1)
        size = index[:, 1:].sum(1, dtype=np.int64)
        at = HEAD.size + 4 * index.size + np.append(0, np.cumsum(size))
        if at[-1] != len(blob):
            raise ValueError("a chunk of token ids is damaged")
        return cls(not kind, n, block, count, index, at)


def read_block(blob: bytes, k: int, chunk: Chunk | None = None) -> np.ndarray:
    """The ids of block k; of the blob its header, its index and this block are read."""
    import zstandard

    chunk, reader = chunk or Chunk.of(blob), zstandard.ZstdDecompressor()
    n = min(chunk.block, chunk.count - k * chunk.block)
    ids, at = np.zeros(n, np.uint32), int(chunk.at[k])
    for p, size in enumerate(chunk.index[k, 1:].tolist()):
        try:
            plane = np.frombuffer(reader.decompress(blob[at : at + size]), np.uint8)
        except zstandard.ZstdError as x:
            raise ValueError("a block of token ids is damaged") from x
        at += size
        if chunk.bits:
            ids |= np.unpackbits(plane, bitorder="little")[:n].astype(np.uint32) << np.uint32(p)
        else:
            ids |= plane.astype(np.uint32) << np.uint32(8 * p)
    if zlib.crc32(ids.astype("<u4").tobytes()) != chunk.index[k, 0]:
        raise ValueError("a block of token ids is damaged")
    return ids


def unpack(blob: bytes) -> np.ndarray:
    """All ids of a blob."""
    chunk = Chunk.of(blob)
    return np.concatenate([np.zeros(0, np.uint32), *(read_block(blob, k, chunk) for k in range(len(chunk.index)))])


class WordEncoder:
    """Ids of texts by a tokenizers file.

    Where the file's normalizer and pre-tokenizer are the known ones, no pre-token holds
    white space: every word between ASCII white space is encoded by the library on its own,
    distinct words of a part once. Words of LOWER letters are a pre-token that the normalizer
    leaves as it is; they go to the file's model without that step, and their ids part where
    an id ends a word. All other words go through the whole tokenizer, parted by a special
    token. Any other file encodes whole texts."""

    def __init__(self, tokenizer_file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            said = json.load(f)
        steps = (said.get("normalizer") or {}).get("normalizers", [])
        cuts = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        suffix = said["model"].get("end_of_word_suffix")
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.by_words = (
            [x["type"] for x in steps] == STEPS
            and steps[1]["pattern"] == {"Regex": r"\s+"}
            and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"] == {"Regex": WORDS}
            and not cuts[1]["add_prefix_space"]
            and said["model"]["type"] == "BPE"
            and bool(suffix and special)
            and all(t.content.startswith("<") for t in self.tokenizer.get_added_tokens_decoder().values())
        )
        if self.by_words:
            self.mark, self.mark_id = max(special)
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            for token, i in self.tokenizer.get_vocab().items():
                self.ends[i] = token.endswith(suffix)

    @staticmethod
    def _runs(words: pa.Array, between: str) -> list[str]:
        bounds = np.append(np.arange(0, len(words), RUN), len(words)).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), words), between).to_pylist()

    def _coded(self, tokenizer, texts: list[str]) -> np.ndarray:
        parts = [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *parts])

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words in some order, and each word's first and number of ids there."""
        plain = np.asarray(pc.match_substring_regex(words, f"^[{LOWER}]+$").cast(pa.uint8())).astype(bool)
        odd = np.asarray(pc.match_substring(words, "<").cast(pa.uint8())).astype(bool)
        first, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)

        one = np.flatnonzero(plain)
        ids = self._coded(self.plain, self._runs(words.take(pa.array(one)), " "))
        last = np.flatnonzero(self.ends[ids])
        first[one] = np.append(0, last + 1)[:-1] if len(last) else 0
        size[one] = last + 1 - first[one]

        two = np.flatnonzero(~plain & ~odd)
        marked = self._coded(self.tokenizer, [x + f" {self.mark}" for x in self._runs(words.take(pa.array(two)), f" {self.mark} ")])
        last = np.flatnonzero(marked == self.mark_id)
        first[two] = len(ids) + (np.append(0, last + 1)[:-1] if len(last) else 0)
        size[two] = len(ids) + last - first[two]

        three = np.flatnonzero(odd)  # words in which the mark or another special token may stand
        rest = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words.take(pa.array(three)).to_pylist(), add_special_tokens=False)]
        size[three] = [len(x) for x in rest]
        first[three] = len(ids) + len(marked) + np.cumsum(size[three]) - size[three]
        return np.concatenate([ids, marked, *rest]), first, size

    def texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's number of them, its end id included."""
        if not self.by_words:
            rows = [np.array([*e.ids, end_id], np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *rows]), np.array([len(x) for x in rows], np.int64)
        # Fewer distinct words: a full stop or comma between a letter and white space is a
        # pre-token of its own, and A-Z is lowered anyhow, unless special tokens (which are met
        # before) or marks that compose with capitals (U+0300 to U+037F, bytes CC and CD) may stand there.
        texts = pc.replace_substring_regex(texts, rf"([{LOWER}{UPPER}])([.,])(\s|$)", r"\1 \2\3")
        raw = texts.cast(pa.binary())
        keep = pc.or_(pc.match_substring(texts, "<|"), pc.or_(pc.match_substring(raw, b"\xcc"), pc.match_substring(raw, b"\xcd")))
        lists = pc.ascii_split_whitespace(pc.if_else(keep, texts, pc.ascii_lower(texts)))
        words = lists.flatten().dictionary_encode()
        # Text between two runs of white space, or none: an empty word has no ids.
        flat, first, size = self.words(words.dictionary)
        which = np.asarray(words.indices)
        bounds = np.asarray(lists.offsets).astype(np.int64)
        bounds = bounds - bounds[0]
        # A word's ids, and after a text's last word its end id.
        each = size[which]
        ends = np.append(0, np.cumsum(each))
        n = ends[bounds[1:]] - ends[bounds[:-1]] + 1
        out = np.full(int(n.sum()), end_id, np.uint32)
        steps = np.arange(ends[-1])
        taken = flat[np.repeat(first[which] - ends[:-1], each) + steps]
        text_of = np.repeat(np.arange(len(n)), np.diff(bounds))
        out[np.repeat(text_of, each) + steps] = taken
        return out, n


def parts(texts: pa.Array, most: int = PART) -> Iterator[tuple[int, int]]:
    """Slices (from, to) of at most `most` bytes, or of one text."""
    size = np.asarray(pc.binary_length(texts)).astype(np.int64)
    first, total = 0, 0
    for k, x in enumerate(size.tolist()):
        if k > first and total + x > most:
            yield first, k
            first, total = k, 0
        total += x
    if first < len(size):
        yield first, len(size)


@lru_cache(2)
def encoder(tokenizer_file: str) -> WordEncoder:
    """One for each worker: as a function of the module it is sent by name, not by value."""
    return WordEncoder(tokenizer_file)


def write_ids(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, bits: bool = False) -> None:
    """Encode every whole text, append end_id, and write the ids in ascending id order
    to `path`: one file per range of ids. The texts are dealt out by range before they
    are encoded, so each is encoded once and only texts are shuffled."""
    spark = docs.sparkSession
    small_batches(spark, BATCH)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, chunk, first = encoder(tokenizer_file), TaskContext.get().partitionId(), 0, 0
        ids, names, sizes, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            row = {"shard": [shard], "chunk": [chunk], "first": [first], "n_ids": [len(flat)], "doc_ids": [[x for y in names for x in y]], "sizes": [np.concatenate(sizes)], "blob": [pack(flat, bits=bits)]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("blob", pa.binary())]))

        for b in batches:
            texts = b.column("text").cast(pa.string())
            for k, m in parts(texts):
                flat, n = coder.texts(texts[k:m], end_id)
                ids.append(flat)
                names.append(b.column("doc_id")[k:m].to_pylist())
                sizes.append(n)
                held += len(flat)
                if held >= CHUNK_IDS:
                    yield out()
                    first, chunk = first + held, chunk + 1
                    ids, names, sizes, held = [], [], [], 0
        if names:
            yield out()

    rows.mapInArrow(run, "shard int, chunk int, first long, n_ids long, doc_ids array<long>, sizes array<long>, blob binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (array of int), read
    from the files alone. Chunks are independent, so this is a narrow pass; the shards'
    offsets come from the index columns (one row per shard)."""
    return _read(spark, path, "ids array<int>", lambda x: x.astype(np.int32), pa.list_(pa.int32()))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """As read_ids, with ids_crc32 (of the ids as little-endian unsigned 32-bit integers)
    in place of the ids."""
    return _read(spark, path, "ids_crc32 long", lambda x: zlib.crc32(x.astype("<u4").tobytes()), pa.int64())


def _read(spark: SparkSession, path: str, column: str, value, kind: pa.DataType) -> DataFrame:
    small_batches(spark, BATCH)
    chunks = spark.read.schema("shard int, chunk int, first long, n_ids long, doc_ids array<long>, sizes array<long>, blob binary").parquet(path)
    # A row for each file that was written: as many as the shards of `write_ids`, 16 bytes each.
    offset, offsets = 0, []
    for r in chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():  # a row per file
        offsets.append((r.shard, offset))
        offset += r.n
    starts = spark.createDataFrame(offsets, "shard int, offset long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                ids = unpack(b.column("blob")[row].as_py())
                sizes = np.asarray(b.column("sizes")[row].values)
                ends = np.append(0, np.cumsum(sizes))
                if ends[-1] != len(ids):
                    raise ValueError("a chunk's index doesn't fit its ids")
                base = b.column("first")[row].as_py() + b.column("offset")[row].as_py()
                values = [value(ids[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_ids")[row].values, pa.array(base + ends[:-1]), pa.array(sizes), pa.array(values, kind)], ["doc_id", "start", "n_tokens", column.split()[0]])

    return chunks.join(F.broadcast(starts), "shard").select("first", "offset", "doc_ids", "sizes", "blob").mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def encode_to_files(docs: DataFrame, tokenizer_file: str, end_id: int, **options) -> str:
    """write_ids to a new folder in the shared one; returns its path."""
    path = f"{shared_dir(docs.sparkSession)}/tidemark-ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer_file, end_id, **options)
    return path
