"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

Within a pre-token, the pairs that can merge wait in buckets, one per merge rank,
which hold positions of a linked list of symbols. A two-level bitmap marks the
buckets in use; find-first-set on it gives the next rank, so a step costs the same
for a pre-token of five bytes and of five million. Entries whose pair has changed
meanwhile are skipped when they come up.

Defined results: a null or empty text has no ids and decodes to no bytes; rows are
independent, so repeated rows give repeated results; a null id stays null; ids out
of the vocabulary raise on decoding; other columns are not read; a very long text is one row
and a very long pre-token one list, about 60 bytes of memory for each of its bytes; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, whole_text

#: Pre-tokens whose ids a worker remembers.
HELD = 600_000


class ByteBPE(dict):
    """Pre-token -> its ids as little-endian 32-bit integers; misses are encoded."""

    def __init__(self, rank_file: str, pattern: str):
        import regex

        super().__init__()
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)  # by id
        for k, v in self.ranks.items():
            self.bytes[v] = k
        self.decimal = [str(i) for i in range(len(self.bytes))]
        # The rank files' library takes white space by its Unicode property.
        pattern = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.cut: Callable[[str], list[str]] = regex.compile(pattern).findall

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        get = ranks.get
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        due = [-1] * n  # rank of the pair that starts at a position
        buckets: dict[int, int | list[int]] = {}  # rank -> position, or a heap of several
        words: dict[int, int] = {}  # bitmaps of 256 ranks each
        top = 0  # bitmap of the words in use
        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) is not None:
                due[i] = r
                if (held := buckets.get(r)) is None:
                    buckets[r] = i
                    w = r >> 8
                    words[w] = words.get(w, 0) | 1 << (r & 255)
                    top |= 1 << w
                elif held.__class__ is int:
                    buckets[r] = [held, i]
                else:
                    held.append(i)  # ascending, so a heap
        while top:
            w = (top & -top).bit_length() - 1
            bits = words[w]
            rank = w << 8 | (bits & -bits).bit_length() - 1
            held = buckets[rank]
            if held.__class__ is int:
                at = held
            else:
                at = heappop(held)
            if held.__class__ is int or not held:
                del buckets[rank]
                words[w] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            if due[at] != rank:
                continue
            gone = after[at]
            end = after[gone]
            after[at] = end
            due[gone] = due[at] = -1
            left = before[at]
            if end < n:
                before[end] = at
                right = after[end]
                r, i = get(piece[at:right]), at
            else:
                r = None
            # The pair to the right, then the one to the left.
            while True:
                if r is not None:
                    due[i] = r
                    if (held := buckets.get(r)) is None:
                        buckets[r] = i
                        w = r >> 8
                        words[w] = words.get(w, 0) | 1 << (r & 255)
                        top |= 1 << w
                    elif held.__class__ is int:
                        buckets[r] = [held, i] if held < i else [i, held]
                    else:
                        heappush(held, i)
                if left < 0:
                    break
                due[left] = -1
                r, i, left = get(piece[left:end]), left, -1
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.merge(word.encode()), "<u4").tobytes()
        if len(word) < 64:
            if len(self) >= HELD:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.cut(text))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and ids.min() < 0:
            raise IndexError("an id below 0")
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


_held: dict[tuple[str, str], ByteBPE] = {}


def codec(rank_file: str, pattern: str) -> ByteBPE:
    """One codec for a worker's life."""
    if (key := (rank_file, pattern)) not in _held:
        _held[key] = ByteBPE(rank_file, pattern)
    return _held[key]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), whole_text(text_col).alias("text"))
    return rows, dict(rows.dtypes)[id_col]


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int) of every whole text; one pass without a shuffle."""
    rows, kind = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for b in batches:
            each = [own.encode(x.as_py()) for x in b.column("text")]
            ends = np.append(0, np.cumsum([len(x) for x in each])).astype(np.int32)
            flat = np.concatenate(each).astype(np.int32) if each else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [id_col, "ids"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(coded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, bytes (binary) of every row's ids; null ids as none."""
    small_batches(coded.sparkSession)
    rows = coded.select(F.col(id_col), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for b in batches:
            out = [own.decode(np.asarray(x.values)) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [id_col, "bytes"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every whole text, then decode the ids: id, n_tokens, ids_sha256 (of the
    decimal ids, comma-joined), decoded_sha256 (of the decoded bytes) and, if asked
    for, ids. Both steps run in one pass, so that ids don't cross to the JVM between."""
    rows, kind = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            n, coded, plain, kept = [], [], [], []
            for x in b.column("text"):
                ids = own.encode(x.as_py())
                n.append(len(ids))
                coded.append(sha(",".join(map(own.decimal.__getitem__, ids.tolist())).encode()))
                plain.append(sha(own.decode(ids)))
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            out = [b.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())]
            if keep_ids:
                ends = np.append(0, np.cumsum(n)).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int32))))
            yield pa.RecordBatch.from_arrays(out, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
