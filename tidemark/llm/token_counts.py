"""Token counts by rank-synchronous array merging.

A batch of texts is cut into pre-tokens (runs that start with the word-start
mark; no piece of the vocabulary crosses such a start). The distinct pre-tokens
of the batch are held as one ragged numpy array of symbols. In each round every
sequence applies its lowest-rank pair, all sequences at once; what is left when
no sequence has a pair is counted. Symbols that are no piece fall back to bytes.

Defined results: a null or empty text has 0 tokens; rows are independent, so
repeated rows give repeated results and ids may be null; other columns are not read; a very
long text is one row, cut into pre-tokens by one task (about 20 bytes of memory for each of
its characters); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, whole_text

MARK = "▁"  # word start, as the piece vocabulary writes a space
_RUNS = re.compile(f"{MARK}+[^{MARK}]*")
#: Slots of the pair table (a power of two), and pre-tokens that a worker remembers.
BITS, HELD = 18, 400_000
NONE = np.iinfo(np.int32).max


class PieceCounter:
    """Counts tokens as a sentencepiece BPE model with byte fallback does."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        scores = {
            sp.id_to_piece(i): sp.get_score(i)
            for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        }
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("a piece holds a word start inside; texts can't be cut into pre-tokens")
        levels = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pieces = sorted(scores)
        ids = {p: i for i, p in enumerate(pieces)}
        rank = np.array([levels[scores[p]] for p in pieces], np.int32)
        pairs, merged = [], []
        again = np.zeros(len(pieces) + 1, bool)  # pieces whose making can bring in a pair of no higher rank
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    merged.append(i)
                    for part, text in ((a, p[:k]), (b, p[k:])):
                        if len(text) > 1 and rank[part] >= rank[i]:
                            again[part] = True
        self.table(np.array(pairs, np.int64), np.array(merged, np.int32))
        self.rank = np.append(rank, NONE).astype(np.int32)
        self.again = again
        self.n = len(pieces)
        self.held: dict[str, int] = {}
        # Code point -> piece; other code points are symbols of their own that no pair holds.
        self.letter = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.letter[ord(p)] = i

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)

    def table(self, pairs: np.ndarray, merged: np.ndarray) -> None:
        """An open hash table of pairs; its arrays are filled round by round."""
        self.keys, self.made = np.full(1 << BITS, -1, np.int64), np.zeros(1 << BITS, np.int32)
        at, left = self.slot(pairs), np.arange(len(pairs))
        while len(left):
            free = self.keys[at[left]] == -1
            self.keys[at[left[free]]] = pairs[left[free]]  # of several the last one stays
            self.made[at[left[free]]] = merged[left[free]]
            left = left[self.keys[at[left]] != pairs[left]]
            at[left] = (at[left] + 1) & ((1 << BITS) - 1)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two neighbours make, or n."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) << 32 | right, -2)
        at = self.slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.made[at], self.n)
        on = np.flatnonzero((found != key) & (found != -1) & (key != -2))
        while len(on):
            at[on] = (at[on] + 1) & ((1 << BITS) - 1)
            found = self.keys[at[on]]
            same = found == key[on]
            out[on[same]] = self.made[at[on[same]]]
            on = on[~same & (found != -1)]
        return out

    def known(self, words: list[str]) -> np.ndarray:
        """As counts; remembers up to HELD pre-tokens."""
        get = self.held.get
        out = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(out < 0)
        if len(new):
            fresh = [words[i] for i in new]
            out[new] = self.counts(fresh)
            if len(self.held) + len(fresh) > HELD:
                self.held.clear()
            self.held.update(zip((w for w in fresh if len(w) < 40), (int(out[i]) for i in new if len(words[i]) < 40), strict=True))
        return out

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token, written without its first mark."""
        if not words:
            return np.zeros(0, np.int64)
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        points = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
        seq = np.repeat(np.arange(len(words)), lengths)
        sym = self.letter[points]
        size = np.where(sym >= 0, 1, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int64)
        total = np.zeros(len(words), np.int64)
        to = np.append(np.where(seq[:-1] == seq[1:], self.pair(sym[:-1], sym[1:]), self.n), self.n)
        while True:
            ranks = self.rank[to]
            start = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low = np.minimum.reduceat(ranks, start)
            live = low < NONE
            if not live.all():  # finished sequences leave the array
                names = seq[start]
                sums = np.add.reduceat(size, start)
                total[names[~live]] = sums[~live]
                keep = np.repeat(live, np.diff(np.append(start, len(seq))))
                seq, sym, size, to, ranks, low = seq[keep], sym[keep], size[keep], to[keep], ranks[keep], low[live]
                if not len(seq):
                    return total
                start = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            span = np.diff(np.append(start, len(seq)))
            hit = np.flatnonzero(ranks == np.repeat(low, span))
            # Of a run of overlapping hits every second one merges, from the left; where
            # a merge can open a pair of no higher rank, only the first of its sequence.
            run = np.flatnonzero(np.append(True, np.diff(hit) != 1))
            offset = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            first = np.append(True, seq[hit[1:]] != seq[hit[:-1]])
            one = np.repeat(self.again[to[hit[first]]], np.diff(np.append(np.flatnonzero(first), len(hit))))
            hit = hit[np.where(one, first, offset % 2 == 0)]
            sym[hit] = to[hit]
            size[hit] = 1
            gone = np.ones(len(seq), bool)
            gone[hit + 1] = False
            place = np.cumsum(gone) - 1
            seq, sym, size, to = seq[gone], sym[gone], size[gone], to[gone]
            hit = place[hit]
            for left in (hit, hit[hit > 0] - 1):
                left = left[left < len(seq)]
                right = np.minimum(left + 1, len(seq) - 1)
                fit = (right > left) & (seq[left] == seq[right])
                to[left] = np.where(fit, self.pair(sym[left], sym[right]), self.n)

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of a string array without nulls."""
        n = np.zeros(len(texts), np.int64)
        plain = ~np.array(
            pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.match_substring(texts, MARK), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))),
            dtype=bool,
        ) & np.array(pc.not_equal(pc.binary_length(texts), 0), dtype=bool)
        for part in np.array_split(np.flatnonzero(plain), max(1, int(plain.sum() * 1.0 // 4000))):
            if len(part):
                lists = pc.split_pattern(texts.take(pa.array(part)), " ")
                words = lists.flatten().dictionary_encode()
                each = self.known(words.dictionary.to_pylist())
                ends = np.append(0, np.cumsum(each[np.asarray(words.indices)]))
                bounds = np.asarray(lists.offsets)
                n[part] = ends[bounds[1:] - bounds[0]] - ends[bounds[:-1] - bounds[0]]
        names: dict[str, int] = {}
        where = []
        for i in np.flatnonzero(~plain):
            runs = _RUNS.findall(MARK + text.replace(" ", MARK)) if (text := texts[int(i)].as_py()) else []
            where.append((i, np.array([names.setdefault(x[1:], len(names)) for x in runs], np.int64)))
        each = self.known(list(names))
        for i, runs in where:
            n[i] = each[runs].sum()
        return n


_held: dict[str, PieceCounter] = {}


def counter(model_file: str) -> PieceCounter:
    """One counter for a worker's life."""
    if model_file not in _held:
        _held[model_file] = PieceCounter(model_file)
    return _held[model_file]


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8) and n_tokens of every whole text, without begin, end or
    other added tokens. One pass over the rows, without a shuffle."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), whole_text(text_col).alias("text"))
    kind = dict(rows.dtypes)[id_col]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_file)
        for b in batches:
            texts = b.column("text")
            texts = texts.cast(pa.string()) if texts.type != pa.string() else texts
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(own.texts(texts))],
                [id_col, "n_bytes", "n_tokens"],
            )

    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
