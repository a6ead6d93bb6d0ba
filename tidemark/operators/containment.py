"""Which of many names a text contains, without comparing every text with every name.

Names whose count and bytes, taken first, are small go to the tasks as sorted words of 8
bytes. A task looks up every place of its texts there, so that a text is read once and its
pairs are written where it lies: nothing is shuffled, and the work grows with the texts and
the pairs.

More names are met by an equi join. A name can only be in a text that holds each of its runs
of GRAM characters. Each name is filed under one of its runs, the one that the fewest names
share; the runs of a text meet those, and only the names that were met are looked for in the
text. Runs travel as hashes without their texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Characters of a run; names that go to every task, and their bytes at most for each of those.
GRAM, BROADCAST_NAMES, NAME_BYTES = 4, 500_000, 32
#: Places of the texts that a task looks at together.
SPAN = 1 << 17
#: A text is cut into pieces for its runs, as the i-th character of a long one is far to seek.
PIECE = 64


def runs(text: Column, k: int) -> Column:
    """The distinct hashes of all runs of k characters."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    # Each piece goes k - 1 characters into the next (and further, where that is shorter than k).
    whole = F.transform(pieces, lambda x, i: F.concat(x, F.coalesce(F.left(F.get(pieces, i + 1), F.lit(k - 1)), F.lit("")))) if k > 1 else pieces
    each = F.transform(whole, lambda x: F.when(F.length(x) >= k, F.transform(F.sequence(F.lit(1), F.length(x) - k + 1), lambda i: F.xxhash64(F.substr(x, i, F.lit(k))))).otherwise(F.array().cast("array<bigint>")))
    return F.array_distinct(F.flatten(each))


def _among(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are known (sorted, not empty), and their places there."""
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    here = np.flatnonzero(known[at] == values)
    return here, at[here]


class Words:
    """Distinct names as words of 8 bytes: of a name of n bytes the first is cut to n, and the
    last ends where the name ends. A state stands for the words of a name up to one of them, so
    that a place has one state for each length of names, however many names begin alike."""

    def __init__(self, names: list[bytes]):
        sizes = np.array([len(x) for x in names])
        read = lambda ids, a, n: np.array([int.from_bytes(names[i][a : a + n], "little") for i in ids], np.uint64)
        self.first = []
        for width in np.unique(np.minimum(sizes, 8)).tolist():
            ids = np.flatnonzero(np.minimum(sizes, 8) == width)
            words, first = np.unique(read(ids, 0, width), return_inverse=True)
            bits = min(max(len(words).bit_length() + 4, 10), 22)
            seen = np.zeros(1 << bits, bool)
            seen[self._slot(words, bits)] = True
            lengths = []
            for n in np.unique(sizes[ids]).tolist():
                own, state = ids[sizes[ids] == n], first[sizes[ids] == n]
                begins, states, steps = np.isin(np.arange(len(words)), state), len(words), []
                for a in (*range(8, n - 8, 8), n - 8) if n > 8 else ():
                    known, word = np.unique(read(own, a, 8), return_inverse=True)
                    pairs, state = np.unique(state * len(known) + word, return_inverse=True)
                    steps.append((a, known, pairs))
                    states = len(pairs)
                name = np.zeros(states, np.int64)
                name[state] = own
                lengths.append((n, begins, steps, name))
            self.first.append((np.uint64((1 << 8 * width) - 1), words, bits, seen, lengths))

    @staticmethod
    def _slot(words: np.ndarray, bits: int) -> np.ndarray:
        return ((words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def begin(self, text: np.ndarray, a: int, b: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Places from a up to b where names of n bytes begin, n, and the names. text: the 8
        bytes from each place, and from the end."""
        here = text[a:b].copy()
        for mask, words, bits, seen, lengths in self.first:
            own = here & mask
            place = np.flatnonzero(seen[self._slot(own, bits)])
            hit, first = _among(words, own[place])
            place = place[hit] + a
            for n, begins, steps, name in lengths:
                fits = begins[first] & (place + n < len(text))
                at, state = place[fits], first[fits]
                for i, known, pairs in steps:
                    if not len(at):
                        break
                    hit, word = _among(known, text[at + i])
                    at, state = at[hit], state[hit] * len(known) + word
                    hit, state = _among(pairs, state)
                    at = at[hit]
                if len(at):
                    yield at, n, name[state]


def _pairs(names: list[bytes], columns: list[str], span: int = SPAN):
    """Batches of key and text to batches of key and name, each pair once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = Words(names), pa.array(names, pa.binary())
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
            total, ends = int(bounds[-1] - bounds[0]), bounds[1:] - bounds[0]
            if not total:
                continue
            raw = np.concatenate([np.frombuffer(column.buffers()[2], np.uint8, total, int(bounds[0])), np.zeros(8, np.uint8)])
            text, held = np.ndarray(total + 1, "<u8", raw, strides=(1,)), np.zeros(0, np.int64)
            for a in range(0, total, span):
                b, codes = min(a + span, total), [held]
                for at, n, name in words.begin(text, a, b):
                    row = np.searchsorted(ends, at, "right")
                    inside = at + n <= ends[row]
                    codes.append(row[inside] * len(names) + name[inside])
                codes = np.unique(np.concatenate(codes))
                # Texts that end here are done; what is known of the next one waits for its end.
                cut = np.searchsorted(codes, np.searchsorted(ends, b, "right") * len(names))
                done, held = codes[:cut], codes[cut:]
                if cut:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(done // len(names))), table.take(pa.array(done % len(names)))], columns)

    return run


def contained(df: DataFrame, key: str, text: str, names: DataFrame, name: str, k: int = GRAM, most: int = BROADCAST_NAMES) -> DataFrame:
    """key, name: every name that the text of a row contains, once. Keys are distinct; empty
    and null names and null texts are in nothing. Names shorter than a run are filed under
    themselves."""
    known = names.select(F.col(name).alias("__name")).filter(F.length("__name") > 0).distinct()
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).filter("__text IS NOT NULL")
    size = known.agg(F.count("*"), F.sum(F.octet_length("__name"))).first()
    if not size[0]:
        return df.select(key, F.lit(None).cast("string").alias(name)).limit(0)
    if size[0] <= most and size[1] <= NAME_BYTES * most:
        few = [bytes(r[0]) for r in known.select(F.col("__name").cast("binary")).collect()]
        kinds = StructType([StructField("__key", rows.schema["__key"].dataType), StructField("__name", BinaryType())])
        pairs = rows.select("__key", F.col("__text").cast("binary")).mapInArrow(_pairs(few, kinds.names), kinds)
        return pairs.select(F.col("__key").alias(key), F.col("__name").cast("string").alias(name))
    known = known.withColumn("__k", F.least(F.length("__name"), F.lit(k)))
    lengths = sorted(r[0] for r in known.select("__k").distinct().collect())  # at most k
    pick = lambda col: F.coalesce(*[F.when(F.col("__k") == n, runs(col, n)) for n in lengths])
    each = known.select("__name", "__k", F.explode(pick(F.col("__name"))).alias("__run"))
    shared = each.groupBy("__k", "__run").agg(F.count("*").alias("__n"))
    filed = each.join(shared, ["__k", "__run"]).groupBy("__name", "__k").agg(F.min(F.struct("__n", "__run")).alias("__x")).select("__name", "__k", F.col("__x.__run").alias("__run"))
    held = None
    for n in lengths:
        part = rows.select("__key", F.lit(n).alias("__k"), F.explode(runs(F.col("__text"), n)).alias("__run"))
        held = part if held is None else held.unionByName(part)
    met = held.join(filed, ["__k", "__run"]).select("__key", "__name")
    return met.join(rows, "__key").filter(F.contains("__text", "__name")).select(F.col("__key").alias(key), F.col("__name").alias(name))
