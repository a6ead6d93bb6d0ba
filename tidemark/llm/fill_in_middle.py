"""Fill-in-middle: a text cut into prefix, middle and suffix at the edges of its units, and
put together again in the order that a model is trained on.

Units are the isolated matches of a pattern by the tokenizers library's Split
pre-tokenizer, which takes no training; it gives their offsets in code points. The length
of the array of offsets is n; two hashes of the id rank two of the n + 1 edges, and the
offsets at those ranks give the slices. A third hash decides whether a text is changed at
all, a fourth which of the two orders it takes. A text is made again from its output and
its form alone (`restore`), on DataFrame functions.

Each row is worked on alone, so that a hot source or a group of copies needs no shuffle,
and a lost executor's rows are made again alike.

Defined results: a null text is empty; an empty text, one that holds a sentinel and one
that the rate spares are plain (the text as it is; the lengths are null); characters that
no unit matches are units of their own, so that nothing is lost; a null id has the empty
string for its decimal digits; rows that repeat an id are cut at the same ranks; a very
long text is one row, whose offsets are one task's (about 100 bytes a unit); columns of
the input that have the name of a result (n, form, prefix_chars, middle_chars, output) are
replaced, others are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import small_batches, whole_text

#: A line with its end, or the last one without.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit integers of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(np.frombuffer(digest[:16], ">u4").tolist())


class Cutter:
    """Cuts texts; made once in each Python worker's task."""

    def __init__(self, pattern: str, seed: int, rate: int, spm: int):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.seed, self.rate, self.spm = seed, rate, spm

    def edges(self, text: str) -> np.ndarray:
        """Code-point offsets of the n + 1 edges of the n units."""
        ends = [end for _, (_, end) in self.split.pre_tokenize_str(text)]
        return np.array([0, *ends], np.int64)

    def cut(self, doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
        edges = self.edges(text)
        n = len(edges) - 1
        h1, h2, h3, h4 = draws(self.seed, doc_id)
        if not text or any(x in text for x in SENTINELS) or h3 % 100 >= self.rate:
            return n, "plain", None, None, text
        a, b = edges[sorted((h1 % (n + 1), h2 % (n + 1)))].tolist()
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < self.spm:
            return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int, rate: int = 100, spm: int = 50, pattern: str = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (whose text is kept beside its `output`) with n (units), form (plain, psm or
    spm), prefix_chars and middle_chars (code points), output. rate: per cent of the texts
    that are changed; spm: per cent of those that have the suffix first."""
    small_batches(docs.sparkSession)
    rest = docs.drop(*RESULTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(pattern, seed, rate, spm)
        for b in batches:
            made = [cutter.cut(i, x or "") for i, x in zip(b.column("__id").to_pylist(), b.column("__text").to_pylist(), strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            arrays = [pa.array([x[k] for x in made], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *arrays], [*b.schema.names[:-2], *RESULTS])

    schema = StructType([*rest.schema.fields, *StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string")])
    return rest.select("*", rest[id_col].cast("long").alias("__id"), rest[text_col].alias("__text")).mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text again: as no text holds a sentinel, the output's three parts lie between them."""
    parts = F.split(output, "|".join(SENTINELS))
    part = lambda k: F.element_at(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output)
