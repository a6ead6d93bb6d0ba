"""Line dedup by pairwise alignment.

Documents overlap where they share a line that is rare (in RARE documents at most): by its
hash a document meets every earlier document that holds it. Lines in more documents lead
to too many; a document meets the first holder of each run of them instead: of the
shortest runs of MIN_WORDS words or more, from each line onwards and up to each line, and
of two of them at most GAP lines apart, with their distance. So a block is found through
any rare line of it, or through a run if all of its lines are frequent, and pairs grow
with the corpus and not with the square of a group.

A pair is aligned by patience diff over all lines that the two share: lines that are
unique on both sides anchor the longest chain in order, rare ones first, and the gaps
between anchors are aligned alike. Each aligned line is followed along equal lines, at the
same distance and at most GAP other lines apart; such a block of MIN_WORDS words or more
goes from the later document. What is left is aligned again, without the pairs of lines
that have been followed, until no pair of lines is left: blocks in another order, and
passages that stand twice, are found by a later alignment. Where no line is unique any
more, the rarest ones anchor. The first document that holds a line never loses it, so
every line stays somewhere.

A block with gaps, all of whose lines are in more than RARE documents and all of whose runs
are short, is found if its earlier document is the first to hold two neighbours of it.

Defined results: lines are compared without case and outer or repeated white space;
lines without words are no lines, and go where a document loses any; a null text is
unchanged; rows with a null id lose nothing; rows with an equal id are one document and
not aligned with each other; rows with equal id and text lose the same lines; columns of
the input with the name of a result (n_lines, n_removed, words_removed, kept) are replaced,
others are kept; a very long text is one row, its lines in one task; an empty table gives no
rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, whole_text
from .quality_rules import SPACE, SPACES, has_word

#: Words of a block; documents that a rare line is in at the most; other lines that a block
#: may hold between two of its own.
MIN_WORDS, RARE, GAP = 20, 16, 2


def patience(a: list[tuple[int, int]], b: list[tuple[int, int]], rare: set[int], done: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs of places of an alignment of two sequences of (place, name), in order, without
    the pairs that are done. The outermost anchors are rare names if there are any; deeper
    ones any name that is unique on both sides; the least frequent where none is unique."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b), True)]
    while todo:
        a0, a1, b0, b1, outer = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0][1] == b[b0][1] and (a[a0][0], b[b0][0]) not in done:
            out.append((a[a0][0], b[b0][0]))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1][1] == b[b1 - 1][1] and (a[a1 - 1][0], b[b1 - 1][0]) not in done:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a[a1][0], b[b1][0]))
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = _once(a, a0, a1), _once(b, b0, b1)
        anchors = [(i, once_b[x], x) for x, i in once_a.items() if x in once_b and (a[i][0], b[once_b[x]][0]) not in done]
        if outer and any(x in rare for _, _, x in anchors):
            anchors = [y for y in anchors if y[2] in rare]
        if outer and not anchors and not out:
            anchors = _rarest(a, b, done)
        chain = _increasing(sorted((i, j) for i, j, _ in anchors))
        if not chain:
            continue
        out += [(a[i][0], b[j][0]) for i, j in chain]
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        todo += [(p + 1, r, q + 1, s, False) for (p, q), (r, s) in zip(edges, edges[1:], strict=False) if p + 1 < r and q + 1 < s]
    return sorted(out)


def _rarest(a: list[tuple[int, int]], b: list[tuple[int, int]], done: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Of the names with the fewest pairs of places, the first open pair of each place in b."""
    held: dict[int, list[int]] = {}
    for i, (_, name) in enumerate(a):
        held.setdefault(name, []).append(i)
    often = Counter(name for _, name in b)
    best: dict[int, list[tuple[int, int, int]]] = {}
    for j, (place, name) in enumerate(b):
        i = next((i for i in held.get(name, ()) if (a[i][0], place) not in done), None)
        if i is not None:
            best.setdefault(len(held[name]) * often[name], []).append((i, j, name))
    return best[min(best)] if best else []


def _once(x: list[tuple[int, int]], lo: int, hi: int) -> dict[int, int]:
    seen: dict[int, int] = {}
    for i in range(lo, hi):
        seen[x[i][1]] = -1 if x[i][1] in seen else i
    return {k: v for k, v in seen.items() if v >= 0}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order, that increases on both sides."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        if k == len(tops):
            tops.append(y)
            at.append(i)
        else:
            tops[k], at[k] = y, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def common_blocks(lines: list[tuple[int, list[int], list[int], int, int]], min_words: int = MIN_WORDS, rare: int = RARE, gap: int = GAP) -> set[int]:
    """Places in the later document that stand in aligned blocks. lines: name, places in
    the earlier document, places in the later one, words, documents that hold it."""
    few = {name for name, _, _, _, df in lines if df <= rare}
    words = {name: w for name, _, _, w, _ in lines}
    left = sorted((p, name) for name, places, _, _, _ in lines for p in places)
    right = sorted((p, name) for name, _, places, _, _ in lines for p in places)
    there, here = dict(left), dict(right)
    count = Counter(name for _, name in left)
    gone: set[int] = set()
    done: set[tuple[int, int]] = set()
    tried: Counter = Counter()
    left_to_find = _near_enough(right, words, min_words, gap)
    while left_to_find:
        names = {name for _, name in left_to_find}
        new = [x for x in patience([x for x in left if x[1] in names], left_to_find, few, done) if x not in done]
        for i, j in new:
            if (i, j) not in done:
                block = _followed(i, j, there, here, gap)
                done.update(block)
                tried.update(y for _, y in block)
                if sum(words[here[y]] for _, y in block) >= min_words:
                    gone.update(y for _, y in block)
        if not new:
            break
        left_to_find = [(y, name) for y, name in left_to_find if y not in gone and tried[y] < count[name]]
    return gone


def _near_enough(right: list[tuple[int, int]], words: dict[int, int], min_words: int, gap: int) -> list[tuple[int, int]]:
    """The lines that have enough words within reach of each other to make a block."""
    out: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []
    for x in [*right, None]:
        if run and (x is None or x[0] - run[-1][0] > gap + 1):
            if sum(words[name] for _, name in run) >= min_words:
                out += run
            run = []
        if x is not None:
            run.append(x)
    return out


def _followed(i: int, j: int, there: dict[int, int], here: dict[int, int], gap: int) -> list[tuple[int, int]]:
    """The pairs of equal lines around a pair, at its distance, at most `gap` lines apart."""
    out = [(i, j)]
    for step in (1, -1):
        far, off = 0, step
        while abs(off - far) <= gap + 1:
            if j + off in here and there.get(i + off) == here[j + off]:
                out.append((i + off, j + off))
                far = off
            off += step
    return out


def line_table(docs: DataFrame) -> DataFrame:
    """id, t, h, g (two hashes of a line), w (its words), at (its places among the lines
    that have words): a row for each distinct line of each document (id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            who, hs, gs, ws, ats = [], [], [], [], []
            for k, text in enumerate(b.column("text")):
                seen: dict[bytes, list[int]] = {}
                i = 0
                for line in text.as_py().lower().encode().split(b"\n"):
                    if words := line.split():
                        seen.setdefault(b" ".join(words), []).append(i)
                        i += 1
                for line, at in seen.items():
                    h = xxhash.xxh3_128_intdigest(line)
                    who.append(k)
                    hs.append(h & 0xFFFFFFFFFFFFFFFF)
                    gs.append(h >> 64)
                    ws.append(line.count(b" ") + 1)
                    ats.append(at)
            rows = pa.array(who, pa.int32())
            hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (hs, gs)]
            yield pa.RecordBatch.from_arrays([b.column("id").take(rows), b.column("t").take(rows), *hashes, pa.array(ws, pa.int32()), pa.array(ats, pa.list_(pa.int32()))], ["id", "t", "h", "g", "w", "at"])

    return docs.select("id", "t", "text").mapInArrow(run, "id long, t long, h long, g long, w int, at array<int>")


LINES = pa.list_(pa.struct([("h", pa.int64()), ("g", pa.int64()), ("w", pa.int32()), ("df", pa.int64()), ("first", pa.int64()), ("at", pa.list_(pa.int32()))]))
KEYS = pa.list_(pa.struct([("k", pa.int64()), ("l", pa.int64())]))


def keys_of(lines: list[tuple[int, bytes, int]], min_words: int = MIN_WORDS, gap: int = GAP) -> set[bytes]:
    """Keys of (place, name, words) in order of place: the shortest runs of neighbours of
    min_words from each line on and up to each line, and pairs at most gap lines apart."""
    out: set[bytes] = set()
    lo, n, before = 0, 0, 0  # lines[lo:i + 1] is the shortest run up to i, of n words
    for i, (at, name, w) in enumerate(lines):
        for place, other, _ in lines[max(0, i - gap - 1) : i]:
            if at - place <= gap + 1:
                out.add(bytes([at - place]) + other + name)
        if i and at != lines[i - 1][0] + 1:
            lo, n, before = i, 0, i
        n += w
        while n - lines[lo][2] >= min_words:
            n, lo = n - lines[lo][2], lo + 1
        if n >= min_words:
            out.add(b"\0" + b"".join(x[1] for x in lines[lo : i + 1]))
            # The shortest runs from the starts that reach min_words here for the first time.
            for start in range(before, lo + 1):
                out.add(b"\0" + b"".join(x[1] for x in lines[start : i + 1]))
            before = lo + 1
    return out


def _sequences(min_words: int, rare: int, gap: int):
    """Of rows sorted by document (id, t): a row with the lines of each, and the keys of its
    frequent lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        doc, lines, out = None, {}, []  # lines by name, so that repeated rows count once

        def end_doc():
            if doc is not None:
                places = sorted((p, name, x["w"]) for name, x in lines.items() if x["df"] > rare for p in x["at"])
                keys = (xxhash.xxh3_128_intdigest(k) for k in keys_of(places, min_words, gap))
                halves = np.array([(k & 0xFFFFFFFFFFFFFFFF, k >> 64) for k in keys], np.uint64).view(np.int64).reshape(-1, 2).tolist()
                out.append((*doc, list(lines.values()), [{"k": k, "l": m} for k, m in halves]))
            lines.clear()

        def rows() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), LINES, KEYS))], ["id", "t", "lines", "keys"])
            out.clear()
            return b

        for b in batches:
            names = ("id", "t", "h", "g", "w", "df", "first", "at")
            for i, t, h, g, w, df, first, at in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if (i, t) != doc:
                    end_doc()
                    doc = (i, t)
                lines[h.to_bytes(8, "little", signed=True) + g.to_bytes(8, "little", signed=True)] = {"h": h, "g": g, "w": w, "df": df, "first": first, "at": at}
            yield rows()
        end_doc()
        yield rows()

    return run


RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def ranges(places: set[int]) -> list[dict[str, int]]:
    """Places as closed ranges, in order."""
    out: list[dict[str, int]] = []
    for x in sorted(places):
        if out and out[-1]["b"] == x - 1:
            out[-1]["b"] = x
        else:
            out.append({"a": x, "b": x})
    return out


def _aligned(min_words: int, rare: int, gap: int):
    """Of rows sorted by document (id, t), its own lines (owner null) before those of
    earlier documents: a row with the ranges of places that go, and the first holders of
    what goes, for each document that loses any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = None
        own: dict = {}
        gone: set[int] = set()
        out: list[tuple] = []

        def end_doc():
            if gone:
                out.append((*doc, ranges(gone), sorted({x["first"] for x in own.values() if not gone.isdisjoint(x["at"])})))
            gone.clear()

        def rows() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), RANGES, pa.list_(pa.int64())))], ["id", "t", "gone", "firsts"])
            out.clear()
            return b

        for b in batches:
            lines = b.column("lines")
            for k, (i, t, owner) in enumerate(zip(*(b.column(c).to_pylist() for c in ("id", "t", "owner")), strict=True)):
                theirs = {(x["h"], x["g"]): x for x in lines[k].as_py()}
                if owner is None:
                    end_doc()
                    doc, own = (i, t), theirs
                else:
                    gone.update(common_blocks([(n, x["at"], own[n]["at"], x["w"], x["df"]) for n, x in theirs.items() if n in own], min_words, rare, gap))
            yield rows()
        end_doc()
        yield rows()

    return run


def removals(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE, gap: int = GAP) -> DataFrame:
    """id, t, gone (ranges a..b of places, among the lines with words, that are deleted),
    needed (whether the document is the first holder of a line deleted elsewhere)."""
    lines = stored(line_table(docs.filter("id IS NOT NULL")), "lines")
    owners = lines.groupBy("h", "g").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("df")).filter(F.col("last") > F.col("first")).drop("last")
    owners = stored(owners, "owners")  # else its partitions are kept for the join, and a hot line can't be split
    shared = lines.join(owners, ["h", "g"]).select("id", "t", "h", "g", "w", "df", "first", "at")
    kinds = "id long, t long, lines array<struct<h:long,g:long,w:int,df:long,first:long,at:array<int>>>, keys array<struct<k:long,l:long>>"
    held = stored(shared.repartition("id", "t").sortWithinPartitions("id", "t").mapInArrow(_sequences(min_words, rare, gap), kinds), "sequences")
    keys = held.select("id", "t", F.explode("keys").alias("key")).select("id", "t", "key.k", "key.l")
    firsts = keys.groupBy("k", "l").agg(F.min("id").alias("owner"), F.max("id").alias("last")).filter(F.col("last") > F.col("owner")).drop("last")
    by_run = keys.join(stored(firsts, "keys"), ["k", "l"]).filter(F.col("id") > F.col("owner")).select("id", "t", "owner")
    # Lines with the same holders (RARE at most) give the same pairs.
    holders = held.select("id", "t", F.explode(F.filter("lines", lambda x: x["df"] <= rare)).alias("x")).select("id", "t", "x.h", "x.g").groupBy("h", "g").agg(F.sort_array(F.collect_set(F.struct("id", "t"))).alias("who")).select("who").distinct()
    by_line = holders.select("who", F.explode("who").alias("x")).select("x.id", "x.t", F.explode(F.filter("who", lambda y: y["id"] < F.col("x.id"))["id"]).alias("owner"))
    pairs = stored(by_line.unionByName(by_run).distinct(), "pairs")
    theirs = pairs.join(held.select(F.col("id").alias("owner"), "lines"), "owner").select("id", "t", "owner", "lines")
    later = held.join(pairs.select("id", "t").distinct(), ["id", "t"], "left_semi").select("id", "t", F.lit(None).cast("long").alias("owner"), "lines")
    ordered = later.unionByName(theirs).repartition("id", "t").sortWithinPartitions("id", "t", F.col("owner").asc_nulls_first())
    gone = stored(ordered.mapInArrow(_aligned(min_words, rare, gap), "id long, t long, gone array<struct<a:int,b:int>>, firsts array<long>"), "gone")
    needed = gone.select(F.explode("firsts").alias("id")).distinct().withColumn("needed", F.lit(True))
    return gone.drop("firsts").join(needed, "id", "left").withColumn("needed", F.coalesce("needed", F.lit(False)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, **options) -> DataFrame:
    """docs with their texts less the deleted lines, n_lines, n_removed, words_removed, and
    kept: false for a document that has lost lines and has fewer than min_words words left,
    unless it is the first holder of a line that was deleted elsewhere."""
    text = whole_text(text_col)
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"), "__t": F.xxhash64(text)})
    gone = removals(keyed.select(F.col("__id").alias("id"), F.col("__t").alias("t"), text.alias("text")), min_words, **options)
    gone = gone.withColumnsRenamed({"id": "__i", "t": "__h", "gone": "__gone", "needed": "__needed"})
    # Sorted at every size: what goes is a share of the input, too much to broadcast when that grows.
    out = keyed.join(gone.hint("merge"), (F.col("__id") == F.col("__i")) & (F.col("__t") == F.col("__h")), "left")
    lines = F.filter(F.split(text, "\n"), has_word)
    out = out.withColumn("__lines", lines).withColumn("__kept", F.when(F.col("__gone").isNotNull(), F.filter("__lines", lambda x, i: ~F.exists("__gone", lambda r: i.between(r["a"], r["b"])))))
    words = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda s, x: s + F.size(F.split(F.btrim(x, F.lit(SPACE)), SPACES)))
    lost = F.col("__kept").isNotNull()
    out = out.withColumns({"n_lines": F.size("__lines").cast("long"), "n_removed": F.when(lost, F.size("__lines") - F.size("__kept")).otherwise(0).cast("long"), "__all": F.when(lost, words("__lines")), "__some": F.when(lost, words("__kept"))})
    out = out.withColumns({"words_removed": F.coalesce(F.col("__all") - F.col("__some"), F.lit(0)).cast("long"), "kept": F.coalesce((F.col("__some") >= min_words) | F.col("__needed"), F.lit(True))})
    out = out.withColumn(text_col, F.when(lost, F.array_join("__kept", "\n")).otherwise(F.col(text_col)))
    return out.drop("__id", "__t", "__i", "__h", "__gone", "__needed", "__lines", "__kept", "__all", "__some")
