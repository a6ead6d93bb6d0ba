"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct word n-grams. XOR-hashing a set into
bits gives a parity sketch: the sketches of two sets differ in no more bits than the sets
differ in elements. Sets of a size band whose similarity reaches the threshold differ in
at most d elements, so of a sketch cut into d + 1 + e blocks at least e + 1 are equal
(pigeonhole). A block is keyed by a hash of its bits; ordered by the bits that are set,
most first, two such sets share one of their first d + 1 keys, and only these are joined.
Keys of few bits, which many documents share, fall behind the cut and are never needed.

Equal sets are one class from the start. In a group of documents with an equal key no
pairs are listed: each is compared with the group's best connected document, components
are formed, and only documents of different components are compared further, until every
pair that shares a key is verified or joined. Where many documents share a passage and
are not alike, so that far more pairs than documents are left in a group, it is dealt anew:
a linked pair also shares one of the rarest n-grams of either (as many as may differ, and
one), so documents are grouped by those, and what sets such documents apart is rare. What
is left then is compared in parts of PART documents a side, none of them larger than
another. Sketches are compared before texts; verification is exact, on whole texts.

Defined results: a text of fewer words than n, but not none, has one element; without
words, or null, it is linked with nothing; rows with a null id are linked with nothing;
rows with an equal id are one document that has either text; other columns are not read; a
very long text is one row, its set in one task; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, stored, whole_text
from .graph import components

#: Words of a worker's memory, ratio of a size band, blocks to spare (a share of d + 1).
HELD, BAND, SPARE = 400_000, 1.3, 0.6
ROUNDS = 2  # of comparing with one document a group, before groups are dealt anew, and after
MOST = 4  # pairs for each row of all groups that end the rounds
HEAVY = 256  # pairs for each row of a group, above which its documents are dealt anew
PART = 256  # documents on either side of what is compared by one key of a join
FOLD = 512  # bits of a document's whole sketch, which candidates are compared by
_M1, _M2, _ONE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class Shingler(dict):
    """Word -> its 64-bit hash; cuts texts into sets of n-grams."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= HELD:
            self.clear()
        self[word] = h
        return h

    def tokens(self, text: str | None) -> np.ndarray:
        """Sorted hashes of the distinct n-grams: A-Z lowered, words between ASCII white space."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        k = min(self.n, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out * _ONE + h[i : len(h) - k + 1 + i])
        return np.unique(out)


class Bands:
    """Size bands, and how many elements two linked sets may differ in, the smaller in a band."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        edges = [1]
        while edges[-1] < 1 << 62:
            edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
        self.edges = edges

    def of(self, size: int) -> int:
        return bisect_right(self.edges, size) - 1

    def differ(self, band: int) -> int:
        small = self.edges[band + 1] - 1
        return (small + small * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    @staticmethod
    def sketch(tokens: np.ndarray) -> np.ndarray:
        """The parity sketch of a set in FOLD bits, as 64-bit words."""
        odd = np.bincount((mix(tokens ^ _M2) & np.uint64(FOLD - 1)).astype(np.int64), minlength=FOLD) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """The keys that a set is joined by."""
        size, out = len(tokens), []
        low = -(-size * self.num // self.den)  # of the smallest set that can be linked
        for band in range(self.of(low), self.of(size) + 1):
            d = self.differ(band)
            if d == 0:
                continue  # only equal sets are linked
            blocks = d + 1 + max(1, int((d + 1) * SPARE))
            spread = mix(tokens + np.uint64(band * int(_ONE) % (1 << 64)))
            block = (spread % np.uint64(blocks)).astype(np.int64)
            bit = (spread >> np.uint64(40)) & np.uint64(4095)  # of the block's 4096
            # A block's bits hashed: bits met twice cancel, as in the sketch.
            order = np.argsort(block << 12 | bit.astype(np.int64), kind="stable")
            block, bit = block[order], bit[order]
            if (twice := (block[1:] == block[:-1]) & (bit[1:] == bit[:-1])).any():
                first = np.flatnonzero(np.append(True, ~twice))
                odd = first[np.diff(np.append(first, len(bit))) % 2 == 1]
                block, bit = block[odd], bit[odd]
            zobrist = mix(bit + _M2)
            start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            bits = np.zeros(blocks, np.uint64)
            if len(block):
                bits[block[start]] = np.bitwise_xor.reduceat(zobrist, start)
            count = np.bincount(block, minlength=blocks)
            key = mix(mix(bits + np.arange(blocks, dtype=np.uint64) * _ONE) + np.uint64(band))
            out.append(key[np.lexsort((key, -count))[: d + 1]])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketches(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """id, n, f, g (hashes of the set), sketch, keys of every document (id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, bands = Shingler(n), Bands(num, den)
        for b in batches:
            size, f, g, whole, keys = [], [], [], [], []
            for x in b.column("text"):
                t = cut.tokens(x.as_py())
                size.append(len(t))
                f.append(t.sum(dtype=np.uint64).astype(np.int64))
                g.append(mix(t ^ _M1).sum(dtype=np.uint64).astype(np.int64))
                whole.append(bands.sketch(t))
                keys.append(bands.keys(t).astype(np.int64) if len(t) else np.zeros(0, np.int64))
            ends = np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size, pa.int64()), pa.array(f, pa.int64()), pa.array(g, pa.int64()), pa.array(whole, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "n", "f", "g", "sketch", "keys"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, f long, g long, sketch array<long>, keys array<long>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, id) in order of the key, those that stand beside an equal key, and the
    first and last of the partition, whose neighbours are elsewhere."""
    held, first = None, True
    for b in batches:
        key, ids = np.asarray(b.column(0)), np.asarray(b.column(1))
        if held is not None:
            key, ids = np.append(held[0], key), np.append(held[1], ids)
        beside = np.append(False, key[1:] == key[:-1])
        keep = beside | np.append(beside[1:], False)
        if held is not None:
            keep[0] |= held[2]
        if first:
            keep[0], first = True, False
        held = (key[-1:], ids[-1:], bool(keep[-1]))
        keep[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(ids[keep])], ["key", "id"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["key", "id"])


def shared_keys(sketched: DataFrame) -> DataFrame:
    """key, id, size: the keys that several documents have, by one shuffle of the keys.
    Partitions are ranges of (key, id), so a hot key spreads over as many as it needs."""
    rows = sketched.select(F.explode("keys").alias("key"), "id")
    near = stored(rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(_shared, "key long, id long"), "keys")
    copies = sketched.groupBy("f", "g", "n").agg(F.min("id").alias("rep"), F.count("*").alias("c")).filter("c > 1")
    copies = stored(copies, "copies")  # else its partitions are kept for the join, and a large class can't be split
    others = sketched.select("f", "g", "n", "id").join(copies, ["f", "g", "n"]).filter("id <> rep").select("id")
    once = stored(near.join(others, "id", "left_anti").distinct(), "near")
    discard(near, copies)
    return sized(once)


def sized(near: DataFrame) -> DataFrame:
    """key, id, size of the rows (key, id) whose key several documents have."""
    sizes = stored(near.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    out = stored(near.join(sizes, "key").select("key", "id", "size"), "groups")
    discard(near, sizes)
    return out


def rare_groups(texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """key, id, size: documents (id, text) by the rarest elements of their sets, as many as
    a linked set may lack, and one; rarity is counted over these documents."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(n)
        for b in batches:
            for i, x in zip(b.column("id"), b.column("text"), strict=True):
                t = cut.tokens(x.as_py()).view(np.int64)
                own = pa.scalar(int(t.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.repeat(i, len(t)), pa.repeat(own, len(t)), pa.repeat(pa.scalar(len(t), pa.int64()), len(t)), pa.array(t)], ["id", "f", "n", "token"])

    rows = stored(texts.mapInArrow(run, "id long, f long, n long, token long"), "elements")
    often = stored(rows.groupBy("token").agg(F.count_distinct("id").alias("df")).filter("df > 1"), "often")
    both = rows.join(often, "token").groupBy("id", "f", "n").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("held"))
    # Elements that no other document has come first in the order, and join with nothing.
    due = F.col("n") - F.ceil(F.col("n") * num / den) + 1 - (F.col("n") - F.size("held"))
    near = both.select("id", F.explode(F.slice("held", 1, F.greatest(due, F.lit(0)).cast("int"))).alias("x")).select(F.col("x.token").alias("key"), "id").distinct()
    near = stored(near, "near")
    discard(rows, often)
    return sized(near)


def verified(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """pairs (a, b) with `link`: den * |intersection| >= num * |union| of the whole texts."""
    small_batches(pairs.sparkSession)
    rows = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, last, left = Shingler(n), None, None
        for b in batches:
            out = []
            for ta, tb in zip(b.column("ta"), b.column("tb"), strict=True):
                ta = ta.as_py()
                if ta != last:
                    last, left = ta, cut.tokens(ta)
                right = cut.tokens(tb.as_py())
                lo, hi = sorted((len(left), len(right)))
                if lo * den < num * hi or not lo:
                    out.append(False)
                    continue
                at = np.minimum(np.searchsorted(left, right), len(left) - 1)
                both = int((left[at] == right).sum())
                out.append(den * both >= num * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.bool_())], ["a", "b", "link"])

    return rows.mapInArrow(run, "a long, b long, link boolean")


def _pair(x: str, y: str):
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_enough(num: int, den: int):
    """Of rows with n, sketch and m, other_sketch: whether their sizes and the Hamming distance
    of their sketches, a lower bound of how many elements differ, leave room for a link."""
    apart = sum((F.bit_count(F.get("sketch", F.lit(i)).bitwiseXOR(F.get("other_sketch", F.lit(i)))) for i in range(FOLD // 64)), F.lit(0))
    both = F.col("n") + F.col("m")
    return (F.least("n", "m") * den >= num * F.greatest("n", "m")) & (apart * (den + num) <= both * (den - num))


def _with_sketches(pairs: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) those whose sketches leave room for a link."""
    other = whole.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("other_sketch"))
    return pairs.join(whole.withColumnRenamed("id", "a"), "a").join(other, "b").filter(near_enough(num, den)).select("a", "b").distinct()


def linked_components(groups: DataFrame, whole: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """node, comp over all documents that share a key (groups: key, id, size; whole: id, n,
    sketch)."""
    spark = groups.sparkSession
    done = spark.createDataFrame([], "a long, b long, link boolean")
    comp = spark.createDataFrame([], "node long, comp long")
    total, most, k = groups.count(), ROUNDS, 0
    heavy = F.col("cross") > HEAVY * F.col("all")
    while True:
        rows = groups.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        cross, spare = 0, []
        if k:
            # Groups with documents of several components, and how many pairs cross between.
            cells = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
            mixed = cells.groupBy("key").agg(F.count("*").alias("comps"), F.sum("c").alias("all"), F.sum(F.col("c").cast("double") * F.col("c")).alias("within"), F.max(F.struct("c", "comp")).alias("top")).filter("comps > 1")
            mixed = stored(mixed.withColumn("cross", (F.col("all").cast("double") * F.col("all") - F.col("within")) / 2), "mixed")
            found = mixed.agg(F.sum("cross").alias("x"), F.count_if(heavy).alias("heavy")).first()
            cross = found.x
            if not cross:
                return comp
            rows = stored(rows.join(mixed.select("key", "all", "cross", F.col("top.comp").alias("top")), "key"), "rest")
            spare = [rows, mixed]
            if found.heavy and k == ROUNDS and cross > MOST * total:
                anew = rare_groups(texts.join(rows.filter(heavy).select("id").distinct(), "id", "left_semi"), n, num, den)
                groups = rows.filter(~heavy).select("key", "id", "size").unionByName(anew)
                k, most = k + 1, k + ROUNDS
                continue
        last = bool(k) and (cross <= MOST * total or k >= most)
        if last:
            # One side is outside its group's largest component; both sides are cut in parts.
            parts = F.greatest(F.ceil(F.col("all") / PART), F.lit(1)).cast("int")
            part = F.pmod(F.xxhash64("id"), parts).cast("int")
            one = rows.filter("comp <> top").select("key", "id", "comp", "top", part.alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other_part"))
            two = rows.select("key", F.col("id").alias("other"), F.col("comp").alias("far"), part.alias("other_part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
            sides = lambda x, i, w: x.join(whole.select(F.col("id").alias(i), *[F.col(c).alias(c if w else o) for c, o in (("n", "m"), ("sketch", "other_sketch"))]), i)
            apart = (F.col("comp") != F.col("far")) & ((F.col("far") == F.col("top")) | (F.col("id") < F.col("other")))
            pairs = sides(one, "id", True).join(sides(two, "other", False), ["key", "part", "other_part"]).filter(apart & near_enough(num, den)).select(*_pair("id", "other")).distinct()
        else:
            # The document that shares most with others, of those outside the largest component.
            reach = rows.groupBy("id").agg(F.sum("size").alias("reach"))
            choice = rows.join(reach, "id")
            if k:
                choice = choice.filter("comp <> top").withColumn("reach", F.xxhash64("id", F.lit(k)))
            best = choice.groupBy("key").agg(F.max(F.struct("reach", (-F.col("id")).alias("id"), "comp")).alias("best")).select("key", (-F.col("best.id")).alias("other"), F.col("best.comp").alias("far"))
            best = stored(best, "best")
            spare.append(best)
            pairs = rows.join(best, "key").filter((F.col("id") != F.col("other")) & (F.col("comp") != F.col("far"))).select(*_pair("id", "other")).distinct()
            pairs = _with_sketches(pairs, whole, num, den)
        new = stored(verified(pairs.join(done, ["a", "b"], "left_anti"), texts, n, num, den), "pairs")
        discard(*spare)
        done = done.unionByName(new)
        comp = components(done.filter("link").select("a", "b"))
        if last:
            return comp
        k += 1


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable by links, its own included)
    of every document; two link when den * |intersection| >= num * |union|."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    sketched = stored(sketches(rows, n, num, den), "sketches")
    known = sketched.filter("id IS NOT NULL AND n > 0")
    groups = shared_keys(known)
    texts = stored(rows.join(groups.select("id").distinct(), "id", "left_semi"), "texts")
    # Rows of one id with several texts: any of its sketches may let a pair through.
    whole = known.select("id", "n", "sketch").distinct()
    comp = linked_components(groups, whole, texts, n, num, den)
    reps = known.groupBy("f", "g", "n").agg(F.min("id").alias("rep"))
    reps = reps.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("f", "g", F.col("n").alias("m"), F.coalesce("comp", "rep").alias("comp"))
    reps = stored(reps, "classes")
    on = (sketched["f"] == reps["f"]) & (sketched["g"] == reps["g"]) & (sketched["n"] == reps["m"])
    return sketched.join(reps, on, "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("id").isNotNull(), F.col("comp")), F.col("id")).alias("component_id"))
