"""Exact top-k search over integer vectors with an impact-ordered index.

The index parts the vectors into blocks. In a block, every dimension has its vectors'
places in order of their component: a posting segment is the run of one component, and
the impact of a segment for a query is the query's component times the segment's. Impacts
of a query are quantised into LEVELS steps, and segments are processed a step at a time
from the highest: the postings that a step takes are one slice of each dimension's order,
whose impacts are added to an accumulator a vector.

After each step a vector's score is at most: what it has gathered, the step's impact for
each started dimension that has not met it yet, and the highest impact of each dimension
that has not started. The k-th best exact score of some vectors is a floor for the k-th
best of all (the leaders of the accumulators are scored for it). Processing stops only
when the bounds of all but a small share (REST) of the block lie below the floor, which
proves that none of those is among the k best; the rest are scored exactly. Without such
proof every segment is processed. Ties with the floor stay in.

Spark deals out the grid of (block of the index, chunk of queries): each block and each
chunk is one row, named by the pair, so that every key of the join is in one row on both
sides. A cell returns k rows a query, and the best k of all blocks are taken with a top-k
per query. Nothing is collected but the counts that size the grid.

Defined results: vectors that are null or hold a null, NaN or infinite component, and rows
with a null id, take no part; shorter vectors are as if padded with zeros; an empty vector
scores 0; a query is not its own candidate, nor is any row with its id; an id with several
vectors is asked with each and found with the best score of its rows, once; repeated rows
change nothing; of equal scores the smaller id is first; fewer candidates than k are all
returned; components and scores stay within the range of a long (beyond it they take its
end); other columns are not read; a table without rows or queries gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranks import top_k
from .common import small_batches, stored

#: Vectors of a block and queries of a chunk at the most: what one task holds. Places in a
#: block fit 16 bits.
BLOCK, CHUNK = 32_768, 32_768
#: Steps of quantised impact; the share of a block that is scored exactly at the end; leaders
#: that are scored for the floor, in multiples of k.
LEVELS, REST, LEADERS = 24, 1 / 8, 4
MOST, LEAST = (1 << 63) - 1, -(1 << 63)


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as longs."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def valid(vector: Column) -> Column:
    """Whether the vector is there and all of its components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of longs, padded with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), max(1, int(lengths.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy()
    return out


def _narrow(m: np.ndarray) -> np.ndarray:
    """The same numbers in the fewest bytes."""
    for kind in (np.int8, np.int16, np.int32):
        if not m.size or np.iinfo(kind).min <= m.min() and m.max() <= np.iinfo(kind).max:
            return m.astype(kind)
    return m


def _packed(numbered: bool):
    """Of rows (block, id, v), one block a partition and after the other: a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def rows() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                m = _narrow(_matrix(t.column("v").combine_chunks()))
                order = np.argsort(m, axis=0, kind="stable").T.astype(np.uint16) if numbered else np.zeros(0, np.uint16)
                columns = [pa.array([t.column("block")[0].as_py()]), pa.array([t.column("id").to_pylist()]), pa.array([m.shape[1]]), pa.array([m.dtype.name]), pa.array([m.tobytes()]), pa.array([order.tobytes()])]
                held.clear()
                yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "width", "kind", "vectors", "places"])

        for b in batches:
            blocks = b.column("block").to_numpy()
            for part in np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(blocks)) + 1):
                if len(part):
                    piece = b.slice(part[0], len(part))
                    if held and held[0].column("block")[0].as_py() != piece.column("block")[0].as_py():
                        yield from rows()
                    held.append(piece)
        yield from rows()

    return run


PACKED = "block long, ids array<long>, width long, kind string, vectors binary, places binary"


def _blocks(vectors: DataFrame, key: Column, blocks: int, indexed: bool) -> DataFrame:
    """(id, v) in blocks of about the same size, dealt out by the key's hash, a row for each."""
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long"))
    rows = dealt.select("block", "id", "v").repartition(min(blocks, 100_000), "block").sortWithinPartitions("block")
    return stored(rows.mapInArrow(_packed(indexed), PACKED), "index" if indexed else "queries")


def build_index(vectors: DataFrame, id_col: str, vector_col: str, scale: int, block: int = BLOCK) -> tuple[DataFrame, int]:
    """The index of all valid vectors, a row for each block, and the number of blocks."""
    if not 0 < block <= BLOCK:
        raise ValueError(f"a block has 1 to {BLOCK} vectors")
    taken = _taken(vectors, id_col, vector_col, scale)
    blocks = max(1, -(-taken.count() // block))
    # By the row's number in its file, so that a row that is repeated a million times is in
    # all blocks; sizes differ little by hash, and twice BLOCK would still fit 16 bits.
    return _blocks(taken, F.monotonically_increasing_id(), blocks, True), blocks


def _taken(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    good = vectors.filter(F.col(id_col).isNotNull() & valid(F.col(vector_col)))
    return good.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"))


class Block:
    """One block of the index, asked with one query after the other."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, places: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.n, self.width = vectors.shape
        self.places = np.ascontiguousarray(places, np.int64)
        self.sorted = np.ascontiguousarray(np.take_along_axis(vectors, self.places.T, 0).T)  # components of each dimension, in order
        self.segments = [np.unique(vectors[:, d], return_counts=True) for d in range(self.width)]
        self.values = [v.astype(object) for v, _ in self.segments]
        self.ends = [np.append(0, np.cumsum(c)) for _, c in self.segments]
        self.top = max((abs(int(x)) for v in self.values for x in (v[0], v[-1])), default=0)

    def exact(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        scores = self.vectors[at].astype(q.dtype) @ q
        return np.clip(scores, LEAST, MOST) if q.dtype == object else scores

    def best(self, at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best places by score, then by id, each id once; the scores."""
        order = sorted(range(len(at)), key=lambda i: (-scores[i], self.ids[at[i]])) if scores.dtype == object else np.lexsort((self.ids[at], -scores))
        at, scores = at[order], scores[order]
        _, first = np.unique(self.ids[at], return_index=True)
        first = np.sort(first)[:k]
        return at[first], scores[first]

    def cuts(self, d: int, x: int, levels: list[int]) -> list[int]:
        """How many postings of a dimension have an impact of each level or more, where the
        query's component is x: whole segments from one end of its order."""
        if x > 0:
            return (self.n - self.ends[d][np.searchsorted(self.values[d], [-(-y // x) for y in levels], "left")]).tolist()
        return self.ends[d][np.searchsorted(self.values[d], [y // x for y in levels], "right")].tolist()

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best, and how many postings were processed for them."""
        x = [int(y) for y in query[: self.width]]
        dims = [d for d, y in enumerate(x) if y]
        # Whole numbers in a double are exact below 2 ** 52; beyond, Python's integers.
        unit = 1 << (self.width + 1).bit_length()
        number = np.float64 if self.top * max((abs(y) for y in x), default=0) * max(1, len(dims)) * unit < 1 << 52 else object
        q = np.array([*x, *[0] * (self.width - len(x))], number)
        reach = {d: sorted((x[d] * int(self.values[d][0]), x[d] * int(self.values[d][-1]))) for d in dims}
        high, low = max((r[1] for r in reach.values()), default=0), min((r[0] for r in reach.values()), default=0)
        step = max(1, -(-(high - low) // LEVELS))
        levels = [max(high - i * step, low) for i in range(1, LEVELS + 1)]
        cuts = {d: self.cuts(d, x[d], levels) for d in dims}
        # What a vector has gathered, in units, and in the last place how many dimensions it has met.
        gathered = np.zeros(self.n, number)
        others = self.ids != own
        alive, floor, taken = others, None, 0
        for i, level in enumerate(levels if dims else ()):
            for d in dims:
                begin, end = cuts[d][i - 1] if i else 0, cuts[d][i]
                if end > begin:
                    part = slice(self.n - end, self.n - begin) if x[d] > 0 else slice(begin, end)
                    np.add.at(gathered, self.places[d, part], self.sorted[d, part].astype(number) * (x[d] * unit) + 1)
                    taken += end - begin
            if 2 * taken < self.n * len(dims) and level > low:
                continue  # bounds are far from the floor while most postings are still to come
            sums = np.floor(gathered * (1 / unit)) if number is np.float64 else gathered // unit
            met = gathered - sums * unit
            started = sum(r[1] >= level for r in reach.values())
            bound = sums + (started - met) * level + sum(r[1] for r in reach.values() if r[1] < level)
            if floor is None or alive.sum() > LEADERS * REST * self.n:
                near = np.flatnonzero(others)
                near = near[_largest(bound[near], LEADERS * k)]
                _, scores = self.best(near, self.exact(near, q), k)
                if len(scores) == k and (floor is None or scores[-1] > floor):
                    floor = scores[-1]
            if floor is not None:
                alive = others & (bound >= floor) if floor > LEAST else others
                if alive.sum() <= REST * self.n:
                    break
        at = np.flatnonzero(alive)
        found, scores = self.best(at, self.exact(at, q), k)
        return self.ids[found], scores, taken


def _largest(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, in any order."""
    if x.dtype == object:
        return np.array(sorted(range(len(x)), key=x.__getitem__)[-k:], np.int64)
    return np.argpartition(x, -k)[-k:] if k < len(x) else np.arange(len(x))


def _cells(k: int):
    """Of cells (a block of the index beside a chunk of queries): query_id, vec_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x = {c: b.column(c)[r] for c in b.schema.names}
                read = lambda p, x=x: np.frombuffer(x[f"{p}vectors"].as_py(), x[f"{p}kind"].as_py()).reshape(-1, x[f"{p}width"].as_py())
                vectors, queries = read(""), read("q_")
                places = np.frombuffer(x["places"].as_py(), np.uint16).reshape(vectors.shape[::-1])
                block = Block(x["ids"].values.to_numpy(), vectors, places)
                asked, found, scored = [], [], []
                for own, q in zip(x["q_ids"].values.to_numpy(), queries, strict=True):
                    ids, scores, _ = block.search(own, q, k)
                    asked.append(np.full(len(ids), own))
                    found.append(ids)
                    scored.append(scores.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (asked, found, scored)], ["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, blocks: int, queries: DataFrame, id_col: str, vector_col: str, scale: int, k: int, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best vectors for each query."""
    small_batches(index.sparkSession)
    distinct = _taken(queries, id_col, vector_col, scale).distinct()
    n, tasks = distinct.count(), 4 * index.sparkSession.sparkContext.defaultParallelism
    # As large as may be, since each chunk meets each block, but enough of them for all cores.
    chunks = max(1, -(-n // chunk), min(-(-n // 64), -(-tasks // blocks)))
    asked = _blocks(distinct, F.struct("id", "v"), chunks, False)
    asked = asked.select(F.col("block").alias("chunk"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "width", "kind", "vectors")])
    cells = min(blocks * chunks, 100_000)
    theirs = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long")).repartition(cells, "block", "chunk")
    ours = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("chunk", F.col("chunk").cast("long")).repartition(cells, "block", "chunk")
    pairs = ours.join(theirs.hint("shuffle_hash"), ["block", "chunk"])
    found = pairs.mapInArrow(_cells(k), "query_id long, vec_id long, score long")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = top_k(once, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return ranked.withColumn("rank", rank).select("query_id", "rank", "vec_id", "score")
