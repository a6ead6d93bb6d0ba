"""Sharding by balanced label propagation: linked documents (those with equal texts)
move towards the shards of their neighbours, round by round, under the shards' quotas.

A document begins in a shard by its hash. Groups are counted first, per shard that their
documents are in (at most `shards` cells a group), so that a hot group is pre-aggregated.
A group larger than a shard is given as many shards as its size fills, its fullest ones
first, and its rest a part of another; the quotas of the other groups are less by that. A
round joins each group's cells with the shard that most of it is in
and so proposes moves. From the flows between shards (a table of shards x shards) follows
how much of each flow the quotas allow, where what leaves a shard makes room for what
enters: exchanges between full shards are flows both ways. Moves are granted in order
(those with most neighbours at their goal first, in every second round the smallest
first) as far as that reaches. The rounds end when one cuts hardly fewer links than the one
before.

The groups that are still cut then, and those over a quota, are taken out and packed whole
into the places that are left, the largest first, by their counts of each size; where none
is large enough for the last few of them, they are parted over as few shards as will do.
Documents without a link take the rest, and cut no link. `cut_share` reports the links that
are cut.

Places in a shard are counted in buckets of about BUCKET_ROWS rows whose offsets are
summed apart, so that no task numbers a whole shard.

Defined results: a null text is empty (size 16); null and empty texts are equal; rows
with an equal or null id each take a place; fewer rows than shards leave the last shards
empty; other columns are not read; a very long text is hashed where it is read and moves
nowhere; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate, count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranks import numbered_within, running
from .common import discard, stored, whole_text

#: A further round must leave less than this share of the cut links.
SHARDS, BUCKET_ROWS, LESS = 40, 20_000, 0.95


def _numbered(rows: DataFrame, within: list[str], bucket: Column, order: list[str]) -> DataFrame:
    """rows with `at`: gapless from 0 within the given columns, in order of the bucket."""
    rows = rows.withColumn("__b", bucket)
    counts = rows.groupBy(*within, "__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*within).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    rank = F.row_number().over(W.partitionBy(*within, "__b").orderBy(*order))
    return rows.withColumn("__r", rank).join(offsets, [*within, "__b"]).withColumn("at", F.col("__before") + F.col("__r") - 1).drop("__b", "__r", "__before")


def allot(large: dict[int, dict[int, int]], quota: list[int]) -> tuple[dict[int, list[tuple[int, int]]], list[int]]:
    """For groups larger than a shard (documents by shard): (end of its places, shard)
    pieces in order, as few as will do; and the room that is left in each shard."""
    left, out = list(quota), {}
    for g in sorted(large, key=lambda g: (-sum(large[g].values()), g)):
        n, at, out[g] = sum(large[g].values()), 0, []
        while at < n:
            empty = [s for s in range(len(quota)) if left[s] and left[s] == quota[s] <= n - at]
            enough = [s for s in range(len(quota)) if left[s] >= n - at]
            if empty:
                to = max(empty, key=lambda s: (large[g].get(s, 0), -s))
            elif enough:
                to = min(enough, key=lambda s: (left[s], s))
            else:
                to = max(range(len(quota)), key=lambda s: (left[s], -s))
            took = min(left[to], n - at)
            at, left[to] = at + took, left[to] - took
            out[g].append((at, to))
    return out, left


def allowed(flows: np.ndarray, load: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """How much of each flow (from, to) may move, so that no shard ends above its quota (or
    above what it holds, if that is more): inflows are cut down until all of them fit, as
    less that enters one shard is less that leaves another."""
    x, most = flows.astype(float), np.maximum(quota, load)
    while True:
        over = load + x.sum(0) - x.sum(1) - most
        if (over <= 1e-9).all():
            return np.floor(x + 1e-6).astype(int)
        into = x.sum(0)
        x *= np.where(over > 1e-9, 1 - np.minimum(1, over / np.maximum(into, 1e-9)), 1)[None, :]
        x[x < 1e-3] = 0


def propagate(cells: DataFrame, quota: list[int]) -> DataFrame:
    """cells (unit, n, origin, c) with shard: where the documents of a unit that began in a
    shard are after the rounds."""
    spark, shards = cells.sparkSession, len(quota)
    state = stored(cells.withColumn("shard", F.col("origin")), "cells")
    before = None
    for k in count():
        now = state.groupBy("unit", "n", "shard").agg(F.sum("c").alias("c"))
        units = now.groupBy("unit", "n").agg(F.sum(F.col("c") * F.col("c")).alias("same"), F.max(F.struct("c", F.xxhash64("unit", "shard", F.lit(k)).alias("t"), "shard")).alias("best"))
        units = stored(units.filter("same < n * n").select("unit", "n", "same", F.col("best.shard").alias("to"), F.col("best.c").alias("near")), "split")
        cut = units.agg(F.sum(F.col("n") * F.col("n") - F.col("same"))).first()[0] or 0
        if not cut or before is not None and cut > LESS * before:
            discard(units)
            return state
        before = cut
        moves = stored(now.join(units.select("unit", "to", "near"), "unit").filter("shard <> to").select("unit", "shard", "to", "c", "near", F.xxhash64("unit", F.lit(k)).alias("t")), "moves")
        load, flows = np.zeros(shards, int), np.zeros((shards, shards), int)
        for r in state.groupBy("shard").agg(F.sum("c").alias("c")).collect():  # a row a shard
            load[r.shard] = r.c
        for r in moves.groupBy("shard", "to").agg(F.sum("c").alias("c")).collect():  # at most shards x shards rows
            flows[r.shard, r["to"]] = r.c
        limits = spark.createDataFrame([(i, j, int(x)) for (i, j), x in np.ndenumerate(allowed(flows, load, np.array(quota)))], "shard int, to int, most long")
        first = F.col("c") if k % 2 else -F.col("near")
        ordered = running(moves.withColumn("first", first), [F.col("shard"), F.col("to"), F.col("first"), F.col("t"), F.col("unit")], ["c"])
        starts = ordered.groupBy("shard", "to").agg(F.min("before_c").alias("start"))
        granted = ordered.join(F.broadcast(starts), ["shard", "to"]).join(F.broadcast(limits), ["shard", "to"]).filter(F.col("before_c") - F.col("start") + F.col("c") <= F.col("most"))
        old, state = state, stored(state.join(granted.select("unit", "shard", "to"), ["unit", "shard"], "left").select("unit", "n", "origin", "c", F.coalesce("to", "shard").alias("shard")), "cells")
        discard(old, units, moves)


def packed(sizes: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """Of so many units of each size: (size, first unit, unit after the last, shard, first
    document, document after the last). Whole units go where they fit best, the largest
    first; then what fits nowhere is parted."""
    out, rest = [], []
    room = list(room)
    for n in sorted(sizes, reverse=True):
        at, left = 0, sizes[n]
        while left:
            enough = [s for s in range(len(room)) if room[s] >= n]
            if not enough:
                break
            s = min(enough, key=lambda s: (room[s] % n, room[s], s))
            took = min(left, room[s] // n)
            out.append((n, at, at + took, s, 0, n))
            room[s], at, left = room[s] - took * n, at + took, left - took
        rest += [(n, k) for k in range(at, at + left)]
    for n, k in rest:
        at = 0
        while at < n:
            s = max(range(len(room)), key=lambda s: (room[s], -s))
            took = min(n - at, room[s])
            out.append((n, k, k + 1, s, at, at + took))
            room[s], at = room[s] - took, at + took
    return out


def settled(ended: DataFrame, quota: list[int]) -> DataFrame:
    """unit, shard, begin, end: the shard of a unit's documents from `begin` on (numbered from
    0) up to `end`; whole units but for the last few."""
    spark = ended.sparkSession
    cells = ended.groupBy("unit", "n", "shard").agg(F.sum("c").alias("c"))
    whole = running(cells.filter("c = n"), [F.col("shard"), F.xxhash64("unit"), F.col("unit")], ["c"])
    whole = whole.join(F.broadcast(whole.groupBy("shard").agg(F.min("before_c").alias("start"))), "shard")
    own = F.element_at(F.array(*[F.lit(x) for x in quota]), F.col("shard") + 1)
    stays = stored(whole.select("unit", "n", "shard", (F.col("before_c") - F.col("start") + F.col("n") <= own).alias("stays")), "whole")
    room = list(quota)
    for r in stays.filter("stays").groupBy("shard").agg(F.sum("n").alias("n")).collect():  # a row a shard
        room[r.shard] -= r.n
    out = stored(stays.filter("NOT stays").select("unit", "n").unionByName(cells.filter("c < n").select("unit", "n").distinct()), "taken")
    # Sizes are few: all different, they add up to the rows, so there are less than the root of twice those.
    sizes = {r.n: r.k for r in out.groupBy("n").agg(F.count("*").alias("k")).collect()}
    places = spark.createDataFrame(packed(sizes, room), "n long, lo long, hi long, shard int, begin long, end long")
    dealt = numbered_within(out, ["n"], [F.col("unit")], "at").withColumn("at", F.col("at") - 1)
    found = dealt.join(F.broadcast(places), "n").filter("at >= lo AND at < hi").select("unit", "shard", "begin", "end")
    return stored(stays.filter("stays").select("unit", "shard", F.lit(0).cast("long").alias("begin"), F.col("n").alias("end")).unionByName(found), "settled")


def cut_share(out: DataFrame) -> DataFrame:
    """Of the result of `shard`, a row: groups of several documents, how many are in more
    than one shard, and the share of all links (pairs of a group) that are cut."""
    cells = out.groupBy("group", "shard").agg(F.count("*").cast("double").alias("c"))
    per = cells.groupBy("group").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"), F.count("*").alias("shards")).filter("n > 1")
    return per.agg(F.count("*").alias("groups"), F.count_if(F.col("shards") > 1).alias("cut_groups"), (F.sum(F.col("n") * F.col("n") - F.col("same")) / F.sum(F.col("n") * (F.col("n") - 1))).alias("cut_share"))


def moved_share(out: DataFrame, shards: int = SHARDS, id_col: str = "doc_id") -> float:
    """Of the result of `shard`, the share of the linked documents that are not in the shard
    they began in: what propagation keeps low, as most of a group stays where it is."""
    linked = out.join(out.groupBy("group").agg(F.count("*").alias("__n")).filter("__n > 1"), "group")
    return linked.agg(F.avg((F.pmod(F.xxhash64(id_col), F.lit(shards)) != F.col("shard")).cast("int"))).first()[0] or 0.0


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size (UTF-8 bytes and 16), text_crc32, shard, slot (gapless from 0) and group
    (hash of the text) of every document."""
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("g"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    rows = stored(rows, "rows")
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    groups = stored(rows.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1"), "groups")  # else its partitions are kept for the join, and a hot group can't be split
    linked = rows.join(groups, "g").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    room = max(1, total // shards)
    salts = max(64, total // BUCKET_ROWS)
    salt = F.pmod(F.xxhash64("id"), F.lit(salts))
    linked = stored(linked.select("id", "g", "n", F.col("shard").alias("origin"), "size", "crc"), "linked")
    # Groups larger than a shard first: fewer than `shards` of them, each in at most `shards` cells.
    large: dict[int, dict[int, int]] = {}
    for r in linked.filter(F.col("n") > room).groupBy("g", "origin").agg(F.count("*").alias("c")).collect():
        large.setdefault(r.g, {})[r.origin] = r.c
    pieces, left = allot(large, quota)
    units = linked.filter(F.col("n") <= room).withColumn("unit", F.col("g"))
    cells = units.groupBy("unit", "n", "origin").agg(F.count("*").alias("c"))
    ends = settled(propagate(cells, left), left)
    one = ends.join(ends.groupBy("unit").agg(F.count("*").alias("parts")).filter("parts = 1"), "unit", "left_semi")
    parted = units.join(ends.join(one, "unit", "left_anti").select("unit").distinct(), "unit")
    parted = _numbered(parted, ["unit"], salt, ["id", "size"]).join(ends, "unit").filter("at >= begin AND at < end")
    label = ["id", "g", "n", "shard", "size", "crc"]
    out = units.join(one, "unit").select(*label).unionByName(parted.select(*label))
    if large:
        whole = _numbered(linked.filter(F.col("n") > room), ["g"], salt, ["id", "size"])
        to = F.lit(None).cast("int")
        for g, parts in pieces.items():
            of = F.lit(parts[-1][1])
            for end, s in reversed(parts[:-1]):
                of = F.when(F.col("at") < end, s).otherwise(of)
            to = F.when(F.col("g") == g, of).otherwise(to)
        out = out.unionByName(whole.withColumn("shard", to).select(*label))
    linked = stored(out, "labels")
    held = {r.shard: r.n for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row a shard
    # Documents without a link fill the rest; then all are numbered within their shards, salted by id.
    free = _numbered(rows.join(groups, "g", "left_anti").withColumn("all", F.lit(0)), ["all"], salt, ["id", "size", "crc"])
    ended = list(accumulate(quota[s] - held.get(s, 0) for s in range(shards)))
    to = F.size(F.filter(F.array(*[F.lit(x) for x in ended]), lambda e: e <= F.col("at")))
    out = linked.select("id", "g", "shard", "size", "crc").unionByName(free.select("id", "g", to.alias("shard"), "size", "crc"))
    out = _numbered(out, ["shard"], salt, ["id", "size", "crc"])
    columns = [F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), F.col("at").cast("long").alias("slot"), F.col("g").alias("group")]
    return out.select(*columns)
