"""URL filters: listed rules first, gradient-boosted trees for the rest.

A rule names a host and a path prefix; it fits that host and its subdomains, and the
longest rule that fits decides. URLs that no rule fits are judged by boosted trees on
lexical features (lengths, depth, digit ratio, entropy, parameter counts) and on statistics
of suffixes and first path parts, trained from labelled URLs.

The statistics are counted by Spark over all labelled URLs and joined to the URLs that are
judged. The trees are fitted on the driver from a bounded sample: the SAMPLE distinct
labelled URLs with the smallest hashes, each with the statistics of the other FOLDS - 1
parts of all labelled URLs (left out alone, a URL would tell its label). A suffix or
path part that no label is known of is a missing value: it follows both branches of a
split, by the weights (second derivatives) of what is known there, so that the score stays
where it was before that split; and every tree sees half of the features only, so that none
decides alone.

Rules are looked up in a table of hosts that each task holds; it has the size of the rule
list. Judging takes no shuffle as long as the statistics fit a broadcast (STATS_BYTES).

Defined results: a null URL, or one without '://', has an empty host and path and no
rule, and is judged by its features as an empty text; without labelled URLs of both kinds
the trees give the one label that there is, or allow; a URL labelled both ways counts as
blocked; of rules of equal length that fit the last by text decides, of equal rules the
last listed; rows are independent, so repeated rows and null ids are returned as they are;
other columns are not read; URLs are read whole, however long; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, stored

#: Labelled URLs that the trees are fitted on, at most; bytes of statistics that are broadcast.
SAMPLE, STATS_BYTES = 20_000, 64 << 20
#: Parts of the labelled URLs.
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    text: str  # host/path prefix, such as net/
    verdict: str  # allow or block

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


class RuleBook:
    """Rules by host and path prefix."""

    def __init__(self, rules: list[Rule]):
        self.hosts: dict[str, dict[str, Rule]] = {}
        for r in rules:
            self.hosts.setdefault(r.host, {})[r.path] = r
        self.sizes = {host: sorted({len(p) for p in paths}) for host, paths in self.hosts.items()}

    def find(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits."""
        best, at = None, 0
        while True:
            if paths := self.hosts.get(host[at:]):
                for n in self.sizes[host[at:]]:
                    r = paths.get(path[:n])
                    if r and (best is None or (len(r.text), r.text) > (len(best.text), best.text)):
                        best = r
            at = host.find(".", at) + 1
            if not at:
                return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(F.lit(""), url), "://", 1))
    rest = F.substr(url, F.length(rest) + 4)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


#: Features: those of the text, and the shares of blocked URLs with an equal
NUMBERS = ("url length", "host length", "path length", "depth", "host labels", "digit ratio", "entropy", "parameters", "hyphens")
KINDS = ("last label", "last two labels", "first path part", "last label and first path part")
NAMES = NUMBERS + KINDS


def keys_of(host: Column, path: Column) -> list[Column]:
    """The keys that statistics are kept for, one of each kind."""
    last = F.substring_index(host, ".", -1)
    first = F.when(F.startswith(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(2))).otherwise("")
    return [F.concat(F.lit(f"{i} "), x) for i, x in enumerate((last, F.substring_index(host, ".", -2), first, F.concat(last, F.lit(" "), first)))]


def fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(FOLDS)).cast("string")


def statistics(labelled: DataFrame, by_fold: bool = False) -> DataFrame:
    """key, n, blocked over all distinct labelled URLs (url, block); or those of the folds,
    keys being preceded by the fold."""
    keys = keys_of(*host_and_path(F.col("url")))
    keys = F.array(*[F.concat(fold(F.col("url")), k) for k in keys] if by_fold else keys)
    return labelled.select(F.explode(keys).alias("key"), F.col("block").cast("long").alias("b")).groupBy("key").agg(F.count("*").alias("n"), F.sum("b").alias("blocked"))


def with_statistics(rows: DataFrame, stats: DataFrame, limit: int = STATS_BYTES, by_fold: bool = False) -> DataFrame:
    """rows (host, path) with the columns n0, b0, n1, b1 ...: null where a key is unknown; or
    m0, c0 ... of their folds."""
    small, (n, b) = fits(stats, limit), "mc" if by_fold else "nb"
    for i, key in enumerate(keys_of(F.col("host"), F.col("path"))):
        side = stats.select(F.col("key").alias(f"k{i}"), F.col("n").alias(f"{n}{i}"), F.col("blocked").alias(f"{b}{i}"))
        rows = rows.withColumn(f"k{i}", F.concat(fold(F.col("url")), key) if by_fold else key).join(F.broadcast(side) if small else side, f"k{i}", "left").drop(f"k{i}")
    return rows


COUNTS = [c for i in range(len(KINDS)) for c in (f"n{i}", f"b{i}")]
FOLD_COUNTS = [c for i in range(len(KINDS)) for c in (f"m{i}", f"c{i}")]


def lexical(url: str, host: str, path: str) -> list[float]:
    n = len(url)
    counts = Counter(url)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
    digits = sum(c for x, c in counts.items() if x.isdigit())
    query = url.partition("?")[2].partition("#")[0]
    return [n, len(host), len(path), path.count("/"), host.count(".") + bool(host), digits / n if n else 0.0, entropy, query.count("&") + 1 if query else 0, url.count("-")]


@dataclass
class Trees:
    """Boosted regression trees for the log-odds of 'block'. A tree is a full binary one,
    the children of i at 2i+1 and 2i+2: each node's feature, cut and weight of what goes right,
    and the leaves' values."""

    prior: float = 0.0
    rate: float = 0.5
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def features(self, urls: list[str], hosts: list[str], paths: list[str], counts: np.ndarray) -> np.ndarray:
        """counts: n0, b0, n1, b1 ... of each URL, NaN or 0 where unknown."""
        n, blocked = counts[:, 0::2], counts[:, 1::2]
        share = np.where(n > 0, (blocked + 4 * self.rate) / (n + 4), np.nan)
        plain = np.array([lexical(*x) for x in zip(urls, hosts, paths, strict=True)], np.float64).reshape(-1, len(NUMBERS))
        return np.concatenate([plain, share], 1)

    @staticmethod
    def leaves(x: np.ndarray, column: np.ndarray, cut: np.ndarray, share: np.ndarray) -> np.ndarray:
        """How much of each row reaches each leaf (a missing value goes both ways)."""
        weight, base = np.ones((len(x), 1)), 0
        while base < len(column):
            nodes = slice(base, base + weight.shape[1])
            value = x[:, column[nodes]]
            right = np.where(np.isnan(value), share[nodes], value > cut[nodes])
            weight = np.stack([weight * (1 - right), weight * right], 2).reshape(len(x), -1)
            base = 2 * base + 1
        return weight

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for column, cut, share, value in self.trees:
            out += self.leaves(x, column, cut, share) @ value
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.score(x)))

    @classmethod
    def fit(cls, urls: list[str], hosts: list[str], paths: list[str], block: np.ndarray, counts: np.ndarray, rounds: int = 60, depth: int = 3, step: float = 0.15, bins: int = 32, seed: int = 1, ridge: float = 5.0) -> Trees:
        y = block.astype(np.float64)
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1e-3
        model = cls(prior=math.log(p / (1 - p)), rate=p)
        if len(y) == 0 or y.min() == y.max():
            return model
        x = model.features(urls, hosts, paths, counts)
        known = [c[~np.isnan(c)] for c in x.T]
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in known]
        # The last code is that of a missing value, which no split is chosen by.
        code = np.stack([np.where(np.isnan(c), len(q) + 1, np.searchsorted(q, c, "left")) for q, c in zip(cuts, x.T, strict=True)], 1)
        score, draw = np.full(len(y), model.prior), np.random.default_rng(seed)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            seen = np.sort(draw.choice(len(NAMES), (len(NAMES) + 1) // 2, replace=False))
            column, cut, share = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(2**depth - 1)
            weight = np.ones((len(y), 1))
            for level in range(depth):
                base = 2**level - 1
                for node in range(2**level):
                    w, best = weight[:, node], 1e-9
                    wg, wh = w * g, w * h
                    for c in seen:
                        k = len(cuts[c]) + 1
                        sg, sh = (np.bincount(code[:, c], v, k + 1)[:k].cumsum() for v in (wg, wh))
                        gain = sg**2 / (sh + ridge) + (sg[-1] - sg) ** 2 / (sh[-1] - sh + ridge) - sg[-1] ** 2 / (sh[-1] + ridge)
                        j = int(gain[:-1].argmax()) if k > 1 else -1
                        if j >= 0 and gain[j] > best:
                            best, column[base + node], cut[base + node], share[base + node] = gain[j], c, cuts[c][j], 1 - sh[j] / sh[-1]
                weight = cls.leaves(x, column[: 2 * base + 1], cut[: 2 * base + 1], share[: 2 * base + 1])
            value = step * (g @ weight) / (h @ weight + ridge)
            score += weight @ value
            model.trees.append((column, cut, share, value))
        return model


@dataclass
class Model:
    """The trees, and the statistics (key, n, blocked) that their features are made from."""

    trees: Trees = field(default_factory=Trees)
    stats: DataFrame | None = None


def train(labelled: DataFrame, url_col: str = "url", verdict_col: str = "verdict", sample: int = SAMPLE) -> Model:
    """Count the statistics of all labelled URLs, and fit the trees on at most `sample`
    distinct ones (those with the smallest hashes); rows with a null URL or label are left out."""
    host, path = host_and_path(F.col("url"))
    own = (
        labelled.select(F.col(url_col).alias("url"), (F.col(verdict_col) == "block").alias("block"))
        .filter("url IS NOT NULL AND block IS NOT NULL")
        .groupBy("url")
        .agg(F.max("block").alias("block"))
        .withColumn("draw", F.pmod(F.xxhash64("url"), F.lit(1 << 40)))
    )
    own = stored(own, "labelled")
    stats = stored(statistics(own), "statistics")
    # Every task would send its own smallest hashes to the driver: rows whose hash is surely
    # not among the smallest of all are left out before.
    share = min(1.0, 1.5 * sample / max(1, own.count()))
    pick = lambda most: stored(own.filter(F.col("draw") < int(most * (1 << 40))).orderBy("draw", "url").limit(sample), "sample")
    picked = pick(share)
    if share < 1 and picked.count() < sample:
        picked = pick(1.0)
    folds = stored(statistics(own, by_fold=True), "statistics")
    rows = with_statistics(with_statistics(picked.select("url", host.alias("host"), path.alias("path"), "block", "draw"), stats), folds, by_fold=True)
    rows = rows.orderBy("draw", "url").collect()  # at most `sample`
    all_, own_fold = (np.array([[r[c] for c in names] for r in rows], np.float64).reshape(-1, len(names)) for names in (COUNTS, FOLD_COUNTS))
    return Model(Trees.fit([r.url for r in rows], [r.host for r in rows], [r.path for r in rows], np.array([r.block for r in rows], bool), all_ - own_fold), stats)


def _parts(pages: DataFrame, url_col: str, *kept: str) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    return pages.select(*kept, F.col(url_col).alias("url")).select(*kept, F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))


def url_rules(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, url (a null one empty), host, path, rule (the longest that fits, else null) and listed (its verdict)."""
    kind = dict(pages.dtypes)[id_col]
    book = pages.sparkSession.sparkContext.broadcast(RuleBook(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = book.value.find
        for b in batches:
            found = [find(h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            rule, listed = (pa.array([getattr(r, k) if r else None for r in found], pa.string()) for k in ("text", "verdict"))
            yield pa.RecordBatch.from_arrays([*b.columns, rule, listed], [*b.schema.names, "rule", "listed"])

    return _parts(pages, url_col, id_col).mapInArrow(run, f"`{id_col}` {kind}, url string, host string, path string, rule string, listed string")


def url_filter(pages: DataFrame, rules: list[Rule], model: Model, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (the longest that fits, else null), verdict and score (the
    trees' probability of 'block') of every URL."""
    rows = _parts(pages, url_col, id_col)
    if model.stats is None:
        rows = rows.withColumns({c: F.lit(None).cast("long") for c in COUNTS})
    else:
        rows = with_statistics(rows, model.stats)
    kind, trees = dict(pages.dtypes)[id_col], model.trees
    book = pages.sparkSession.sparkContext.broadcast(RuleBook(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = book.value.find
        for b in batches:
            url, host, path = (b.column(c).to_pylist() for c in ("url", "host", "path"))
            counts = np.stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in COUNTS], 1)
            score = trees.probability(trees.features(url, host, path, counts))
            found = [find(h, p) for h, p in zip(host, path, strict=True)]
            rule = pa.array([r.text if r else None for r in found], pa.string())
            verdict = pa.array([r.verdict if r else "block" if s > 0.5 else "allow" for r, s in zip(found, score.tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("host"), b.column("path"), rule, verdict, pa.array(score)], [id_col, "host", "path", "rule", "verdict", "score"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, score double")


def labelled_by_rules(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """url, rule, verdict of the URLs that a rule fits: labelled URLs for `train`."""
    rows = url_rules(pages.withColumn("__id", F.lit(0)), rules, "__id", url_col)
    return rows.filter("rule IS NOT NULL").select("url", "rule", F.col("listed").alias("verdict"))


def held_out(labelled: DataFrame, group_col: str = "rule") -> list[dict]:
    """For each group of labelled URLs (url, verdict), how trees trained on all the others
    judge it: rows, accuracy and log loss, beside those of the others' prior."""
    labelled = stored(labelled.select("url", "verdict", F.col(group_col).alias("part")), "groups")
    out = []
    for r in labelled.groupBy("part").count().orderBy("part").collect():  # a row per group, one model each
        model = train(labelled.filter(~F.col("part").eqNullSafe(r.part)))
        part = labelled.filter(F.col("part").eqNullSafe(r.part)).select("url", (F.col("verdict") == "block").cast("int").alias("page_id"))
        said = url_filter(part, [], model).select(F.col("page_id").alias("block"), F.least(F.greatest("score", F.lit(1e-3)), F.lit(1 - 1e-3)).alias("p"))
        loss = lambda p: -(F.col("block") * F.log(p) + (1 - F.col("block")) * F.log(1 - p))
        prior = F.lit(model.trees.rate)
        right = lambda p: F.avg(((p > 0.5).cast("int") == F.col("block")).cast("double"))
        out.append(said.agg(F.lit(r.part).alias("group"), F.count("*").alias("rows"), right(F.col("p")).alias("accuracy"), right(prior).alias("prior_accuracy"), F.avg(loss(F.col("p"))).alias("loss"), F.avg(loss(prior)).alias("prior_loss")).first().asDict())
    return out
