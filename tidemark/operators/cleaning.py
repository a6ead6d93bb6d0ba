"""Repairs of raw text tables with a log of every changed value, contracts, dictionaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze, strip, tokens, whole
from ..session import shared_dir
from .keys import keep_first, union_all

# What stands for a missing cell; patterns that corrupt texts end with.
MISSING = ("", "NULL", "null", "None", "NaN", "nan", "N/A", "NA")
ARTIFACTS = {"html_entity_amp": "&amp;", "html_tag_br": "<br>", "html_tag_div": "<div>", "mojibake_e_acute": "Ã©", "trailing_newlines": r"\n+"}


def route_timestamp(c: Column) -> Column:
    """struct(at, date, format): a time written as ISO, as epoch seconds, or as day-month-year
    (a date without time); other forms are null with format 'unknown'."""
    iso, epoch, dmy = whole(c, r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), whole(c, r"\d{9,10}"), whole(c, r"\d{2}-\d{2}-\d{4}")
    at = F.when(iso, F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss"))).when(epoch, F.timestamp_seconds(c.try_cast("bigint")))
    day = F.when(dmy, F.try_to_timestamp(c, F.lit("dd-MM-yyyy")).cast("date")).otherwise(at.cast("date"))
    form = F.when(iso, "iso").when(epoch, "epoch").when(dmy, "dmy").otherwise("unknown")
    return F.struct(at.alias("at"), day.alias("date"), form.alias("format"))


def missing_to_null(c: Column) -> Column:
    return F.when(~c.isin(*MISSING), c)


def canonical(c: Column, names: Sequence[str]) -> Column:
    """The listed name that equals the text without case and outer space; else as written."""
    key = F.lower(strip(c))
    return F.coalesce(*[F.when(key == n.lower(), F.lit(n)) for n in names], c)


def artifact(c: Column) -> Column:
    """The kind of artifact that the text ends with, or null."""
    return F.coalesce(*[F.when(F.rlike(c, F.lit(rf"(?:{end})\z")), F.lit(kind)) for kind, end in ARTIFACTS.items()])


def without_artifact(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?:{'|'.join(ARTIFACTS.values())})\z", "")


def unsigned(c: Column) -> Column:
    """A count written as text; a minus sign is a corruption. Fractions and words are null."""
    x = F.abs(strip(c).try_cast("double"))
    return F.when(F.pmod(x, F.lit(1.0)) == 0, x.cast("long"))


@dataclass
class Repair:
    rule: str
    column: str
    apply: object  # Column -> Column


@dataclass
class Cleaner:
    """Repairs in order, each logged where it changes a value."""

    key: str
    repairs: list[Repair] = field(default_factory=list)

    def run(self, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The clean rows, and the log: key, column, rule, old_value, new_value. One pass
        over the rows makes every step's value; the log is unpivoted from it."""
        rows, logs = raw, []
        for i, r in enumerate(self.repairs):
            before = f"__{i}"
            rows = rows.withColumn(before, F.col(r.column)).withColumn(r.column, r.apply(F.col(r.column)))
            after = next((f"__{j}" for j in range(i + 1, len(self.repairs)) if self.repairs[j].column == r.column), r.column)
            logs.append((r, before, after))
        entry = F.array(*[F.struct(F.lit(r.column).alias("column"), F.lit(r.rule).alias("rule"), F.col(b).cast("string").alias("old_value"), F.col(a).cast("string").alias("new_value"), (~F.col(b).cast("string").eqNullSafe(F.col(a).cast("string"))).alias("changed")) for r, b, a in logs])
        log = rows.select(F.col(self.key), F.explode(F.filter(entry, lambda e: e["changed"])).alias("e")).select(self.key, "e.column", "e.rule", "e.old_value", "e.new_value")
        return rows.select(*raw.columns), log


def drop_copies(raw: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, with copies_removed; and the keys whose copies disagree."""
    value = F.xxhash64(*[c for c in raw.columns if c not in (key, order)])
    n = raw.groupBy(key).agg((F.count("*") - 1).cast("int").alias("copies_removed"), F.count_distinct(value).alias("__v"))
    first = keep_first(raw, [key], [order])
    return first.join(n.drop("__v"), key), n.filter("__v > 1").select(key)


def post_cleaner(platforms: Sequence[str]) -> Cleaner:
    """Repairs of a feed of posts: id, platform, likes, text."""
    return Cleaner(
        "post_id",
        [
            Repair("missing_token_to_null", "platform", missing_to_null),
            Repair("canonical_case", "platform", lambda c: canonical(c, platforms)),
            Repair("missing_token_to_null", "likes", missing_to_null),
            Repair("sign_flip_abs", "likes", lambda c: F.when(F.startswith(strip(c), F.lit("-")), unsigned(c).cast("string")).otherwise(c)),
            Repair("strip_suffix_artifact", "text", without_artifact),
            Repair("missing_token_to_null", "text", missing_to_null),
            Repair("collapse_whitespace", "text", squeeze),
        ],
    )


def profile(df: DataFrame) -> DataFrame:
    """column, kind, n, known, complete, distinct, example (the least value): a row for each
    column. Each column is aggregated in a scan of its own, which reads that column alone:
    distinct values of several columns in one pass would repeat every row for each."""
    out = None
    for c, kind in df.dtypes:
        x = F.col(f"`{c}`")
        row = df.select(x).agg(F.count("*").alias("n"), F.count(x).alias("known"), F.count_distinct(x.cast("string")).alias("distinct"), F.min(x.cast("string")).alias("example"))
        row = row.select(F.lit(c).alias("column"), F.lit(kind).alias("kind"), "n", "known", F.try_divide("known", "n").alias("complete"), "distinct", "example")
        out = row if out is None else out.unionByName(row)
    return out


def raw_profile(df: DataFrame, key: str, category: str, count: str, text: str, names: Sequence[str]) -> DataFrame:
    """name, n of what is wrong in raw text cells: missing tokens, labels not as listed,
    negative counts, artifacts at the end of texts; rows and distinct keys beside them."""
    lost = lambda c: missing_to_null(F.col(c)).isNull()
    kind = artifact(F.col(text))
    counts = {
        "rows": F.count("*"),
        f"{category} missing": F.count_if(lost(category)),
        f"{category} not canonical": F.count_if(~lost(category) & ~F.col(category).isin(*names)),
        f"{count} missing": F.count_if(lost(count)),
        f"{count} negative": F.count_if(F.startswith(strip(F.col(count)), F.lit("-"))),
        f"{text} missing": F.count_if(lost(text)),
        **{f"{text} {k}": F.count_if(kind == k) for k in ARTIFACTS},
    }
    own = df.agg(*[c.alias(k) for k, c in counts.items()]).unpivot([], list(counts), "name", "n")
    return own.unionByName(df.agg(F.count_distinct(key).alias("n")).select(F.lit("ids").alias("name"), "n"))


def holds(row: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, ok of conditions on a frame of one row."""
    each = F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(c, F.lit(False)).alias("ok")) for k, c in checks.items()])
    return row.select(F.explode(each).alias("x")).select("x.*")


def contracts(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, violations, ok: rows for which a condition is not true, counted in one pass."""
    row = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(checks.values())])
    each = F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("violations"), (F.col(f"c{i}") == 0).alias("ok")) for i, name in enumerate(checks)])
    return row.select(F.explode(each).alias("x")).select("x.*")


def demand(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """df, whose rows raise when they are read and break a check."""
    bad = F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()])
    return df.withColumn("__ok", F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("contract broken: "), bad))).otherwise(F.lit(True))).filter("__ok").drop("__ok")


def dedupe_by_regime(df: DataFrame, source: str, author: str, body: str, order: str, by_author: Sequence[str]) -> DataFrame:
    """The first of equal texts within a source; of listed sources, within an author too."""
    key = F.regexp_replace(F.lower(body), "[^a-z0-9 ]", "")
    who = F.when(F.col(source).isin(*by_author), F.coalesce(author, F.lit(""))).otherwise("")
    return keep_first(df.withColumns({"__k": key, "__w": who}), [source, "__w", "__k"], [order]).drop("__k", "__w")


def log_odds(df: DataFrame, text: str, focus: Column, k: int, pattern: str = r"[a-z][a-z'&-]{2,}", least: int = 4, prior: float = 0.01) -> DataFrame:
    """term, a, b, z: the k terms most typical of the focus rows against the others."""
    words = df.select(focus.alias("f"), F.explode(tokens(F.col(text), pattern)).alias("term"))
    c = words.groupBy("term").agg(F.count_if("f").alias("a"), F.count_if(~F.col("f")).alias("b")).filter(F.col("a") + F.col("b") >= least)
    shared_dir(df.sparkSession)
    c = c.checkpoint()  # read for the totals and for the scores
    n = c.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    p, all_p = prior * (F.col("a") + F.col("b")), prior * (F.col("na") + F.col("nb"))
    logit = lambda x, m: F.log((F.col(x) + p) / (F.col(m) + all_p - F.col(x) - p))
    z = F.round((logit("a", "na") - logit("b", "nb")) / F.sqrt(1 / (F.col("a") + p) + 1 / (F.col("b") + p)), 5)
    return c.crossJoin(F.broadcast(n)).select("term", "a", "b", z.alias("z")).orderBy(F.desc("z"), "term").limit(k)


def pipeline_counts(**steps: DataFrame) -> DataFrame:
    """step, n: the rows after each step."""
    return union_all(*[df.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n") for name, df in steps.items()])
