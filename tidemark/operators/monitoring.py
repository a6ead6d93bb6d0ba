"""Monitoring of reactions: unification, spikes of two kinds, shifts pooled over scopes,
evidence near an event, and cases classified by their signature."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import squeeze, stable_id
from ..session import shared_dir
from . import keys, ranks, series
from .cleaning import dedupe_by_regime
from .containment import contained


def unify(raw: DataFrame, aliases: dict[str, str], lo: str, hi: str, by_author: Sequence[str]) -> dict[str, DataFrame]:
    """The steps from raw records (source, record_native_id, created_utc, title, text,
    author_pseudonym, brand) to one reaction a row: read, in the window, once by id, once
    by text, with brand. Times are tried as ISO text and as RFC 822 without its weekday."""
    bare = F.regexp_replace("created_utc", r"^[A-Za-z]{3}, ", "")
    at = F.coalesce(F.col("created_utc").try_cast("timestamp"), F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss z")), F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss Z")))
    title, text = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    body = squeeze(F.regexp_replace(F.concat(title, F.lit(". "), text), r"^[. ]+|[. ]+\z", ""))
    read = raw.withColumns({"created": at, "body": body}).filter(F.length("body") >= 3)
    read = read.withColumns({"thin": F.length("body") < 15, "record_id": stable_id(F.col("source"), F.col("record_native_id"), F.substring("body", 1, 200))})
    inside = read.filter(F.col("created").between(F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp")))
    # Written after each shuffle, so that a count of one step doesn't make those before it again.
    shared_dir(raw.sparkSession)
    once = keys.keep_first(inside, ["record_id"], ["created", "body"]).checkpoint()
    texts = dedupe_by_regime(once, "source", "author_pseudonym", "body", "record_id", by_author).checkpoint()
    found = keys.contains_first(F.lower("body"), aliases)
    branded = texts.withColumn("brand", F.when(F.coalesce("brand", F.lit("")) == "", found).otherwise(F.col("brand")))
    return {"raw": raw, "read": read, "in_window": inside, "once_by_id": once, "once_by_text": texts, "unified": branded}


def spikes(daily: DataFrame, scope: list[str], measures: dict[str, str], z: float = 3.5, least: int = 7) -> DataFrame:
    """scope, date, kind, value, z, ratio: days far above their scope's median, for each
    measure (kind -> column); scopes of fewer than `least` days have none."""
    long = daily.select(*scope, "date", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("double").alias("value")) for k, c in measures.items()])).alias("m")).select(*scope, "date", "m.*").filter("value IS NOT NULL")
    enough = long.groupBy(*scope, "kind").agg(F.count("*").alias("days")).filter(F.col("days") >= least).drop("days")
    scored = series.robust_z(long.join(enough, [*scope, "kind"]), "value", [*scope, "kind"])
    return scored.filter(F.col("z") >= z).select(*scope, "date", "kind", "value", "z", F.try_divide("value", "median").alias("ratio"))


def pooled_shifts(scans: DataFrame, scope: list[str], p: str, q: float = 0.05, gap: int = 2) -> DataFrame:
    """Of shift tests (scope, date, d, p) those that survive the pooled control, and of runs
    no more than `gap` days apart within a scope the one of largest effect."""
    kept = series.islands(series.discoveries(scans, p, q).filter("kept"), scope, "date", gap)
    best = F.row_number().over(W.partitionBy(*scope, "island").orderBy(F.abs("d").desc(), p, "date"))
    return kept.withColumn("__r", best).filter("__r = 1").drop("__r", "kept", "island")


def evidence(events: DataFrame, incidents: DataFrame, attention: DataFrame, days: int = 2, share: float = 0.25, ratio: float = 1.25) -> DataFrame:
    """events (event, brand, day, dominance) with incidents (entity, day) and attention
    (brand, day, views) within `days` of them: n_incidents, lift and a verdict from 0 to 3,
    one point for an incident of the same name, one for attention, one for dominance."""
    name = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9 ]", "")
    spread = incidents.select(name(F.col("entity")).alias("__n"), (F.col("day") - days).alias("__lo"), (F.col("day") + days).alias("__hi"))
    near = keys.interval_join(events.select("event", name(F.col("brand")).alias("__n0"), "day"), spread, "day", "__lo", "__hi", 2 * days + 1).filter("__n = __n0").groupBy("event").agg(F.count("*").alias("n_incidents"))
    base = attention.groupBy("brand").agg(F.avg("views").alias("usual"))
    window = events.select("event", "brand", F.explode(F.sequence(F.col("day") - days, F.col("day") + days)).alias("day"))
    lift = window.join(attention, ["brand", "day"]).groupBy("event", "brand").agg(F.avg("views").alias("here")).join(base, "brand").select("event", F.try_divide("here", "usual").alias("lift"))
    out = events.join(near, "event", "left").join(lift, "event", "left").withColumn("n_incidents", F.coalesce("n_incidents", F.lit(0)))
    point = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return out.withColumn("verdict", point(F.col("n_incidents") > 0) + point(F.col("lift") >= ratio) + point(F.col("dominance") >= share))


def binomial_z(k: Column, n: Column, k0: Column, n0: Column) -> Column:
    p0 = k0 / n0
    return F.when((n > 0) & (n0 > 0) & (p0 > 0) & (p0 < 1), (k / n - p0) / F.sqrt(p0 * (1 - p0) / n))


def cases(df: DataFrame, group: str, at: str, value: str, signs: dict[str, Column], least: int = 25, z: float = -1.5) -> DataFrame:
    """Days on which a group's mean is z or less robust deviations below its median, with a
    binomial z of each sign against the group's other days and the signature they make."""
    n = {f"k_{s}": F.count_if(c) for s, c in signs.items()}
    day = df.groupBy(group, F.to_date(at).alias("date")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), *[v.alias(k) for k, v in n.items()])
    all_days = W.partitionBy(group)
    day = day.withColumns({f"{c}_rest": F.sum(c).over(all_days) - F.col(c) for c in ("n", *n)})
    low = series.robust_z(day.filter(F.col("n") >= least), "mean", [group]).filter(F.col("z") <= z)
    low = low.withColumns({f"z_{s}": binomial_z(F.col(f"k_{s}"), F.col("n"), F.col(f"k_{s}_rest"), F.col("n_rest")) for s in signs})
    strong = F.lit("mixed")
    for s in reversed(list(signs)):
        strong = F.when(F.col(f"z_{s}") >= 3, F.lit(s)).otherwise(strong)
    quiet = F.lit(True)
    for s in signs:
        quiet = quiet & (F.coalesce(f"z_{s}", F.lit(0.0)) < 2)
    return low.withColumn("signature", F.when(quiet, "no_signature").otherwise(strong)).select(group, "date", "n", "mean", "z", *[f"z_{s}" for s in signs], "signature")


def crossed(df: DataFrame, by: str, measures: dict[str, str]) -> DataFrame:
    """by, n, share of all rows and the mean of each measure (name -> column), to 4 digits."""
    rows = df.groupBy(by).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(k) for k, c in measures.items()])
    total = rows.agg(F.sum("n").alias("__all"))
    return rows.crossJoin(F.broadcast(total)).select(by, "n", F.round(F.col("n") / F.col("__all"), 4).alias("share"), *measures)


def against_ratings(df: DataFrame, flag: str, rating: str) -> DataFrame:
    """What a rule selects, held against ratings that it does not read: one row."""
    hit, r = F.col(flag), F.col(rating)
    own, rest = F.avg(F.when(hit, r)), F.avg(F.when(~hit, r))
    five = F.avg(F.when(hit, (F.coalesce(r, F.lit(0)) == 5).cast("int")))
    columns = {"share": F.avg(hit.cast("int")), "mean_rating": own, "five_star_share": five, "baseline": rest, "contrast": rest - own}
    return df.agg(F.count("*").alias("n"), F.count_if(hit).alias("selected"), *[F.round(c, 4).alias(k) for k, c in columns.items()])


def first_contained(df: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """df with name: the first of the names, in order, that the text contains; rows without
    one go. Distinct texts meet the names that share a rare run of characters with them."""
    each = df.select(F.col(text), F.col(text).alias("__says")).distinct()
    found = contained(each, text, "__says", names, name).groupBy(text).agg(F.min(name).alias(name))
    return df.join(found, text)


def headline_evidence(events: DataFrame, news: DataFrame, fails: Callable[[Column], Column], days: int = 2) -> DataFrame:
    """events (event, brand, day) with the headlines (news: day, asked, says) within `days`:
    how many there are, name the brand as a word, also report a failure, and were returned
    by the brand's own query; and the strongest tier that has any. Headlines of a day are
    counted by text before the join."""
    said = news.groupBy("day", "asked", "says").agg(F.count("*").alias("k")).withColumn("fails", fails(F.col("says")))
    cases = events.select("brand", "day").distinct()  # what is found depends on these alone
    near = cases.select("brand", F.col("day").alias("__day"), F.explode(F.sequence(F.date_sub("day", days), F.date_add("day", days))).alias("day")).join(said, "day")
    names = F.regexp_count("says", F.concat(F.lit(r"(?iu)\b\Q"), F.col("brand"), F.lit(r"\E\b"))) > 0
    total = lambda c: F.sum(F.when(c, F.col("k")).otherwise(0))
    found = near.withColumn("names", names).groupBy("brand", F.col("__day").alias("day")).agg(F.sum("k").alias("headlines"), total(F.col("names")).alias("naming"), total(F.col("names") & F.col("fails")).alias("failing"), total(F.col("names") & F.col("fails") & (F.col("asked") == F.col("brand"))).alias("own_query"))
    out = events.select("event", "brand", "day").join(found, ["brand", "day"], "left").drop("brand", "day").na.fill(0)
    return out.withColumn("tier", F.when(F.col("own_query") > 0, "own query").when(F.col("failing") > 0, "named").otherwise("none"))


def incidents(raw: DataFrame, started: str = "started_utc", observed: str = "observed_utc") -> DataFrame:
    """raw with started: when an incident began, else when it was seen; without either it goes."""
    return raw.withColumn("started", F.coalesce(F.col(started).try_cast("timestamp"), F.col(observed).try_cast("timestamp"))).filter("started IS NOT NULL")


def incident_evidence(events: DataFrame, found: DataFrame, sectors: dict[str, list[str]], chain: Sequence[str], key: str, days: int = 2, most: int = 8) -> DataFrame:
    """Incidents (key, started, entity, sector, tier) within `days` of an event (event, ts,
    brand, domain) that bear on it: the entity has the brand as a word, the sector covers the
    domain, or it is a direct vendor of a domain in `chain`, which is context only. The first
    `most` of an event, those that corroborate before the others. Of each way to bear on an
    event its first `most` are enough: one behind them is behind as many in the end."""
    width = days * 86_400 * 1_000_000
    right = events.select("event", "brand", "domain", (F.unix_micros("ts") - width).alias("__lo"), (F.unix_micros("ts") + width).alias("__hi"))
    rows = found.select(key, "entity", "sector", "tier", F.unix_micros("started").alias("__at"))
    # Each way to bear on an event is a join of its own: by brand, for the brands that an
    # entity names, or by domain, for those that a sector covers or that are listed.
    brands = events.select("brand").filter(F.length("brand") > 3).distinct().withColumn("__b", F.lower("brand"))
    entities = rows.filter("entity IS NOT NULL").select("entity", F.lower("entity").alias("__e")).distinct()
    word = F.regexp_count("__e", F.concat(F.lit(r"(?u)\b\Q"), F.col("__b"), F.lit(r"\E\b"))) > 0
    by_name = contained(entities, "entity", "__e", brands, "__b").join(entities, "entity").filter(word).join(brands, "__b").select("entity", "brand")
    covered = found.sparkSession.createDataFrame([(d, s) for d, of in sectors.items() for s in of], "domain string, sector string")
    listed = F.explode(F.array(*[F.lit(d) for d in chain]).cast("array<string>")).alias("domain")
    ways = {"__name": (rows.join(by_name, "entity"), "brand"), "__sector": (rows.join(F.broadcast(covered), "sector"), "domain"), "__chain": (rows.filter("tier = 'direct'").select("*", listed), "domain")}
    near = None
    for way, (left, on) in ways.items():
        part = keys.first_within(left.select(F.struct(key, "entity").alias("__x"), "__at", on), right.select("event", on, "__lo", "__hi"), [on], "__at", "__lo", "__hi", "event", "__x", most)
        part = part.select("event", "__x.*", *[F.lit(w == way).alias(w) for w in ways])
        near = part if near is None else near.unionByName(part)
    near = near.groupBy("event", key, "entity").agg(*[F.bool_or(w).alias(w) for w in ways])
    matched = F.when(F.col("__name"), "entity").when(F.col("__sector"), "sector").otherwise("supply_chain_tier")
    out = near.select("event", key, "entity", matched.alias("matched_on"), (F.col("__name") | F.col("__sector")).alias("corroborates"))
    return ranks.top_k(out, ["event"], [F.col("corroborates").desc(), F.col(key)], most)


def attention_evidence(events: DataFrame, views: DataFrame, days: int = 2, least: int = 5) -> DataFrame:
    """events (brand, day) with the mean of views (hint, date, views) within `days`, over
    hints that hold the brand's first word, against the median of all other days."""
    hints = views.filter("hint IS NOT NULL").select("hint", F.lower("hint").alias("__h")).distinct()
    words = events.select("brand", F.lower(F.substring_index("brand", " ", 1)).alias("__w")).distinct()
    names = contained(hints, "hint", "__h", words, "__w").join(words, "__w").select("brand", "hint")
    daily = views.join(names, "hint").groupBy("brand", "date").agg(F.sum("views").alias("views"))
    # A brand's days are one array, which no calendar makes long; an event leaves its own out.
    days_of = daily.groupBy("brand").agg(F.array_sort(F.collect_list(F.struct("views", "date"))).alias("__d"))
    near = lambda x: F.abs(F.datediff(F.col("day"), x["date"])) <= days
    out = events.select("brand", "day").distinct().join(days_of, "brand").withColumns({"__in": F.filter("__d", near), "__out": F.filter("__d", lambda x: ~near(x))}).withColumn("__n", F.size("__out").cast("long"))
    mid = lambda k: F.get("__out", k.cast("int"))["views"]
    usual = (mid(F.floor((F.col("__n") - 1) / 2)) + mid(F.floor(F.col("__n") / 2))) / 2.0
    mean = F.aggregate("__in", F.lit(0.0), lambda s, x: s + x["views"]) / F.when(F.size("__in") > 0, F.size("__in"))
    out = out.select("brand", "day", mean.alias("here"), F.when(F.col("__n") > 0, usual).alias("usual"), "__n")
    ratio = F.col("here") / F.greatest("usual", F.lit(1))
    out = out.filter((F.col("__n") >= least) & F.col("here").isNotNull())
    return out.select("brand", "day", F.round("here", 1).alias("here"), F.round("usual", 1).alias("usual"), F.round(ratio, 2).alias("ratio"), ((ratio >= 1.25) | (ratio <= 0.8)).alias("corroborates"))


def replies(df: DataFrame, group: str, replied: str, rating: str, least: int) -> DataFrame:
    """group, n, reply_rate, mean_rating, and Welch's t of the ratings with and without a reply."""
    x, yes = F.col(rating).cast("double"), F.col(replied)
    part = lambda c, v: F.when(c, v)
    sums = {f"{k}{e}": f(part(c, v)) for e, c in (("1", yes), ("0", ~yes)) for k, f, v in (("n", F.count, x), ("s", F.sum, x), ("q", F.sum, x * x))}
    own = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(yes.cast("int")).alias("rate"), F.avg(x).alias("mean"), *[c.alias(f"__{k}") for k, c in sums.items()]).filter(F.col("n") >= least)
    c = lambda k: F.col(f"__{k}")
    t = series.welch(c("n0"), c("s0"), c("q0"), c("n1"), c("s1"), c("q1"))["t"]
    return own.select(group, "n", F.round("rate", 4).alias("reply_rate"), F.round("mean", 4).alias("mean_rating"), F.round(c("s1") / c("n1") - c("s0") / c("n0"), 6).alias("difference"), F.round(t, 6).alias("t"))


# What is said of an event that so many sources bear out.
VERDICTS = ("internal only", "weak", "two sources", "three sources")


def verdicts(events: DataFrame, headlines: DataFrame, found: DataFrame, attention: DataFrame) -> DataFrame:
    """strength, tier, n, incidents, verdict over events (event, brand, day): one point each
    for an incident that corroborates, a headline of any tier, and attention."""
    inc = found.groupBy("event").agg(F.count_if("corroborates").alias("incidents"))
    out = events.join(headlines.select("event", "tier"), "event").join(inc, "event", "left").join(attention.select("brand", "day", "corroborates"), ["brand", "day"], "left")
    out = out.withColumn("incidents", F.coalesce("incidents", F.lit(0)))
    strength = (F.col("incidents") > 0).cast("int") + (F.col("tier") != "none").cast("int") + F.coalesce(F.col("corroborates"), F.lit(False)).cast("int")
    per = out.groupBy(strength.alias("strength"), "tier").agg(F.count("*").alias("n"), F.sum("incidents").alias("incidents"))
    return per.withColumn("verdict", F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), F.col("strength") + 1))
