"""Readers and writers of the formats that feeds come in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import ranks
from ..operators.keys import same_rows, union_all


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file is at the path, in whatever store the session can reach."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def batches(spark: SparkSession, path: str, name: str = "batch") -> list[int]:
    """The numbers of the folders name=K that were written whole (they hold _SUCCESS)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(int(str(x.getPath().getParent().getName()).partition("=")[2]) for x in found)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of every file at a path; a file is one row and is read by one task."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def landed(spark: SparkSession, path: str) -> DataFrame:
    """page, position, body: the lines of landed answers, page by page, by Spark's own reader."""
    df = spark.read.text(path, wholetext=True)
    rest = [c for c in df.columns if c != "value"]  # columns in the names of folders
    whole = df.select(F.regexp_extract(F.input_file_name(), "[^/]+$", 0).alias("page"), *rest, F.filter(F.split("value", "\n"), lambda x: F.btrim(x) != "").alias("lines"))
    return whole.select("page", *rest, F.posexplode("lines").alias("position", "body"))


def csv_text(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Every cell as text, none taken for null: quoted cells may hold line breaks."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in columns})


def csv_typed(spark: SparkSession, path: str, schema: str, null: str = "") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", null).csv(path)


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, or an error that lists the columns it lacks."""
    if lack := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(lack)}")
    return df


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns as the given types; empty or unreadable cells are null."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")).try_cast(k) for c, k in kinds.items()})


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, and a path without files is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    kinds = spark.createDataFrame([], schema).schema
    df = spark.read.schema(kinds).option("mode", "DROPMALFORMED").json(path)
    return df.dropna("all")


def parquet_or_csv(spark: SparkSession, parquet: str, csv: str, schema: str) -> DataFrame:
    return spark.read.parquet(parquet) if exists(spark, parquet) else csv_typed(spark, csv, schema)


def sources(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """JSON lines of several sources as one table with the column `source`; an error if
    none of them has a file. Counts by source are an aggregation of the result."""
    there = {name: p for name, p in paths.items() if exists(spark, p)}
    if not there:
        raise FileNotFoundError("no source has any file: " + ", ".join(paths.values()))
    return union_all(*[json_lines(spark, p, schema).withColumn("source", F.lit(name)) for name, p in there.items()])


def xml_items(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements of a tag in XML files (Atom entries, RSS items, status feeds)."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """id, title, text, author, created, url of the entries of Atom feeds."""
    link = "link struct<_href: string>"
    df = xml_items(spark, path, "entry", f"id string, title string, content string, summary string, author struct<name: string>, published string, updated string, {link}")
    return df.select("id", "title", F.coalesce("content", "summary").alias("text"), F.col("author.name").alias("author"), F.coalesce("published", "updated").alias("created"), F.col("link._href").alias("url"))


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """id, title, text, author, created, url of the items of RSS feeds."""
    df = xml_items(spark, path, "item", "guid string, title string, description string, source string, pubDate string, link string")
    return df.select(F.coalesce("guid", "link").alias("id"), "title", F.col("description").alias("text"), F.col("source").alias("author"), F.col("pubDate").alias("created"), F.col("link").alias("url"))


# Where interfaces keep their items, the fields of a reaction in them, and the
# counters that make up its engagement.
INTERFACES = {
    "lemmy": ("posts", "post struct<id: long, name: string, body: string, published: string, ap_id: string>, creator struct<name: string>, counts struct<score: long, comments: long>", {"id": "post.id", "title": "post.name", "text": "post.body", "author": "creator.name", "created": "post.published", "url": "post.ap_id"}, ("counts.score", "counts.comments")),
    "mastodon": ("statuses", "id string, content string, created_at string, url string, account struct<acct: string>, favourites_count long, reblogs_count long, replies_count long", {"id": "id", "title": None, "text": "content", "author": "account.acct", "created": "created_at", "url": "url"}, ("favourites_count", "reblogs_count", "replies_count")),
    "hackernews": ("hits", "objectID string, title string, story_text string, comment_text string, author string, created_at string, story_url string, points long, num_comments long", {"id": "objectID", "title": "title", "text": ("story_text", "comment_text"), "author": "author", "created": "created_at", "url": "story_url"}, ("points", "num_comments")),
    "pageviews": ("items", "article string, timestamp string, views long", {"id": "article", "title": "article", "text": None, "author": None, "created": "timestamp", "url": None}, ("views",)),
}


def answers(df: DataFrame, column: str, interface: str) -> DataFrame:
    """id, title, text, author, created, url, engagement of the items in JSON answers of a
    known interface; missing counters count as 0."""
    items, schema, fields, counters = INTERFACES[interface]
    rows = json_items(df, column, items, schema)
    of = lambda x: F.lit(None).cast("string") if x is None else F.coalesce(*x) if isinstance(x, tuple) else F.col(x).cast("string")
    return rows.select(*[of(x).alias(k) for k, x in fields.items()], engagement(*counters).alias("engagement"))


def airport_delays(spark: SparkSession, path: str) -> DataFrame:
    """entity, kind, reason, delay, detail of airport status documents, whose two kinds of
    record (delays of programmes and closures) are one table."""
    ground = xml_items(spark, path, "Ground_Delay", "ARPT string, Reason string, Avg string, Max string").select(F.col("ARPT").alias("entity"), F.lit("ground_delay").alias("kind"), F.col("Reason").alias("reason"), F.col("Avg").alias("delay"), F.concat_ws(" | ", F.nullif(F.col("Reason"), F.lit("")), F.nullif(F.col("Max"), F.lit(""))).alias("detail"))
    closed = xml_items(spark, path, "Airport", "ARPT string, Reason string, Start string, Reopen string").select(F.col("ARPT").alias("entity"), F.lit("closure").alias("kind"), F.col("Reason").alias("reason"), F.lit(None).cast("string").alias("delay"), F.concat_ws(" | ", F.nullif(F.col("Reason"), F.lit("")), F.nullif(F.col("Start"), F.lit("")), F.nullif(F.col("Reopen"), F.lit(""))).alias("detail"))
    return ground.unionByName(closed).filter("entity IS NOT NULL")


def status_incidents(spark: SparkSession, path: str, tiers: dict[str, str], default: str = "infra") -> DataFrame:
    """The items of status pages as incidents, with the tier of the page they are from."""
    items = rss_items(spark, path)
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    tier = F.coalesce(*[F.when(host == h, F.lit(v)) for h, v in tiers.items()], F.lit(default))
    return items.select("id", "title", F.col("text").alias("detail"), F.col("created").alias("started_utc"), host.alias("entity"), tier.alias("tier"))


def enumerated(fetch, first: str | None, oldest: str, created: str = "created"):
    """Rows of a paginated interface, page after page, until a page reaches past the oldest
    time wanted, is empty, or is the last: fetch(token) -> (rows, next token). Rows older
    than the edge are left out."""
    token, more = first, True
    while more:
        rows, token = fetch(token)
        yield from (r for r in rows if r[created] >= oldest)
        more = bool(rows) and token is not None and min(r[created] for r in rows) >= oldest


def json_items(df: DataFrame, column: str, items: str, schema: str) -> DataFrame:
    """The objects of a list inside a JSON answer, a row each."""
    kind = f"struct<`{items}`: array<struct<{schema}>>>"
    return df.select(F.explode(F.from_json(column, kind)[items]).alias("x")).select("x.*")


def engagement(*counters: str):
    """Counters added up, missing ones as 0."""
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in counters[1:]), F.coalesce(F.col(counters[0]), F.lit(0)))


def write_csv(df: DataFrame, path: str, order: Sequence[str], gzip: bool = False) -> None:
    """CSV in a total order, nulls as empty cells."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').option("compression", "gzip" if gzip else "none").csv(path)


def write_json(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if gzip else "none").option("ignoreNullFields", False).json(path)


def write_nested(parent: DataFrame, child: DataFrame, key: str, name: str, path: str) -> None:
    """Parents with their children as a list, an object a line; a parent's children are
    the unit that one row holds."""
    lists = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in child.columns if c != key]))).alias(name))
    write_json(parent.join(lists, key, "left"), path)


def read_nested(spark: SparkSession, path: str, parent: DataFrame, child: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    rest = [f for f in child.schema.fields if f.name != key]
    kind = f"array<{StructType(rest).simpleString()}>"
    schema = ", ".join([*(f"`{c}` {k}" for c, k in parent.dtypes), f"`{name}` {kind}"])
    df = spark.read.schema(schema).json(path)
    return df.select(*parent.columns), df.select(key, F.explode(name).alias("x")).select(key, "x.*").select(*child.columns)


def nested_round_trip(parent: DataFrame, child: DataFrame, key: str, name: str, path: str) -> bool:
    """Whether both tables come back from the nested file value for value."""
    write_nested(parent, child, key, name, path)
    a, b = read_nested(parent.sparkSession, path, parent, child, key, name)
    return same_rows(a, parent) and same_rows(b, child)


def write_table(df: DataFrame, path: str) -> str:
    """Parquet, or CSV where a column has a type that Parquet can't hold; the format used."""
    try:
        df.write.mode("overwrite").parquet(path)
        return "parquet"
    except AnalysisException:
        df.select(*[F.to_json(c).alias(c) if k.startswith(("map", "array", "struct")) else F.col(c).cast("string").alias(c) for c, k in df.dtypes]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
        return "csv"


def nullified(df: DataFrame) -> DataFrame:
    """df with empty texts and NaN as nulls, as a database is given them."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) if k == "string" else F.nanvl(F.col(c), F.lit(None)) for c, k in df.dtypes if k in ("string", "double", "float")})


def save_table(df: DataFrame, name: str) -> None:
    nullified(df).write.mode("overwrite").saveAsTable(name)


def save_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None, rows: int = 5000) -> None:
    """The rows of a database table replaced (it is emptied, not dropped, so that its keys
    stay), in batches; the driver of the database must be on Spark's path."""
    w = nullified(df).write.mode("overwrite").option("truncate", True).option("batchsize", rows)
    w.jdbc(url, table, properties=properties or {})


def within_budget(df: DataFrame, limit: int, text: str, rank: Sequence, droppable: Sequence[str] = (), cuts: Sequence[int] = (600, 400, 280), on_topic=None) -> DataFrame:
    """df made smaller, step by step, until its JSON lines take `limit` bytes or fewer: first
    only the rows on topic (where a condition is given), then without the droppable columns,
    one by one, then with its text cut, then with the lowest-ranked rows left out. One
    aggregation sizes every step at once; the rows that fit are found from sizes cumulated
    in order of rank, in one more pass."""
    shape = lambda of, cols, n: of.select(*[F.substring(c, 1, n).alias(c) if n and c == text else F.col(c) for c in cols])
    line = lambda cols, n: F.octet_length(F.to_json(F.struct(*[F.substring(c, 1, n).alias(c) if n and c == text else F.col(c) for c in cols]))) + 1
    topic = F.lit(True) if on_topic is None else F.coalesce(on_topic, F.lit(False))
    cols, steps = list(df.columns), [(list(df.columns), None, F.lit(True))]
    if on_topic is not None:
        steps.append((cols, None, topic))
    for c in droppable:
        cols = [x for x in cols if x != c]
        steps.append((cols, None, topic))
    steps += [(cols, n, topic) for n in cuts]
    sizes = df.agg(*[F.sum(F.when(keep, line(own, n))).alias(f"s{i}") for i, (own, n, keep) in enumerate(steps)]).first()
    for i, (own, n, keep) in enumerate(steps):
        if (sizes[f"s{i}"] or 0) <= limit:
            return shape(df.filter(keep), own, n)
    own, n, keep = steps[-1]
    rows = ranks.running(df.filter(keep).withColumn("__size", line(own, n)), list(rank), ["__size"])
    return shape(rows.filter(F.col("before___size") + F.col("__size") <= limit), own, n)
