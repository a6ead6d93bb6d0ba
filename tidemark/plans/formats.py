"""Questions asked of tables that have gone through a file format or a feed and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import posts, stats, text
from ..operators import claims, cleaning
from ..session import shared_dir
from ..sources import files
from .registry import Tables, query


def _place(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/tidemark-{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(*) FILTER (o_orderkey % 7 = 0) AS without_priority, 'o_clerk' AS lacking FROM orders GROUP BY 1")
def csv_as_text(t: Tables):
    """Orders written as CSV in order of their key, read as text alone, required, then typed."""
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit('a "quoted", \n'), "o_orderpriority")).alias("o_orderpriority"))
    files.write_csv(o, path := _place(t, "csv"), ["o_orderkey"])
    raw = files.require(files.csv_text(t.spark, path, o.columns), ["o_orderkey", "o_totalprice"])
    back = files.typed(raw, {"o_orderkey": "bigint", "o_totalprice": "double", "o_orderpriority": "string"})
    try:
        files.require(raw, ["o_orderkey", "o_clerk"])
        lack = ""
    except ValueError as x:
        lack = str(x).partition(": ")[2]
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_if(F.col("o_orderpriority").isNull()).alias("without_priority"), F.lit(lack).alias("lacking"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, count(*) FILTER (event_id % 5 = 0) AS nulls FROM events GROUP BY 1")
def csv_typed_back(t: Tables):
    """Events as gzipped CSV and back by a schema, empty cells as nulls."""
    e = t.events.select("event_id", "event_type", "value", F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("who"))
    files.write_csv(e, path := _place(t, "csv"), ["event_id"], gzip=True)
    back = files.parquet_or_csv(t.spark, f"{path}-none", path, "event_id long, event_type string, value double, who long")
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("who").isNull()).alias("nulls"))


@query("SELECT CASE event_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS source, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def json_sources(t: Tables):
    """Two sources of JSON lines as one table; a third has no file."""
    base = _place(t, "json")
    for k, name in enumerate(("even", "odd")):
        files.write_json(t.events.filter(F.col("event_id") % 2 == k).select("event_id", "event_type", "value"), f"{base}/{name}", gzip=bool(k))
    both = files.sources(t.spark, {name: f"{base}/{name}" for name in ("even", "odd", "none")}, "event_id long, event_type string, value double")
    return both.groupBy("source", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT 'u' || user_id AS author, count(*) AS n, min('e' || event_id) AS first, count(*) FILTER (event_id % 3 = 0) AS summaries FROM events WHERE value > 90 GROUP BY 1")
def atom_feed(t: Tables):
    """Events as an Atom feed, its entries read back as rows."""
    k = F.col("event_id")
    body = F.concat(F.lit("said & done "), k.cast("string"))
    entry = t.events.filter("value > 90").select(F.concat(F.lit("e"), k.cast("string")).alias("id"), F.lit("<title>").alias("title"), F.when(k % 3 != 0, body).alias("content"), F.when(k % 3 == 0, body).alias("summary"), F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name")).alias("author"), F.date_format("ts", "yyyy-MM-dd").alias("updated"), F.struct(F.lit("https://x/1").alias("_href")).alias("link"))
    entry.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path := _place(t, "atom"))
    rows = files.atom_entries(t.spark, path)
    return rows.filter("url = 'https://x/1' AND title = '<title>' AND text LIKE 'said & done%' AND created IS NOT NULL").groupBy("author").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.count_if(F.regexp_extract("id", r"\d+", 0).cast("long") % 3 == 0).alias("summaries"))


@query("SELECT CASE WHEN event_type IN ('error', 'view') THEN 'direct' ELSE 'infra' END AS tier, event_type || '.status.io' AS entity, count(*) AS n FROM events WHERE value > 90 GROUP BY 1, 2")
def status_feed(t: Tables):
    """Events as the RSS of status pages, as incidents with the tier of their page."""
    item = t.events.filter("value > 90").select(F.concat(F.lit("https://"), "event_type", F.lit(".status.io/"), F.col("event_id").cast("string")).alias("link"), F.lit("late").alias("title"), F.date_format("ts", "yyyy-MM-dd").alias("pubDate"))
    item.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path := _place(t, "rss"))
    return files.status_incidents(t.spark, path, {"error.status.io": "direct", "view.status.io": "direct"}).groupBy("tier", "entity").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'ground_delay' ELSE 'closure' END AS kind, event_type AS entity, count(*) AS n, count(*) FILTER (event_id % 2 = 0) AS delays, min(CASE WHEN event_id % 2 = 0 THEN 'wind | 2 h' ELSE 'wind | noon' END) AS detail FROM events WHERE value > 90 GROUP BY 1, 2")
def airport_feed(t: Tables):
    """Airport status documents of two kinds of record, as one table."""
    base, e = _place(t, "faa"), t.events.filter("value > 90")
    ground = e.filter("event_id % 2 = 0").select(F.col("event_type").alias("ARPT"), F.lit("wind").alias("Reason"), F.lit("1 h").alias("Avg"), F.lit("2 h").alias("Max"))
    closed = e.filter("event_id % 2 = 1").select(F.col("event_type").alias("ARPT"), F.lit("wind").alias("Reason"), F.lit("noon").alias("Start"))
    for tag, rows in (("Ground_Delay", ground), ("Airport", closed)):
        rows.write.format("xml").option("rootTag", "all").option("rowTag", tag).save(f"{base}/{tag}")
    return files.airport_delays(t.spark, f"{base}/*").groupBy("kind", "entity").agg(F.count("*").alias("n"), F.count("delay").alias("delays"), F.min("detail").alias("detail"))


@query("SELECT 'u' || user_id AS author, count(*) AS n, sum(event_id % 10 + CASE WHEN event_id % 4 > 0 THEN event_id % 3 ELSE 0 END)::BIGINT AS engagement FROM events GROUP BY 1")
def api_answers(t: Tables):
    """Events inside JSON answers of a page each, their items as rows, counters added up."""
    k = F.col("event_id")
    hit = F.struct(k.cast("string").alias("objectID"), F.lit("t").alias("title"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"), (k % 10).alias("points"), F.when(k % 4 > 0, k % 3).alias("num_comments"))
    pages = t.events.groupBy((k / 100).cast("long").alias("page")).agg(F.to_json(F.struct(F.collect_list(hit).alias("hits"))).alias("body"))
    return files.answers(pages, "body", "hackernews").groupBy("author").agg(F.count("*").alias("n"), F.sum("engagement").alias("engagement"))


@query("SELECT event_type AS page, count(*) AS n, min(event_id)::VARCHAR AS first FROM events WHERE value > 50 GROUP BY 1")
def landed_pages(t: Tables):
    """Landed answers, line by line, by Spark's own reader; a folder stands for a page."""
    rows = t.events.filter("value > 50").select("event_type", F.format_string("%012d", "event_id").alias("value"))
    rows.repartition("event_type").write.partitionBy("event_type").text(path := _place(t, "pages"))
    back = files.landed(t.spark, path).withColumn("page", F.col("event_type"))
    return back.groupBy("page").agg(F.count("*").alias("n"), F.min("body").cast("long").cast("string").alias("first"))


@query("SELECT sha256(string_agg(r_name, chr(10) ORDER BY r_name) || chr(10)) AS sha256, sum(length(r_name) + 1)::BIGINT AS length FROM region")
def file_digests(t: Tables):
    """The digest and length of a written file."""
    t.region.orderBy("r_name").select("r_name").coalesce(1).sortWithinPartitions("r_name").write.text(path := _place(t, "text"))
    return files.digests(t.spark, f"{path}/part-*").select("sha256", "length")


@query("SELECT 'corpus.rows' AS name, count(*)::VARCHAR AS value FROM documents UNION ALL SELECT 'labels.toxic', sum(toxic)::VARCHAR FROM labels")
def report_round_trip(t: Tables):
    """Metrics written as a report and read back as an input."""
    m = {"corpus": claims.of_row(t.documents.agg(F.count("*").alias("rows"))), "labels": claims.of_row(t.labels.agg(F.sum("toxic").cast("long").alias("toxic")))}
    claims.write_report(t.spark, m, path := _place(t, "report"))
    flat = claims.flatten(claims.read_report(t.spark, path))
    return t.spark.createDataFrame([(k, str(v)) for k, v in flat.items()], "name string, value string")


@query("SELECT count(*) AS n, count(*) FILTER (n_nationkey % 3 = 0) AS nulls FROM nation")
def table_sink(t: Tables):
    """A table saved to the catalogue, empty texts as nulls, and read from there."""
    name = f"tidemark_{uuid.uuid4().hex}"
    files.save_table(t.nation.select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name")).alias("n_name")), name)
    out = t.spark.table(name).agg(F.count("*").alias("n"), F.count_if(F.col("n_name").isNull()).alias("nulls")).first()
    t.spark.sql(f"DROP TABLE {name}")
    return t.spark.createDataFrame([tuple(out)], "n long, nulls long")


@query("SELECT 'whole' AS step, count(*) AS n, 4 AS columns FROM supplier UNION ALL SELECT 'on topic', count(*) FILTER (s_nationkey < 12), 4 FROM supplier UNION ALL SELECT 'without a column', count(*) FILTER (s_nationkey < 12), 3 FROM supplier")
def budget_ladder(t: Tables):
    """A table made to fit three budgets."""
    s = t.supplier.select("s_suppkey", "s_name", "s_nationkey", F.lit("x" * 200).alias("s_comment"))
    size = lambda df: df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 1)).first()[0]
    on = F.col("s_nationkey") < 12
    full, some = size(s), size(s.filter(on))
    rows = []
    for step, limit in (("whole", full), ("on topic", some), ("without a column", some - 1)):
        out = files.within_budget(s, limit, "s_name", [F.col("s_suppkey")], ["s_comment"], on_topic=on)
        rows.append((step, out.count(), len(out.columns)))
    return t.spark.createDataFrame(rows, "step string, n long, columns int")


#: A text; stripped of any white space; in NFKC; without entities.
TEXTS = [("  a\tb 　", "a\tb"), ("ﬁne ½", "fine 1⁄2"), ("&lt;b&gt; &amp;amp; &eacute;", "<b> &amp; é"), ("a b", "a b"), ("", "")]


@query("SELECT event_id, y AS text FROM events JOIN (VALUES " + ", ".join(f"({i}, '{y}')" for i, (_, y) in enumerate(TEXTS)) + f") v(i, y) ON event_id % {len(TEXTS)} = i")
def unicode_texts(t: Tables):
    """Texts stripped of any white space, in NFKC, entities as characters."""
    said = F.element_at(F.array(*[F.lit(x) for x, _ in TEXTS]), (F.col("event_id") % len(TEXTS) + 1).cast("int"))
    return t.events.select("event_id", text.strip(text.nfkc(text.html_unescape(said))).alias("text"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a b' WHEN 1 THEN 'c & d' ELSE '' END AS text FROM events")
def html_text(t: Tables):
    """Pages as plain text: scripts and tags out, entities decoded."""
    k = F.col("event_id") % 3
    html = F.when(k == 0, "<p>a<script>x < 1</script> <!-- no --><b>b</b></p>").when(k == 1, "c <i>&amp;</i> d<style>p {}</style>").otherwise("<br/>")
    return t.events.select("event_id", text.plain_page(html).alias("text"))


@query("SELECT event_id, quote FROM events JOIN (VALUES (0, 'say \"it'), (1, 'A'), (2, 'plain')) v(i, quote) ON event_id % 3 = i")
def undamaged_texts(t: Tables):
    said = F.element_at(F.array(F.lit('""say ""it"" ""'), F.lit('"\\u0041"'), F.lit("plain")), (F.col("event_id") % 3 + 1).cast("int"))
    return t.events.select("event_id", posts.undamaged(said).alias("quote"))


@query("""WITH k AS (SELECT user_id, count(*) FILTER (value > 40)::INT AS k, count(*)::INT AS n FROM events WHERE event_id % 4 = 0 GROUP BY 1), i AS (SELECT k.*, unnest(range(0, n + 1)) AS i FROM k),
l AS (SELECT *, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5)) AS p FROM i), o AS (SELECT user_id, p AS own FROM l WHERE i = k)
SELECT l.user_id, any_value(k) AS k, any_value(n) AS n, round(least(1, sum(p) FILTER (p <= own * (1 + 1e-7))), 5) AS p FROM l JOIN o USING (user_id) GROUP BY 1""")
def binomial_tests(t: Tables):
    """Exact two-sided tests of each user's share of large values against a half."""
    k = t.events.filter("event_id % 4 = 0").groupBy("user_id").agg(F.count_if(F.col("value") > 40).cast("int").alias("k"), F.count("*").cast("int").alias("n"))
    return k.select("user_id", "k", "n", F.round(stats.binomial_test(F.col("k"), F.col("n")), 5).alias("p"))


@query("SELECT o_orderstatus, count(*) AS kept FROM orders GROUP BY 1")
def demanded(t: Tables):
    """Rows that keep their contract, which would stop the read if one of them broke it."""
    return cleaning.demand(t.orders, {"price is positive": F.col("o_totalprice") > 0}).groupBy("o_orderstatus").agg(F.count("*").alias("kept"))
