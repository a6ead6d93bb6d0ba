"""Questions on text: rules, tokens, terms, repairs of dirty feeds, parsed sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import posts, rules, text
from ..operators import cleaning
from ..operators.containment import contained
from .registry import Tables, query

LABELS = [("shout", "[A-Z]{3,}"), ("number", r"[0-9]+"), ("greeting", r"\bthe\b"), ("ending", r"ing\b")]


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)[A-Z]{3,}') THEN 'shout' WHEN regexp_matches(text, '[0-9]+') THEN 'number' WHEN regexp_matches(text, '(?i)\bthe\b') THEN 'greeting' WHEN regexp_matches(text, '(?i)ing\b') THEN 'ending' ELSE 'none' END AS label,
substr(CASE WHEN regexp_matches(text, '(?i)[A-Z]{3,}') THEN regexp_extract(text, '(?i)[A-Z]{3,}') WHEN regexp_matches(text, '[0-9]+') THEN regexp_extract(text, '[0-9]+') WHEN regexp_matches(text, '(?i)\bthe\b') THEN regexp_extract(text, '(?i)\bthe\b') WHEN regexp_matches(text, '(?i)ing\b') THEN regexp_extract(text, '(?i)ing\b') ELSE '' END, 1, 60) AS evidence FROM documents""")
def first_match_label(t: Tables):
    m = rules.first_match(F.col("text"), LABELS, "none")
    return t.documents.select("doc_id", m.alias("m")).select("doc_id", "m.label", "m.evidence")


@query(r"SELECT doc_id, regexp_matches(text, '!') AS flag_loud, regexp_matches(text, '[0-9]') AS flag_digit, regexp_matches(text, '(?i)license') AS flag_license FROM documents")
def flags(t: Tables):
    return t.documents.select("doc_id", *[c.alias(k) for k, c in rules.flags(F.col("text"), {"loud": "!", "digit": "[0-9]", "license": "license"}).items()])


TRIGGERS = [("a", ("license", "GNU")), ("b", ("the", "er")), ("c", ("und", "der"))]


@query(r"""SELECT doc_id, CASE WHEN contains(text, 'license') OR contains(text, 'GNU') THEN 'a' WHEN contains(text, 'the') OR contains(text, 'er') THEN 'b' WHEN contains(text, 'und') OR contains(text, 'der') THEN 'c' ELSE 'other' END AS class,
CASE WHEN contains(text, 'license') THEN 'license' WHEN contains(text, 'GNU') THEN 'GNU' WHEN contains(text, 'the') THEN 'the' WHEN contains(text, 'er') THEN 'er' WHEN contains(text, 'und') THEN 'und' WHEN contains(text, 'der') THEN 'der' END AS trigger FROM documents""")
def substring_switch(t: Tables):
    return t.documents.select("doc_id", rules.switch(F.col("text"), TRIGGERS, "other").alias("class"), rules.deciding(F.col("text"), TRIGGERS).alias("trigger"))


@query(r"""SELECT count(*) FILTER (hit AND NOT alone) AS misfires, count(*) FILTER (hit) AS hits FROM (SELECT contains(text, 'the') OR contains(text, 'er') AS hit, regexp_matches(text, '(^|[^\p{L}\p{N}_])(?:the|er)($|[^\p{L}\p{N}_])') AS alone FROM documents)""")
def misfire(t: Tables):
    one = [("b", ("the", "er"))]
    return t.documents.agg(F.count_if(rules.misfire(F.col("text"), one)).alias("misfires"), F.count_if(rules.any_of(F.col("text"), one[0][1])).alias("hits"))


@query(r"""SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '!'))::INT AS exclamations, len(regexp_extract_all(text, '[A-Z]{3,}'))::INT AS caps, len(regexp_extract_all(text, '[0-9]'))::INT AS digits, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''))::INT AS words FROM documents""")
def text_stats(t: Tables):
    c = F.col("text")
    n = lambda p: F.regexp_count(c, F.lit(p))
    return t.documents.select("doc_id", F.length(c).cast("long").alias("chars"), n("!").alias("exclamations"), n("[A-Z]{3,}").alias("caps"), n("[0-9]").alias("digits"), text.word_count(c).alias("words"))


@query(r"SELECT w AS mail, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+')) AS w FROM documents) GROUP BY 1")
def token_explode(t: Tables):
    found = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z0-9.]+@[a-z0-9.]+"), F.lit(0))).alias("mail"))
    return found.groupBy("mail").agg(F.count("*").alias("n"))


TERMS = r"""WITH w AS (SELECT lang = 'en' AS focus, unnest(regexp_extract_all(lower(text), '[a-z][a-z''&-]{2,}')) AS term FROM documents WHERE lang IN ('en', 'de')),
c AS (SELECT term, count(*) FILTER (focus) AS a, count(*) FILTER (NOT focus) AS b FROM w GROUP BY 1 HAVING count(*) >= 4), n AS (SELECT sum(a) AS na, sum(b) AS nb, sum(a + b) AS nt FROM c),
z AS (SELECT term, a, b, ln((a + p) / (na + p0 - a - p)) - ln((b + p) / (nb + p0 - b - p)) AS delta, 1 / (a + p) + 1 / (b + p) AS v FROM (SELECT c.*, n.*, 0.01 * (a + b) AS p, 0.01 * nt AS p0 FROM c, n))
SELECT term, a, b, round(delta / sqrt(v), 5) AS z FROM z ORDER BY round(delta / sqrt(v), 5) DESC, term LIMIT 30"""


@query(TERMS)
def log_odds_terms(t: Tables):
    """Terms that set one group apart: log-odds with an informative prior."""
    d = t.documents.filter(F.col("lang").isin("en", "de"))
    return cleaning.log_odds(d, "text", F.col("lang") == "en", 30)


@query(r"""WITH d AS (SELECT doc_id, quality AS q, unnest(list_distinct(regexp_extract_all(text, '\p{L}+'))) AS w FROM documents JOIN labels USING (doc_id)),
s AS (SELECT DISTINCT doc_id, q, unnest(flatten(list_transform(range(2, 9), lambda n: list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n))))) AS chunk FROM d)
SELECT chunk, count(*) AS df, count(*) FILTER (q = 1) AS in_class FROM s GROUP BY 1 HAVING count(*) >= 3""")
def substring_df_whole(t: Tables):
    """Document frequency of all alphabetic substrings of 2 to 8 characters of whole texts."""
    s = t.documents.select("doc_id", "text").join(t.labels, "doc_id").select("quality", F.explode(text.letter_substrings(F.col("text"), 2, 8)).alias("chunk"))
    return s.groupBy("chunk").agg(F.count("*").alias("df"), F.count_if(F.col("quality") == 1).alias("in_class")).filter("df >= 3")


@query(r"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE NULL END AS datetime,
o_orderdate::DATE AS date, CASE o_orderkey % 3 WHEN 0 THEN 'iso' WHEN 1 THEN 'epoch' ELSE 'dmy' END AS format FROM orders""")
def timestamp_router(t: Tables):
    """Three written forms of a time, told apart by shape and parsed; a bare date has no time."""
    d = F.col("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("o_orderkey") % 3 == 1, F.unix_timestamp(d).cast("string")).otherwise(F.date_format(d, "dd-MM-yyyy"))
    r = cleaning.route_timestamp(F.col("raw"))
    return t.orders.select("o_orderkey", raw.alias("raw")).select("o_orderkey", F.date_format(r["at"], "yyyy-MM-dd HH:mm:ss").alias("datetime"), r["date"].alias("date"), r["format"].alias("format"))


@query(r"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN ((event_id % 9) * 24)::DOUBLE WHEN event_id % 4 = 1 THEN greatest(event_id % 50, 2)::DOUBLE ELSE NULL END AS hours FROM events""")
def duration_extract(t: Tables):
    k = F.col("event_id")
    said = F.when(k % 4 == 0, F.concat(F.lit("took "), (k % 9).cast("string"), F.lit(" Days"))).when(k % 4 == 1, F.concat(F.lit("2 hrs, then "), (k % 50).cast("string"), F.lit("hours or 99999 weeks"))).otherwise("no time said")
    return t.events.select("event_id", text.longest_hours(said).alias("hours"))


@query(r"""SELECT c_custkey, substr(sha256('crm|' || c_custkey::VARCHAR || '|' || substr(c_name, 1, 200)), 1, 20) AS id, (('0x' || substr(sha256('crm|' || c_custkey::VARCHAR || '|' || substr(c_name, 1, 200)), 1, 8))::BIGINT % 2)::BIGINT AS half FROM customer""")
def stable_ids(t: Tables):
    i = text.stable_id(F.lit("crm"), F.col("c_custkey"), F.substring("c_name", 1, 200))
    return t.customer.select("c_custkey", i.alias("id"), text.half(i).alias("half"))


#: Raw posts, and each as comparable text with negation marked.
RAW_POSTS = [
    ('"RT @bob: Sooooo bad!!! #NotGood https://a.b/c 12,5 :)"', "usertoken : soo bad!! # not good_neg urltoken_neg numtoken_neg emotesmile_neg"),
    ("i do not like this one at all. really good", "i do not like_neg this_neg one_neg at_neg all. really good"),
    ("never again, ok </3 <3 ;) :( :p :/", "never again,_neg ok emotebroken emoteheart emotewink emotefrown emotetongue emotemeh"),
    ("\\u0041pple &amp; pie cut off...", "apple & pie cut off trunctoken"),
    ("#GoodFriday_Sale2024Now at 10:30", "# good friday sale2024 now at numtoken emotesmile numtoken"),
    ("no one cannot say without   doubt", "no one_neg cannot say_neg without doubt_neg"),
    ("", ""),
]


def _raw_posts(t: Tables, *columns):
    said = F.element_at(F.array(*[F.lit(x) for x, _ in RAW_POSTS]), (F.col("event_id") % len(RAW_POSTS) + 1).cast("int"))
    return t.events.select("event_id", said.alias("text")).select("event_id", *columns)


@query("SELECT event_id, marked FROM events JOIN (VALUES " + ", ".join(f"({i}, '{y}')" for i, (_, y) in enumerate(RAW_POSTS)) + f") p(i, marked) ON event_id % {len(RAW_POSTS)} = i")
def normalised_posts(t: Tables):
    """Comparable text with negation marked."""
    return posts.prepared(_raw_posts(t, "text"), "text", "marked").select("event_id", "marked")


#: Of each raw post: characters, words, !, ?, doubled marks, capitals, elongations, #, @, glad, sad.
SURFACE = [(55, 8, 3, 0, 1, 0, 1, 1, 1, 1, 1), (42, 10, 0, 0, 0, 0, 0, 0, 0, 0, 0), (34, 9, 0, 0, 0, 0, 0, 0, 0, 3, 3), (31, 5, 0, 0, 0, 0, 0, 0, 0, 0, 0), (32, 3, 0, 0, 0, 0, 0, 1, 0, 0, 0), (33, 6, 0, 0, 0, 0, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)]
SURFACE_NAMES = ("n_chars", "n_words", "n_exclaim", "n_question", "n_punct_run", "n_allcaps", "n_elong", "n_hashtag", "n_mention", "emote_pos", "emote_neg")


@query(f"SELECT event_id, round(ln(1 + n_chars), 9) AS n_chars, round(ln(1 + n_words), 9) AS n_words, {', '.join(f'{c}::DOUBLE AS {c}' for c in SURFACE_NAMES[2:])} FROM events JOIN (VALUES {', '.join(str((i, *x)) for i, x in enumerate(SURFACE))}) p(i, {', '.join(SURFACE_NAMES)}) ON event_id % {len(SURFACE)} = i")
def surface_stats(t: Tables):
    """Eleven surface statistics of raw posts."""
    return _raw_posts(t, *[F.round(c, 9).alias(k) for k, c in posts.surface(F.col("text")).items()])


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=\"'))::INT AS links FROM pages")
def page_fields(t: Tables):
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit('<a href="')).alias("links"))


@query("SELECT event_id, k::INT AS k FROM (SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events) WHERE k IS NOT NULL")
def json_fields(t: Tables):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k")).filter("k IS NOT NULL")


@query("""WITH d AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'store' ELSE 'social' END AS source, 'u' || (user_id % 10) AS author, lower(regexp_replace('Late ' || (event_id % 97) || '!', '[^A-Za-z0-9 ]', '', 'g')) AS body FROM events)
SELECT event_id, source FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN source = 'store' THEN source || '|' || author || '|' || body ELSE source || '|' || body END ORDER BY event_id) AS r FROM d) WHERE r = 1""")
def two_regime_dedupe(t: Tables):
    """Store reviews repeat by author and text, social posts by text alone."""
    k = F.col("event_id")
    d = t.events.select("event_id", F.when(k % 2 == 0, "store").otherwise("social").alias("source"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("author"), F.concat(F.lit("Late "), (k % 97).cast("string"), F.lit("!")).alias("body"))
    return cleaning.dedupe_by_regime(d, "source", "author", "body", "event_id", by_author=("store",)).select("event_id", "source")


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS name FROM benchmark), d AS (SELECT doc_id, lower(text) AS text FROM documents WHERE text IS NOT NULL)
SELECT name, count(*) AS n, min(doc_id) AS first FROM w JOIN d ON contains(text, name) GROUP BY 1""")
def names_in_texts(t: Tables):
    """In how many documents each word of the benchmark stands, also within longer words."""
    names = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("name"))
    docs = t.documents.select("doc_id", F.lower("text").alias("says"))
    return contained(docs, "doc_id", "says", names, "name").groupBy("name").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
