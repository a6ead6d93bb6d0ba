"""Quality rules on DataFrame functions alone: base statistics of every text, and the
frequency of its lines across the documents of its host.

Lines are normalised (white space squeezed, lower case), hashed, and counted by the
distinct documents of the host that hold them. A line is frequent in more than
LINE_DOCUMENTS documents that are more than LINE_SHARE of the host's, and in more than
LINE_MOST documents whatever their share: the share's limit grows with the host, the other
holds at every size. A frequent line is removed from all of the host's documents but the
first that holds it and passes the base rules. A document that loses more than MOST_LOST of
its words is depleted and rejected, as is one that fails the base rules. (Where the first
holder of a line is itself depleted by other lines, the line goes with it.)

Texts are read once: their statistics and the hashes of their lines are written to the
shared folder, and everything that follows reads those.

Defined results: a null text has no words and fails the base rules; a null host is a
host of its own; a document is an id and a text, so rows that repeat both count once, are
judged alike and all returned; ids may be null: a frequent line that no passing document
with an id holds stays where the id is null; a very long text is one row (its words and
lines are arrays of one task, about 30 times its bytes at the most); columns of the input
that have the name of a result (n_words, word_chars, n_symbols, n_dup_lines,
n_repeat_words, base_failed, lost_words, kept) are replaced, others are kept; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, whole_text

LINE_SHARE, LINE_DOCUMENTS, LINE_MOST, MOST_LOST = 0.10, 20, 1000, 0.5
MIN_WORDS, MOST_REPEATED = 50, 0.5
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
#: White space of the word rule: the space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The runs of other than white space, in order."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def let(value: Column, body) -> Column:
    """body(value), where value is computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words stand in 3-word windows that are found twice or more."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda p: F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    hashes = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(words) >= 4, found).otherwise(0)


def has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(SPACE))) > 0


def base_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = whole_text(text_col)
    taken = ("__words", "__lines")
    lines = F.filter(F.split(text, "\n"), has_word)
    out = docs.withColumns({"__words": words_of(text), "__lines": lines}).withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("__words")).cast("long"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop(*taken)


def hashed_lines(text: Column) -> Column:
    """at (position among the lines, split at \\n), h, g (hashes) and n (words) of every line with words."""
    squeezed = lambda x: F.lower(F.btrim(F.regexp_replace(x, SPACES, " "), F.lit(" ")))
    hashed = lambda line, at: let(squeezed(line), lambda x: F.struct(at.alias("at"), F.xxhash64(x).alias("h"), F.hash(x).alias("g"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n"), (x == "").alias("none")))
    return F.transform(F.filter(F.transform(F.split(text, "\n"), hashed), lambda x: ~x["none"]), lambda x: x.dropFields("none"))


def frequent_lines(rows: DataFrame, share: float = LINE_SHARE, documents: int = LINE_DOCUMENTS, most: int = LINE_MOST) -> DataFrame:
    """Of rows (row, id, t, host, passed, lines) the lines that are removed: row, at (their
    positions), words (in them), for the rows that lose any.

    Counts are pre-aggregated before each shuffle. Frequent lines are at most 1 / share of a
    document's lines for each host, and one for each `most` of the host's lines."""
    each = rows.select("row", "id", "t", "host", "passed", F.explode("lines").alias("x")).select("row", "id", "t", "host", "passed", "x.at", "x.h", "x.g", "x.n")
    hosts = rows.select("host", "id", "t").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    held = each.select("host", "h", "g", "id", "t", "passed").distinct().groupBy("host", "h", "g").agg(F.count("*").alias("docs"), F.min(F.when(F.col("passed"), F.col("id"))).alias("first"))
    held = held.filter(F.col("docs") > min(documents, most)).join(hosts, "host")
    frequent = held.filter(((F.col("docs") > documents) & (F.col("docs") > share * F.col("host_docs"))) | (F.col("docs") > most)).select("host", "h", "g", "first")
    frequent = stored(frequent, "frequent")  # else its partitions are kept for the join, and a hot line can't be split
    lost = each.join(frequent, ["host", "h", "g"]).filter(~F.col("id").eqNullSafe(F.col("first")))
    return lost.groupBy("row").agg(F.collect_list("at").alias("at"), F.sum("n").alias("words"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", most_lost: float = MOST_LOST, strip: bool = False, **limits) -> DataFrame:
    """docs with the base statistics, lost_words, and kept. With strip, the text has its
    frequent lines removed; otherwise the text column is dropped."""
    text = whole_text(text_col)
    host = F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit("null"))
    rows = base_stats(docs, text_col).withColumns({"__row": F.monotonically_increasing_id(), "__t": F.xxhash64(text), "__host": host, "__lines": hashed_lines(text)})
    rows = rows.select(id_col, *STATISTICS, "__row", "__t", "__host", "__lines") if strip else rows.drop(text_col)
    rows = stored(rows, "judged")  # a row's number is fixed as it is written
    lost = frequent_lines(rows.select(F.col("__row").alias("row"), F.col(id_col).alias("id"), F.col("__t").alias("t"), F.col("__host").alias("host"), (~F.col("base_failed")).alias("passed"), F.col("__lines").alias("lines")), **limits)
    out = rows.drop("__host", "__lines").join(lost.select(F.col("row").alias("__row"), F.col("at").alias("__at"), F.col("words").alias("__lost")), "__row", "left")
    out = out.withColumn("lost_words", F.coalesce("__lost", F.lit(0)).cast("long"))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= most_lost * F.col("n_words")))
    if strip:  # the texts come in here, so that they are written nowhere but on the way to this join
        results = [*STATISTICS, "lost_words", "kept"]
        judged = out.select(F.col(id_col).alias("__id"), F.col("__t").alias("__h"), *results, "__at").dropDuplicates(["__id", "__h"])
        rest = docs.drop(*results).withColumn("__t", F.xxhash64(text))
        out = rest.join(judged, rest[id_col].eqNullSafe(judged["__id"]) & (rest["__t"] == judged["__h"])).drop("__id", "__h")
        less = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains("__at", i)), "\n")
        out = out.withColumn(text_col, F.when(F.col("__at").isNull(), F.col(text_col)).otherwise(less))
    return out.drop("__row", "__t", "__at", "__lost")
