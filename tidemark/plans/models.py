"""Questions on models: confusion counts, calibration, thresholds, folds, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon, posts, rules, text
from ..operators import features, keys, linear, metrics, ranks, rowfits, terms
from ..operators.calibrated import CalibratedLinear
from .registry import Tables, query

SCORED = "(SELECT doc_id, quality::INT AS y, (n_chars % 101) / 100 AS s, (n_chars > 700)::INT AS p FROM documents JOIN labels USING (doc_id))"


def _scored(t: Tables):
    d = t.documents.select("doc_id", "n_chars", "text").join(t.labels, "doc_id")
    return d.select("doc_id", "text", F.col("quality").cast("int").alias("y"), (F.col("n_chars") % 101 / 100).alias("s"), (F.col("n_chars") > 700).cast("int").alias("p"))


@query(f"""WITH c AS (SELECT y, p, count(*) AS k FROM {SCORED} GROUP BY 1, 2), g AS (SELECT sum(k)::DOUBLE AS n, sum(k) FILTER (y = p)::DOUBLE AS hit FROM c),
m AS (SELECT v, coalesce((SELECT sum(k) FROM c WHERE y = v), 0)::DOUBLE AS a, coalesce((SELECT sum(k) FROM c WHERE p = v), 0)::DOUBLE AS b, coalesce((SELECT sum(k) FROM c WHERE y = v AND p = v), 0)::DOUBLE AS h FROM (SELECT unnest([0, 1]) AS v)),
f AS (SELECT avg(2 * h / (a + b)) AS macro, sum(2 * h / (a + b) * a) / sum(a) AS weighted, sum(a * b) AS ab, sum(a * a) AS aa, sum(b * b) AS bb FROM m)
SELECT n::BIGINT AS n, round(hit / n, 6) AS accuracy, round(macro, 6) AS macro_f1, round(weighted, 6) AS weighted_f1, round((hit / n - ab / n / n) / (1 - ab / n / n), 6) AS kappa, round((hit * n - ab) / sqrt((n * n - bb) * (n * n - aa)), 6) AS mcc FROM g, f""")
def confusion_metrics(t: Tables):
    m = metrics.summary(metrics.confusion(_scored(t), "y", "p"))
    return m.select("n", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@query(f"SELECT y AS actual, p AS predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y), 6) AS share FROM {SCORED} GROUP BY 1, 2 QUALIFY y <> p")
def confused_pairs(t: Tables):
    return metrics.pairs_confused(metrics.confusion(_scored(t), "y", "p")).withColumn("share", F.round("share", 6)).select("actual", "predicted", "n", "share")


@query(f"""WITH r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM {SCORED})
SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc FROM r""")
def auc(t: Tables):
    a = metrics.auc(_scored(t), F.col("y") == 1, "s")
    return a.select(F.round("auc", 6).alias("auc"))


@query(f"SELECT least(floor(s * 10), 9)::INT AS bin, count(*) AS n, round(avg(s), 6) AS confidence, round(avg((y = p)::INT), 6) AS accuracy, round(abs(avg(s) - avg((y = p)::INT)), 6) AS gap FROM {SCORED} GROUP BY 1")
def calibration_bins(t: Tables):
    c = metrics.calibration(_scored(t), "s", F.col("y") == F.col("p"))
    return c.select("bin", "n", *[F.round(x, 6).alias(x) for x in ("confidence", "accuracy", "gap")])


@query(f"SELECT tau::INT AS tau, count(*) AS n, sum(((round(s * 100) >= tau)::INT = y)::INT)::BIGINT AS hits FROM {SCORED}, (SELECT unnest(range(20, 96)) AS tau) GROUP BY 1")
def tau_grid(t: Tables):
    return metrics.threshold_grid(_scored(t), "y", "s", 20, 95)


@query("""WITH u AS (SELECT text, min(source) AS l FROM documents GROUP BY 1), f AS (SELECT text, ((row_number() OVER (PARTITION BY l ORDER BY md5('42' || text), text) - 1) % 5)::INT AS fold FROM u)
SELECT doc_id, fold FROM documents JOIN f USING (text)""")
def grouped_folds(t: Tables):
    return ranks.folds(t.documents.select("doc_id", "text", "source"), "text", "source", 5).select("doc_id", "fold")


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS c FROM w GROUP BY 1, 2), df AS (SELECT term, count(*) AS d FROM tf GROUP BY 1 HAVING count(*) >= 2),
n AS (SELECT count(*) AS n FROM documents), x AS (SELECT doc_id, tf.term, (1 + ln(c)) * (ln((1 + n) / (1 + d)) + 1) AS v FROM tf JOIN df ON tf.term = df.term, n), s AS (SELECT doc_id, sqrt(sum(v * v)) AS z FROM x GROUP BY 1)
SELECT doc_id, term, round(v / z, 6) AS weight FROM (SELECT x.doc_id, term, v, z, row_number() OVER (PARTITION BY x.doc_id ORDER BY round(v / z, 9) DESC, term) AS r FROM x JOIN s ON x.doc_id = s.doc_id) WHERE r <= 3""")
def tfidf_topk(t: Tables):
    w = features.tfidf(t.documents, "doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0)), least=2)
    return ranks.top_k(w.withColumn("w9", F.round("weight", 9)), ["doc_id"], [F.desc("w9"), F.col("term")], 3).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query()
def linear_model_eval(t: Tables):
    """Grouped cross-validation of a linear model on hashed words against a shuffled-label floor."""
    d = t.documents.select("doc_id", "text").join(t.labels, "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("label"))
    return features.grouped_cv(ranks.folds(d, "text", "label", 3), "text", "label")


@query(f"SELECT size, count(*) AS n, round(avg((y = p)::INT), 6) AS accuracy FROM (SELECT *, ('0x' || substr(md5('lc' || doc_id::VARCHAR), 1, 4))::INT / 65536 AS u FROM {SCORED}), (SELECT unnest([0.15, 0.3, 0.5, 0.7, 0.85, 1.0])::DOUBLE AS size) WHERE u < size GROUP BY 1")
def learning_curve_sizes(t: Tables):
    """Nested subsets by hash threshold, scored in one pass over rows times six sizes."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit("lc"), F.col("doc_id").cast("string"))), 1, 4), 16, 10).cast("int") / 65536
    sizes = F.array(*[F.lit(x) for x in (0.15, 0.3, 0.5, 0.7, 0.85, 1.0)])
    each = _scored(t).withColumn("u", u).select("y", "p", F.explode(F.filter(sizes, lambda s: F.col("u") < s)).alias("size"))
    return each.groupBy("size").agg(F.count("*").alias("n"), F.round(F.avg((F.col("y") == F.col("p")).cast("double")), 6).alias("accuracy"))


@query(f"SELECT doc_id, CASE WHEN s >= 0.66 THEN 'neutral' WHEN doc_id % 10 >= 10 - doc_id % 10 THEN 'negative' ELSE 'positive' END AS label FROM {SCORED}")
def threshold_rule(t: Tables):
    """The neutral class from a threshold on, else the likelier of the others, ties negative."""
    share = F.col("doc_id") % 10  # in tenths of what the neutral class leaves
    return _scored(t).select("doc_id", F.when(F.col("s") >= 0.66, "neutral").when(share >= 10 - share, "negative").otherwise("positive").alias("label"))


WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_'#]*[\p{L}\p{N}_]"
#: The labelled documents, lower case without accents; and terms from counts tf (doc_id, term, c), weighted.
_PLAIN = "d AS (SELECT doc_id, strip_accents(lower(text)) AS x FROM documents JOIN labels USING (doc_id))"


def _weighted(least: int) -> str:
    return f"""df AS (SELECT term, count(*) AS d FROM tf GROUP BY 1 HAVING count(*) >= {least}), n AS (SELECT count(*) AS n FROM d), v AS (SELECT doc_id, tf.term, (1 + ln(c)) * (ln((1 + n) / (1 + d)) + 1) AS v FROM tf JOIN df ON tf.term = df.term, n),
w AS (SELECT doc_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS weight FROM v)"""


_TOP = "SELECT doc_id, term, round(weight, 6) AS weight FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) <= 5"
_WORDS = "k AS (SELECT doc_id, regexp_extract_all(x, '" + WORD.replace("'", "''") + "') AS ws FROM d)"


def _plain(t: Tables):
    d = t.documents.select("doc_id", "text").join(t.labels, "doc_id")
    return d.withColumn("plain", posts.strip_accents(F.lower("text")))


def _top(w):
    return ranks.top_k(w.withColumn("w9", F.round("weight", 9)), ["doc_id"], [F.desc("w9"), F.col("term")], 5).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def _words():
    return F.regexp_extract_all("plain", F.lit(WORD), F.lit(0))


@query(f"WITH {_PLAIN}, {_WORDS}, g AS (SELECT doc_id, unnest(ws) AS term FROM k UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM k), tf AS (SELECT doc_id, term, count(*) AS c FROM g GROUP BY 1, 2), {_weighted(2)} {_TOP}")
def tfidf_bigrams(t: Tables):
    """Words and pairs of words without accents, weighted; the five heaviest of each document."""
    d = _plain(t).withColumn("words", _words())
    return _top(features.tfidf(d, "doc_id", features.word_ngrams(F.col("words"), 1, 2), least=2))


@query(f"WITH {_PLAIN}, p AS (SELECT doc_id, ' ' || unnest(list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) || ' ' AS p FROM d), q AS (SELECT doc_id, p, unnest([3, 4, 5]) AS k FROM p), g AS (SELECT doc_id, substr(p, i, k) AS term FROM (SELECT *, unnest(range(1, length(p) - k + 2)) AS i FROM q WHERE length(p) >= k)), tf AS (SELECT doc_id, term, count(*) AS c FROM g GROUP BY 1, 2), {_weighted(3)} {_TOP}")
def char_tfidf(t: Tables):
    """Character 3- to 5-grams within padded words, weighted; the five heaviest of each document."""
    d = terms.labelled(t.documents.select("doc_id", "text"), t.labels.select("doc_id"), "doc_id").withColumn("plain", posts.strip_accents(F.lower("text")))
    d = d.select("doc_id", F.filter(F.split("plain", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"))
    n, each = d.count(), terms.by_key(d, "doc_id", "words")
    known = terms.Vocabulary(each, F.col("words"), (3, 5), 3, rows=n)
    return _top(known.heaviest("doc_id", d.schema["doc_id"].dataType.simpleString(), each, 5))


_STATS = {"n_chars": "ln(1 + length(text))", "n_exclaim": "length(text) - length(replace(text, '!', ''))", "n_hashtag": "length(text) - length(replace(text, '#', ''))"}


@query(f"""WITH {_PLAIN}, {_WORDS}, g AS (SELECT doc_id, unnest(ws) AS term FROM k), tf AS (SELECT doc_id, term, count(*) AS c FROM g GROUP BY 1, 2), {_weighted(2)}, r AS (SELECT doc_id, {", ".join(f"({x})::DOUBLE AS {k}" for k, x in _STATS.items())} FROM documents JOIN labels USING (doc_id)),
s AS ({" UNION ALL ".join(f"SELECT doc_id, 'stats:{k}' AS feature, 0.5 * {k} / nullif((SELECT max({k}) FROM r), 0) AS weight FROM r" for k in _STATS)}), u AS (SELECT doc_id, 'word:' || term AS feature, weight FROM w UNION ALL SELECT * FROM s WHERE weight <> 0)
SELECT doc_id, string_split(feature, ':')[1] AS block, count(*) AS n, round(sum(weight), 6) AS total FROM u GROUP BY 1, 2""")
def feature_union(t: Tables):
    """Words and scaled surface statistics as one table of features, the statistics at half weight."""
    d = _plain(t)
    words = features.tfidf(d, "doc_id", _words(), least=2)
    stats = features.scaled(d, "doc_id", {k: c for k, c in posts.surface(F.col("text")).items() if k in _STATS})
    u = features.union("doc_id", {"word": (words, 1.0), "stats": (stats, 0.5)})
    return u.groupBy("doc_id", F.substring_index("feature", ":", 1).alias("block")).agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("total"))


def _any_sql(column: str, words: list[str]) -> str:
    return " OR ".join(f"contains({column}, '{w}')" for w in words)


def _topic_sql(column: str) -> str:
    whens = " ".join(f"WHEN {_any_sql(column, words)} THEN '{name}'" for name, words in lexicon.TOPIC_TRIGGERS)
    return f"CASE {whens} ELSE '{lexicon.TOPIC_DEFAULT}' END"


@query(f"""WITH s AS (SELECT doc_id, {_topic_sql("lower(text)")} AS rule, [(n_chars % 7)::DOUBLE, (doc_id % 5)::DOUBLE, (n_chars % 11 / 2)::DOUBLE, (doc_id % 3)::DOUBLE] AS z FROM documents), e AS (SELECT doc_id, rule, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM s), p AS (SELECT doc_id, rule, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)
SELECT doc_id, ['Technical_Issues', 'Account_Security', 'Feature_Feedback', 'Community_Discussion'][list_position(p, list_max(p))] AS label, round(list_max(p), 4) AS confidence, rule, ['Technical_Issues', 'Account_Security', 'Feature_Feedback', 'Community_Discussion'][list_position(p, list_max(p))] = rule AS agrees FROM p""")
def batch_scores(t: Tables):
    """A label with its confidence for every document, and whether the topic rule agrees."""
    n, k = F.col("n_chars"), F.col("doc_id")
    s = features.scored(t.documents, {"Technical_Issues": n % 7, "Account_Security": k % 5, "Feature_Feedback": n % 11 / 2, "Community_Discussion": k % 3})
    rule = lexicon.topic(F.col("text"))
    return s.select("doc_id", "label", "confidence", rule.alias("rule"), (F.col("label") == rule).alias("agrees"))


def _misfire_sql() -> str:
    whens = " ".join(f"WHEN {_any_sql('x', words)} THEN NOT regexp_matches(x, '\\b(?:{'|'.join(words)})\\b')" for _, words in lexicon.TOPIC_TRIGGERS)
    return f"CASE {whens} ELSE false END"


@query(f"""WITH d AS (SELECT lower(text) AS x, {_topic_sql("text")} AS truth FROM documents), p AS (SELECT {_topic_sql("x")} AS said, truth, {_misfire_sql()} AS off FROM d)
SELECT count(*) AS n, round(avg((said = truth)::INT), 6) AS fidelity, count(*) FILTER (said <> truth) AS mismatches, round(avg((said <> '{lexicon.TOPIC_DEFAULT}')::INT), 6) AS trigger_rate, round(avg(off::INT), 6) AS artefact_rate, round(count(*) FILTER (off) / count(*) FILTER (said <> '{lexicon.TOPIC_DEFAULT}'), 6) AS artefact_share FROM p""")
def rule_fidelity(t: Tables):
    """How far the topic rule explains labels given by its case-sensitive twin."""
    truth = rules.switch(F.col("text"), lexicon.TOPIC_TRIGGERS, lexicon.TOPIC_DEFAULT)
    return rules.fidelity(t.documents, F.lower("text"), truth, lexicon.TOPIC_TRIGGERS, lexicon.TOPIC_DEFAULT)


@query(r"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, toxic = 1 AS hit, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS words FROM documents JOIN labels USING (doc_id)),
p AS MATERIALIZED (SELECT doc_id, hit, unnest(words) AS trigger FROM d), s AS MATERIALIZED (SELECT trigger, count(*) AS df, count(*) FILTER (hit) AS ins, list(doc_id) FILTER (hit) AS docs FROM p GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (hit) >= 0.95 * count(*)),
r AS (SELECT 0 AS place, ''::VARCHAR AS trigger, 0::BIGINT AS gain, []::BIGINT[] AS covered UNION ALL
SELECT place + 1, b.trigger, b.gain, list_concat(covered, b.fresh) FROM r, LATERAL (SELECT s.trigger, len(list_filter(docs, lambda x: NOT list_contains(r.covered, x))) AS gain, list_filter(docs, lambda x: NOT list_contains(r.covered, x)) AS fresh FROM s ORDER BY 2 DESC, ins / df DESC, df DESC, s.trigger LIMIT 1) b WHERE b.gain > 0 AND place < 12)
SELECT place, trigger FROM r WHERE place > 0""")
def mined_rule(t: Tables):
    """The shortest cover of the toxic documents by words that hardly any other document has."""
    rows = t.documents.join(t.labels, "doc_id").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)).alias("words"), F.col("toxic").cast("int").alias("toxic"))
    found = rules.mine_triggers(rows.withColumn("toxic", F.col("toxic").cast("string")), "words", "toxic", "1")
    return t.spark.createDataFrame(list(enumerate(found, 1)), "place int, trigger string")  # at most a dozen


def _modelled(t: Tables):
    """doc_id, label, fold, features of the labelled documents: texts stay where they are,
    and equal ones share a fold by their digests."""
    d = terms.labelled(t.documents.select("doc_id", "text"), t.labels.select("doc_id", F.col("quality").cast("int").alias("label")), "doc_id")
    d = d.withColumn("plain", posts.strip_accents(F.lower("text")))
    known = terms.Vocabulary(d, _words(), None, 2)
    kept = {"doc_id": d.schema["doc_id"].dataType.simpleString(), "label": "int", "text": "string"}
    rows = known.hashed(kept, d.select("doc_id", "label", F.sha2("text", 256).alias("text"), _words().alias("words")), 1 << 10)
    return ranks.folds(rows.checkpoint(), "text", "label", 2).drop("text")


@query()
def model_candidates(t: Tables):
    """Eight candidates under the same two folds of texts."""
    return features.cross_validated(_modelled(t).select("label", "fold", "features"), "label", "fold", features.classifiers("label"))


#: The four classes of a labelled document, by toxic and quality.
CLASSES = ["clean low", "clean high", "toxic low", "toxic high"]
#: Strengths of regularisation and ranges of character n-grams that are tried.
REGS, RANGES = [0.1, 0.03, 0.01, 3e-3, 1e-3, 3e-4, 1e-4, 3e-5, 1e-5], [(2, 2), (2, 3), (2, 4), (2, 5), (3, 4), (3, 5)]


def _classed(t: Tables):
    """Labelled documents with their class, folds of texts, and the text without accents."""
    d = t.documents.select("doc_id", "text").filter("text IS NOT NULL").join(t.labels, "doc_id").select("doc_id", "text", (2 * F.col("toxic") + F.col("quality")).cast("int").alias("class"))
    return ranks.folds(d, "text", "class", 3).withColumn("plain", posts.strip_accents(F.lower("text")))


def _told(t: Tables):
    """Labelled documents as rows to fit: class, fold, w, and the text with and without accents."""
    d = _classed(t).drop("plain").withColumn("w", F.lit(1.0)).checkpoint()
    return d.withColumn("plain", posts.strip_accents(F.lower("text")))


def _macro(counts):
    """name, n, accuracy, macro_f1 of confusion counts."""
    per = metrics.by_name(counts.withColumnsRenamed({"class": "actual", "said": "predicted"}), "name")
    return per.select("name", "n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


ROW = ["class", "fold", "w"]


@query()
def linear_candidates(t: Tables):
    """Losses over words and their union with surface statistics, four classes, the same folds
    of texts; the rows are read once for all losses of a set of features."""
    d = _told(t)
    known = terms.Vocabulary(d, _words(), None, 2)
    more = posts.surface(F.col("text"))
    top = d.agg(*[F.max(F.abs(c.cast("double"))).alias(f"__{k}") for k, c in more.items()])  # a row
    scaled = F.array(*[F.coalesce(0.5 * F.try_divide(c.cast("double"), F.col(f"__{k}")), F.lit(0.0)) for k, c in more.items()])
    size, words = len(known), known.rows_of([*ROW, "more"])
    d = d.crossJoin(F.broadcast(top)).select(*ROW, scaled.alias("more"), _words().alias("words"))
    rows = rowfits.Rows(d, [0, size, size + len(more)], lambda b: rowfits.beside(words(b), size))
    tried = lambda name: {f"{name}, {loss}": (loss, 1e-3) for loss in linear.LOSSES}
    out = rowfits.cross_validated(rows, [(0, 1, tried("words")), (0, 2, tried("words and statistics"))], len(CLASSES), 3, linear.FLAT)
    rows.drop()
    return _macro(out)


@query()
def parameter_grid(t: Tables):
    """A sweep of the regularisation over words, and one of the range of character n-grams.
    A term's weight is the same in all ranges but for the length of the row: rows are made
    once, over features in order of their length, and a range is some of these lengths."""
    d = _told(t)
    known = terms.Vocabulary(d, _words(), None, 2)
    rows = rowfits.Rows(d.select(*ROW, _words().alias("words")), [0, len(known)], known.rows_of(ROW))
    out = [rowfits.cross_validated(rows, [(0, 1, {f"reg {r:g}": ("squared_hinge", r) for r in REGS})], len(CLASSES), 3, linear.FLAT)]
    rows.drop()
    words = F.filter(F.split("plain", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    least, most = min(lo for lo, _ in RANGES), max(hi for _, hi in RANGES)
    known = terms.Vocabulary(d, words, (least, most), 3, by_length=True)
    cuts = [0, *(int((known.sizes <= k).sum()) for k in range(least, most + 1))]
    rows = rowfits.Rows(d.select(*ROW, words.alias("words")), cuts, known.rows_of(ROW, plain=True))
    sets = [(lo - least, hi - least + 1, {f"characters {lo}-{hi}": ("squared_hinge", 1e-3)}) for lo, hi in RANGES]
    out.append(rowfits.cross_validated(rows, sets, len(CLASSES), 3, linear.FLAT, scale=known.idf))
    rows.drop()
    return _macro(keys.union_all(*out))


@query()
def predicted_labels(t: Tables):
    """A calibrated model of the four classes, fitted on the labelled documents and applied to
    all: label, confidence and whether the topic rule finds a topic. Weights of words are over
    all documents, the vocabulary is that of the labelled ones."""
    d = _classed(t).checkpoint()
    every = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("plain", posts.strip_accents(F.lower("text")))
    words = features.tfidf(every, "doc_id", _words(), least=2).withColumnRenamed("term", "feature")
    known, _ = linear.vocabulary(words.join(d.select("doc_id"), "doc_id", "left_semi"))
    label = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("class") + 1)
    train = linear.sparse(d.select("doc_id", "text", label.alias("truth")), "doc_id", words, known).checkpoint()
    model = CalibratedLinear(labelCol="truth", folds=2, reg=1e-3, steps=12).fit(train)
    out = model.transform(linear.sparse(every.select("doc_id", lexicon.topic(F.col("text")).alias("rule")), "doc_id", words, known))
    return out.select("doc_id", "label", "confidence", F.array_max("p").alias("p"), "rule")


@query()
def leakage_audit(t: Tables):
    """What a split by rows, where copies stand on both sides, adds to the score, and what
    moved labels leave of it."""
    return features.leakage(_modelled(t), "doc_id", "text", "label", features.classifiers("label")["logistic"])


@query("""WITH u AS (SELECT text, min(source) AS l FROM documents GROUP BY 1), k AS (SELECT text, row_number() OVER (PARTITION BY l ORDER BY md5('42' || text), text) <= 0.2 * count(*) OVER (PARTITION BY l) AS held FROM u)
SELECT doc_id, held, 0 AS leaks FROM documents JOIN k USING (text)""")
def stratified_holdout(t: Tables):
    """A fifth of the distinct texts of each source, held out; and how many texts leak."""
    d = ranks.holdout(t.documents.select("doc_id", "text", "source"), "text", "source", 0.2)
    lost = ranks.leaks(d, "text", "held").agg(F.count("*").cast("int").alias("leaks"))
    return d.crossJoin(F.broadcast(lost)).select("doc_id", "held", "leaks")


@query(f"""WITH x AS (SELECT *, doc_id % 2 AS half FROM {SCORED}), g AS (SELECT tau, sum(((round(s * 100) >= tau)::INT = y)::INT) AS hits FROM x, (SELECT unnest(range(20, 96)) AS tau) WHERE half = 0 GROUP BY 1), b AS (SELECT arg_min(tau, (-hits, tau))::INT AS tau FROM g)
SELECT tau, a::DOUBLE AS margin, count(*) AS n, count(*) FILTER (abs(s - tau / 100) >= a) AS decided, round(avg(((s >= tau / 100)::INT = y)::INT) FILTER (abs(s - tau / 100) >= a), 6) AS accuracy FROM x, b, (SELECT unnest([0.0, 0.105, 0.205]) AS a) WHERE half = 1 GROUP BY 1, 2""")
def tau_transfer(t: Tables):
    """The threshold chosen on one half, judged on the other, with abstention near it."""
    x = _scored(t).withColumn("half", F.col("doc_id") % 2)
    tau = metrics.best_threshold(x.filter("half = 0"), "y", "s", 20, 95)
    margins = F.explode(F.array(*[F.lit(a) for a in (0.0, 0.105, 0.205)])).alias("margin")
    rest = x.filter("half = 1").crossJoin(F.broadcast(tau)).select("y", "s", "tau", margins)
    on = F.abs(F.col("s") - F.col("tau") / 100) >= F.col("margin")
    right = ((F.col("s") >= F.col("tau") / 100).cast("int") == F.col("y")).cast("int")
    return rest.groupBy("tau", "margin").agg(F.count("*").alias("n"), F.count_if(on).alias("decided"), F.round(F.avg(F.when(on, right)), 6).alias("accuracy"))


@query(f"""WITH x AS (SELECT *, ('0x' || substr(md5('lc' || doc_id::VARCHAR), 1, 4))::INT / 65536 AS u FROM {SCORED}), z AS (SELECT unnest([0.15, 0.3, 0.5, 0.7, 0.85, 1.0])::DOUBLE AS size),
g AS (SELECT size, tau, sum(((round(s * 100) >= tau)::INT = y)::INT) AS hits FROM x, z, (SELECT unnest(range(5, 96)) AS tau) WHERE doc_id % 4 > 0 AND u < size GROUP BY 1, 2), b AS (SELECT size, arg_min(tau, (-hits, tau))::INT AS tau FROM g GROUP BY 1)
SELECT size, tau, count(*) AS n, round(avg(((round(s * 100) >= tau)::INT = y)::INT), 6) AS accuracy FROM x, b WHERE doc_id % 4 = 0 GROUP BY 1, 2""")
def learning_curve(t: Tables):
    """A threshold fitted on nested samples of growing size, each judged on the same held-out quarter."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit("lc"), F.col("doc_id").cast("string"))), 1, 4), 16, 10).cast("int") / 65536
    sizes = F.array(*[F.lit(x) for x in (0.15, 0.3, 0.5, 0.7, 0.85, 1.0)])
    x = _scored(t)
    train = x.filter("doc_id % 4 > 0").withColumn("u", u).select("y", "s", F.explode(F.filter(sizes, lambda z: F.col("u") < z)).alias("size"))
    fitted = metrics.best_threshold(train, "y", "s", 5, 95, ["size"])
    said = (F.round(F.col("s") * 100) >= F.col("tau")).cast("int")
    return x.filter("doc_id % 4 = 0").crossJoin(F.broadcast(fitted)).groupBy("size", "tau").agg(F.count("*").alias("n"), F.round(F.avg((said == F.col("y")).cast("int")), 6).alias("accuracy"))


CUES = {"question": r"\?", "loud": "!", "digit": "[0-9]", "mention": "@", "shout": "[A-Z]{3,}"}


@query("WITH x AS (SELECT quality <> (n_chars > 700)::INT AS wrong, text, abs(n_chars - 700) / 10000.0 AS confidence FROM documents JOIN labels USING (doc_id)) " + " UNION ALL ".join(f"SELECT '{k}' AS cue, count(*) AS n, round(avg(wrong::INT), 6) AS error_rate, round(avg(confidence) FILTER (NOT wrong), 6) AS sure_right, round(avg(confidence) FILTER (wrong), 6) AS sure_wrong FROM x WHERE regexp_matches(text, '{p}') HAVING count(*) >= 20" for k, p in CUES.items()))
def error_cues(t: Tables):
    """Errors where a cue is in the text, and how sure the right and the wrong ones were."""
    j = t.documents.join(t.labels, "doc_id")
    x = j.select((F.col("quality") != (F.col("n_chars") > 700).cast("int")).alias("wrong"), (F.abs(F.col("n_chars") - 700) / 10000).alias("confidence"), F.explode(F.filter(F.array(*[F.when(F.rlike("text", F.lit(p)), F.lit(k)) for k, p in CUES.items()]), lambda c: c.isNotNull())).alias("cue"))
    r = x.groupBy("cue").agg(F.count("*").alias("n"), F.round(F.avg(F.col("wrong").cast("int")), 6).alias("error_rate"), F.round(F.avg(F.when(~F.col("wrong"), F.col("confidence"))), 6).alias("sure_right"), F.round(F.avg(F.when(F.col("wrong"), F.col("confidence"))), 6).alias("sure_wrong"))
    return r.filter("n >= 20")
