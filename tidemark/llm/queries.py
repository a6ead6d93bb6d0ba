"""The queries opN_<name>: each operator over its whole intended table, and the SQL
that DuckDB can run for the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, decontaminate, fill_in_middle, importance, line_dedup, ngram_join, pipeline as corpus, quality_rules, sharding, token_counts, token_files, topk_search, url_filter
from .common import table

#: The rules of the URL query: fixed values.
URL_RULES = [url_filter.Rule("org/", "allow"), url_filter.Rule("example.org/es/", "block"), url_filter.Rule("example.org/en/1", "block"), url_filter.Rule("com/fr/", "allow"), url_filter.Rule("com/de/", "block")]
TOKEN_LIMIT = 4096


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = url_filter.train(url_filter.labelled_by_rules(pages, URL_RULES))
    return url_filter.url_filter(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "score")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3 that SQL can express: host, path and longest rule."""
    return url_filter.url_rules(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", F.col("listed").alias("rule_verdict"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), pattern())


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.encode_to_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)
    return token_files.read_checksums(spark, path)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    out = chat_format.chat_format(rows)
    read = out.select("conv_id", "valid", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss"), "formatted")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index, blocks = topk_search.build_index(vectors, "vec_id", "embedding", scale=64)
    return topk_search.search(index, blocks, vectors.filter(F.col("vec_id") % 20 == 0), "vec_id", "embedding", scale=64, k=20)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=7, rate=100, spm=50)
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), seed=2024)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_line_dedup, op3_url_filter, op4_byte_bpe, op5_token_files, op6_ngram_join, op7_decontaminate, op8_chat_format, op9_quality_rules, op10_sharding, op11_topk_search, op12_fill_in_middle, op13_importance, pipeline, url_rules)
}

_SPACES = r"[\x20\x09-\x0D]+"

#: The base statistics and the line rule again, by other means (windows over exploded words).
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
n AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars FROM w),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS tri
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, tri) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
b AS (SELECT n.doc_id, n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed FROM n LEFT JOIN c ON n.doc_id = c.doc_id),
l AS (SELECT doc_id, host, line, trim(lower(regexp_replace(line, '{_SPACES}', ' ', 'g'))) AS norm
      FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY 1),
h AS (SELECT host, count(*) AS host_docs FROM d GROUP BY 1),
f AS (SELECT host, norm, count(DISTINCT l.doc_id) AS docs, min(CASE WHEN NOT base_failed THEN l.doc_id END) AS first FROM l JOIN b ON l.doc_id = b.doc_id GROUP BY 1, 2),
hot AS (SELECT f.host, norm, first FROM f JOIN h ON f.host = h.host
        WHERE docs > {quality_rules.LINE_DOCUMENTS} AND docs > {quality_rules.LINE_SHARE} * host_docs OR docs > {quality_rules.LINE_MOST}),
lost AS (SELECT doc_id, sum(len(string_split(l.norm, ' '))) AS lost_words FROM l JOIN hot ON l.host = hot.host AND l.norm = hot.norm WHERE doc_id IS DISTINCT FROM first GROUP BY 1),
s AS (SELECT d.doc_id, n_words, word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, base_failed, coalesce(lost_words, 0) AS lost_words
      FROM d JOIN n ON d.doc_id = n.doc_id JOIN b ON d.doc_id = b.doc_id LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN u ON d.doc_id = u.doc_id LEFT JOIN lost ON d.doc_id = lost.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       base_failed, NOT base_failed AND lost_words <= {quality_rules.MOST_LOST} * n_words AS kept, lost_words::BIGINT AS lost_words
FROM s
"""

#: A window joined by its 13 words; shorter items by all of theirs.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""

#: Lengths of the template's openings and end; an escaped text grows by a character for
#: each backslash and control string.
OP8_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM (SELECT unnest([0, 1]) AS i)),
t AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\|\[SYS\]|\[INST\]|\[/INST\]|\[ROLE\]|\[/ROLE\]|</s>|<s>')) + 4
        + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 7 WHEN 'assistant' THEN 8 ELSE 14 + length(role) END AS chars,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prior,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars,
       bool_and(CASE role WHEN 'system' THEN k = 1 WHEN 'user' THEN k = 1 OR prior IN ('system', 'assistant') WHEN 'assistant' THEN k > 1 AND prior = 'user' ELSE false END AND (back > 1 OR role = 'assistant')) AS valid
FROM t GROUP BY conv_id
"""

URL_RULES_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, said) AS (VALUES {", ".join(f"('{r.text}', '{r.verdict}')" for r in URL_RULES)}),
f AS (SELECT page_id, rule, said, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, rule DESC) AS k
      FROM p JOIN r ON ('.' || host LIKE '%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, strpos(rule, '/'))))
SELECT p.page_id, host, path, rule, said AS rule_verdict FROM p LEFT JOIN f ON p.page_id = f.page_id AND k = 1
"""

#: Every query with every other vector.
OP11_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

#: DuckDB has no crc32: its table by the rule, then a byte at a time, for each distinct word.
OP13_SQL = r"""
WITH step AS (SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS crcs),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
w AS (SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
n AS (SELECT side, id, word, count(*) AS n FROM w GROUP BY ALL),
distinct_words AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM n)),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UBIGINT)),
                                        lambda c, y: xor(crcs[(xor(c, y) % 256)::BIGINT + 1], c >> 8)), 4294967295::UBIGINT) % 10000 AS bucket FROM distinct_words, step),
f AS (SELECT side, id, n, bucket FROM n JOIN hashed USING (word)),
c AS (SELECT bucket, sum(CASE WHEN side = 'd' THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 'b' THEN n ELSE 0 END) AS t FROM f GROUP BY 1),
a AS (SELECT sum(s)::DOUBLE AS alls, sum(t)::DOUBLE AS allt FROM c),
g AS (SELECT bucket, floor(1000 * ln(((t::DOUBLE + 1) * (alls + 10000)) / ((s::DOUBLE + 1) * (allt + 10000))))::BIGINT AS gain FROM c, a),
m AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM f JOIN g USING (bucket) WHERE side = 'd' GROUP BY 1),
r AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::UBIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM documents LEFT JOIN m ON doc_id = id),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS eligible FROM r WHERE n_features >= 20)
SELECT r.doc_id, n_features, weight, score, CASE WHEN k <= 10 * eligible // 100 THEN k END AS rank FROM r LEFT JOIN o ON r.doc_id = o.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op11_topk_search": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_importance": OP13_SQL, "url_rules": URL_RULES_SQL, "op7_decontaminate": OP7_SQL, "op8_chat_format": OP8_SQL, "op9_quality_rules": OP9_SQL}
