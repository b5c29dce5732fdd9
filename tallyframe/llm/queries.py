"""Queries of the operators of this subpackage over the given tables, and SQL for those it can say."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(key: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql.strip()
        return fn

    return wrap


def tokenizer_path() -> str:
    """The public tokenizer's file; TOKENIZER_PATH names another."""
    if "TOKENIZER_PATH" in os.environ:
        return os.environ["TOKENIZER_PATH"]
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.doc_id, k.i, k.line, coalesce(k.doc_id <> f.first_id, false) AS dropped FROM keyed k LEFT JOIN firsts f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op2_line_dedup", LINES_SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.lines import line_digests

    return line_digests(_table(spark, sf_dir, "documents"))


WINDOWS_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word, len(ws) AS n,
                 array_to_string(ws[generate_subscripts(ws, 1): generate_subscripts(ws, 1) + 19], ' ') AS win FROM docs),
first_seen AS (SELECT doc_id, i, word, i + 19 <= n AND row_number() OVER (PARTITION BY win, i + 19 <= n ORDER BY doc_id, i) > 1 AS again FROM words),
marked AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM first_seen),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


@query("op5_substring_dedup", WINDOWS_SQL)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.substrings import window_digests

    return window_digests(_table(spark, sf_dir, "documents"))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.packing import packed_digests

    return packed_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


BYTES_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bs FROM documents),
bytes AS (SELECT doc_id, len(bs) AS n, generate_subscripts(bs, 1) AS i, unnest(bs) AS b FROM docs),
strings AS (SELECT doc_id, i, b, CASE WHEN i + 49 <= n THEN string_agg(b, '') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) END AS s FROM bytes),
firsts AS (SELECT s, min(doc_id) AS first_id FROM strings WHERE s IS NOT NULL GROUP BY s HAVING min(doc_id) <> max(doc_id)),
again AS (SELECT t.doc_id, t.i, t.b, coalesce(f.first_id < t.doc_id, false) AS again FROM strings t LEFT JOIN firsts f ON f.s = t.s),
marked AS (SELECT doc_id, i, b, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM again),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM marked),
kept AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans,
                string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone) AS h FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n, 0) AS n_bytes, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k.h, ''))) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


@query("op8_suffix_dedup", BYTES_SQL)
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.suffixes import string_digests

    return string_digests(_table(spark, sf_dir, "documents"))


NEAR_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i: i + 3], ' ')) END) AS s FROM docs)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM inter JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
pairs AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM docs UNION SELECT r.x, b.y FROM reach r JOIN pairs b ON b.x = r.y),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM docs d JOIN comp c ON c.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


@query("op3_minhash_near_dedup", NEAR_SQL)
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.decontaminate import benchmark_matches

    return benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.perplexity import quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality(docs, carry_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "log_perplexity_points")


@query("op6_private_data")
def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.pii import private_digests

    return private_digests(_table(spark, sf_dir, "documents"))


#: Rules of the URL query: fixed values.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@query("op4_url_filters")
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.urls import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


CALLS_SQL = r"""
WITH calls AS (
  SELECT conv_id, turn, conv_id::VARCHAR || ':' || turn::VARCHAR AS call_id, CASE WHEN role = 'system' THEN 'set_rules' ELSE 'answer' END AS tool, text
  FROM conversations WHERE role IN ('user', 'system')),
results AS (SELECT conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR AS call_id, text AS content FROM conversations WHERE role = 'assistant'),
grouped AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM calls),
levelled AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level FROM grouped),
joined AS (
  SELECT c.conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn, c.level, c.tool, c.text, r.content, c.call_id IS NOT NULL AS has_call,
         r.call_id IS NOT NULL AS has_result
  FROM levelled c FULL JOIN results r ON r.call_id = c.call_id)
SELECT conv_id, call_id, turn, level, row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, turn NULLS FIRST, call_id) - 1 AS position,
       CASE WHEN NOT has_call THEN 'orphan' WHEN NOT has_result THEN 'no_result'
            WHEN text IS NULL OR (tool = 'set_rules' AND turn > 1) THEN 'invalid' ELSE 'ok' END AS status,
       CASE WHEN has_call AND text IS NULL THEN 'missing:n_chars,missing:prompt' WHEN has_call AND tool = 'set_rules' AND turn > 1 THEN 'value:first' ELSE '' END AS errors,
       '{"arguments":' || CASE WHEN has_call THEN '{"first":' || to_json((turn <= 1)::VARCHAR)::VARCHAR || ',"n_chars":' || coalesce(to_json(length(text)::VARCHAR)::VARCHAR, 'null')
         || ',"prompt":' || coalesce(to_json(text)::VARCHAR, 'null') || '}' ELSE '{}' END || ',"call_id":' || to_json(call_id)::VARCHAR || ',"result":'
         || coalesce(to_json(content)::VARCHAR, 'null') || ',"tool":' || coalesce(to_json(tool)::VARCHAR, 'null') || '}' AS json
FROM joined
"""


@query("op1_chat_formatting", CALLS_SQL)
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.toolcalls import conversation_calls

    return conversation_calls(_table(spark, sf_dir, "conversations"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    ship(spark)
    return corpus_pipeline.run(spark, sf_dir)


PHRASES_SQL = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, generate_subscripts(ps, 1) AS p, unnest(ps) AS piece FROM (
    SELECT row_number() OVER () AS doc_id, lang,
           regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents)),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: ws[i: i + size - 1])) AS phrase
    FROM worded, (SELECT unnest([1, 2, 3, 4]) AS size)) GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT g.lang, g.phrase, g.size, g.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * g.f) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM grams WHERE size > 1) g
  JOIN grams x ON x.lang = g.lang AND x.phrase = g.phrase[1: k] JOIN grams y ON y.lang = g.lang AND y.phrase = g.phrase[k + 1: g.size]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, f, unnest(list_concat(list_transform(range(1, size), lambda i: phrase[i: i + 1]),
                                     CASE WHEN size = 4 THEN [phrase[1: 3], phrase[2: 4]] ELSE [] END)) AS phrase FROM grams WHERE size > 2),
longest AS (SELECT lang, phrase, max(f) AS f FROM inner_parts GROUP BY ALL),
kept AS (SELECT b.*, array_to_string(b.phrase, ' ') AS words FROM best b LEFT JOIN longest x ON x.lang = b.lang AND x.phrase = b.phrase
         WHERE x.f IS NULL OR 100 * x.f < 80 * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, words) AS rank, words AS phrase, a, l, r, t.n, score::BIGINT AS score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, words) <= 2000
"""


@query("op12_phrase_collocations", PHRASES_SQL)
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"))


NEGATIVES_SQL = r"""
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
           FROM whole a JOIN whole b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id,
       positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.negatives import mine_hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return mine_hard_negatives(vectors, F.col("vec_id") % 100 == 0)


@query("op13_language_id")
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.llm.languages import identify_languages

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    found = identify_languages(docs, (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
