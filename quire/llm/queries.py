"""The queries ``opN_<name>`` of the corpus operators, with production parameters, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bytebpe, bytedup, filter_audit, langid, mixing, packing, pagetext, quality, ranking, simhash, token_files, topk, worddup
from .common import table

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=2)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pagetext.page_texts(pages, pagetext.train(pages))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=1, tokens=4096)


def op8_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytedup.without_repeats(table(spark, sf_dir, "documents"))


def op9_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worddup.without_repeats(table(spark, sf_dir, "documents"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def queries() -> dict:
    ops = (
        op1_language_id, op2_token_files, op3_exact_top_k, op4_byte_bpe, op5_quality_rules, op6_page_text, op7_best_fit_packing,
        op8_byte_repeats, op9_word_repeats, op10_simhash_groups, op11_filter_interactions, op12_source_mix, op13_ranked_search,
    )
    return {f.__name__: f for f in ops}


#: Integer vectors and inner products are plain SQL; the other operators are held to brute force in tests/llm.
OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.row AS row, a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.row <> b.row
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), w AS (
  SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)
), again AS (
  SELECT s FROM w GROUP BY s HAVING count(*) > 1
), gone AS (
  SELECT r, list_distinct(flatten(list(range(i, i + 35)))) AS g FROM w SEMI JOIN again USING (s) GROUP BY r
), kept AS (
  SELECT doc_id, ws, CASE WHEN g IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(g, i)) END AS k FROM d LEFT JOIN gone USING (r)
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - len(k) AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


OP11_SQL = r"""
WITH RECURSIVE one AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, concat(
           CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END,
           CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END,
           CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END,
           CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
           CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM d LEFT JOIN one USING (doc_id)
), c AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), o AS (
  SELECT '' AS o UNION ALL SELECT o || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)
), s AS (
  SELECT o AS filter_order, step, substr(o, step, 1) AS own, substr(o, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE length(o) = 5
), x AS (
  SELECT part, filter_order, step, own, fails, n, good, toxic, contains(fails, own) AS failing,
         before <> '' AND regexp_matches(fails, '[' || before || '_]') AS earlier
  FROM s, c
), a AS (
  SELECT part, filter_order, step, own,
         sum(n) FILTER (NOT failing AND NOT earlier) AS kept, sum(n) FILTER (failing AND NOT earlier) AS removed,
         sum(n) FILTER (failing AND earlier) AS redundant, sum(n) FILTER (fails = own) AS unique_fails,
         sum(good) FILTER (failing AND NOT earlier) AS good_lost, sum(toxic) FILTER (failing AND NOT earlier) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM a
"""


OP13_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), d AS (
  SELECT r, doc_id, ws, len(ws) AS n FROM words WHERE len(ws) > 0
), s AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d
), p AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY r, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2.0 * n_docs + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs
), i AS (
  SELECT i, item_id, unnest(ws) AS term FROM (
    SELECT row_number() OVER () AS i, item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
    FROM benchmark)
), q AS (
  SELECT i, item_id, term, count(*) AS times FROM i GROUP BY i, item_id, term
), x AS (
  SELECT i, item_id, d.r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (r), s GROUP BY i, item_id, d.r, doc_id
), o AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_top_k": OP3_SQL, "op9_word_repeats": OP9_SQL, "op11_filter_interactions": OP11_SQL, "op13_ranked_search": OP13_SQL}
