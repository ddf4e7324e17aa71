"""Queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

import corpus_pipeline
from tidemark.llm import (
    bin_slack_packing,
    bloom_lm,
    byte_bpe,
    curve_packing,
    exact_dedup,
    language_id,
    lexical_search,
    nn_descent,
    paragraph_dedup,
    pu_quality,
    simhash_trie,
    source_divergence,
    suffix_dedup,
)
from tidemark.llm.common import table


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over all documents: the places of every piece and a checksum of its ids."""
    pieces = curve_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over all documents: digests of the ids and of the bytes that they decode to."""
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over all documents."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", (~language_id.learnable("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over all documents."""
    return simhash_trie.near_duplicates(table(spark, sf_dir, "documents"))


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over all documents: what goes from each, and the text that is left."""
    cut = paragraph_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_removed", "removed_words", "text")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over all documents."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over all embeddings."""
    return nn_descent.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over all documents."""
    docs = table(spark, sf_dir, "documents")
    found = pu_quality.score(docs, pu_quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (~language_id.learnable("doc_id")).alias("held_out"), "score", "predicted")


def op9_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over all documents."""
    return bloom_lm.score(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over all documents."""
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11: all benchmark items against all documents."""
    return lexical_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op12_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12 over all documents: the places of every piece and a checksum of its ids."""
    return bin_slack_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13 over all documents."""
    return source_divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_curve_packing": op1_curve_packing,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_language_id": op3_language_id,
    "op4_simhash_trie": op4_simhash_trie,
    "op5_paragraph_dedup": op5_paragraph_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_nn_descent": op7_nn_descent,
    "op8_pu_quality": op8_pu_quality,
    "op9_bloom_lm": op9_bloom_lm,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_bin_slack_packing": op12_bin_slack_packing,
    "op13_source_divergence": op13_source_divergence,
    "pipeline": corpus_pipeline.run,
}

#: A-Z lowered and nothing else; null is empty.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op6_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS cp,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) AS kept,
               sha256(norm) AS text_sha256
        FROM d""",
    "op11_lexical_search": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        totals AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n_docs, coalesce(sum(len(ts)), 0)::BIGINT AS n_terms FROM d),
        i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
        wanted AS (SELECT i, t, count(*) AS a FROM (SELECT i, unnest(ts) AS t FROM i) GROUP BY i, t),
        entries AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
        weighed AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM entries, totals GROUP BY t, n_docs),
        lengths AS (SELECT r, doc_id, 100 - 25 + ((25 * len(ts) * n_docs) // n_terms) AS m FROM d, totals WHERE len(ts) > 0),
        scored AS (
            SELECT i, r, sum(a * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
            FROM wanted JOIN entries USING (t) JOIN weighed USING (t) JOIN lengths USING (r) GROUP BY i, r),
        ranked AS (
            SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank
            FROM scored JOIN lengths USING (r) WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked JOIN i USING (i) WHERE rank <= 20""",
    "op13_source_divergence": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all({LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
            FROM documents),
        words AS (SELECT r, lang, source, unnest(ts) AS t FROM d),
        kept AS (SELECT lang, t, count(*) AS n FROM words GROUP BY lang, t HAVING count(DISTINCT r) >= 10),
        counted AS (SELECT lang, source, t, count(*) AS n FROM words GROUP BY lang, source, t),
        grid AS (
            SELECT g.lang, g.source, k.t, k.n AS lang_n, coalesce(c.n, 0) AS n, count(*) OVER (PARTITION BY g.lang, g.source) AS v,
                   sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source)::BIGINT AS total, sum(k.n) OVER (PARTITION BY g.lang, g.source)::BIGINT AS lang_total
            FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
        shares AS (
            SELECT lang, source, t, n, 1 + (1000000000 * (n + 2)) // (total + 2 * v) AS p, 1 + (1000000000 * (lang_n + 2)) // (lang_total + 2 * v) AS q
            FROM grid),
        sums AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM d),
        parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL
            SELECT lang, source, 'term', t, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
