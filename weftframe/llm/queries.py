"""One query per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftframe.llm import language_parsing, licence_scan, mixing, neighbours, pieces, quality_cascade, simhash, token_lists, web_archive, wrappers
from weftframe.llm import check_queries  # noqa: F401
from weftframe.llm.common import table, vocabulary, written
from weftframe.llm.registry import LLM_ORACLES, LLM_QUERIES, llm_query  # noqa: F401
from weftframe.session import scratch_path


@llm_query("op1_wrapper_text")
def op1_wrapper_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, folder, "pages")
    paths = written(wrappers.wrapper_paths(wrappers.infer_wrappers(pages)), "wrappers")
    return wrappers.extract_text(pages, paths)


@llm_query("op2_cross_parsing")
def op2_cross_parsing(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    return language_parsing.identify(table(spark, folder, "documents"))


@llm_query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Piece ids of every document, and whether decoding them gives the text back."""
    return pieces.encode(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"), check=True)


@llm_query("op4_multiprobe_neighbours")
def op4_multiprobe_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest vectors found for every hundredth id."""
    return neighbours.nearest_neighbours(table(spark, folder, "embeddings"), lambda vec_id: vec_id % 100 == 0)


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT doc_id, t, words, lines, len(words) AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM w),
win AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS g
          FROM (SELECT doc_id, words, unnest(range(1, n_words - 6)) AS i FROM m WHERE n_words > 8)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(8) r(k) GROUP BY 1),
b AS (SELECT m.*, coalesce(cov.n, 0) AS n_repeat_words FROM m LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words
            OR n_symbols * 4 > n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR len(list_filter(words, lambda x: regexp_matches(x, '\pL'))) * 10 < n_words * 6
            OR len(lines) > 2 * len(list_distinct(lines))
            OR len(list_distinct(words)) * 50 < n_words) AS kept
  FROM b
"""


@llm_query("op5_quality_cascade", OP5_SQL)
def op5_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality_cascade.judge(table(spark, folder, "documents"))


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
f AS (SELECT b, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, to_base32_sha1 AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
  FROM (SELECT p.page_id, p.b, f.first,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + (('0x' || substr(sha1(p.b), 1 + (i * 5) // 4, 1))::INT * 16
                      + ('0x' || substr(sha1(p.b) || '0', 2 + (i * 5) // 4, 1))::INT)
                     // (1 << (3 - (i * 5) % 4)) % 32, 1)), 'string_agg', '') AS to_base32_sha1
          FROM p JOIN f USING (b))
"""


@llm_query("op6_warc_packages", OP6_SQL)
def op6_warc_packages(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a record of a package, read back."""
    return web_archive.archive_round_trip(spark, table(spark, folder, "pages"))


@llm_query("op7_licence_scan", licence_scan.oracle())
def op7_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence that every document states, if any."""
    return licence_scan.scan(table(spark, folder, "documents"))


@llm_query("op8_token_lists")
def op8_token_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Position, length and checksum of every document's ids, from the files."""
    path = scratch_path(spark, "tokens")
    token_lists.write_tokens(table(spark, folder, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_lists.checksums(spark, path)


@llm_query("op9_soft_mixing")
def op9_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Domain posterior and rate of every document."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return mixing.mixing_rates(docs, labels, mixing.label_domain(), mixing.WEIGHTS, anchor="good", repeat=False)


@llm_query("op10_simhash")
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"), width=3, distance=3, blocks=5)
