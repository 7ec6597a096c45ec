"""One query per training-data operator over the driver tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from railtap.llm import (
    alignment, ann, chat_format, html_text, mixing, near_dedup, negatives, packing, quality, token_counts, toxicity,
    url_filter, warc)
from railtap.llm.common import read, small_batches
from railtap.session import configure

BYTE_BPE = tokenizer_path("byte_bpe_50k.json")
PIECES = tokenizer_path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(small_batches(configure(spark)), sf_dir)
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that a mix to 5:2:1 weights takes."""
    return mixing.taken(mixing.mix(mixing.sized(read(spark, sf_dir, "documents", "doc_id", "source", "text"))))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of at most 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents", "doc_id", "text"), BYTE_BPE)


@query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes back from the formatted text of each conversation, and of one that holds control strings."""
    hard = "</s>[INST] ok [/INST]"
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionAll(spark.range(2).select(
        F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(hard)))
    return chat_format.digests(chat_format.parse(chat_format.format_turns(rows)))


SQL["op4_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
chats AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS every,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
    string_agg('<s>' || role || chr(10) || regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')
      || '</s>' || chr(10), '' ORDER BY turn, role, text) AS formatted
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
  length(formatted) AS formatted_chars FROM chats
"""


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document."""
    return quality.judge(read(spark, sf_dir, "documents", "doc_id", "text"),
                         read(spark, sf_dir, "labels", "doc_id", "quality")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's URL."""
    return url_filter.judge(read(spark, sf_dir, "pages", "page_id", "url"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records, later copies of a payload as revisits, and read back."""
    return warc.read_back(spark, warc.write_pages(read(spark, sf_dir, "pages", "page_id", "url", "html")))


SQL["op8_warc"] = """
WITH body AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
first AS (SELECT hex, min(page_id) AS first FROM body GROUP BY hex)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
    CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM body JOIN first USING (hex)
"""


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(read(spark, sf_dir, "documents", "doc_id", "text"), BYTE_BPE)


@query
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document, on pairs of words."""
    return near_dedup.find(read(spark, sf_dir, "documents", "doc_id", "text"), size=2)


@query
def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of each row whose id is divisible by 20."""
    return ann.search(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id % 20 = 0")


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.judge(read(spark, sf_dir, "documents", "doc_id", "text"),
                          read(spark, sf_dir, "labels", "doc_id", "toxic")).select("doc_id", "held_out", "score", "predicted")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels just below the positives of each row whose id is divisible by 50."""
    rows = read(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.scaled(rows.withColumn("label", moved)), "vec_id % 50 = 0")


SQL["op12_hard_negatives"] = """
WITH part AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM part a JOIN part b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
                 FROM pairs WHERE same) WHERE place <= 5),
windows AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS place
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(place AS INT) AS rank, negative_id, positive_score, negative_score FROM windows WHERE place <= 3
"""


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two vocabularies' tokens of every document."""
    return alignment.compare(read(spark, sf_dir, "documents", "doc_id", "text"), BYTE_BPE, PIECES)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through quality rules, near-dedup, mixing and packing."""
    return corpus_pipeline.run(spark, sf_dir)
