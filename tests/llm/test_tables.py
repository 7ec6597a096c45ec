"""Nulls, empty and long texts, repeats, empty tables and clashing columns, for every operator and stage."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from public_tokenizers import path as tokenizer_path

from railtap.llm import (
    alignment, ann, chat_format, html_text, mixing, near_dedup, negatives, packing, quality, token_counts, toxicity, url_filter, warc)

BPE = tokenizer_path("byte_bpe_50k.json")
PIECES = tokenizer_path("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 997} of line{i % 13}" for i in range(30_000))
PROSE = "the river rose in the night and by morning the lower meadow was under water so the farmers moved the herd"

DOCS = [(0, PROSE, "en", "a", 1), (1, PROSE, "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0), (None, "x y z", "en", "b", 5),
        (5, LONG, "en", "a", 9), (6, LONG + " and more", "en", None, 9), (6, LONG + " and more", "en", None, 9), (7, "  \n\t ", "en", "b", 4),
        (8, "one", "en", "b", 3), (9, "one", "en", "c", 3), (10, PROSE.upper() + " now", "en", "c", 3), (None, None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """With columns that have the names the operators use inside."""
    df = spark.createDataFrame(DOCS, SCHEMA)
    for c in ("rid", "size", "start", "s", "n", "ids", "raw", "_id", "f1", "node", "tail", "block"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (0, 0, 0), (8, 0, None), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")


def test_mixing(docs):
    rows = mixing.taken(mixing.mix(mixing.sized(docs))).collect()
    assert len(rows) == len(DOCS)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3, 7)} == {0}


def test_packing(docs):
    rows = packing.pack(docs, BPE).collect()
    assert sum(r["length"] for r in rows if r["start"] == 0 and r["doc_id"] in (2, 3)) == 2
    assert sum(r["start"] == 0 for r in rows) == len(DOCS)


def test_quality(docs, labels):
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == len(DOCS)
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 10)
    assert {r["kept"] for r in rows if r["doc_id"] in (0, 1)} == {True}
    kept = quality.keep(docs, labels)
    assert sorted(kept.columns) == sorted(docs.columns)
    assert kept.count() == sum(r["kept"] for r in rows)
    none = quality.judge(docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in none)


def test_near_dedup(docs):
    rows = near_dedup.find(docs, size=2).collect()
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in rows}
    assert len(rows) == len(DOCS)
    assert {k[0]: v for k, v in got.items() if k[1]} | {} == {
        0: (0, True), 1: (0, False), None: (None, True), 5: (5, True), 6: (5, False), 8: (8, True), 9: (8, False), 10: (0, False)}
    assert all(v == (k[0], True) for k, v in got.items() if not k[1])
    left = near_dedup.keep_one(docs, size=2).collect()
    assert sorted((r["doc_id"] for r in left if r["doc_id"] is not None)) == [0, 2, 3, 5, 7, 8]


def test_token_counts(docs):
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(docs, BPE).collect()}
    assert (rows[2]["n_bytes"], rows[2]["n_tokens"], rows[3]["n_tokens"]) == (0, 0, 0)
    assert rows[5]["over_limit"] and not rows[0]["over_limit"]


def test_toxicity(docs, labels):
    rows = toxicity.judge(docs, labels).collect()
    assert len(rows) == len(DOCS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True, True]
    none = toxicity.judge(docs, labels.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}


def test_alignment(docs):
    rows = alignment.compare(docs, BPE, PIECES).collect()
    assert len(rows) == len(DOCS)
    empty = [r for r in rows if r["doc_id"] in (2, 3)]
    assert [tuple(r)[1:] for r in empty] == [(0, 0, 0, 0, 0, 0, "")] * 2
    long = {r["doc_id"]: r for r in rows if r["doc_id"] in (5, 6)}
    assert long[6]["n_a"] > long[5]["n_a"] > 60_000 and long[5]["n_links"] >= long[5]["n_groups"] > 30_000
    assert len([r for r in rows if r["doc_id"] == 6]) == 2 and len({r["groups_sha256"] for r in rows if r["doc_id"] == 6}) == 1


def test_negatives(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(50, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.9, 0.0]), (3, 2, [0.5, 0.0]), (None, 2, [0.7, 0.0]), (4, 2, [0.4, 0.0]),
            (100, 3, [0.0, 1.0]), (5, 3, [0.0, 0.0]), (6, 1, [0.3, 0.0]), (7, None, [1.0, 0.0]), (8, 2, None), (9, 2, [nan, 0.0]), (10, 2, [inf, 0.0]),
            (11, 2, [None, 0.0]), (12, 2, [0.6]), (13, 2, []), (150, 4, [1.0, 1.0]), (50, 1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("rid", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = negatives.mine(negatives.scaled(df), "vec_id % 50 = 0").collect()
    mine = sorted((r["positive_id"], r["rank"], r["negative_id"] if r["negative_id"] is not None else -1, r["positive_score"], r["negative_score"])
                  for r in got if r["anchor_id"] == 50)
    # floor(256 * x): 1.0 -> 256, 0.9 -> 230, 0.7 -> 179, 0.5 -> 128; both rows 50 are anchors, each with the other one and both rows 1 as positives
    one = [(r, n, 65536, s) for r, n, s in ((1, 2, 58880), (2, -1, 45824), (3, 3, 32768))]
    assert mine == sorted([(1, *x) for x in one] * 4 + [(50, *x) for x in one] * 2)
    # an anchor whose positive scores 0 takes scores of 0; one without positives gives none
    zero = sorted((r["rank"], r["negative_id"]) for r in got if r["anchor_id"] == 100)
    assert zero == [(1, 1), (2, 1), (3, 2)] and not [r for r in got if r["anchor_id"] == 150]


def test_empty_tables(spark, docs, labels):
    none = docs.limit(0)
    assert mixing.taken(mixing.mix(mixing.sized(none))).count() == 0
    assert packing.pack(none, BPE).count() == 0
    assert quality.judge(none, labels).count() == 0
    assert near_dedup.find(none).count() == 0
    assert token_counts.count_tokens(none, BPE).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(pages).count() == 0
    assert url_filter.judge(pages, [("block", "net/")]).count() == 0
    assert warc.read_back(spark, warc.write_pages(pages)).count() == 0
    assert toxicity.judge(none, labels).count() == 0
    assert toxicity.judge(none, labels.limit(0)).count() == 0
    assert alignment.compare(none, BPE, PIECES).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.mine(negatives.scaled(vectors), "vec_id % 50 = 0").count() == 0
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.parse(chat_format.format_turns(chats))).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), "true").count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, docs, labels, tmp_path, empty):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    left = docs.limit(0) if empty else docs
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, str(tmp_path))
        left.write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(left.columns)
    assert empty or left.count() > 0
