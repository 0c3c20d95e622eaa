"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, huffman, licences, lm_scoring, packing, quality, sharding, simhash, toxicity
from .common import held_out, table


def op1_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that ``documents`` hold."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` on 16 shards whose row counts differ by one at most."""
    return sharding.ring_shards(table(spark, sf_dir, "documents"), shards=16)


def op3_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests of all ``documents`` and the known licences they are."""
    return licences.scan(table(spark, sf_dir, "documents"))


#: Labelled rows from which the toxicity lexicon is fitted, at most.
TOXICITY_ROWS = 20_000


def op4_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all ``documents``, learnt from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_sample(docs, table(spark, sf_dir, "labels"), ~held_out(5), TOXICITY_ROWS)
    got = toxicity.score_rows(docs, model)
    return got.select("doc_id", held_out(5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), 2048)


def op6_text_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and link components of all ``documents``."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all ``documents`` by the attention model and by the word unigram base."""
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op9_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all ``documents``; rules are certified on the quality labels."""
    return quality.risk_controlled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all ``documents`` written to a file of Huffman codes and read back."""
    return huffman.round_trip(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bm25_decontamination": op1_bm25_decontamination,
    "op2_ring_sharding": op2_ring_sharding,
    "op3_licence_digests": op3_licence_digests,
    "op4_toxicity_lexicon": op4_toxicity_lexicon,
    "op5_shortest_pack_first": op5_shortest_pack_first,
    "op6_text_tag_ratio": op6_text_tag_ratio,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_attention_lm": op8_attention_lm,
    "op9_risk_controlled_rules": op9_risk_controlled_rules,
    "op10_huffman_ids": op10_huffman_ids,
}

ORACLE_SQL: dict[str, str] = {"op3_licence_digests": licences.sql()}
