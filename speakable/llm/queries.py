"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table
from .conv_trie import prefix_nodes, rebuilt_rows
from .decontam import SQL as DECONTAM_SQL
from .decontam import contaminated
from .line_dedup import SQL as LINE_SQL
from .line_dedup import drop_boilerplate
from .lm import lm_scores
from .merkle import document_manifest
from .packing import packed_documents
from .pieces import piece_digest
from .quality import quality_score, train_quality
from .repetition import repetition_report
from .simhash import hex_bits, near_duplicates
from .suffix_dedup import remove_repeats
from .token_store import stored_tokens
from .toxicity import toxicity_score, train_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _labels(spark: SparkSession, sf_dir: str, column: str, n: int, held: int) -> DataFrame:
    """doc_id and label of the rows that may be learned from."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col(column).alias("label"))
    return rows.filter(fold(F.col("doc_id"), n) != held)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, _labels(spark, sf_dir, "quality", 4, 2))
    scored = docs.select("doc_id", quality_score(model, F.col("text")).alias("score"))
    return _judged(scored, 4, 2, 0.7)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, their source as the site."""
    out = drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "text")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(F.col("doc_id"), 5) != 1).alias("train"))
    return lm_scores(docs).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "vocabulary")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return stored_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, digest=True)


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "n_matched", "n_reworded")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", hex_bits(F.col("bits")).alias("fingerprint"), "component_id")


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_report(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, _labels(spark, sf_dir, "toxic", 5, 0))
    scored = docs.select("doc_id", toxicity_score(model, F.col("text")).alias("score"))
    return _judged(scored, 5, 0, 0.5)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", piece_digest(F.col("text"), model).alias("r")).select("doc_id", "r.*")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_conv_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_nodes(rebuilt_rows(table(spark, sf_dir, "conversations")))


def _judged(scored: DataFrame, n: int, held: int, limit: float) -> DataFrame:
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), n) == held).alias("held_out"),
        "score",
        (F.col("score") >= limit).cast("int").alias("predicted"),
    )


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_lm_score": op4_lm_score,
    "op5_token_store": op5_token_store,
    "op6_decontam": op6_decontam,
    "op7_simhash": op7_simhash,
    "op8_repetition": op8_repetition,
    "op9_toxicity": op9_toxicity,
    "op10_pieces": op10_pieces,
    "op11_merkle": op11_merkle,
    "op12_packing": op12_packing,
    "op13_conv_trie": op13_conv_trie,
}
ORACLES: dict[str, str] = {"op3_line_dedup": LINE_SQL, "op6_decontam": DECONTAM_SQL}
