"""A cleaning pipeline over ``documents``: five stages, each one operator on what the stage before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; each result is
written as Parquet to the folder that the cluster shares and read again as the
next stage's documents, so a lost executor costs at most one stage's tasks.

1. toxicity: documents that the weakly supervised classifier rejects go.
2. line_dedup: lines that are boilerplate of their source leave the texts.
3. near_dedup: documents go whose five-word shingles have a Jaccard similarity of 0.8 or more to one that stays;
   fingerprints that hang together and shared bands name the candidates.
4. decontaminate: documents that hold a benchmark item go.
5. pieces: texts are encoded with SentencePiece and decoded again.

All but the last return the columns of ``documents``; ``n_chars`` follows the text.
Empty tables pass through; null and empty texts are kept by every stage but
the third, which treats them as copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speakable.llm.common import drop_stored, stored, table
from speakable.llm.decontam import without_contaminated
from speakable.llm.line_dedup import without_boilerplate
from speakable.llm.pieces import coded_documents
from speakable.llm.simhash import one_per_group
from speakable.llm.toxicity import toxicity_score, train_toxicity

TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from all labelled rows among the documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = train_toxicity(docs.select("doc_id", "text"), labels)
    return docs.filter(toxicity_score(model, F.col("text")) < TOXIC)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are the sites."""
    out = without_boilerplate(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_group(docs, shingle=5, similar=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``piece_ids``, their number, and ``decoded``: the text that the ids stand for, which replaces ``text``."""
    return coded_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pieces", to_pieces),
]
#: SQL can express neither the classifier nor the components; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        after = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", few=False)
        if k:
            drop_stored(docs)
        docs = after
    return docs
