"""From raw documents to token ids: toxic documents go, repeated passages go, one of each group of near copies stays,
documents with benchmark passages go, the rest is encoded.

``STAGES`` has a function of (spark, docs, sf_dir) for each step. Its result is written as Parquet to the shared folder and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.

Null and empty texts pass every filter and end with no tokens. Repeated rows count as copies: one stays. Columns besides
doc_id and text stay as they are, but for n_chars where a text was shortened. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm import bpe, decontaminate, jaccard, lines, toxicity
from twinframe.llm.common import table, unused
from twinframe.session import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the model, trained on the labelled ones among them, scores 0.5 or more."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; a document that loses all its lines goes."""
    removed = F.col(unused(docs.columns, "n_removed"))
    cleaned = lines.dedup_lines(docs).where((removed == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        length = F.when(removed > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", length)
    return cleaned.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 80 % common five-word shingles or more."""
    return jaccard.without_near_duplicates(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its token ids, packed, their number, and the text that they decode to."""
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return encoded.select("doc_id", "n_tokens", "ids", F.col("decoded").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Training and tokenizing cannot be expressed in SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
