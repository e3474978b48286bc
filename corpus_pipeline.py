"""A training-data pipeline over `documents`: reject, deduplicate, decontaminate, redact, encode.

Every stage works on all rows its predecessor kept and returns the columns of documents; the last
returns the encoded documents. Stages hand over tables in the shared folder. Operators see doc_id and
text alone: whatever other columns are called, they come through unchanged (but n_chars, which the
personal data stage counts anew).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm import near_dup, pieces, pii, quality, winnow
from ticketloom.llm.catalog import tokenizer_path
from ticketloom.llm.staging import staged, table
from ticketloom.session import ship


class Apart:
    """Documents with all columns but doc_id and text in one column of a name nothing else has."""

    def __init__(self, docs: DataFrame):
        self.columns, self.rest = docs.columns, f"rest_{uuid.uuid4().hex}"
        others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
        self.docs = docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias(self.rest)).alias(self.rest))

    def whole(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"{self.rest}.`{c}`").alias(c)
                           for c in self.columns])


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality reaches the threshold."""
    ship(spark)
    apart = Apart(docs)
    model = quality.fit(apart.docs, table(spark, sf_dir, "labels"))
    scored = quality.with_score(apart.docs, model, column="_score")
    return apart.whole(scored.filter(F.col("_score") >= quality.THRESHOLD))


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id."""
    apart = Apart(docs)
    return apart.whole(near_dup.with_classes(apart.docs, first_by="doc_id").filter("is_first"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    apart = Apart(docs)
    found = winnow.contamination(apart.docs, table(spark, sf_dir, "benchmark"))
    return apart.whole(found.filter(~F.col("contaminated")))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind's name and its length counted anew."""
    apart = Apart(docs)
    clean = apart.whole(pii.with_spans(apart.docs, clean="text"))
    if "n_chars" not in clean.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as the ids of its best segmentation, with the scores of its best three."""
    return pieces.with_pieces(docs, tokenizer_path("piece_bpe_32k.model")).drop("text")


STAGES = [
    ("quality classifier", good_documents),
    ("minhash near-dedup", first_of_near_duplicates),
    ("benchmark decontamination", without_benchmarks),
    ("pii", without_personal_data),
    ("sentencepiece encoding", encoded),
]

#: A learned classifier cannot be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
