"""A corpus pipeline of the training-data operators: quality rules, line
dedup, near-duplicates, mixing and tokenization.  Each stage works on all
that the one before it kept, and its result is written before the next one
starts, so a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectspark.llm.common import materialize, table
from aspectspark.llm.lines import without_repeated_lines
from aspectspark.llm.mixing import mixed_documents
from aspectspark.llm.pieces import encode_pieces
from aspectspark.llm.quality import keep_good
from aspectspark.llm.queries import piece_digests, piece_model
from aspectspark.llm.simhash import keep_one_each


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines whose template recurs; ``n_chars``
    follows the text."""
    kept = without_repeated_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by 3-word shingles and
    3 bits."""
    return keep_one_each(docs, shingle=3, bits=3)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixed_documents(docs)


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids, and digests of ids, decoded text and span ends, of
    each document that the mix takes, once for each time."""
    return piece_digests(encode_pieces(docs, piece_model(), round_trip=True))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", tokenize_stage),
]

#: SQL has neither the fingerprints' and the mix's hashes nor the tokenizer;
#: the tests compare the stages with plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
