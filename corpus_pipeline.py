"""A corpus pipeline of five stages; each works on all that the one before it kept.

run() keeps what every stage returns as a table in the shared folder, so a lost executor costs no finished stage.
All stages but the last keep all columns, whatever their names; an empty table gives an empty result in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import decontamination, jaccard_join, line_dedup, piece_codec, toxicity
from weft.llm.common import documents, stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. Null and empty texts score the fitted bias; rows that share a doc_id are scored one by one."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted from the texts; every row stays. Null texts stay null, and a text whose lines all go is empty."""
    return line_dedup.without_repeated_lines(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest doc_id. Texts without words are in no group and stay; of rows that share that doc_id all stay."""
    return jaccard_join.one_per_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 80 percent of the shingles of a benchmark item go, with all rows of their doc_id. Null and empty texts hold none and stay."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and piece_ids of each text, one row for each document. Null and empty texts have no pieces."""
    return piece_codec.pieces(docs).select("doc_id", "n_pieces", "piece_ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: The classifier and the encoder cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
