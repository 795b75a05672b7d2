"""The corpus pipeline: quality rules, near-dedup, secrets, mixing, SentencePiece encoding, each over all that the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm.common import written
from archivolt.llm.host_quality import kept_documents
from archivolt.llm.mixing import mixed_documents
from archivolt.llm.piece_lattice import Lattice, encode
from archivolt.llm.probminhash import one_of_each
from archivolt.llm.secret_scan import without_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules reject go."""
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the least doc_id."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; no document goes."""
    return without_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to tempered weights by repeating documents; each stays once at least."""
    return mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled pieces of each document."""
    encoded = encode(docs, Lattice(public_tokenizers.path("piece_bpe_32k.model")), keep=["doc_id", "source"])
    return encoded.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "n_pieces", "ids_crc32", "ids")


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("secret scans", secrets), ("mixing", mixing), ("sentencepiece", pieces)]

#: No DuckDB SQL can express the sketches, the lattice and the host prior's use together; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over sf_dir's documents; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
