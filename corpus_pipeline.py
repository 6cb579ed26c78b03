"""A training corpus from raw documents: five stages, each of which reads what its predecessor kept.

Language ID drops documents whose language can't be told; of near duplicates one stays; secrets are replaced by a mark;
sources are mixed to their target weights, so that a document can be dropped or repeated; and what remains is encoded.
All stages but the last return the columns of documents. An empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ostinato.llm import langid, mixing, ngram_join, pieces, secrets
from ostinato.llm.storage import DOCUMENT_COLUMNS, keep_columns, new_folder, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that rank-order profiles, learnt from these documents, can tell."""
    return langid.drop_undetermined(keep_columns(docs, DOCUMENT_COLUMNS))


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.drop_near_duplicates(docs)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The four best segmentations of each document."""
    return pieces.encode_texts(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", join_ngrams),
    ("secret_scan", scan_secrets),
    ("source_mix", mix_sources),
    ("piece_encoding", encode_pieces),
]

#: The piece lattice isn't expressible in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents table; what each returns is written and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
