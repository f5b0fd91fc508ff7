"""From raw documents to token files, in five stages of the training-data operators.

Each stage reads what the one before kept: language ID drops texts in no language, the n-gram
join keeps one document of each class of near duplicates, documents holding benchmark items go,
the rest is put in the mixed order of its sources, and the last stage writes token files in that
order and returns their digest.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from witnessgrid.llm import decontamination, language_id, mixing, parity_join, token_files
from witnessgrid.llm.queries import END_ID, table, tokenizer_path
from witnessgrid.session import shared_path, stash


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language: those without text or letters go."""
    model = language_id.fit(docs.select("text", "lang"))
    found = language_id.predict(docs, model, docs.columns)
    return found.filter(F.col("lang_pred") != language_id.UNDETERMINED).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row, by id, of each class of near duplicates."""
    return parity_join.first_of_classes(docs, 75)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), 75)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the source schedule."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the rows in their files; returns the digest read back from them."""
    try:
        placed = docs.select(
            "*", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("bigint").alias("file"),
            F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # rows that are in no file have the order of their ids
        placed = docs.select("*", F.lit(0).alias("file"), F.lit("").alias("file_name"), F.col("doc_id").alias("row"))
    path = shared_path(spark, "tokens")
    token_files.write_corpus(placed, path, tokenizer_path(), END_ID, order=("file", "file_name", "row", "doc_id"))
    return token_files.read_corpus(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language_id", identify_language), ("parity_join", drop_near_duplicates), ("decontamination", decontaminate),
    ("mixing", mix_sources), ("token_files", write_tokens)]

# Language scores, the schedule and the tokenizer are beyond SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for position, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if position + 1 < len(STAGES):
            docs = stash(docs)
    return docs
