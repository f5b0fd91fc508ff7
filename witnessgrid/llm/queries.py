"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    cross_polytope, decontamination, divergence, language_id, mixing, parity_join, quality, sharding, super_minhash, token_files,
    tool_calls, toxicity, turn_repair)
from ..session import shared_path
from .oracles import ORACLES

# Kept out of the repository; the package names its folder.
TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 8)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    found = decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 75)
    return found.select("doc_id", "item_id", "item_shingles", "shared", "containment")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written as token files and read back."""
    path = shared_path(spark, "tokens")
    token_files.write_corpus(table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID)
    return token_files.read_corpus(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


# A schema per tool; calls of other tools are reported as unknown.
TOOL_SCHEMAS = {
    "search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"],
               "additionalProperties": False},
    "lookup": {"properties": {"id": {"type": "integer"}, "lang": {"type": "string", "enum": ["de", "en", "es", "fr"]}}, "required": ["id"]},
}


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversation turns as canonical JSON with linked calls.

    The given conversations hold plain turns, so each user turn is read as a call, right or faulty,
    chained to the one before, and the assistant turn after it as its result.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return tool_calls.link(tool_calls.as_calls(turns), TOOL_SCHEMAS)


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth embedding."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cross_polytope.search(rows, rows.filter("vec_id % 20 = 0"), 20)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = language_id.id_part(F.col("doc_id"), 3)
    model = language_id.fit(docs.filter(part != 1))
    return language_id.predict(docs, model, ["doc_id"]).select(
        "doc_id", (part == 1).alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the mixed order of their sources."""
    found = mixing.interleave(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "block", "slot", "release", "deadline", "position")


def op9_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return parity_join.linked_components(table(spark, sf_dir, "documents"), 75)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sets each source of a language apart from the other sources and from the language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents on two-word shingles."""
    return super_minhash.near_duplicates(table(spark, sf_dir, "documents"), 80, 2)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a fixed rule, with the cheapest repair of their turns."""
    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.repair(turn_repair.damaged(conversations), conversations)


def queries():
    found = {name: value for name, value in globals().items() if name.startswith("op") and callable(value)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
