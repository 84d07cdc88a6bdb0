"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loamwork.llm.arc import archive_pages
from loamwork.llm.collocations import COLLOCATIONS_SQL, collocations
from loamwork.llm.dialogue import repair_conversations
from loamwork.llm.fingerprints import fingerprint_documents
from loamwork.llm.langid import identify_documents
from loamwork.llm.minhash import near_duplicates
from loamwork.llm.mixing import mix_documents
from loamwork.llm.packing import pack_documents
from loamwork.llm.pii import pii_documents
from loamwork.llm.quality import score_documents
from loamwork.llm.sharding import shard_documents
from loamwork.llm.token_files import token_documents
from loamwork.llm.vectors import near_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    """Where the tokenizer file is; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_documents(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), byte_bpe())


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), word_bpe())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_shard": op2_shard,
    "op3_language_id": op3_language_id,
    "op4_fingerprints": op4_fingerprints,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_pii": op8_pii,
    "op9_minhash": op9_minhash,
    "op10_pack": op10_pack,
    "op11_repair": op11_repair,
    "op12_collocations": op12_collocations,
    "op13_token_files": op13_token_files,
}
ORACLE_SQL: dict[str, str] = {"op12_collocations": COLLOCATIONS_SQL}
