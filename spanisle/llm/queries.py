"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hnsw, jaccard, langid, mixing, mpegts, pii, quality, suffixdedup, tokenfile
from .common import table


MIX = {
    "weights": {"domain": {"web": 400, "books": 300, "code": 200, "forums": 100}, "language": {"en": 500, "fr": 200, "de": 200, "es": 100}},
    "default": 10,
    "share": 0.5,
    "epochs": 4,
    "seed": "2024",
}
_DOMAINS = ("web", "books", "code", "forums")


def domain():
    """The table has no domains: sources are assigned to four of them by their number."""
    number = F.regexp_extract("source", r"([0-9]+)", 1).try_cast("int")
    return F.element_at(F.array(*map(F.lit, _DOMAINS)), number % 4 + 1)


DOMAIN_SQL = "list_extract(['web', 'books', 'code', 'forums'], TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 4 + 1)"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), domain(), **MIX)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op5_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.digests(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read(tokenfile.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs), ["doc_id"])
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_mixing": op2_mixing, "op3_byte_bpe": op3_byte_bpe, "op4_jaccard_join": op4_jaccard_join, "op5_transport_streams": op5_transport_streams, "op6_pii": op6_pii, "op7_quality": op7_quality, "op8_hnsw": op8_hnsw, "op9_token_files": op9_token_files, "op10_language_id": op10_language_id}
ORACLE: dict[str, str] = {"op2_mixing": mixing.oracle(**MIX, domain_sql=DOMAIN_SQL)}
