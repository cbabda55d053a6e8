"""The corpus pipeline: five stages over `documents`, each working on all that the one before has kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.  `run` writes
each stage as Parquet to the shared folder and reads it again for the next; a table goes when the one after it is there.

Cases, alike for all stages unless a stage says otherwise: an empty table gives an empty table; a null or empty text is kept by every
stage but the first; texts of any length are read whole; rows that repeat, share a key or have none are each kept or dropped as
said below; columns beside those of documents pass through, whatever their names; there are no ties that row order decides.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanisle.llm import bpe, common, jaccard, langid, mixing, pii, queries

#: A text of which no learned language explains the letters needs more phrases for each byte than this.
RATE_MOST = 0.75
#: Word shingles of near-duplicates, and the least similarity in per cent.
WORDS, PER_CENT = 5, 80
#: The mix takes this share of all tokens, each document once at most.
MIX = queries.MIX | {"share": 0.8, "epochs": 1}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Names the language of every document in `lang`; those without letters (so null and empty texts) or of no learned language go.

    Each row is judged by its own text, so repeated rows go or stay together; a tie is the language's that sorts first.  Where no row
    has a label to learn from, no document is rejected and none is named."""
    automata = langid.fit(docs)
    if not automata:
        return docs
    names = tuple(common.free(docs, x) for x in ("lang", "score", "rate"))
    found = langid.identify(docs, automata, docs.columns, names=names)
    kept = found.where((F.col(names[0]) != "und") & (F.col(names[2]) <= RATE_MOST))
    return kept.withColumn("lang", F.col(names[0])).select([F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links join, the one with the least doc_id stays.

    Texts without words are alike to nothing and stay.  Rows that share a doc_id are one document and stay or go together; a row
    without a doc_id can't be named and stays."""
    gone = jaccard.join(docs, WORDS, PER_CENT).where("component_id <> doc_id").select("doc_id").distinct()
    return common.without(docs, "doc_id", common.saved(gone)).select([F.col(f"`{c}`") for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are marked or removed in the texts; n_chars, if it is there, follows.

    No row goes; each row counts as a document, whatever its key; null and empty texts stay as they are."""
    out = pii.sanitise(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select([F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights of domains, languages and sources, each once at most.

    Texts without tokens take no budget and go; a null language, source or domain is a leaf of its own; rows that share a doc_id, or
    have none, stand in one place of their leaf's order and are selected together."""
    return mixing.select(docs, domain=queries.domain(), **MIX).select([F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): token ids of every text, and digests of the ids and of what they decode to.

    Null and empty texts have no tokens; every row has a result."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, made = common.table(spark, sf_dir, "documents"), common.Saved(spark)
    for k, (_, stage) in enumerate(STAGES):
        if k:
            out = made(out)
            made.drop(keep=1)
        out = stage(spark, out, sf_dir)
    return out
