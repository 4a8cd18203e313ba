"""A training-data pipeline over documents: language, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. A stage works on all rows that the one before kept.

Defined cases: a null, empty or letterless text goes in the first stage, and so does one of an unknown language, but
not where no row is labelled; rows that repeat are near duplicates of each other, null ids lose against others; an
empty table gives an empty result; columns that aren't used are passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hakuspark.llm import lang_id, minhash, packing, secret_scan
from hakuspark.llm.common import mask_of, masked, stored, table, unmasked
from hakuspark.llm.tokens import vocabulary_path

#: Share of a document's n-grams that its language knows, below which it is rejected.
LEAST_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters, and those whose n-grams no language knows; a missing lang is filled in.

    Where no row has a lang, nothing is known of any language, and all documents with letters stay.
    """
    model = lang_id.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = lang_id.predict(masked(docs), model, mask_of(docs, "text"))
    kept = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    lang = mask_of(docs, "lang")
    return unmasked(kept.withColumn(lang, F.coalesce(lang, "lang_pred")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id stays."""
    return minhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts by a mark; n_chars follows the text."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequence and place in it."""
    return packing.pack(docs, vocabulary_path(packing.TOKENIZER), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Models and hashes decide, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
