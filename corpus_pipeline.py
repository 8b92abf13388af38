"""The corpus pipeline: STAGES over the documents table, each written as Parquet and read again for the next.

A stage takes (spark, docs, sf_dir), docs being all that its predecessor kept, and returns a DataFrame; all but the last
return the columns of documents. run() applies them to the documents of a folder of tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import common, langid, mixing, neardup, pieces, pii

#: A text goes if at least this share of its words is of no learned language.
MOST_OTHER = 0.6
#: A model that has met fewer different words can't tell what is strange: it rejects texts without a letter only.
LEAST_WORDS = 1000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go: null, without a letter, or mostly of words unlike every language learned here. A null
    lang is filled in. Where no row has a label to learn from, all texts with a letter stay as they are. Repeated rows
    share their fate; an empty table gives no rows; very long texts are read in windows."""
    common.slim_batches(spark)
    model = langid.fit(langid.learnable(docs), other=True)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.annotate(docs.select(F.struct(*docs.columns).alias("_row"), "text"), model)
    stays = (F.col("lang_pred") != "und") & ((F.col("other") < MOST_OTHER) if model.words >= LEAST_WORDS else F.lit(True))
    found = found.where(stays).select("_row.*", "lang_pred")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest doc_id (a null doc_id only where no other is
    there), and one of its repeated rows. Texts without a word are all different. Extra columns pass through."""
    common.slim_batches(spark)
    return neardup.deduplicated(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become the name of their kind in brackets; n_chars follows, a null one stays null. Every
    row stays, null texts too; an empty table gives no rows."""
    common.slim_batches(spark)
    return pii.masked(docs, pii.fit(docs)).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by rates calibrated to the tempered source, language and topic marginals; rates above 1 repeat documents.
    Null source, language and text are categories of their own; rows that were equal share their fate; columns named as
    the operator's own pass through untouched; an empty table gives no rows."""
    return mixing.sampled(docs, repeated=True)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The SentencePiece ids of every text that is left, row by row: a null or empty text has none, a text of any length is
    encoded whole, and columns named as the results are replaced."""
    common.slim_batches(spark)
    return pieces.encode_column(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")


STAGES = [
    ("identify_language", identify_language),
    ("drop_near_duplicates", drop_near_duplicates),
    ("mask_personal_data", mask_personal_data),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name, [docs])
    return STAGES[-1][1](spark, docs, sf_dir)


#: The trained models and the tokenizer are beyond SQL; tests/llm/test_registered.py holds run() against a brute-force version.
ORACLE_SQL = None
