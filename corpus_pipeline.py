"""Training-data pipeline over ``documents``: language ID, near-dedup, secret scans, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import langid, packing, secret_scan, simhash
from tradewind.llm.storage import kept_as, named, store

#: Documents whose language is less sure than this go, as do those without any letter.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in one of the learned languages; ``und`` and unsure texts go.

    Without any labelled row there is no language to hold a text against, and all rows stay.
    """
    model = langid.fit(docs.where(langid.fold() != 1))
    if not model.langs:
        return docs
    found = langid.predictions(docs, model, docs.columns)
    sure = (F.col("result.lang_pred") != langid.UNKNOWN) & (F.col("result.score") >= MIN_LANGUAGE_SCORE)
    return found.where(sure).select(*kept_as(docs.columns))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the one with the smallest doc_id."""
    return simhash.keep_first(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, every secret in a text replaced by a mark; n_chars follows the text."""
    clean = secret_scan.redact(docs, words=secret_scan.corpus_words(docs))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*map(named, docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of every document with its place in a sequence (the columns of the packing operator)."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("simhash_near_dedup", simhash_near_dedup), ("secret_scans", secret_scans),
          ("best_fit_packing", best_fit_packing)]

#: The language model and the packing search are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; each result is stored before the next stage."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
