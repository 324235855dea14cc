"""A corpus pipeline of four operators; each stage works on all its predecessor kept.

language   drops documents whose language is undetermined or uncertain, or knows few of their words
neardup    keeps one document of each group of SimHash near-duplicates
mixture    repeats or drops documents so that sources come near their target weights
tokens     encodes every text to token ids, decodes them and returns the digests

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs.  All but the last return the columns of documents.
Null and empty texts have no letter, so ``language`` drops them; documents without a
source are a source of their own; an empty table stays empty through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgermatch.llm import langid, mixing, simhash
from ledgermatch.llm.common import documents
from ledgermatch.llm.queries import bpe_digests
from ledgermatch.session import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=3, bits=2)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(docs)


STAGES = [("language", language), ("neardup", neardup), ("mixture", mixture), ("tokens", tokens)]
#: SQL expresses neither the language model nor the token ids; tests/llm compares each stage's operator with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
