"""The registered queries of this folder: thin uses of the operators over whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.llm import (bpe, chat, chat_repair, divergence, langid, line_index, mixing, pivots, simhash, sketch, token_counts,
                             training_order, url_templates)
from ledgermatch.llm.common import documents
from ledgermatch.session import ensure_checkpoint_dir

#: Free id of the byte-level vocabulary, used to end documents.
END_ID = 50256
ORDER_KEY = 20240607


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), 4096)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(documents(spark, sf_dir, "conversations"))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a sequence, read back from the shards that were written."""
    path = training_order.shards_folder(spark, "shards")
    n = training_order.write_shards(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                    public_tokenizers.PATTERN, END_ID, ORDER_KEY)
    if not n:
        return spark.createDataFrame([], "shard bigint, slot bigint, doc_id bigint, offset bigint, n_ids bigint, ids_sha256 string")
    got = training_order.read_sequences(spark, path)
    return got.select("shard", "slot", "doc_id", "offset", "n_ids", F.sha2("ids", 256).alias("ids_sha256"))


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_templates.judge(documents(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.drop("purity")


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(documents(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.take_counts(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = simhash.near_duplicates(documents(spark, sf_dir), shingle=3, bits=2)
    return marked.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def bpe_digests(docs: DataFrame) -> DataFrame:
    coded = bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return found.select("doc_id", langid.held_out().alias("held_out"), F.col("__lm_lang.lang_pred").alias("lang_pred"),
                        F.col("__lm_lang.score").alias("score"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sketch.edit_likeness(documents(spark, sf_dir))
    return d.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    sketch.to_text("sketch").alias("fingerprint"), sketch.to_text("edited_sketch").alias("edited_fingerprint"),
                    "near_edited", "near_next")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/line-index-{uuid.uuid4().hex}"
    cleaned = line_index.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), path, at_least=3, least=20)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir), least_docs=30, top_terms=50)


def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = documents(spark, sf_dir, "conversations")
    return chat_repair.with_digests(chat_repair.damage(talks), talks)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_chat_formatting, op3_training_order, op4_url_templates, op5_embedding_neardup, op6_mixing,
    op7_simhash_neardup, op8_byte_bpe, op9_language_id, op10_fingerprints, op11_line_dedup, op12_source_divergence,
    op13_chat_repair, pipeline)}
