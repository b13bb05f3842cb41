"""The registered queries of this subpackage: production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, langid, lines, merkle, minhash, pages, sharding, substrings, suffixes, topk, trie, warc
from ._common import table

BPE_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.byte_digests(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.window_digests(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), BPE_VOCABULARY)


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(table(spark, sf_dir, "documents"), PIECE_VOCABULARY)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_embeddings(table(spark, sf_dir, "embeddings"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_texts(table(spark, sf_dir, "pages"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_suffixes, op2_sharding, op3_warc, op4_substrings, op5_bpe, op6_lines, op7_language_id, op8_decontamination, op9_topk, op10_minhash, op11_pages, op12_merkle, op13_trie)}
ORACLES = {"op1_suffixes": suffixes.ORACLE_SQL, "op3_warc": warc.ORACLE_SQL, "op4_substrings": substrings.ORACLE_SQL, "op6_lines": lines.ORACLE_SQL, "op9_topk": topk.ORACLE_SQL, "op10_minhash": minhash.ORACLE_SQL, "op12_merkle": merkle.ORACLE_SQL, "op13_trie": trie.ORACLE_SQL}
