"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import (byte_bpe, decontamination, lexical_search, license_scan, lm_scoring, quality_rules, secret_scan, sharding,
               simhash, spelling, toxicity, wavelet, weak_quality)
from .common import documents

RANK_FILE, TOKENIZER_FILE = "byte_bpe_50k.tiktoken", "word_bpe_49k.json"


def op1_lm_scoring(spark, sf_dir) -> DataFrame:
    return lm_scoring.pseudo_likelihood(documents(spark, sf_dir))


def op2_quality_rules(spark, sf_dir) -> DataFrame:
    book = quality_rules.ledger(documents(spark, sf_dir))
    failed = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.mask(quality_rules.BASE))) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), (~failed & quality_rules.passes("v2")).alias("kept"),
                       "fail_bits", quality_rules.passes("v1").alias("kept_v1"))


def op3_decontamination(spark, sf_dir) -> DataFrame:
    return decontamination.contained_items(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op4_byte_bpe(spark, sf_dir) -> DataFrame:
    return byte_bpe.encode_digests(documents(spark, sf_dir), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op5_secret_scan(spark, sf_dir) -> DataFrame:
    return secret_scan.find_secrets(documents(spark, sf_dir))


def op6_sharding(spark, sf_dir) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_toxicity(spark, sf_dir) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op8_weak_quality(spark, sf_dir) -> DataFrame:
    return weak_quality.quality_scores(documents(spark, sf_dir))


def op9_wavelet_tokens(spark, sf_dir) -> DataFrame:
    with open(public_tokenizers.path(TOKENIZER_FILE), encoding="utf-8") as f:
        return wavelet.token_index(documents(spark, sf_dir), f.read())


def op10_simhash(spark, sf_dir) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_lexical_search(spark, sf_dir) -> DataFrame:
    return lexical_search.best_documents(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op12_license_scan(spark, sf_dir) -> DataFrame:
    return license_scan.find_licenses(documents(spark, sf_dir)).drop("spans")


def op13_spelling(spark, sf_dir) -> DataFrame:
    return spelling.spelling_groups(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_quality_rules, op3_decontamination, op4_byte_bpe, op5_secret_scan,
                                   op6_sharding, op7_toxicity, op8_weak_quality, op9_wavelet_tokens, op10_simhash,
                                   op11_lexical_search, op12_license_scan, op13_spelling)}
