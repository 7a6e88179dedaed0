"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, documents with benchmark
items go, secrets are redacted, and what is left is encoded and decoded by byte-level BPE.

STAGES are (name, function); each function takes (spark, docs, sf_dir). All but the last return the columns of
``documents``; the last returns the digests of the ids and of the decoded bytes for each document.
"""

from __future__ import annotations

import public_tokenizers

from crawlspark.llm import byte_bpe, decontamination, secret_scan, simhash, toxicity
from crawlspark.llm.common import documents
from crawlspark.llm.queries import RANK_FILE
from crawlspark.session import shared_dir


def drop_toxic(spark, docs, sf_dir):
    return toxicity.without_toxic(docs, documents(spark, sf_dir, "labels"))


def drop_near_duplicates(spark, docs, sf_dir):
    return simhash.one_of_each(docs)


def drop_contaminated(spark, docs, sf_dir):
    return decontamination.clean_of(docs, documents(spark, sf_dir, "benchmark"))


def redact_secrets(spark, docs, sf_dir):
    return secret_scan.redact_secrets(docs)


def encode(spark, docs, sf_dir):
    return byte_bpe.encode_digests(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("secrets", redact_secrets), ("byte_bpe", encode)]

# Neither the trained model nor the fingerprints nor the merges can be written as SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written and read again."""
    docs = documents(spark, sf_dir)
    home = shared_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return docs
