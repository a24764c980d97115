"""The registered queries of this subpackage: one a operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import edit_fingerprint, langid, neardup, packing, pii, quality, sentencepiece_stream, sharding, suffix_dedup, token_store
from quire.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


QUERIES["op1_token_store"] = op1_token_store


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


QUERIES |= {"op5_packing": op5_packing, "op9_quality_rules": op9_quality_rules}
ORACLES |= {"op9_quality_rules": quality.ORACLE}


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.evaluate(documents(spark, sf_dir))


def op8_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.with_neighbours(documents(spark, sf_dir))


def op10_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout keeps each source in one of 32 shards, so that its sizes are as uneven as the sources."""
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(32))
    return sharding.digest(documents(spark, sf_dir).select("doc_id", "text", "source"), old)


QUERIES |= {"op3_language_id": op3_language_id, "op8_edit_fingerprint": op8_edit_fingerprint, "op10_reshard": op10_reshard}


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), threshold=0.85).drop("digest")


QUERIES |= {"op2_minhash_neardup": op2_minhash_neardup}


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_report(documents(spark, sf_dir))


QUERIES |= {"op7_suffix_dedup": op7_suffix_dedup}


#: In production the key comes from a secret store; the queries need the same one at each run.
PII_KEY = "a key for the registered queries"


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY, "n_entities")


QUERIES |= {"op4_pii_surrogates": op4_pii_surrogates}


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_stream.round_trip(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


QUERIES |= {"op6_sentencepiece": op6_sentencepiece}
