"""Queries opN_<name> over the driver's tables, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.session import importable
from . import decontaminate, fertility, language, lm, minhash, mixing, oracles, quality, sentences, shards, suffixes


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_deep_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.reported(spark, _read(spark, sf_dir, "documents"))


def op3_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.scored(spark, docs, quality.train(spark, docs, _read(spark, sf_dir, "labels")))


def op4_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language.identified(spark, docs, language.train(docs))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(spark, _read(spark, sf_dir, "documents"))


def op6_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.ruled(spark, _read(spark, sf_dir, "documents"))


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.deduplicated(spark, _read(spark, sf_dir, "documents"))


def op8_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_read(spark, sf_dir, "documents"))


def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, _read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_report(_read(spark, sf_dir, "documents"), 40)


def queries():
    return {
        "op1_spaced_seeds": op1_spaced_seeds,
        "op2_deep_shallow": op2_deep_shallow,
        "op3_factorisation_machine": op3_factorisation_machine,
        "op4_viterbi": op4_viterbi,
        "op5_context_mixing": op5_context_mixing,
        "op6_fertility": op6_fertility,
        "op7_sentence_spans": op7_sentence_spans,
        "op8_raked_mixture": op8_raked_mixture,
        "op9_superminhash": op9_superminhash,
        "op10_interleave": op10_interleave,
    }


def oracle_sql():
    return {
        "op2_deep_shallow": oracles.repeated_bytes(),
        "op8_raked_mixture": mixing.oracle(),
        "op9_superminhash": oracles.near_duplicates(),
        "op10_interleave": oracles.interleaved(),
    }
