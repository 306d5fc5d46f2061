"""A corpus pipeline of five stages, each reading what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridmark.llm.bpe_automaton import bpe_round_trip
from gridmark.llm.common import Scratch, table
from gridmark.llm.exact_dedup import keep_one
from gridmark.llm.near_dedup import keep_firsts
from gridmark.llm.queries import vocabulary
from gridmark.llm.rule_ensemble import keep_good
from gridmark.llm.source_mix import mixed_rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return keep_one(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return keep_firsts(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: every document stays, those of small sources come again in later epochs."""
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with their digest and that of the text decoded from them."""
    return bpe_round_trip(docs, vocabulary("byte_bpe_50k.json"), ids_too=True)


STAGES = [("quality classifier", quality), ("exact dedup", exact_copies), ("near dedup", near_copies), ("source mix", source_mix), ("BPE", tokens)]

#: Trained rules, signatures and automata aren't SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each stage's rows written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with Scratch.passing():  # the stage's own tables go when its rows are written
            docs = scratch.put(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
