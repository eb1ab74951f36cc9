"""Corpus pipeline: quality rules, near-duplicates, personal data, source mix, pieces; each stage written and read again.

Defined results, of every stage: a null text is empty, and a null source is a source of its own; an empty text has no words
and goes with the first stage; texts of any length are dealt with whole; repeated rows and equal texts are near-duplicates of
each other, of which the smallest doc_id stays, ties included; an empty table gives an empty result with the same columns;
further columns pass through all stages, whatever their names, but `ids` and `n_ids`, which the last stage replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.llm import minhash, mixing, pii, quality, sentencepiece
from refweave.llm.common import delete, intermediates, materialize, prepared, same_columns

#: Columns that stages read or write; all others are out of their operators' sight.
OWN = ("doc_id", "text", "source", "n_chars")


def aside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`stage` applied while further columns bear names that none of its operators adds."""
    prepared(docs.sparkSession)
    other = {c: f"_column_{i}" for i, c in enumerate(docs.columns) if c not in OWN}
    hidden = docs.withColumnsRenamed(other)
    return same_columns(same_columns(stage(hidden), hidden).withColumnsRenamed({v: k for k, v in other.items()}), docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go."""
    return aside(docs, lambda d: quality.with_verdict(d).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest doc_id."""
    return aside(docs, minhash.keep_one)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in angle brackets; n_chars follows."""
    return aside(docs, lambda d: pii.redact(d).withColumn("n_chars", F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, kept or left out so that sources meet their targets; one row a copy."""
    return aside(docs, lambda d: mixing.repeat(mixing.mix(d)))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as piece ids, with the text that the ids decode to."""
    prepared(spark)
    return sentencepiece.recode(docs).withColumns({"n_ids": F.size("ids").cast("long"), "n_chars": F.length("text").cast("long")})


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("redact_pii", redact_pii),
    ("mix_sources", mix_sources),
    ("sentencepiece", pieces),
]
#: Near-duplicates, boosted trees and pieces are beyond SQL; tests hold the rows against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage leaves in the shared folder besides its result goes once that is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with intermediates(spark) as keep:
            docs = materialize(stage(spark, docs, sf_dir), name)
            keep.append(docs)
        if before is not None:
            delete(before)
        before = docs
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
