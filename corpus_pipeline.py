"""The corpus pipeline: documents go through five operators, each on all that the one before kept.

quality classifier -> SimHash near-dedup -> benchmark decontamination -> PII -> mixing sources to target weights.
Every stage is written as Parquet to the shared folder and read back before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimsift.llm import benchmark_suffixes, entropy_mix, latent_neighbours, private_spans, simhash_trie
from claimsift.llm.common import documents
from claimsift.session import materialise


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours of their text vote for; the rest goes."""
    return latent_neighbours.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash of three-word shingles, at most two bits apart."""
    return simhash_trie.keep_one(docs, radius=simhash_trie.RADIUS, words=simhash_trie.WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to be contaminated."""
    return benchmark_suffixes.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return private_spans.redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the copies it takes of each."""
    return entropy_mix.mixed(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing),
]

#: The classifier, the random field and the fingerprints have no form in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages, in turn, make of the documents; columns of documents, size, target and copies."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
