"""A training corpus from ``documents``: five stages, each written as Parquet and read again.

Each function takes (spark, docs, sf_dir). All but the last return the columns of ``docs``; an
empty table passes through all stages. Intermediate tables lie in the folder the session names
in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, mixing, orc_tokens, probminhash, quality
from tallyspark.llm.queries import TARGETS, table, tokenizer_file
from tallyspark.sources.workspace import settle, work_path

#: Expected tokens after mixing, as a multiple of those before; each document is kept at most
#: once (rates on [0, 1]), and a domain that holds less than its share keeps all it holds.
BUDGET = 1.0


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour vote takes for good."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    return quality.keep_good(docs, quality.fit(docs, labels))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return probminhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned out by domain, each at most once."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    model, measured = mixing.fit_measured(docs, mixing.label_domains(labels))
    return mixing.mix(docs, model, TARGETS, BUDGET, upper=1.0, measured=measured)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as ORC files; per document, from the files: place, number and checksum of its ids."""
    path = work_path(spark, "corpus-tokens")
    orc_tokens.write_token_ids(docs, path, tokenizer_file())
    return orc_tokens.token_digest(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: Models and tokenizers are beyond SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
