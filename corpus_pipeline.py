"""A corpus in five stages: without toxic texts, without near copies, without secrets, mixed, and as token ids.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one
before kept; all but the last return the columns of documents.

Defined cases: as the operators define them. Null and empty texts pass every
filter unless equal to an earlier text; very long texts are taken whole; an empty
documents table gives an empty result; other columns travel along as far as mixing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import load, stage_written
from tessera.llm.mixing import mixed
from tessera.llm.pieces import encode
from tessera.llm.secrets import redact
from tessera.llm.simhash import keep_one
from tessera.llm.toxicity import without_toxic

#: The most copies of a document, by its likeliest domain.
MOST_RATE = {"clean": 4.0, "poor": 1.0, "toxic": 1.0}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return without_toxic(docs, load(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret is replaced by its kind."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that the domains' tokens meet the target weights; clean ones stay."""
    return mixed(docs, load(spark, sf_dir, "labels"), most=MOST_RATE, floor=1.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip."""
    return encode(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("tokens", tokens)]

#: Learned models and components are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what no later stage reads is deleted."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage_written(docs, lambda at, stage=stage: stage(spark, at, sf_dir))
    return docs
