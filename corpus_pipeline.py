"""A training corpus from `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of `documents`.  `run` writes each result as Parquet into the
cluster's shared checkpoint folder and hands the next stage what it reads back.
SQL cannot express the stages; the tests hold them against brute force.
"""

from __future__ import annotations

import os
import sys

# Executors get the package with the session; the driver finds it beside this file.
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession

from pagefold.llm import bpe, lines, mixing, neardup, quality
from pagefold.llm.graph import staged
from pagefold.session import ensure_session_defaults, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    ensure_session_defaults(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every line that is near one of an earlier document or line, and
    documents that lose all their lines."""
    ensure_session_defaults(spark)
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near duplicates."""
    ensure_session_defaults(spark)
    return neardup.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents up to twice, so that sources reach their target weights."""
    ensure_session_defaults(spark)
    return mixing.resample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of their decoding."""
    ensure_session_defaults(spark)
    return bpe.encoding_digests(docs, tokens=True)


STAGES = [("quality", good_quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", source_mix), ("bpe", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    ensure_session_defaults(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
