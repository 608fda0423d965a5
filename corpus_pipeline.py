"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``:

* ``quality`` drops documents that importance resampling does not select;
* ``near_dedup`` leaves one document of each near-duplicate group (five-word
  shingles, similarity 0.8);
* ``decontaminate`` drops documents that hold a benchmark item;
* ``secrets`` masks every secret in the text and counts ``n_chars`` again;
* ``pack`` returns the packed pieces.

Null or empty texts and null ids follow each operator's docstring; an empty
table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codesieve.llm import common, decontam, neardup, packing, quality, secret_scan
from codesieve.session import prepare, table_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.keep_selected(docs, _table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return neardup.keep_one(docs, shingle_words=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontam.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secret_scan.redact_secrets(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 2)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage),
          ("secrets", secrets_stage), ("pack", pack_stage)]

#: Neither model scores nor edit distances nor tokens can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is kept in the
    shared checkpoint folder only until the next stage has been written."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = common.scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.discard(spark, before)
        before = path
    out = common.cut(STAGES[-1][1](spark, docs, sf_dir))
    common.discard(spark, before)
    return out
