"""Registered queries ``op1_`` to ``op13_`` and ``pipeline``: each applies its
operator with production parameters to its whole table and derives the digest
columns from what the operator returns."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm import (ann, common, decontam, licenses, neardup, packing, quality, secret_scan, sharding, substring,
                           token_files, turn_repair, url_rules, whitening)
from codesieve.llm.oracles import ORACLES  # noqa: F401
from codesieve.session import table_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@register
def op1_secret_scan(spark, sf_dir):
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
                        count("novel"))


@register
def op2_license_scan(spark, sf_dir):
    return licenses.digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


@register
def op3_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


@register
def op4_kd_shards(spark, sf_dir):
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@register
def op5_quality_select(spark, sf_dir):
    scored = quality.select_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.where("selected").select("doc_id", "n_tokens", "log_weight", "key")


@register
def op6_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, 2)


@register
def op7_window_dedup(spark, sf_dir):
    kept = substring.deduplicate_windows(table(spark, sf_dir, "documents"), size=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join("kept_words", " "), 256).alias("kept_sha256"))


@register
def op8_decontaminate(spark, sf_dir):
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op9_token_files(spark, sf_dir):
    path = common.scratch(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 0)
    out = common.cut(token_files.read_token_files(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")))
    common.discard(spark, path)
    return out


@register
def op10_nearest(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@register
def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


@register
def op12_url_rules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = url_rules.judged(pages, url_rules.labelled_urls(pages, table(spark, sf_dir, "labels")))
    return found.select("page_id", "host", "path", "rule", "verdict", F.array_join(F.col("mined")["tokens"], " ").alias("mined_rule"))


@register
def op13_turn_repair(spark, sf_dir):
    return turn_repair.repair_digest(table(spark, sf_dir, "conversations"))


QUERIES["pipeline"] = corpus_pipeline.run
