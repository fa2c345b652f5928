"""The registered queries of this subpackage: thin uses of the operators on whole tables, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extraction, mixing, pieces, quality_classifier, quality_rules, sharding, simhash, substring_dedup, topk, url_filter
from .common import read

#: The url rules of the filter's query.
URL_RULES = [
    url_filter.Rule.parse("com/en/", "block"),
    url_filter.Rule.parse("example.com/en/7", "allow"),
    url_filter.Rule.parse("net/de/", "allow"),
    url_filter.Rule.parse("example.net/de/8", "block"),
    url_filter.Rule.parse("org/es/", "block"),
]

SHARDS = 16

#: A SentencePiece model's file, read by the driver alone.
PIECES = os.environ.get("SHARDLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def levels() -> dict[str, Column]:
    """The mixture's tree: a source's domain, its documents' language, and the source."""
    number = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    domain = F.when(number < 10, "web").when(number < 15, "reference").otherwise("other")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


#: Of the tree's nodes among their siblings; sources weigh alike.
WEIGHTS = {("web",): 5, ("reference",): 3, ("other",): 2} | {(d, lang): w for d in ("web", "reference", "other") for lang, w in (("en", 6), ("de", 2), ("fr", 2), ("es", 1))}


def pieces_vocabulary() -> pieces.Vocabulary:
    return pieces.Vocabulary.load(PIECES)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, read(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs.select("doc_id", "source", "lang", "text"), model)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(read(spark, sf_dir, "pages"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"), SHARDS)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), pieces_vocabulary())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents")).drop("host")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), levels(), WEIGHTS, fraction=0.8, epochs=4, seed=11).select("doc_id", "epoch")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_quality_classifier, op3_html_extraction, op4_url_filter, op5_sharding, op6_substring_dedup, op7_topk, op8_sentencepiece, op9_quality_rules, op10_mixing)
}
