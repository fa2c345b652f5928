"""The corpus pipeline: documents through the training-data operators, stage by stage.

Every stage takes all documents that its predecessor kept. All but the last
return the columns of documents; the last returns tokens.

Nulls, empty and very long texts, ties and repeated rows are taken as the
stages' operators state. Stages read the columns of documents alone, so others
may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import mixing, near_copies, pieces, quality_classifier, queries, substring_dedup
from shardloom.llm.common import read, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    model = quality_classifier.train(docs, read(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs.select(*COLUMNS), model, with_rows=True).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id: five-word shingles, Jaccard similarity of 0.8 or more.

    Rows that share an id but not their words are judged each by its own text.
    """
    return near_copies.near_duplicates(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start in an earlier one; documents of which nothing is left go."""
    clean = substring_dedup.deduplicate(docs.select(*COLUMNS), with_text=True)
    clean = clean.where("n_removed = 0 OR n_removed < n_words").withColumn("text", F.col("kept_text"))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mixture, once for each epoch that they are in."""
    return mixing.mix(docs.select(*COLUMNS), queries.levels(), queries.WEIGHTS, fraction=1.0, epochs=2, seed=11).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the tokens of every document."""
    return pieces.encode(docs.select("doc_id", "lang", "source", "text"), queries.pieces_vocabulary())


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing", mixture),
    ("SentencePiece encoding", tokens),
]

#: Hashes and learned weights are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for the table documents; what each stage keeps is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
