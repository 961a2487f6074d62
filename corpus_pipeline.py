"""From raw documents to packed sequences: five stages, each a training-data operator whose decisions take effect.

Every stage but the last returns the columns of ``documents``. Stages are written as Parquet and read again, so
each starts from stored rows, and a lost executor costs no more than the stage's own work.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girderlake.llm import complement_packing, language_vectors, minhash_star, quality_lines, store, suffix_trees

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Cosine with the nearest language below which a text is of no language at all; clean short sentences have 0.3 and more.
LEAST_SCORE = 0.1
#: Rows of whole texts that go to a Python worker at once.
ARROW_ROWS = "1000"


def _ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def _columns(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without lines that too many documents of their host share."""
    _ready(spark)
    return _columns(quality_lines.clean(docs.select(*COLUMNS)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is of some language that the labelled documents teach; if none teaches any, all with letters."""
    _ready(spark)
    prototypes = language_vectors.learn(docs)
    if not prototypes:
        return language_vectors.lettered(docs.select(*COLUMNS))
    told = language_vectors.predict(docs, prototypes, keep=COLUMNS[1:])
    return told.where((F.col("lang_pred") != language_vectors.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, 0.8 or more in common."""
    _ready(spark)
    return minhash_star.one_of_each(docs, shingle=5, percent=80).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 words and more that stand earlier in the corpus."""
    _ready(spark)
    done = suffix_trees.remove_repeated_passages(docs, width=20, keep=("lang", "source"), whole_if_clean=True)
    return _columns(done.withColumnRenamed("kept_text", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, each with its sequence of at most 4096 tokens and its place there."""
    _ready(spark)
    return complement_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("quality rules", quality), ("language ID", language), ("MinHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("best-fit packing", packing)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the folder of spark.checkpoint.dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = store.until_exit(spark, f"{store.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
