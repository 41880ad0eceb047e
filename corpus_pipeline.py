"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage works on all that its predecessor kept.  All but the last return the columns of ``documents``;
``n_chars`` follows the text.

Null and empty texts pass every filter (as one empty window, one line, no shingle, no leak) and are packed as an end
token; equal rows are one document to near-dedup, which keeps one of them, and rows of their own to the other
stages; of ties the smallest doc_id stays, a null id before all others; long texts are worked on whole; other columns
go along untouched up to packing; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, lines, minhash, packing, toxicity
from tessera.llm.common import load, shared_dir
from tessera.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the model learns from the labelled rows outside the held-out fold."""
    rows = toxicity.sample(docs, load(spark, sf_dir, "labels"), toxicity.remainder("doc_id") == 1)
    return toxicity.keep_clean(docs, toxicity.train([t for t, _ in rows], [y for _, y in rows]))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line repeats up to one edit (exactly, if they are short)."""
    return lines.dedup(docs, short_repeats=True).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return minhash.dedup(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: SQL can't say a trained classifier, consistent sampling or a tokenizer: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
