"""The corpus pipeline: documents in, token digests of the training mix out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's documents:

1. quality: documents that the line labeller or the base rules reject go;
2. near_duplicates: one document of each group linked by 5-gram Jaccard similarity of 0.8 stays;
3. pii: personal data is replaced by its kind in angle brackets;
4. mixing: sources are brought to their target words, a row per copy taken, in training order;
5. bpe: texts become token ids, as digests with their decoded text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import bpe, jaccard, mixing, pii, quality
from inkwell.session import table, work_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the labeller learns from the labels beside the documents."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_one(docs)


def cover_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes."""
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix."""
    return bpe.encode(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("pii", cover_pii),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: The labeller and the tagger have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; stages meet as Parquet in the shared folder.

    A stage's folder goes once the next one is written, so that of the last but one alone stays, which the result
    reads.
    """
    top = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before is not None:
            remove(spark, before)
        before = f"{top}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
