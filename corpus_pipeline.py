"""The corpus pipeline: five stages, each written as Parquet and read again by the next one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from arborist.llm import decontaminate, quality, sentences, shingles
from arborist.llm.common import ensure_checkpoint_dir
from arborist.llm.queries import packed, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted, without their hosts' common lines.

    Exact copies count as one document of a host. A null text has no words and goes; a null host is a host of its own;
    repeated rows share their fate; an empty table gives none; other columns stay.
    """
    return quality.clean(docs, copies=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every component of texts that share 0.8 of their five-word shingles.

    SimHash: fingerprints of those shingles are compared in tiles, and what is near is verified on the shingles themselves.
    Null and empty texts are equal; of rows that repeat an id in a component one stays, and a null id only where its
    whole component has none.
    """
    return shingles.keep_first(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without sentence spans that an earlier document or place has.

    Null texts stay, null ids come first, rows repeated with id and text do not remove each other's sentences; documents
    of which nothing is left go.
    """
    return sentences.clean(docs, extend=True)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that mostly consist of such passages go. Null texts and items have no words."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into sequences; a null text is one closing token."""
    return packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash", near_duplicates),
    ("sentence_spans", substrings),
    ("decontaminate", decontaminated),
    ("best_fit", packing),
]

#: Fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what passes between them lies in the shared checkpoint folder.

    A stage's folder goes when the next one is written; that of the last but one stays, as the result is read from it.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            here = f"{folder}/{k}-{name}"
            docs.write.parquet(here)
            docs = spark.read.parquet(here)
            if last is not None:
                _delete(spark, last)
            last = here
    return docs


def _delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder where the cluster has it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
