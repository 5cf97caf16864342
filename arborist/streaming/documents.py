"""Structured Streaming over folders of documents: stateless shredding, and per-batch queries and validation.

No operator of the engine spans documents, so nothing needs state or watermarks; a batch's documents are complete.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arborist.sources.shred import Limits, shred

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def documents(spark: SparkSession, path: str, most_files: int = 1000) -> DataFrame:
    """A stream of (doc_id, uri, xml) of the files that arrive below a path."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", most_files).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("uri"), F.col("content").alias("xml"))


def nodes(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """A stream of node rows."""
    return shred(documents(spark, path), uri_col="uri", limits=limits)[0]


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs `work` (a query, transformation or validation of a batch's documents) and appends its rows as Parquet.

    A batch that is run again after a failure overwrites its own folder, so results are written exactly once.
    """

    def run(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
