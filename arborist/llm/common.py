"""Helpers shared by the corpus operators: shared folders, byte-level words, Arrow batches."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII bytes that are not part of a word of letters and digits become spaces, A-Z become a-z.
_ALNUM = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Leave the cluster's ``spark.checkpoint.dir`` alone; set a temporary one only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="arborist-checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def space_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, as UTF-8 bytes; null has none."""
    return text.lower().split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters and digits and of characters beyond ASCII; null has none."""
    return text.translate(_ALNUM).split() if text else []


def binary(name: str) -> Column:
    """The UTF-8 bytes of a string column."""
    return F.col(name).cast("binary")


def arrow_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `rows`, so that long texts do not pile up as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def partitions(spark: SparkSession, rows: int, per: int) -> int:
    """Partitions for `rows` rows of which a task takes about `per`, no fewer than the session's default."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per))
