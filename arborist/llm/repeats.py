"""Which rows of a table of keyed places are not the first of their key, without gathering a key in one task.

Both substring operators hash pieces of every document. A map task keeps only its own first place of each key for the
shuffle and reports the others at once, so a key has at most one row a task; sorted streams then find the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborist.llm.common import binary

#: Columns of a place: two key halves, the document's id and tie-breaker, the place in it, and whether it is known to be repeated.
PLACES = "a bigint, b bigint, doc bigint, tie bigint, pos bigint, seen boolean"
NULL_ID = -(2**63)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__doc, __tie, __text): documents in their order; equal ids are told apart by a hash of the text, null comes first."""
    ids = docs.select(F.col(id_col).cast("bigint").alias("i"))
    unique = ids.groupBy("i").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    tie = F.lit(0).cast("bigint") if unique else F.xxhash64(text_col)
    return docs.select("*", F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("__doc"), tie.alias("__tie"), binary(text_col).alias("__text"))


def local_firsts(a: np.ndarray, b: np.ndarray, doc: np.ndarray, tie: np.ndarray, pos: np.ndarray, equal=None) -> pa.RecordBatch:
    """Places of one block: each key's first as it is, the others as seen, their keys replaced by a hash of the place.

    `equal` tells for rows, and rows of the firsts of their keys, whether what they stand for is the same; where it is not,
    the row goes on as a first of its own.
    """
    order = np.argsort(a)
    same = a[order][1:] == a[order][:-1]
    tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    rows = order[tied]
    order[tied] = rows[np.lexsort((pos[rows], tie[rows], doc[rows], b[rows], a[rows]))]
    a, b, doc, tie, pos = (x[order] for x in (a, b, doc, tie, pos))
    n = len(a)
    start = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][:n]
    first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    seen = (doc != doc[first]) | (tie != tie[first]) | (pos != pos[first])
    again = ~seen & ~start  # a repeated row
    if equal is not None and seen.any():
        at = np.flatnonzero(seen)
        seen[at[~equal(order[at], order[first[at]])]] = False
    spread = (doc * 0x9E3779B1 + pos * 0x85EBCA77) & 0x7FFFFFFFFFFF
    columns = [np.where(seen, spread, a), b, doc, tie, pos, seen]
    return pa.RecordBatch.from_arrays([pa.array(x[~again]) for x in columns], names=["a", "b", "doc", "tie", "pos", "seen"])


class Firsts:
    """Streams rows sorted by key and place; tells which are not the first place of their key."""

    def __init__(self) -> None:
        self.last: tuple | None = None

    def seen(self, batch: pa.RecordBatch) -> np.ndarray:
        a, b, doc, tie, pos, seen = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        n = len(a)
        start = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | seen[1:] | seen[:-1]]
        first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        fd, ft, fp = doc[first], tie[first], pos[first]
        if self.last and not seen[0] and self.last[:2] == (a[0], b[0]):
            head = first == 0
            fd, ft, fp = (np.where(head, x, y) for x, y in zip(self.last[2:], (fd, ft, fp), strict=True))
        out = seen | (doc != fd) | (tie != ft) | (pos != fp)
        self.last = None if seen[-1] else (a[-1], b[-1], fd[-1], ft[-1], fp[-1])
        return out


def sorted_by_key(places: DataFrame, tasks: int) -> DataFrame:
    return places.repartition(tasks, "a").sortWithinPartitions("a", "seen", "b", "doc", "tie", "pos")
