"""SimHash near-duplicates by tiled exact comparison of 64-bit fingerprints.

Equal fingerprints are one row. By the pigeonhole principle two fingerprints within `radius` bits agree on at
least one of `radius + 1` bands, so tiles are cut from the fingerprints that share a band's value. Within a tile
pair numpy takes exclusive-or and bit counts of whole blocks; blocks, and tile pairs of large bands, whose
population counts differ by more than the radius are skipped. A task emits a spanning forest of the links it
finds, never the pairs, and the forests' union is closed by connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborist.llm.common import arrow_rows, binary, cut, partitions, space_words
from arborist.llm.components import components, survivors

#: Fingerprints in one tile at most.
TILE = 4096
#: Rows of a block of the comparison inside a tile; two blocks of exclusive-ors stay in a core's cache.
BLOCK = 256


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; zero where there is no word."""
    words = space_words(text)
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    runs = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    n = len(words) - shingle + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in runs), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint as a signed long) for every row; null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            prints = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), binary(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, fingerprint bigint"
    )


def _pairs(prints: np.ndarray, pops: np.ndarray, radius: int, split: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Links inside one tile, or between its first `split` rows and the rest; each part is sorted by pops."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    n = len(prints)
    a, b = (0, n) if split is None else (split, n)
    for i in range(0, n if split is None else split, BLOCK):
        stop = min(i + BLOCK, n if split is None else split)
        for j in range(i if split is None else a, b, BLOCK):
            if pops[j] > pops[stop - 1] + radius:
                break
            end = min(j + BLOCK, b)
            if pops[end - 1] < pops[i] - radius:
                continue
            near = np.bitwise_count(prints[i:stop, None] ^ prints[None, j:end]) <= radius
            x, y = np.nonzero(near)
            keep = (x + i) < (y + j)
            left.append(x[keep] + i)
            right.append(y[keep] + j)
    return np.concatenate(left), np.concatenate(right)


def _small_groups(group: np.ndarray, prints: np.ndarray, pops: np.ndarray, radius: int):
    """Links of many small groups at once: rows against the next, the next but one, and so on."""
    left, right, here = [], [], np.arange(len(prints) - 1)
    step = 1
    while len(here):
        here = here[here + step < len(prints)]
        there = here + step
        same = (group[here] == group[there]) & (pops[there] - pops[here] <= radius)
        here, there = here[same], there[same]
        near = np.bitwise_count(prints[here] ^ prints[there]) <= radius
        left.append(here[near])
        right.append(there[near])
        step += 1
    none = [np.empty(0, np.int64)]
    return np.concatenate(none + left), np.concatenate(none + right)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row number reached from each of n rows over the links."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    return root


def _compare(radius: int):
    def links(group: np.ndarray, side: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        pops = np.bitwise_count(prints).astype(np.int64)
        order = np.lexsort((prints, pops, side, group))
        group, side, prints, pops = group[order], side[order], prints[order], pops[order]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(group)])
        sided = np.bitwise_or.reduceat(side, starts) > 0
        large = (sizes > 64) | sided
        small = np.repeat(~large, sizes)
        at = np.flatnonzero(small)
        a, b = _small_groups(group[at], prints[at], pops[at], radius) if len(at) > 1 else (at[:0], at[:0])
        lefts, rights = [at[a]], [at[b]]
        for k in np.flatnonzero(large):
            s, e = starts[k], starts[k] + sizes[k]
            split = int((side[s:e] == 0).sum()) if sided[k] else None
            x, y = _pairs(prints[s:e], pops[s:e], radius, split)
            lefts.append(x + s)
            rights.append(y + s)
        # one node for a fingerprint in all of this task's groups
        nodes, number = np.unique(prints.view(np.int64), return_inverse=True)
        root = forest(len(nodes), number[np.concatenate(lefts)], number[np.concatenate(rights)])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]) < 65536:
                continue
            # rows come sorted by group: all but the last group are complete
            whole = int(np.searchsorted(held[0] != held[0][-1], False)) if held[0][0] != held[0][-1] else 0
            if whole:
                yield links(held[0][:whole], held[1][:whole], held[2][:whole].view(np.uint64))
                held = [x[whole:] for x in held]
        if len(held[0]):
            yield links(held[0], held[1], held[2].view(np.uint64))

    return run


def link(prints: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Distinct fingerprints (column fingerprint) -> (u, v) edges whose closure links all within `radius` bits.

    Bands with more than `tile` fingerprints are cut into tiles of one population count and, where needed, a
    share of its hash; only tile pairs within the radius meet, each in a group of its own.
    """
    width = 64 // (radius + 1)
    mask = (1 << width) - 1
    bands = prints.select(
        "fingerprint",
        F.bit_count("fingerprint").cast("int").alias("pop"),
        F.posexplode(
            F.array(
                *[
                    F.shiftrightunsigned("fingerprint", k * width).bitwiseAND(F.lit(mask))
                    if k < radius
                    else F.shiftrightunsigned("fingerprint", k * width)
                    for k in range(radius + 1)
                ]
            )
        ).alias("band", "value"),
    ).withColumn("key", F.xxhash64("band", "value"))
    counts = bands.groupBy("key", "pop").agg(F.count("*").alias("n"))
    hot = counts.groupBy("key").agg(F.sum("n").alias("all")).where(F.col("all") > tile).select("key")
    tiles = counts.join(hot, "key", "left_semi").withColumn("shares", F.ceil(F.col("n") / F.lit(tile)).cast("int"))
    # for a tile's population count: all tiles of its band within the radius
    near = (
        tiles.select("key", F.explode(F.sequence(F.col("pop") - radius, F.col("pop") + radius)).alias("pop"),
                     F.struct(F.col("pop").alias("pop"), "shares").alias("other"))
        .groupBy("key", "pop").agg(F.collect_list("other").alias("others"))
    )
    near = tiles.select("key", "pop", "shares").join(near, ["key", "pop"])
    cold = bands.join(hot, "key", "left_anti").select(F.col("key").alias("group"), F.lit(0).cast("bigint").alias("side"), "fingerprint")
    mine = F.col("pop") * 1_000_000 + F.pmod(F.xxhash64("fingerprint"), F.col("shares"))
    theirs = F.flatten(
        F.transform("others", lambda o: F.transform(F.sequence(F.lit(0), o["shares"] - 1), lambda s: o["pop"] * 1_000_000 + s))
    )
    warm = (
        bands.join(near, ["key", "pop"])
        .select("key", "fingerprint", mine.alias("mine"), F.explode(theirs).alias("theirs"))
        .select(
            F.xxhash64("key", F.least("mine", "theirs"), F.greatest("mine", "theirs")).alias("group"),
            (F.col("mine") > F.col("theirs")).cast("bigint").alias("side"),
            "fingerprint",
        )
    )
    spark = prints.sparkSession
    return (
        cold.union(warm)
        .repartition(partitions(spark, 0, 1), "group")
        .sortWithinPartitions("group")
        .mapInArrow(_compare(radius), "u bigint, v bigint")
        .distinct()
    )


def _roots(prints: DataFrame, radius: int) -> DataFrame:
    """(fingerprint, root) of distinct fingerprints; root is the smallest one reached over links."""
    roots = components(link(prints, radius)).withColumnRenamed("node", "fingerprint")
    return prints.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for every row; component_id is the smallest id reached over links.

    A null text counts as an empty one: fingerprint 0, linked like any other. Repeated rows share fingerprint and
    component. A null id is never a component's id unless all its rows have a null id. Extra columns are ignored.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    prints = rows.groupBy("fingerprint").agg(F.min("id").alias("first"))
    labelled = _roots(prints, radius)
    firsts = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = labelled.join(firsts, "root").select("fingerprint", "component_id")
    return rows.join(classes, "fingerprint").select("id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns.

    Of rows of a component that repeat the smallest id, one stays; a row with a null id stays only where its whole
    component has null ids, one of them.
    """
    node = F.xxhash64(F.coalesce(binary(text_col), F.lit(b"")))
    texts = docs.select(node.alias("node"), F.col(text_col).alias("text"))
    found = cut(fingerprints(texts, "node", "text", shingle)).distinct()
    labels = found.join(_roots(found.select("fingerprint").distinct(), radius), "fingerprint")
    labels = labels.select(F.col("id").alias("__llm_node"), F.col("root").alias("__llm_root"))
    return survivors(docs.withColumn("__llm_node", node).join(labels, "__llm_node"), "__llm_root", id_col, docs.columns)
