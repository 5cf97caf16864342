"""SimHash near-duplicates, verified by the exact Jaccard similarity of sets of word shingles.

A text's fingerprint is a SimHash of BITS bits over its set of shingles; texts whose fingerprints differ in at most
`radius` bits are candidates. Sets of similarity s differ in each bit with probability acos(2s / (1 + s)) / pi or a
little more, independently, and the radius lies 7.2 deviations beyond the mean: 80 of 256 bits at 0.8. Comparison is
exact and tiled: equal fingerprints are one row, tiles hold sets of like size, and only tile pairs whose sizes allow the
similarity meet. In a tile pair numpy takes exclusive-or and bit counts of blocks, first of half the bits (radius 48), then,
for what is near in these, of all. By the binomial law a pair at 0.8 is missed with probability 2e-10; small sets differ
in more bits, the worst of all (four shingles in five) with 8e-7. A task gives a spanning forest, never pairs.

Connected candidates meet in a task, which holds their shingle sets against each other, so a link is never a guess.
Equal texts are one node, and a task gives every text the smallest one it is linked to. `band_edges` finds candidates by
MinHash instead: a pair of similarity s agrees in no band with probability (1 - s ** ROWS) ** BANDS, 5e-8 at 0.8. Only
tests use it, as a second opinion.

Over TILE connected candidates are a crowd, and no task holds one: all are compared with the crowd's first text, each
in its place, and those that are linked to it are one class. The others, and the class, are cut into tiles; only pairs of
tiles with one of the others' meet, in a task each, and the links found are closed by connected components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborist.llm.common import arrow_rows, cut, partitions, space_words
from arborist.llm.components import components, survivors
from arborist.llm.simhash import forest

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, 64 to a word; fingerprints in a tile, about; links that a tile's task holds at once, about.
BITS, PRINTS, LINKS = 256, 32_768, 1 << 18
#: Rows and columns of a block of the comparison inside a tile pair; long rows suit numpy.
ROW_BLOCK, COLUMN_BLOCK = 32, 4096
BANDS, ROWS = 32, 4
#: Nodes of a table that is broadcast at most.
BROADCAST = 200_000
#: Texts of connected candidates that one task holds, and bytes of first texts that are broadcast at most.
TILE, BROADCAST_BYTES = 1024, 64 << 20

_DRAW = np.random.Generator(np.random.PCG64(42))
_TIMES = _DRAW.integers(0, 2**64, BANDS * ROWS, np.uint64)[:, None] | np.uint64(1)
_FLIP = _DRAW.integers(0, 2**64, BANDS * ROWS, np.uint64)[:, None]


_SEEDS = _DRAW.integers(0, 2**64, BITS // 64, np.uint64)


def _mix(h: np.ndarray, new: np.ndarray) -> np.ndarray:
    h = (h ^ new) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; a shorter text is one shingle, one without words has none."""
    words = space_words(text)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(each))
    n = len(each) - size + 1 if size else 0
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = _mix(h, each[k : k + n])
    return np.unique(h)


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes, as words of 64 bits; zero for the empty set."""
    ones = np.zeros(BITS, np.int64)
    # counts of up to 255 rows fit a byte
    for at in range(0, len(found), 255):
        h = found[at : at + 255, None] + _SEEDS
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)


def radius(bits: int, similarity: float) -> int:
    """Differing bits up to which fingerprints are near: 7.2 deviations beyond the mean of sets of the given similarity."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + 7.2 * np.sqrt(bits * p * (1 - p)))


def size_bounds(similarity: float) -> np.ndarray:
    """Smallest sizes of classes of sets; sizes that allow the similarity lie in one class or in two that follow each other."""
    bounds = [0, 1]
    while bounds[-1] < 2**31:
        bounds.append(max(bounds[-1] + 1, int((bounds[-1] - 1) / similarity + 1e-6) + 1))
    return np.array(bounds)


def _flat(found: np.ndarray) -> np.ndarray:
    """Places of the few true values, eight looked at together."""
    flat = found.reshape(-1)
    whole = len(flat) & ~7
    at = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
    at = at[flat[at]]
    return np.concatenate([at, np.flatnonzero(flat[whole:]) + whole]) if whole < len(flat) else at


def reached(prints: np.ndarray, sizes: np.ndarray, split: int | None, similarity: float = SIMILARITY) -> np.ndarray:
    """The smallest row reached from each row over near fingerprints (a column each) in one tile, or between its first `split` rows and the rest.

    Each part is sorted by size.
    """
    n, half = len(sizes), len(prints) // 2
    narrow, wide = radius(64 * half, similarity), radius(64 * len(prints), similarity)
    root, left, right, held = np.arange(n), [], [], 0

    def close() -> np.ndarray:
        none = [np.empty(0, np.int64)]
        return forest(n, root[np.concatenate(none + left)], root[np.concatenate(none + right)])[root]

    for i in range(0, n if split is None else split, ROW_BLOCK):
        stop = min(i + ROW_BLOCK, n if split is None else split)
        start = i if split is None else split
        start += int(np.searchsorted(sizes[start:], similarity * sizes[i] - 1e-9))
        last = int(np.searchsorted(sizes[start:], (sizes[stop - 1] + 1e-9) / similarity, "right")) + start
        for j in range(start, last, COLUMN_BLOCK):
            end = min(j + COLUMN_BLOCK, last)
            bits = np.bitwise_count(prints[0][i:stop, None] ^ prints[0][None, j:end])
            for word in prints[1:half]:
                bits += np.bitwise_count(word[i:stop, None] ^ word[None, j:end])
            at = _flat(bits <= narrow)
            a, b = at // (end - j) + i, at % (end - j) + j
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            if not len(a):
                continue
            bits = np.zeros(len(a), np.int64)
            for word in prints:
                bits += np.bitwise_count(word[a] ^ word[b])
            fits = np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]) - 1e-9
            close_by = (bits <= wide) & fits
            left.append(a[close_by])
            right.append(b[close_by])
            held += len(left[-1])
            if held > LINKS:
                root, left, right, held = close(), [], [], 0
    return close()


def band_keys(found: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set; the empty set has a key of its own."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), 1024):
        h = found[None, at : at + 1024] ^ _FLIP
        h *= _TIMES
        np.minimum(least, h.min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = _mix(keys, column)
    return keys


def linked(sets: list[np.ndarray], similarity: float = SIMILARITY, known: np.ndarray | None = None) -> np.ndarray:
    """For each set, the number of one in its component; sets of at least the given similarity, or equal in `known`, are linked.

    Each set meets the earlier ones of a size that allows a link, until they all are in its own component.
    """
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    _, codes = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mark = np.zeros(len(codes) + 1, np.int64)
    label = np.arange(len(sets))
    if known is not None:
        _, first, which = np.unique(known[order], return_index=True, return_inverse=True)
        label = first[which]
    for d in range(1, len(sets)):
        mine = codes[starts[d] : ends[d]]
        mark[mine] = 1
        low = int(np.searchsorted(sizes, similarity * sizes[d] - 1e-9))
        high, step = d, 16
        while high > low:
            at = max(low, high - step)
            others = at + np.flatnonzero(label[at:high] != label[d])
            if len(others):
                if sizes[d] == 0:
                    near = others
                else:
                    spread = np.concatenate([codes[starts[k] : ends[k]] for k in others])
                    first = np.cumsum(sizes[others]) - sizes[others]
                    both = np.add.reduceat(mark[spread], first)
                    near = others[both >= similarity * (sizes[others] + sizes[d] - both) - 1e-9]
                if len(near):
                    label[np.isin(label, label[near])] = label[d]
            high, step = at, min(step * 2, 1024)
        mark[mine] = 0
    out = np.empty(len(sets), np.int64)
    out[order] = order[label]
    return out


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, node) -> edges to the first node of each key."""
    key = first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes = (batch.column(k).to_numpy() for k in range(2))
        new = np.r_[key is None or keys[0] != key, keys[1:] != keys[:-1]]
        at = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
        firsts = np.where(at >= 0, nodes[at], first if first is not None else 0)
        key, first = keys[-1], firsts[-1]
        apart = firsts != nodes
        pairs = np.unique(np.stack([firsts[apart], nodes[apart]], 1), axis=0)
        yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def _crowds(near: DataFrame, tile: int, shingle: int, similarity: float) -> DataFrame:
    """(root, n, node, text) of crowds of n connected candidates -> (node, root) of the nodes that are linked to another one."""
    spark = near.sparkSession

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, np.empty(0, np.uint64)
        for batch in arrow_rows(batches):
            found = []
            for root, node, text, center in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if root != last:
                    last, first = root, shingles(center, shingle)
                mine = shingles(text, shingle)
                both = np.intersect1d(mine, first, assume_unique=True).size
                found.append(node == root or both >= similarity * (len(mine) + len(first) - both) - 1e-9)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found)], ["root", "node", "covered"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, covered, sets = None, [], [], []

        def links() -> pa.RecordBatch:
            at = np.array(nodes, np.int64)
            known = np.where(covered, -1, np.arange(len(at)))
            label = linked(sets, similarity, known)
            least = np.full(len(at), 2**63 - 1, np.int64)
            np.minimum.at(least, label, at)
            apart = np.flatnonzero(least[label] != at)
            return pa.record_batch([pa.array(least[label][apart]), pa.array(at[apart])], ["u", "v"])

        for batch in arrow_rows(batches):
            for g, node, c, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if g != group and nodes:
                    yield links()
                    nodes, covered, sets = [], [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    covered.append(c)
                    sets.append(shingles(text, shingle))
                group = g
        if nodes:
            yield links()

    centers = near.where("node = root").select("root", F.col("text").alias("center"))
    size = centers.agg(F.coalesce(F.sum(F.octet_length("center")), F.lit(0))).first()[0]
    centers = F.broadcast(centers) if size <= BROADCAST_BYTES else centers
    covered = near.select("root", "node", "text").join(centers, "root").mapInArrow(cover, "root bigint, node bigint, covered boolean")
    covered = cut(covered)
    counts = covered.groupBy("root").agg(F.count_if("covered").alias("c"), F.count_if(~F.col("covered")).alias("u"))
    shares = counts.select("root", *[F.ceil(F.col(k) / F.lit(tile)).cast("int").alias(k) for k in ("c", "u")]).where("u > 0")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("covered"), F.col("c")).otherwise(F.col("u"))).cast("int")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    inside = F.transform(upto("u"), lambda k: F.xxhash64("root", F.lit(0), F.least(F.col("own"), k), F.greatest(F.col("own"), k)))
    across = F.transform(upto("c"), lambda k: F.xxhash64("root", F.lit(1), F.col("own"), k))
    mine = F.when(F.col("covered"), F.transform(upto("u"), lambda k: F.xxhash64("root", F.lit(1), k, F.col("own")))).otherwise(F.concat(inside, across))
    placed = covered.join(shares, "root").withColumn("own", own).select("root", "node", "covered", F.explode(mine).alias("group"))
    groups = placed.join(near.select("root", "node", "text"), ["root", "node"]).select("group", "node", "covered", "text")
    tiles = groups.repartition(partitions(spark, 0, 1), "group").sortWithinPartitions("group", "node").mapInArrow(verify, "u bigint, v bigint")
    stars = covered.where("covered AND node != root").select(F.col("root").alias("u"), F.col("node").alias("v"))
    return components(stars.union(tiles))


def print_edges(texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, tile: int = PRINTS) -> DataFrame:
    """(node, text as bytes) -> (u, v) edges whose closure links all nodes with near fingerprints, by tiled comparison."""
    spark, tasks = texts.sparkSession, partitions(texts.sparkSession, 0, 1)
    words = [f"f{k}" for k in range(BITS // 64)]
    bounds = size_bounds(similarity)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            sets = [shingles(x, shingle) for x in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in sets], np.int64)
            prints = np.array([fingerprint(x) for x in sets], np.uint64).reshape(-1, len(words)).view(np.int64)
            level = np.searchsorted(bounds, sizes, "right") - 1
            yield pa.record_batch([batch.column(0), pa.array(level), pa.array(sizes), *map(pa.array, prints.T.copy())], ["node", "level", "size", *words])

    longs = ", ".join(f"{w} bigint" for w in words)
    prints = cut(texts.mapInArrow(sketch, f"node bigint, level bigint, size bigint, {longs}").distinct())
    # equal fingerprints of one size are one row, that of the smallest node
    stars = prints.select(F.xxhash64("size", *words).alias("key"), "node")
    stars = stars.repartition(tasks, "key").sortWithinPartitions("key", "node").mapInArrow(_stars, "u bigint, v bigint")
    firsts = cut(prints.groupBy("level", "size", *words).agg(F.min("node").alias("node")))
    # one number for each level of sizes, of which there are about a hundred
    counts = {r["level"]: r["count"] for r in firsts.groupBy("level").count().collect()}
    shares = np.array([-(-counts.get(k, 0) // tile) for k in range(len(bounds) + 1)])
    starts = np.r_[0, np.cumsum(shares)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            level, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # multiplied, as nodes that are hashes of one partition share their remainders
            spread = (node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own = starts[level] + (spread % shares[level].astype(np.uint64)).astype(np.int64)
            low = starts[np.maximum(level - 1, 0)]
            times = starts[level + 2] - low
            at = np.repeat(np.arange(len(own)), times)
            other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + low[at]
            group = np.minimum(own[at], other) * (starts[-1] + 1) + np.maximum(own[at], other)
            rest = [c.take(pa.array(at)) for c in batch.columns[1:]]
            yield pa.record_batch([pa.array(group), pa.array((own[at] > other).astype(np.int64)), *rest], ["group", "side", "node", "size", *words])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def links() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            _, side, node, size, *prints = (rows.column(k).to_numpy() for k in range(rows.num_columns))
            split = int((side == 0).sum()) if alone < 0 else None
            root = reached([np.ascontiguousarray(w).view(np.uint64) for w in prints], size, split, similarity)
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pa.record_batch([pa.array(node[root[moved]]), pa.array(node[moved])], ["u", "v"])

        last = alone = None
        for batch in batches:
            groups = batch.column(0).to_numpy()
            cuts = np.r_[0, np.flatnonzero(groups[1:] != groups[:-1]) + 1, len(groups)] if len(groups) else []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if groups[s] != last and held:
                    yield links()
                    held = []
                last = groups[s]
                one, two = divmod(int(last), int(starts[-1]) + 1)
                alone = one if one == two else -1
                held.append(batch.slice(s, e - s))
        if held:
            yield links()

    dealt = firsts.select("level", "node", "size", *words).mapInArrow(deal, f"group bigint, side bigint, node bigint, size bigint, {longs}")
    # sorted to the last column, as a forest depends on the order, and written once: whoever reads it twice must see one forest
    dealt = dealt.repartition(tasks, "group").sortWithinPartitions("group", "side", "size", "node")
    return cut(stars.union(dealt.mapInArrow(compare, "u bigint, v bigint")).distinct())


def band_edges(texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(node, text as bytes) -> (u, v) edges whose closure links all nodes that agree in a MinHash band."""
    tasks = partitions(texts.sparkSession, 0, 1)

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            nodes = batch.column(0).to_numpy()
            keys = [band_keys(shingles(x, shingle)) for x in batch.column(1).to_pylist()]
            both = np.stack([np.concatenate(keys).view(np.int64), np.repeat(nodes, BANDS)], 1)
            both = np.unique(both, axis=0)
            yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], ["key", "node"])

    edges = texts.mapInArrow(bands, "key bigint, node bigint").repartition(tasks, "key").sortWithinPartitions("key", "node")
    return edges.mapInArrow(_stars, "u bigint, v bigint").distinct()


def roots(
    texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, tile: int = TILE, edges: Callable[..., DataFrame] | None = None
) -> DataFrame:
    """(node, text as bytes) -> (node, root) of the nodes that are linked to another one; candidates by `edges`, else by fingerprints."""
    spark = texts.sparkSession

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets = None, [], []

        def links() -> pa.RecordBatch:
            label = linked(sets, similarity)
            at = np.array(nodes, np.int64)
            least = np.full(len(at), 2**63 - 1, np.int64)
            np.minimum.at(least, label, at)
            many = np.bincount(label, minlength=len(at))[label] > 1
            return pa.record_batch([pa.array(at[many]), pa.array(least[label][many])], ["node", "root"])

        for batch in arrow_rows(batches):
            for g, node, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if g != group and nodes:
                    yield links()
                    nodes, sets = [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    sets.append(shingles(text, shingle))
                group = g
        if nodes:
            yield links()

    tasks = partitions(spark, 0, 1)
    candidates = cut(components((edges or print_edges)(texts, shingle, similarity)))
    crowds = candidates.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    crowded = not crowds.isEmpty()
    found = None
    if crowded:
        crowds = cut(crowds)
        # equal texts are one row from here on
        many = texts.join(small(candidates.join(small(crowds), "root")), "node").select("root", "node", "text").dropDuplicates(["root", "node"])
        found = _crowds(cut(many), tile, shingle, similarity)
        candidates = cut(candidates.join(small(crowds), "root", "left_anti").select("node", "root"))
    near = texts.join(small(candidates), "node").select("root", "node", "text")
    few = cut(near.repartition(tasks, "root").sortWithinPartitions("root", "node").mapInArrow(verify, "node bigint, root bigint"))
    return few if found is None else few.union(found.select("node", "root"))


def small(table: DataFrame) -> DataFrame:
    """A checkpointed table, to be broadcast where it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST else table


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, tile: int = TILE, edges: Callable[..., DataFrame] | None = None) -> DataFrame:
    """One document of each component of near-duplicates, with all its columns; see `survivors` for which.

    A null text counts as an empty one; texts without a word are alike.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    node = F.xxhash64(text)
    found = roots(docs.select(node.alias("node"), text.alias("text")), shingle, similarity, tile, edges)
    found = small(found.select(F.col("node").alias("__llm_node"), F.col("root").alias("__llm_linked")))
    rows = docs.withColumn("__llm_node", node).join(found, "__llm_node", "left")
    return survivors(rows.withColumn("__llm_root", F.coalesce("__llm_linked", "__llm_node")), "__llm_root", id_col, docs.columns)
