"""Exact removal of repeated byte strings with suffix arrays.

A byte goes if a window of `window` bytes that covers it also starts earlier. Three steps:

1. Anchors. The minimum-hash k-mer of every window (a minimizer) depends on the window's bytes only, so equal windows
   have equal anchors at the same distance. A place's context is all that windows over its anchor can reach.
   Sorted streams over hashes of (anchor, context) find places whose whole context seems to have occurred before, and
   the first places of contexts whose anchor has other contexts as well; all other windows are unique or first. What
   seems to have occurred is compared byte by byte: in a block of texts at once, else joined along with its source into
   spans, whose bytes the source sends.
2. Suffix arrays. The differing contexts of an anchor lie in one shard: their bytes get a suffix array by
   Larsson-Sadakane refinement in numpy and common prefixes by Kasai's rule, whose runs of `window` or more are equal
   windows. Anchors with more contexts than a shard holds are spread over several shards, whose arrays are merged by
   binary search.
3. The windows found are joined to their documents as spans, and spans of other documents are removed as far as they equal
   their sources for a window or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborist.llm.common import arrow_rows, cut
from arborist.llm.repeats import NULL_ID, PLACES, keyed, local_firsts

WINDOW, KMER = 100, 32
#: Bytes of text hashed at a time, and bytes of contexts in one suffix array.
BLOCK_BYTES, SHARD_BYTES = 1 << 19, 1 << 20
#: Anchors with more differing contexts than this compare their windows by hash, grouped by Spark.
HOT_CONTEXTS = 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_ODD = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_powers: list[np.ndarray] = []  # of the base and of its inverse, as long as was needed


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n, 2 * BLOCK_BYTES), x)]) for x in (_BASE, _INVERSE)]
    return _powers


def _words(data: np.ndarray) -> np.ndarray:
    """Little-endian 64-bit words starting at every byte; data must have 7 bytes to spare."""
    n = len(data) - 7
    out = np.empty(n, np.uint64)
    for s in range(8):
        m = (n - s + 7) // 8
        if m > 0:
            out[s::8] = np.frombuffer(data[s : s + 8 * m].tobytes(), np.uint64)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


#: A random-looking value for each byte.
_BYTES = _mixed(np.arange(256, dtype=np.uint64) + np.uint64(0x1234567))


class Anchors:
    """Anchors of a block of texts laid end to end, with their contexts."""

    def __init__(self, texts: list[bytes], window: int = WINDOW, kmer: int = KMER) -> None:
        width = window - kmer + 1
        self.data = data = np.frombuffer(b"".join(texts) + bytes(kmer + 8), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        n = int(ends[-1]) if len(ends) else 0
        self.doc = np.empty(0, np.int64)
        self.at = self.left = self.right = np.empty(0, np.int64)
        self.anchor = self.context = np.empty(0, np.uint64)
        if not (sizes >= window).any():
            return
        words = _words(data)
        words = _mixed(words)
        key = words[:n] * _ODD[0]
        for j, k in enumerate(range(8, kmer, 8), 1):
            at = min(k, kmer - 8)
            key += words[at : at + n] * _ODD[j % 4]
        key ^= key >> np.uint64(31)
        # windows that lie in one text; a k-mer that crosses a boundary is in none of them
        low = (key & ~np.uint64(0xFFFFFFFF)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
        best = _sliding_min(low, width)
        inside = np.ones(len(best), bool)
        for e in ends[:-1].tolist():
            inside[max(0, e - window + 1) : e] = False
        inside[max(0, n - window + 1) :] = False
        picked = np.zeros(n, bool)
        picked[(np.uint64(0xFFFFFFFF) - (best[inside[: len(best)]] & np.uint64(0xFFFFFFFF))).astype(np.int64)] = True
        self.at = at = np.flatnonzero(picked)
        self.doc = doc = np.searchsorted(ends, at, side="right")
        self.left = np.minimum(at - starts[doc], width - 1)
        self.right = np.minimum(ends[doc] - at, window)
        self.start = starts
        self.anchor = key[at]
        # hash of a context: a difference of weighted prefix sums, brought to weight one
        power, inverse = _power(n)
        values = _BYTES[data[:n]]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * power[:n], out=total[1:])
        a, b = at - self.left, at + self.right
        self.context = _mixed((total[b] - total[a]) * inverse[a] + self.left.astype(np.uint64) * np.uint64(1009) + self.right.astype(np.uint64))


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes of the bytes in order, by Larsson-Sadakane: only groups of equal rank are sorted again, by the rank h further on.

    Starts from the first seven bytes and the number of bytes that are there, so h is 7, 14, 28 and so on.
    """
    n = len(data)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    first = np.zeros(n, np.uint64)
    for k in range(7):
        first = (first << np.uint64(8)) | padded[k : k + n].astype(np.uint64)
    first = (first << np.uint64(8)) | np.minimum(n - np.arange(n), 7).astype(np.uint64)
    order = np.argsort(first, kind="stable")
    ranked = first[order]
    start = np.r_[True, ranked[1:] != ranked[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    head = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    rank[order] = head
    h = 7
    while True:
        # places in the order whose group is not single
        single = start & np.r_[start[1:], True]
        open_ = np.flatnonzero(~single)
        if not len(open_):
            return order
        suffix = order[open_]
        further = rank[np.minimum(suffix + h, n)]
        group = head[open_]
        again = np.lexsort((further, group))
        suffix, further = suffix[again], further[again]
        order[open_] = suffix
        new = np.r_[True, (group[1:] != group[:-1]) | (further[1:] != further[:-1])]
        start[open_] = new
        head[open_] = np.maximum.accumulate(np.where(new, open_, 0))
        rank[suffix] = head[open_]
        h *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix in the order with the one before it (0 for the first).

    Kasai's rule in text order: a suffix shares at least one byte less with its neighbour than the suffix one byte
    before it does, and exactly one less where both are preceded by the same byte. So only the places where the
    preceding bytes differ are compared, eight bytes at a time.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    places = np.arange(n)
    back = before - 1
    compared = (before < 0) | (places == 0) | (back < 0)
    same = ~compared
    compared[same] = data[places[same] - 1] != data[back[same]]
    at = np.flatnonzero(compared & (before >= 0))
    words = _words(np.r_[data, np.zeros(16, np.uint8)])
    length = np.zeros(n, np.int64)
    a, b, here = at.copy(), before[at], at.copy()
    while len(here):
        ended = (a >= n) | (b >= n)
        x = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        x = np.where(ended, np.uint64(1), x)
        low = x & (~x + np.uint64(1))
        shared = np.where(x == 0, 8, (np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64))
        shared = np.minimum(shared, n - np.maximum(a, b)).clip(0)
        length[here] += shared
        on = (x == 0) & (shared == 8)
        a, b, here = a[on] + 8, b[on] + 8, here[on]
    last = np.maximum.accumulate(np.where(compared, places, 0))
    length = np.maximum(length[last] - (places - last), 0)
    length[before < 0] = 0
    return length[order]


class Shard:
    """Windows of some contexts: suffix array, equal windows, and the first place of each."""

    def __init__(self, contexts: list[bytes], doc: np.ndarray, tie: np.ndarray, pos: np.ndarray, window: int) -> None:
        sizes = np.array([len(c) for c in contexts])
        self.data = data = np.frombuffer(b"".join(contexts), np.uint8)
        ends = np.cumsum(sizes)
        which = np.repeat(np.arange(len(sizes)), sizes)
        starts = ends - sizes
        room = ends[which] - np.arange(len(data))
        order = suffix_array(data)
        prefix = common_prefixes(data, order)
        whole = room[order] >= window
        # equal windows stand side by side among all suffixes; a common prefix of `window` or more joins them
        number = np.cumsum(prefix < window)
        order, number = order[whole], number[whole]
        _, number = np.unique(number, return_inverse=True)
        self.window, self.at, self.group = window, order, number
        self.doc, self.tie = doc[which[order]], tie[which[order]]
        self.pos = pos[which[order]] + order - starts[which[order]]
        best = np.lexsort((self.pos, self.tie, self.doc, number))
        self.first = best[np.flatnonzero(np.r_[True, number[best][1:] != number[best][:-1]])] if len(best) else best

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """The windows of some rows as byte strings, in the order of the array."""
        if not len(rows):
            return np.empty(0, f"V{self.window}")
        view = np.lib.stride_tricks.sliding_window_view(self.data, self.window)
        return np.ascontiguousarray(view[self.at[rows]])

    def firsts(self):
        """(doc, tie, pos) of the first place of each window, in group order."""
        return self.doc[self.first], self.tie[self.first], self.pos[self.first]

    def repeated(self, doc: np.ndarray, tie: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Rows whose place is not the given first place of their group."""
        g = self.group
        return np.flatnonzero((self.doc != doc[g]) | (self.tie != tie[g]) | (self.pos != pos[g]))


def _merged_firsts(shards: list[Shard]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First places of each shard's windows among all shards: every shard's windows are looked up in every other by binary search."""
    firsts = [tuple(x.copy() for x in s.firsts()) for s in shards]
    keys = [[k.tobytes() for k in s.keys(s.first)] for s in shards]
    tables = [np.array(k, dtype=object) for k in keys]
    for i in range(len(shards)):
        for j in range(i):
            if not len(tables[i]) or not len(tables[j]):
                continue
            at = np.searchsorted(tables[j], tables[i])
            hit = np.flatnonzero(at < len(tables[j]))
            hit = hit[tables[j][at[hit]] == tables[i][hit]]
            there = at[hit]
            a, b = [x[hit] for x in firsts[i]], [x[there] for x in firsts[j]]
            swap = (b[0] < a[0]) | ((b[0] == a[0]) & ((b[1] < a[1]) | ((b[1] == a[1]) & (b[2] < a[2]))))
            for x, y, own, other in zip(a, b, firsts[i], firsts[j], strict=True):
                least = np.where(swap, y, x)
                own[hit] = least
                other[there] = least
    return firsts


def repeated_windows(anchor: np.ndarray, contexts: list[bytes], doc, tie, pos, window: int = WINDOW, shard_bytes: int = SHARD_BYTES):
    """(doc, tie, start, end) of runs of windows that also start earlier; rows come sorted by anchor, pos is a context's start.

    Anchors are put into shards whole; one that is larger than a shard is cut into several, which are merged.
    """
    sizes = np.array([len(c) for c in contexts])
    bounds = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True])
    found = []
    k = 0
    while k < len(bounds) - 1:
        s, total = bounds[k], 0
        while k < len(bounds) - 1 and (total == 0 or total + sizes[bounds[k] : bounds[k + 1]].sum() <= shard_bytes):
            total += sizes[bounds[k] : bounds[k + 1]].sum()
            k += 1
        e = bounds[k]
        parts = np.searchsorted(np.cumsum(sizes[s:e]), np.arange(shard_bytes, total, shard_bytes)) if total > 2 * shard_bytes else []
        cuts = [s, *(s + np.asarray(parts, np.int64)).tolist(), e]
        shards = [Shard(contexts[a:b], doc[a:b], tie[a:b], pos[a:b], window) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        firsts = _merged_firsts(shards) if len(shards) > 1 else [shards[0].firsts()]
        for shard, first in zip(shards, firsts, strict=True):
            rows = shard.repeated(*first)
            found.append((shard.doc[rows], shard.tie[rows], shard.pos[rows]))
    d, t, p = (np.concatenate([f[j] for f in found] or [np.empty(0, np.int64)]) for j in range(3))
    return as_spans(d, t, p, window)


def as_spans(d: np.ndarray, t: np.ndarray, p: np.ndarray, window: int):
    """(doc, tie, start, end) of runs of neighbouring window starts."""
    order = np.lexsort((p, t, d))
    d, t, p = d[order], t[order], p[order]
    if not len(d):
        return d, t, p, p
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] > p[:-1] + 1)])
    last = np.r_[new[1:], len(d)] - 1
    return d[new], t[new], p[new], p[last] + window


#: Kinds of places: whole contexts compared in their block, those that seem to be elsewhere, and those whose anchor has others.
SEEN, CLAIM, DISPUTE = range(3)


class Classes:
    """Streams places sorted by (anchor, context, place): whole contexts seen before, and first places of contexts in dispute."""

    def __init__(self) -> None:
        self.first: tuple | None = None  # anchor, context and place of the last context's first place
        self.waiting: tuple | None = None  # the first place of an anchor that has had one context so far

    def classify(self, batch: pa.RecordBatch):
        """(doc, tie, pos, anchor, kind, first place) of the places to report, of kinds SEEN, CLAIM and DISPUTE."""
        a, c, doc, tie, pos, seen = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        n = len(a)
        alone = seen
        newa = np.r_[True, (a[1:] != a[:-1]) | alone[1:] | alone[:-1]]
        newc = newa | np.r_[True, c[1:] != c[:-1]]
        if self.first is not None and not alone[0]:
            newa[0] = a[0] != self.first[0]
            newc[0] = newa[0] or c[0] != self.first[1]
        index = np.arange(n)
        head = np.maximum.accumulate(np.where(newc, index, -1))
        fd, ft, fp = (np.where(head >= 0, x[np.maximum(head, 0)], 0) for x in (doc, tie, pos))
        if self.first is not None:
            fd, ft, fp = (np.where(head < 0, y, x) for x, y in zip((fd, ft, fp), self.first[2:], strict=True))
        whole = seen | (~newc & ((doc != fd) | (tie != ft) | (pos != fp)))
        # a context's first place is in dispute if its anchor has had another one, or gets one later
        dispute = newc & ~newa & ~alone
        lead = np.maximum.accumulate(np.where(newa, index, -1))
        second = np.flatnonzero(dispute)
        dispute[lead[second][lead[second] >= 0]] = True
        extra = None
        if self.waiting is not None and len(second) and lead[second[0]] < 0:
            extra, self.waiting = self.waiting, None
        elif self.waiting is not None and newa.any():
            self.waiting = None
        last = lead[-1]
        if last >= 0:
            self.waiting = None if dispute[last] or alone[last] else (doc[last], tie[last], pos[last], a[last])
        self.first = None if alone[-1] else (a[-1], c[-1], fd[-1], ft[-1], fp[-1])
        at = np.flatnonzero(whole | dispute)
        kind = np.where(dispute, DISPUTE, np.where(seen, SEEN, CLAIM))[at]
        source = (np.where(kind == CLAIM, x[at], 0) for x in (fd, ft, fp))
        out = [doc[at], tie[at], pos[at], a[at], kind, *source]
        if extra is not None:
            out = [np.r_[x, np.array([y], x.dtype)] for x, y in zip(out, (*extra, DISPUTE, 0, 0, 0), strict=True)]
        return out


def equal_contexts(data: np.ndarray, start: np.ndarray, size: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether contexts of some bytes, given by their starts and sizes, are equal pair by pair; data has 8 bytes to spare."""
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    out = size[one] == size[other]
    at = np.flatnonzero(out)
    step = 0
    while len(at):
        left = size[one[at]] - step
        at = at[left > 0]
        left = left[left > 0]
        mask = np.where(left >= 8, np.uint64(2**64 - 1), (np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1))
        same = ((words[start[one[at]] + step] ^ words[start[other[at]] + step]) & mask) == 0
        out[at[~same]] = False
        at = at[same]
        step += 8
    return out


def merged_claims(row: np.ndarray, pos: np.ndarray, doc: np.ndarray, tie: np.ndarray, place: np.ndarray, window: int, width: int):
    """(row, start, end, doc, tie, start in the source) of claims that adjoin and have one source at one distance."""
    ahead = place - pos
    order = np.lexsort((pos, ahead, tie, doc, row))
    row, pos, doc, tie, ahead = (x[order] for x in (row, pos, doc, tie, ahead))
    if not len(row):
        return row, pos, pos, doc, tie, pos
    new = np.r_[True, pos[1:] - pos[:-1] > window + width - 1]
    for x in (row, doc, tie, ahead):
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(row)] - 1
    start = np.maximum(pos[first] - width + 1, 0)
    return row[first], start, pos[last] + window, doc[first], tie[first], start + ahead[first]


def equal_runs(text: bytes, source: bytes, window: int) -> list[tuple[int, int]]:
    """Where two texts laid side by side are equal for `window` bytes or more."""
    if text == source:
        return [(0, len(text))] if len(text) >= window else []
    n = min(len(text), len(source))
    same = np.frombuffer(text, np.uint8, n) == np.frombuffer(source, np.uint8, n)
    edges = np.flatnonzero(np.diff(np.r_[0, same.view(np.int8), 0])).reshape(-1, 2)
    return [(s, e) for s, e in edges.tolist() if e - s >= window]


def _anchor_blocks(batches: Iterator[pa.RecordBatch], window: int, kmer: int):
    held: list[tuple] = []
    size = 0
    for batch in arrow_rows(batches):
        for d, t, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if text and len(text) >= window:
                held.append((d, t, text))
                size += len(text)
            if size >= BLOCK_BYTES:
                yield held, Anchors([x[2] for x in held], window, kmer)
                held, size = [], 0
    if held:
        yield held, Anchors([x[2] for x in held], window, kmer)


_SPANS = "doc bigint, tie bigint, start bigint, end bigint"


def spans(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, hot: int = HOT_CONTEXTS, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Spans (doc, tie, start, end) of bytes to remove, possibly overlapping, and bytes (doc, tie, start, bytes) to remove where they are found.

    docs has columns __doc, __tie and __text.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = window - kmer + 1

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        rows = size = 0

        def firsts() -> pa.RecordBatch:
            *keys, start, length, data = (list(x) for x in zip(*parts, strict=True))
            data, start, length = np.concatenate([*data, np.zeros(8, np.uint8)]), np.concatenate(start), np.concatenate(length)
            return local_firsts(*map(np.concatenate, keys), lambda one, other: equal_contexts(data, start, length, one, other))

        for held, found in _anchor_blocks(batches, window, kmer):
            if not len(found.at):
                continue
            doc, tie = (np.array([x[k] for x in held], np.int64)[found.doc] for k in range(2))
            place = found.at - found.start[found.doc]
            parts.append((found.anchor.view(np.int64), found.context.view(np.int64), doc, tie, place, size + found.at - found.left, found.left + found.right, found.data))
            rows += len(doc)
            size += len(found.data)
            if rows > 2_000_000:
                yield firsts()
                parts, rows, size = [], 0, 0
        if parts:
            yield firsts()

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Classes()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in state.classify(batch)], names=["doc", "tie", "pos", "anchor", "kind", "fd", "ft", "fp"])

    def claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Claims of each document as spans."""
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "fd", "ft", "fs")]))
        for batch in batches:
            lists = batch.column(5)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            row, *found = merged_claims(row, *(lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(4)), window, width)
            offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=batch.num_rows))].astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], ["start", "end", "fd", "ft", "fs"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.ListArray.from_arrays(pa.array(offsets), spans).cast(kind)], names=batch.schema.names)

    flagged = (
        docs.select("__doc", "__tie", "__text").mapInArrow(places, PLACES)
        .repartition(tasks, "a").sortWithinPartitions("a", "seen", "b", "doc", "tie", "pos")
        .mapInArrow(classes, "doc bigint, tie bigint, pos bigint, anchor bigint, kind bigint, fd bigint, ft bigint, fp bigint")
        .groupBy(F.col("doc").alias("__doc"), F.col("tie").alias("__tie"))
        .agg(
            F.collect_list(F.when(F.col("kind") == SEEN, F.col("pos"))).alias("whole"),
            F.collect_list(F.when(F.col("kind") == DISPUTE, F.col("pos"))).alias("pos"),
            F.collect_list(F.when(F.col("kind") == DISPUTE, F.col("anchor"))).alias("anchor"),
            F.collect_list(F.when(F.col("kind") == CLAIM, F.struct("pos", "fd", "ft", "fp"))).alias("claims"),
        )
        .mapInArrow(
            claims,
            "__doc bigint, __tie bigint, whole array<bigint>, pos array<bigint>, anchor array<bigint>, "
            "claims array<struct<start:bigint,end:bigint,fd:bigint,ft:bigint,fs:bigint>>",
        )
    )
    flagged = cut(flagged)

    def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans of neighbouring whole contexts; their ends are cut to the text later."""
        for batch in batches:
            lists = batch.column(2)
            place = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            order = np.lexsort((place, row))
            row, place = row[order], place[order]
            if not len(row):
                continue
            new = np.r_[True, (row[1:] != row[:-1]) | (place[1:] - place[:-1] > window + width - 1)]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(row)] - 1
            doc, tie = (batch.column(k).to_numpy(zero_copy_only=False)[row[first]] for k in range(2))
            found = (doc, tie, np.maximum(place[first] - width + 1, 0), place[last] + window)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["doc", "tie", "start", "end"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of every context in dispute."""
        for batch in arrow_rows(batches):
            lists = batch.column(3)
            place, anchor = lists.flatten().to_numpy(), batch.column(4).flatten()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            a, parts, at = np.maximum(place - width + 1, 0), [], 0
            for text, n in zip(batch.column(2).to_pylist(), sizes.tolist(), strict=True):
                parts += [text[x : y + window] for x, y in zip(a[at : at + n].tolist(), place[at : at + n].tolist(), strict=True)]
                at += n
            doc, tie = (batch.column(k).take(pa.array(row)) for k in range(2))
            yield pa.RecordBatch.from_arrays([doc, tie, pa.array(a), anchor, pa.array(parts, pa.binary())], names=["doc", "tie", "start", "anchor", "bytes"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes that others claim to repeat."""
        for batch in arrow_rows(batches, 64):
            lists = batch.column(1)
            doc, tie, start, end, fs = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(5))
            parts, at = [], 0
            for text, n in zip(batch.column(0).to_pylist(), lists.value_lengths().to_pylist(), strict=True):
                parts += [text[s : s + e - b] for s, e, b in zip(fs[at : at + n].tolist(), end[at : at + n].tolist(), start[at : at + n].tolist(), strict=True)]
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tie), pa.array(start), pa.array(parts, pa.binary())], names=["doc", "tie", "start", "bytes"])

    claimed = flagged.select("__doc", "__tie", F.explode("claims").alias("c"))
    wanted = claimed.groupBy(F.col("c.fd").alias("__fd"), F.col("c.ft").alias("__ft")).agg(
        F.collect_list(F.struct(F.col("__doc").alias("doc"), F.col("__tie").alias("tie"), "c.start", "c.end", "c.fs")).alias("wanted")
    )
    wanted = wanted.withColumnsRenamed({"__fd": "__doc", "__ft": "__tie"})
    sources = docs.select("__doc", "__tie", "__text").join(wanted, ["__doc", "__tie"]).select("__text", "wanted")
    sources = sources.mapInArrow(slices, "doc bigint, tie bigint, start bigint, bytes binary")

    whole = flagged.select("__doc", "__tie", "whole").where(F.size("whole") > 0).mapInArrow(wholes, _SPANS)
    disputed = (
        docs.select("__doc", "__tie", "__text")
        .join(flagged.where(F.size("pos") > 0).select("__doc", "__tie", "pos", "anchor"), ["__doc", "__tie"])
        .select("__doc", "__tie", "__text", "pos", "anchor")
        .mapInArrow(contexts, "doc bigint, tie bigint, start bigint, anchor bigint, bytes binary")
    )
    crowded = (
        flagged.select(F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor")
    )
    any_crowded = not crowded.isEmpty()

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def result(table: pa.Table) -> pa.RecordBatch:
            columns = [table.column(k).to_numpy() for k in range(4)]
            d, t, s, e = repeated_windows(columns[3], table.column(4).to_pylist(), *columns[:3], window, shard_bytes)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (d, t, s, e)], names=["doc", "tie", "start", "end"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= 16384:
                table = pa.Table.from_batches(held)
                anchor = table.column(3).to_numpy()
                done = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if anchor[0] != anchor[-1] else 0
                if done:
                    yield result(table.slice(0, done))
                    held, rows = table.slice(done).to_batches(), table.num_rows - done
        if held:
            yield result(pa.Table.from_batches(held))

    cool = disputed.join(crowded, "anchor", "left_anti") if any_crowded else disputed
    windows = (
        cool.select("doc", "tie", "start", "anchor", "bytes")
        .repartition(tasks, "anchor").sortWithinPartitions("anchor")
        .mapInArrow(arrays, _SPANS)
    )
    out = whole.union(windows)
    if any_crowded:
        one = (
            disputed.join(crowded, "anchor", "left_semi")
            .select("doc", "tie", "start", "bytes", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - window)).alias("o"))
            .where(F.octet_length("bytes") >= window)
            .select("doc", "tie", (F.col("start") + F.col("o")).alias("start"), F.substring("bytes", F.col("o") + 1, F.lit(window)).alias("w"))
            .select("doc", "tie", "start", F.sha2("w", 256).alias("w"))
        )
        first = one.groupBy("w").agg(F.min(F.struct("doc", "tie", "start")).alias("first"))
        again = one.join(first, "w").where(F.struct("doc", "tie", "start") != F.col("first"))
        out = out.union(again.select("doc", "tie", "start", (F.col("start") + window).alias("end")))
    return out, sources


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """docs without text_col, with n_bytes, removed (array of maximal [start, end) spans) and kept (bytes).

    A null text is empty; a null id comes before all others; rows repeated with id and text count as one document;
    other columns pass through; ids are integers.
    """
    rows = keyed(docs, id_col, text_col)
    if docs.columns in ([id_col, text_col], [text_col, id_col]) and docs.schema[id_col].dataType.simpleString() == "bigint":
        # the id is the key: both joins then read one and the same exchange of the texts
        rows = rows.select("__doc", "__tie", "__text")
        names = [F.when(F.col("__doc") != NULL_ID, F.col("__doc")).alias(id_col)]
    else:
        names = [c for c in docs.columns if c != text_col]
    found, sources = spans(rows.select("__doc", "__tie", "__text"), window, **options)
    sources = sources.groupBy(F.col("doc").alias("__doc"), F.col("tie").alias("__tie")).agg(F.collect_list(F.struct("start", "bytes")).alias("__claims"))
    found = found.groupBy(F.col("doc").alias("__doc"), F.col("tie").alias("__tie")).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    shape = docs.select(*[c for c in docs.columns if c != text_col]).schema
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in shape)
    passed = len(names)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            k = passed
            sizes, removed, kept = [], [], []
            for text, found, claims in zip(*(batch.column(k + j).to_pylist() for j in range(3)), strict=True):
                text = text or b""
                gone: list[list[int]] = []
                places = [(x["start"], min(x["end"], len(text))) for x in found or ()]
                for x in claims or ():
                    at, source = x["start"], x["bytes"]
                    places += [(at + s, at + e) for s, e in equal_runs(text[at : at + len(source)], source, window)]
                for s, e in sorted(places):
                    if gone and s <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], e)
                    else:
                        gone.append([s, e])
                at, parts = 0, []
                for s, e in gone:
                    parts.append(text[at:s])
                    at = e
                sizes.append(len(text))
                removed.append([{"start": s, "end": e} for s, e in gone])
                kept.append(b"".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:k], pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())],
                names=[*batch.schema.names[:k], "n_bytes", "removed", "kept"],
            )

    joined = rows.join(found, ["__doc", "__tie"], "left").join(sources, ["__doc", "__tie"], "left").select(*names, "__text", "__spans", "__claims")
    return joined.mapInArrow(cleaned, f"{kinds}n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")
