"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Training words are streamed through the automaton and the longest match ending at each word is tracked; a word is hit
if it lies in a run of WINDOW item words, or in a whole item that is shorter. Items are cut into blocks of a bounded
number of words, each with an automaton of its own that is broadcast; documents pass all blocks, one after another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborist.llm.automaton import SuffixAutomaton
from arborist.llm.common import alnum_words, arrow_rows, binary, cut

WINDOW = 10
#: Item words in one automaton at most (some 200 bytes a word on every worker).
BLOCK_WORDS = 500_000
#: In the filtering stage: spans go from a document; it goes itself if they hold over this share of its words.
MAX_COVERAGE = 0.5

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SPANS = "array<struct<start:int,end:int>>"


class Index:
    """Automaton of a block of (name, text) items, with the windows that a state stands for."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        named = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in alnum_words(text)]) for name, text in items]
        named = [(name, words) for name, words in named if words]
        self.automaton = a = SuffixAutomaton([words for _, words in named])
        self.shortest = min([window, *(len(words) for _, words in named)])
        names: list[set[str]] = [set() for _ in a.length]
        self.anchor = list(range(len(a.length)))
        for v in a.states_by_length():
            names[v].update(named[k][0] for k, _ in a.ends[v])
            if a.length[a.link[v]] >= window:
                names[a.link[v]] |= names[v]
        for v in reversed(a.states_by_length()):
            if a.length[a.link[v]] >= window:
                self.anchor[v] = self.anchor[a.link[v]]
        self.names = [frozenset(n for n in x if n is not None) if a.length[v] >= window else None for v, x in enumerate(names)]
        own: dict[int, set[tuple[int, str | None]]] = {}
        for name, words in named:
            if len(words) < window:
                own.setdefault(a.walk(words), set()).add((len(words), name))
        self.short: list[tuple] = [()] * len(a.length)
        for v in reversed(a.states_by_length()):
            self.short[v] = (*own.get(v, ()), *self.short[a.link[v]])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal runs [start, end) of hit words and the names of the items that occur."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.r_[0, (ids >= 0).view(np.int8), 0]))
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        for start, stop in known.reshape(-1, 2).tolist():
            if stop - start < self.shortest:
                continue
            for at, (v, n) in enumerate(self.automaton.statistics(ids[start:stop].tolist()), start + 1):
                if n >= self.window:
                    spans.append((at - self.window, at))
                    names |= self.names[self.anchor[v]]
                for length, name in self.short[v]:
                    if n >= length:
                        spans.append((at - length, at))
                        if name is not None:
                            names.add(name)
        return merged(spans), names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and adjoining [start, end) spans as one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]


def blocks(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[tuple[Index, bool]]:
    """(index, whether it is the last) of all items, made one at a time; items are dealt to as many blocks as keep each within the bound by their bytes."""
    rows = items.select(F.col(item_col).cast("string").alias("name"), binary(text_col).alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // (2 * block_words)))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        yield Index([(r.name, bytes(r.text)) for r in part.distinct().toLocalIterator()], window), k == n - 1


def _passes(docs: DataFrame, indexes: Iterator[tuple[Index, bool]], keep: tuple[str, ...], text_col: str, max_coverage: float | None = None) -> DataFrame:
    """`keep` columns, __text, __n, __spans and __items after all indexes, one pass of the documents for each.

    With several, each pass is cut from the next one by a checkpoint and its index is given up, so that driver and workers
    hold one at a time. With max_coverage the last pass also takes the spans from the texts, and drops documents that are
    hit beyond it.
    """
    sc = docs.sparkSession.sparkContext
    shape = docs.select(*keep).schema
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in shape) + f"__text binary, __n int, __spans {_SPANS}, __items array<string>"
    rows = docs.select(
        *keep, binary(text_col).alias("__text"), F.lit(0).alias("__n"),
        F.array().cast(_SPANS).alias("__spans"), F.array().cast("array<string>").alias("__items"),
    )
    for index, last in indexes:
        shared = sc.broadcast(index)
        cleans = max_coverage is not None and last

        def run(batches: Iterator[pa.RecordBatch], shared=shared, cleans=cleans) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in arrow_rows(batches):
                k = batch.num_columns - 4
                texts, counts, spans, names, stays = [], [], [], [], []
                for text, old_spans, old_names in zip(*(batch.column(k + j).to_pylist() for j in (0, 2, 3)), strict=True):
                    words = alnum_words(text)
                    found, named = index.scan(words)
                    if old_spans:
                        found = merged([*found, *((s["start"], s["end"]) for s in old_spans)])
                    if cleans and found:
                        text = without_spans(text, found)
                    texts.append(text)
                    stays.append(not cleans or sum(e - s for s, e in found) <= max_coverage * len(words))
                    counts.append(len(words))
                    spans.append([{"start": s, "end": e} for s, e in found])
                    names.append(sorted(named.union(old_names)))
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                out = pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:k], pa.array(texts, pa.binary()) if cleans else batch.column(k), pa.array(counts, pa.int32()),
                        pa.array(spans, kind), pa.array(names, pa.list_(pa.string())),
                    ],
                    names=batch.schema.names,
                )
                yield out if all(stays) else out.filter(pa.array(stays))

        rows = rows.mapInArrow(run, kinds)
        if not last:
            rows = cut(rows)
            shared.destroy()
    return rows


def scan(
    docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """`keep` columns, text (as bytes), n_words, spans of hit words [start, end) and names of the occurring items.

    Null texts have no words and null items no windows; an item without an id marks words but is not named; repeated
    rows are scanned each; without items nothing is hit.
    """
    rows = _passes(docs, blocks(items, item_col, item_text, window, block_words), keep, text_col)
    return rows.select(
        *keep, F.col("__text").alias("text"), F.col("__n").cast("bigint").alias("n_words"),
        F.col("__spans").alias("spans"), F.col("__items").alias("items"),
    )


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the bytes from the first to the last word of each span of words."""
    places = [m.span() for m in _WORD.finditer(text.lower())]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def clean(
    docs: DataFrame, items: DataFrame, text_col: str = "text", max_coverage: float = MAX_COVERAGE,
    item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Documents without the spans that items share with them; those hit beyond max_coverage of their words go.

    All columns stay; n_chars, if present, follows the text.
    """
    others = tuple(c for c in docs.columns if c != text_col)
    named = docs.select(*[F.col(c).alias(f"__in_{c}") for c in others], F.col(text_col))
    rows = _passes(named, blocks(items, item_col, item_text, window, block_words), tuple(f"__in_{c}" for c in others), text_col, max_coverage)
    out = {c: F.col(f"__in_{c}") for c in others} | {text_col: F.col("__text").cast("string")}
    if "n_chars" in out:
        out["n_chars"] = F.char_length(F.col("__text").cast("string")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[out[c].alias(c) for c in docs.columns])


#: The scan in DuckDB SQL, for the columns that the query returns.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
v AS (SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[p : p + least(10, len(ws)) - 1], ' ') AS gram
      FROM (SELECT item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM v),
g AS (SELECT doc_id, p, n, array_to_string(ws[p : p + n - 1], ' ') AS gram
      FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, sizes WHERE len(ws) >= n)),
h AS (SELECT g.doc_id, g.p, g.n, v.item FROM g JOIN v ON g.gram = v.gram AND g.n = v.n),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.names, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
