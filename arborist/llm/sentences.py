"""Substring dedup by sliding sentence spans.

Every run of RUN consecutive sentences is hashed; runs are joined globally, and sentences covered by a run that is
not the first of its hash are removed. A sentence ends at . ! ? followed by white space, or at a line's end; one of
more than LONG words is cut where its words say so, so that long repeated passages without stops have runs as well,
at whatever word of a sentence they start. A passage of over 50 words always has a run: fewer than LONG + GRAM words
at its start and fewer than LONG at its end can lie in pieces that it shares with what surrounds it, and the rest is
cut into pieces of at most LONG words. Only where GRAM words come again within LONG words can the cuts depend on what is before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborist.llm.common import alnum_words, arrow_rows
from arborist.llm.repeats import PLACES, Firsts, keyed, local_firsts, sorted_by_key

RUN, LONG = 3, 12
#: Words hashed to place a cut.
GRAM = 3
#: A run of fewer words is too short to tell copying from chance: it is passed over or, where `extend` is set, goes on
#: to the sentence that makes them up.
MIN_RUN_WORDS = 8
#: Bytes of text that a task hashes at a time.
BLOCK_BYTES = 16 << 20

#: For words: A-Z become a-z, ASCII other than letters and digits goes (the line feed stands between words).
_KEEP = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_DROP = bytes(c for c in range(128) if c != 10 and not chr(c).isalnum())

_SENTENCE = re.compile(rb"\s*+(?:[^.!?\n]++|[.!?]++(?!\s|\Z))*+(?:[.!?]++)?+[^\S\n]*+\n?+")
_TOKEN = re.compile(rb"\s*+\S++\s*+")


def split(text: bytes | None) -> list[bytes]:
    """The sentences of a text; joined they are the text."""
    if not text:
        return []
    found = []
    for m in _SENTENCE.finditer(text):
        part = m[0]
        if not part:
            continue
        words = part.split()
        if len(words) > LONG:
            tokens = _TOKEN.findall(part)
            ends = _cuts(words)
            found += [b"".join(tokens[a:b]) for a, b in zip([0, *ends], [*ends, len(tokens)], strict=True) if a < b]
        else:
            found.append(part)
    return found


def _cuts(words: list[bytes]) -> list[int]:
    """How many words lie before each cut: every LONG words in a row have a cut behind the one of least hash.

    A word is hashed with the GRAM - 1 before it. Of equal hashes the last cut stands while it can, then the last.
    """
    # letters and digits only, as in the keys of runs
    plain = b"\n".join(words).translate(_KEEP, _DROP).split(b"\n")
    padded = [plain[0]] * (GRAM - 1) + plain
    grams = [b" ".join(x) for x in zip(*(padded[k:] for k in range(GRAM)), strict=False)]
    h = list(map(xxhash.xxh64_intdigest, grams))
    cuts, at = [], -1
    for end in range(LONG - 1, len(h)):
        start = end - LONG + 1
        if at < start:
            least = min(h[start : end + 1])
            at = next(k for k in range(end, start - 1, -1) if h[k] == least)
            cuts.append(at + 1)
        elif h[end] < h[at]:
            at = end
            cuts.append(at + 1)
    return cuts


def runs(sentences: list[bytes], run: int = RUN, extend: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first key half, second key half, first sentence) of every run with enough words; sentences without a word are passed over.

    With `extend`, a run of too few words takes in the sentences after it until it has enough, if the text has them.
    """
    own, hashes, sizes = [], [], []
    for k, s in enumerate(sentences):
        words = alnum_words(s)
        if words:
            own.append(k)
            hashes.append(xxhash.xxh64_intdigest(b" ".join(words)))
            sizes.append(len(words))
    n = len(own) - run + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h, size = np.array(hashes, np.uint64), np.array(sizes)
    a, b, words = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    at = np.arange(n)
    for k in range(max(run, MIN_RUN_WORDS) if extend else run):
        if k >= run:
            at = at[(words[at] < MIN_RUN_WORDS) & (at + k < len(h))]
            if not len(at):
                break
        x = (a[at] ^ h[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        a[at] = x ^ (x >> np.uint64(29))
        x = (b[at] + h[at + k]) * np.uint64(0xC2B2AE3D27D4EB4F)
        b[at] = x ^ (x >> np.uint64(31))
        words[at] += size[at + k]
    keep = np.flatnonzero(words >= MIN_RUN_WORDS)
    return a[keep].view(np.int64), b[keep].view(np.int64), keep


def _covered(sentences: list[bytes], starts: set[int], run: int) -> list[bool]:
    """Which sentences a run starting at one of the given runs covers; those without a word between covered ones go too."""
    sizes = [len(alnum_words(s)) for s in sentences]
    own = [k for k, n in enumerate(sizes) if n]
    gone = [False] * len(sentences)
    for s in starts:
        last = s + run - 1
        words = sum(sizes[k] for k in own[s : last + 1])
        while words < MIN_RUN_WORDS:
            last += 1
            words += sizes[own[last]]
        for k in range(own[s], own[last] + 1):
            gone[k] = True
    return gone


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, tasks: int | None = None, extend: bool = False) -> DataFrame:
    """docs with n_sentences, n_removed and clean_text; the first place is that of the smallest id, then place.

    Null texts stay null and have no sentences; a null id comes before all others; rows repeated with id and text
    count as one document, so they do not remove each other's sentences; other columns pass through.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in arrow_rows(batches):
            doc, tie = (batch.column(k).to_pylist() for k in range(2))
            for d, t, text in zip(doc, tie, batch.column(2).to_pylist(), strict=True):
                a, b, pos = runs(split(text), run, extend)
                held.append((a, b, np.full(len(a), d), np.full(len(a), t), pos))
                size += len(text or b"")
            if size >= BLOCK_BYTES:
                yield local_firsts(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield local_firsts(*map(np.concatenate, zip(*held, strict=True)))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = Firsts()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(firsts.seen(batch))).select(["doc", "tie", "pos"])

    found = sorted_by_key(rows.select("__doc", "__tie", "__text").mapInArrow(places, PLACES), tasks).mapInArrow(
        repeated, "doc bigint, tie bigint, pos bigint"
    )
    found = found.groupBy(F.col("doc").alias("__doc"), F.col("tie").alias("__tie")).agg(F.collect_set("pos").alias("__runs"))
    joined = rows.join(found, ["__doc", "__tie"], "left")
    names = [c for c in docs.columns if c != text_col]
    shape = docs.select(*names).schema
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in shape)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            k = len(names)
            counts, removed, texts = [], [], []
            for text, starts in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist(), strict=True):
                sentences = split(text)
                counts.append(len(sentences))
                if not starts:
                    removed.append(0)
                    texts.append(text)
                    continue
                gone = _covered(sentences, set(starts), run)
                removed.append(sum(gone))
                texts.append(b"".join(s for s, g in zip(sentences, gone, strict=True) if not g))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:k], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                names=[*batch.schema.names[:k], "n_sentences", "n_removed", "clean_text"],
            )

    return joined.select(*names, "__text", "__runs").mapInArrow(clean, f"{kinds}n_sentences bigint, n_removed bigint, clean_text string")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with repeated spans removed; documents of which nothing but white space is left go."""
    found = dedup(docs, id_col, text_col, **options).where((F.col("n_removed") == 0) | F.col("clean_text").rlike(r"\S"))
    out = {c: F.col(c) for c in docs.columns if c != text_col} | {text_col: F.col("clean_text")}
    if "n_chars" in out:
        out["n_chars"] = F.char_length("clean_text").cast(docs.schema["n_chars"].dataType)
    return found.select(*[out[c].alias(c) for c in docs.columns])
