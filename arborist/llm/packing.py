"""Packing of tokenised documents into sequences: best fit, then swap-based local search.

A document's tokens are its tokenizer ids and one closing id; only documents longer than a sequence are cut. Pieces
are dealt by hash to groups of a few thousand, and each group is packed on its own: first best-fit decreasing, then
moves, one-for-one and two-for-one exchanges between underfull bins that raise the sum of squared fills, until bins
empty or a lower bound is met. The emptiest bins of all groups then meet, and the search goes on between them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborist.llm.common import arrow_rows, binary, cut

SEQUENCE = 2048
#: Shorter pieces in a group, and the rows at which a group of a hot hash is closed.
GROUP, MOST = 8192, 32768
#: Bins of a group that go on to the next round.
SPARE = 8
#: Words kept with their ids by a worker; the store is emptied when it is full.
MEMO = 1 << 19
#: Bytes of text that are encoded at a time, and of the longest word in the store's own table.
BLOCK_BYTES, SHORT = 1 << 21, 16

# The steps before the model of the tokenizers whose words can be encoded in arrays.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Of the bytes of a plain word: 0 letters (a-z and the bytes of U+00C0 to U+00FF), 1 digits, 2 other visible ASCII.
_CLASS = np.full(256, 2, np.int8)
_CLASS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 0
_CLASS[0x30:0x3A] = 1
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[[0x27, *range(0x41, 0x5B)]] = False
_LETTER_END = np.zeros(256, bool)  # after 0xC3
_LETTER_END[0x80:0xC0] = True
_LETTER_END[[0x97, 0xB7]] = False
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_NONE = np.iinfo(np.int32).max

_SPACE = re.compile(rb"[ \t-\r]")
_TOKENIZERS: dict[str, WordIds] = {}  # of this worker, by path


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start, as many as its size, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else the next from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, rest = {b: chr(b) for b in seen}, 0x100
    for b in range(256):
        if b not in out:
            out[b] = chr(rest)
            rest += 1
    return [out[b] for b in range(256)]


class Merges:
    """Byte-pair merges of many words at once, in arrays."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str) -> None:
        letters = _byte_characters()
        self.inner = np.array([vocabulary[c] for c in letters], np.int64)
        self.last = np.array([vocabulary[c + suffix] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right, self.made = (np.array([vocabulary[t] for t in ts], np.int64) for ts in zip(*((a, b, a + b) for a, b in pairs), strict=True))
        # merging every place of the best pair at once is the same as one by one if a pair is made of older tokens
        age = np.full(len(vocabulary) + max(vocabulary.values()), -1)
        age[self.made] = np.arange(len(pairs))
        self.ordered = len(set(self.made.tolist())) == len(pairs) and bool((np.maximum(age[left], age[right]) < np.arange(len(pairs))).all())
        self.ordered &= max(vocabulary.values()) < 1 << 16
        bits = 18
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, _NONE, np.int32)
        keys = left << 16 | right
        at, wait = self._slots(keys), np.arange(len(keys))
        while len(wait):
            free = self.keys[at[wait]] < 0
            _, first = np.unique(at[wait[free]], return_index=True)
            placed = wait[free][first]
            self.keys[at[placed]], self.ranks[at[placed]] = keys[placed], placed
            wait = wait[self.keys[at[wait]] != keys[wait]]
            at[wait] = (at[wait] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 16 | right
        at = self._slots(keys)
        seen = self.keys[at]
        out = self.ranks[at]
        wait = np.flatnonzero((seen != keys) & (seen >= 0))
        out[seen != keys] = _NONE
        while len(wait):
            at[wait] = (at[wait] + 1) & self.mask
            seen = self.keys[at[wait]]
            hit = seen == keys[wait]
            out[wait[hit]] = self.ranks[at[wait[hit]]]
            wait = wait[~hit & (seen >= 0)]
        return out

    def encode(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of plain words laid end to end."""
        data = data.copy()
        capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] < 0x9F) & (data[:-1] == 0xC3)) + 1
        data[capital] += 0x20
        kind = _CLASS[data]
        new = np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == 1)]
        new[np.cumsum(sizes)[:-1]] = True
        part = np.cumsum(new) - 1
        word_of = np.repeat(np.arange(len(sizes)), sizes)[new]
        symbols = np.where(np.r_[new[1:], True], self.last[data], self.inner[data])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        ranks = np.full(len(data), _NONE, np.int32)
        inner = np.flatnonzero(~new[1:])
        ranks[inner] = self._rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            least = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.r_[starts, len(part)]))
            ended = least == _NONE
            done.append((part[ended], symbols[ended]))
            merge = (ranks == least) & ~ended
            at = np.flatnonzero(merge)
            if len(at) and (np.diff(at) == 1).any():
                # of neighbours the first, the third and so on
                run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) > 1], at, 0))
                at = at[(at - run) % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            stays = ~ended
            stays[at + 1] = False
            moved = np.zeros(len(part), bool)
            moved[at] = True
            moved[np.maximum(at - 1, 0)] = True
            symbols, part, ranks, moved = symbols[stays], part[stays], ranks[stays], moved[stays]
            if len(part):
                # the ranks of merged symbols, and of those before them
                at = np.flatnonzero(moved | np.r_[moved[1:], False])
                inside = np.r_[part[1:] == part[:-1], False][at]
                ranks[at[~inside]] = _NONE
                at = at[inside]
                ranks[at] = self._rank(symbols[at], symbols[at + 1])
        part, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(part, kind="stable")
        return symbols[order].astype("<u4"), np.bincount(word_of[part], minlength=len(sizes))


class WordIds:
    """Ids of texts by a tokenizer that never joins characters across ASCII white space, word by word with a store.

    Words of visible ASCII and Latin letters are merged in arrays; all others go through the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        model, steps = spec["model"], spec["pre_tokenizer"] or {}
        known = spec["normalizer"] == _NORMALIZER and [s.get("pattern") for s in steps.get("pretokenizers", [])] == [{"Regex": _PATTERN}, None]
        known &= model["type"] == "BPE" and not model["continuing_subword_prefix"] and not model["ignore_merges"] and not model["dropout"]
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "") if known else None
        if self.merges and not self.merges.ordered:
            self.merges = None
        self._sized(4 * MEMO)
        self._empty()

    def _sized(self, places: int) -> None:
        self.table = np.empty(1 << (places - 1).bit_length(), np.int32)
        self.shift = np.uint64(64 - len(self.table).bit_length() + 1)

    def _empty(self) -> None:
        self.table.fill(-1)
        self.long: dict[bytes, int] = {}
        self.count = self.used = 0
        # first and second eight bytes, size, and where a word's ids lie
        self.low, self.high = np.zeros(4096, np.uint64), np.zeros(4096, np.uint64)
        self.size, self.start, self.number = (np.zeros(4096, np.int64) for _ in range(3))
        self.ids = np.zeros(1 << 14, "<u4")

    def _grown(self, names: str, need: int) -> None:
        for name in names.split():
            old = getattr(self, name)
            if len(old) < need:
                new = np.zeros(max(need, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)

    def _add(self, first: int, ids: np.ndarray, numbers: np.ndarray, words: np.ndarray) -> None:
        """Keep the ids of the words numbered `first` + words."""
        self._grown("ids", self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[first + words] = self.used + np.cumsum(numbers) - numbers
        self.number[first + words] = numbers
        self.used += len(ids)

    def _through_tokenizer(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """One call for some words; a token belongs to the word in which it starts."""
        texts = [w.decode() for w in words]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        starts = np.fromiter((s for s, _ in found.offsets), np.int64, len(found.ids))
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        cuts = np.searchsorted(starts, ends[:-1])
        return np.array(found.ids, "<u4"), np.diff(np.r_[0, cuts, len(found.ids)])

    def _learn(self, first: int, data: bytes, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Find the ids of new words, numbered from `first`."""
        plain = np.zeros(len(starts), bool)
        if self.merges:
            own = flat[_ranges(starts, sizes)]
            tail = np.r_[False, own[:-1] == 0xC3] & _LETTER_END[own]
            head = (own == 0xC3) & np.r_[tail[1:], False]
            bad = ~(_VISIBLE[own] | tail | head)
            bad[:-1] |= (own[:-1] == 0x3C) & (own[1:] == 0x7C)  # part of a special token, perhaps
            edges = np.cumsum(sizes) - sizes
            # a letter's bytes lie in one word
            bad[edges] |= tail[edges]
            plain = ~np.logical_or.reduceat(bad, edges)
            at = np.flatnonzero(plain)
            if len(at):
                self._add(first, *self.merges.encode(own[np.repeat(plain, sizes)], sizes[at]), at)
        others = np.flatnonzero(~plain)
        for k in range(0, len(others), 4096):
            at = others[k : k + 4096]
            words = [data[s:e] for s, e in zip(starts[at].tolist(), (starts[at] + sizes[at]).tolist(), strict=True)]
            self._add(first, *self._through_tokenizer(words), at)

    def _numbers(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number in the store of each word; new words are learnt. data has SHORT bytes to spare."""
        flat = np.frombuffer(data, np.uint8)
        eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        out = np.full(len(starts), -1, np.int64)
        first = self.count
        new: list[np.ndarray] = []
        for k in np.flatnonzero(sizes > SHORT).tolist():
            word = data[starts[k] : starts[k] + sizes[k]]
            at = self.long.get(word)
            if at is None:
                at = self.long[word] = self.count
                self.count += 1
                new.append(np.array([k]))
            out[k] = at
        wait = np.flatnonzero(sizes <= SHORT)
        low = eight[starts[wait]] & _LOW_BYTES[np.minimum(sizes[wait], 8)]
        high = eight[starts[wait] + 8] & _LOW_BYTES[np.maximum(sizes[wait] - 8, 0)]
        size = sizes[wait]
        h = (low ^ (high * np.uint64(0xBF58476D1CE4E5B9)) ^ size.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        at = (h >> self.shift).astype(np.int64)
        self._grown("low high size start number", self.count)
        while len(wait):
            there = self.table[at]
            found = np.maximum(there, 0)
            same = (there >= 0) & (self.low[found] == low) & (self.high[found] == high) & (self.size[found] == size)
            out[wait[same]] = there[same]
            # the first word at each free slot takes it; the others look again
            free = np.flatnonzero(there < 0)
            if len(free):
                _, pick = np.unique(at[free], return_index=True)
                pick = free[pick]
                names = self.count + np.arange(len(pick))
                self.count += len(pick)
                self._grown("low high size start number", self.count)
                self.table[at[pick]] = names
                self.low[names], self.high[names], self.size[names] = low[pick], high[pick], size[pick]
                new.append(wait[pick])
                out[wait[pick]] = names
                same[pick] = True
            other = (there >= 0) & ~same
            at[other] = (at[other] + 1) & (len(self.table) - 1)
            left = ~same
            wait, low, high, size, at = wait[left], low[left], high[left], size[left], at[left]
        if new:
            rows = np.concatenate(new)
            self._grown("low high size start number", self.count)
            self._learn(first, data, flat, starts[rows], sizes[rows])
        return out

    def _block(self, texts: list[bytes]) -> list[np.ndarray]:
        data = b"\n".join(texts) + b"\n"
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        space = _SPACES[np.frombuffer(data, np.uint8)]
        edges = np.flatnonzero(np.r_[True, space[1:] != space[:-1]])
        if len(edges) and space[0]:
            edges = edges[1:]
        starts, stops = edges[::2], edges[1::2]
        numbers = self._numbers(data + bytes(SHORT), starts, stops - starts) if len(starts) else np.empty(0, np.int64)
        counts = self.number[numbers]
        ids = self.ids[_ranges(self.start[numbers], counts)]
        upto = np.r_[0, np.cumsum(counts)][np.searchsorted(starts, ends)]
        return np.split(ids, upto[:-1])

    def batch(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of each text, as little-endian unsigned 32-bit numbers."""
        out: list[list[np.ndarray]] = []
        held: list[bytes] = []
        size = 0

        def encode() -> None:
            nonlocal held, size
            # all words of the block may be new
            most = size // 2 + len(held)
            if self.count > MEMO or self.count + most > len(self.table) // 2:
                if most > len(self.table) // 2:
                    self._sized(2 * most)
                self._empty()
            for place, ids in zip(owners, self._block(held), strict=True):
                out[place].append(ids)
            held, size = [], 0
            owners.clear()

        owners: list[int] = []
        for k, text in enumerate(texts):
            out.append([])
            text = text or b""
            # the tokenizer lower-cases; its special tokens are spelt in lower case with a bar
            text = text if b"<|" in text else text.lower()
            at = 0
            while True:
                # long texts are cut at white space
                stop = len(text)
                if stop - at > BLOCK_BYTES:
                    m = _SPACE.search(text, at + BLOCK_BYTES)
                    stop = m.start() if m else stop
                held.append(text[at:stop])
                owners.append(k)
                size += stop - at
                if size >= BLOCK_BYTES:
                    encode()
                at = stop
                if at >= len(text):
                    break
        if held:
            encode()
        return [np.concatenate(x) if len(x) > 1 else x[0] for x in out]


def pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE, end_id: int = 0
) -> DataFrame:
    """(id, piece, start, length, ids) of every row; ids are little-endian unsigned 32-bit, a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _TOKENIZERS.get(tokenizer)
        if coder is None:
            coder = _TOKENIZERS[tokenizer] = WordIds(tokenizer)
        close = np.array([end_id], "<u4")
        for batch in arrow_rows(batches, 256):
            found = [np.concatenate((ids, close)) for ids in coder.batch(batch.column(1).to_pylist())]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            count = -(-sizes // capacity)
            number = _ranges(np.zeros(len(count), np.int64), count)
            row = np.repeat(np.arange(len(count)), count)
            start = number * capacity
            length = np.minimum(sizes[row] - start, capacity)
            offsets = np.r_[0, np.cumsum(4 * length)].astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(found))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), data],
                names=["id", "piece", "start", "length", "ids"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), binary(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, piece int, start bigint, length bigint, ids binary"
    )


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: by sums, and by the pieces that cannot share a bin (Martello and Toth)."""
    count = np.bincount(lengths, minlength=capacity + 1)
    number = np.r_[0, np.cumsum(count)]  # pieces shorter than k
    weight = np.r_[0, np.cumsum(count * np.arange(capacity + 1))]
    best = -(-int(weight[-1]) // capacity)
    half = capacity // 2
    for a in range(1, half + 1):
        alone = number[-1] - number[capacity - a + 1]
        large = number[capacity - a + 1] - number[half + 1]
        room = large * capacity - (weight[capacity - a + 1] - weight[half + 1])
        small = weight[half + 1] - weight[a]
        best = max(best, int(alone + large + max(0, -(-(small - room) // capacity))))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece: longest first, each into the fullest bin that takes it."""
    order = np.argsort(-lengths, kind="stable")
    out = np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what they still take
    some = bins = 0  # bit k: room[k] has a bin
    for k, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = some >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            at = room[free].pop()
            if not room[free]:
                some ^= 1 << free
        else:
            free, at = capacity, bins
            bins += 1
        out[k] = at
        left = free - size
        if left:
            room[left].append(at)
            some |= 1 << left
    return out


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Empties bins by the exchanges with the largest gain in squared fill; returns the bin of each piece.

    The least filled bin gives: it moves a piece, exchanges one for a shorter one, or two for one that is shorter
    than both together, with a bin that is at least as full afterwards. Every step raises the sum of squares, so it
    ends; a bin that can give nothing more is set aside. After a pass over all underfull bins the lower bound ends it.
    """
    bins = bins.copy()
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    least = lower_bound(lengths, capacity)
    live = np.ones(len(fill), bool)
    used, changed = int((fill > 0).sum()), False
    under = np.flatnonzero(fill[bins] < capacity)  # pieces of underfull bins
    while True:
        open_ = np.flatnonzero(live & (fill > 0) & (fill < capacity))
        if not len(open_):
            if not changed or used <= least:
                break
            live, changed = fill > 0, False
            continue
        giver = int(open_[np.argmin(fill[open_])])
        while fill[giver]:
            mine = under[bins[under] == giver]
            rest = under[(bins[under] != giver) & (fill[bins[under]] < capacity)]
            if not len(rest):
                break
            theirs, slack, full = lengths[rest], capacity - fill[bins[rest]], fill[bins[rest]]
            best, step = 0, None
            # one piece for each length, one pair for each two lengths: all else is the same exchange
            mine = mine.tolist()
            single = {int(lengths[a]): (a,) for a in mine}
            twins, spare = {}, {}
            for a in mine:
                n = int(lengths[a])
                if n in spare:
                    twins.setdefault(2 * n, (spare[n], a))
                spare.setdefault(n, a)
            ones = sorted(single)
            pairs = {x + y: single[x] + single[y] for i, x in enumerate(ones) for y in ones[:i]}
            some = pairs | twins | single
            # the gain grows with what a bin receives on balance: its best is the largest that fits
            for choice, back in ((single, np.zeros(len(rest), np.int64)), (some, theirs)):
                sizes = np.array(sorted(choice))
                k = np.searchsorted(sizes, back + slack, "right") - 1
                d = sizes[np.maximum(k, 0)] - back
                gain = np.where((k >= 0) & (d > 0), 2 * d * (full - fill[giver] + d), 0)
                at = int(gain.argmax())
                if gain[at] > best:
                    taken = None if choice is single else int(rest[at])
                    best, step = int(gain[at]), (choice[int(sizes[k[at]])], taken, int(bins[rest[at]]))
            if step is None:
                break
            given, taken, to = step
            moved = int(lengths[list(given)].sum()) - (int(lengths[taken]) if taken is not None else 0)
            bins[list(given)] = to
            if taken is not None:
                bins[taken] = giver
            fill[to] += moved
            fill[giver] -= moved
            changed = True
        live[giver] = False
        used -= fill[giver] == 0
    return bins


def pack_group(lengths: np.ndarray, capacity: int, bins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bin from 0, offset) of each piece of a group, from best fit or the given bins; bins and offsets are gapless."""
    bins = local_search(lengths, best_fit(lengths, capacity) if bins is None else bins, capacity)
    _, bins = np.unique(bins, return_inverse=True)
    order = np.argsort(bins, kind="stable")
    upto = np.cumsum(lengths[order]) - lengths[order]
    first = np.r_[True, np.diff(bins[order]) > 0]
    offset = np.empty(len(lengths), np.int64)
    offset[order] = upto - np.maximum.accumulate(np.where(first, upto, 0))
    return bins, offset


def _search(rows: DataFrame, deal: str, groups: int, capacity: int, spare: int, turn: int) -> DataFrame:
    """rows in `groups` groups by the column `deal`, packed anew or from the bins that they have; __open: of a group's `spare` emptiest bins."""
    names = [c for c in rows.columns if c not in ("sequence_id", "offset", "__deal", "__open")]
    kept = [*names, "sequence_id"] if "sequence_id" in rows.columns else names
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40 | turn << 32
        held, n = [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal base
            table = pa.Table.from_batches(held).combine_chunks()
            lengths = table.column(at).to_numpy().astype(np.int64)
            given = np.unique(table.column(len(names)).to_numpy(), return_inverse=True)[1] if len(kept) > len(names) else None
            bins, offset = pack_group(lengths, capacity, given)
            fill = np.bincount(bins, weights=lengths)
            emptiest = np.argsort(fill, kind="stable")[:spare]
            open_ = np.isin(bins, emptiest[fill[emptiest] < capacity])
            out = table.select(names).append_column("sequence_id", pa.array(base + bins)).append_column("offset", pa.array(offset))
            base += int(bins.max()) + 1
            yield from out.append_column("__open", pa.array(open_)).to_batches()

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if n >= MOST:
                # a bin's rows stand together and stay together
                whole = 0
                if given_bins:
                    ids = batch.column(len(names)).to_numpy()
                    whole = int(np.argmax(ids != last)) if (ids != last).any() else len(ids)
                if whole:
                    held.append(batch.slice(0, whole))
                    batch = batch.slice(whole)
                if not batch.num_rows:
                    continue
                yield from packed()
                held, n = [], 0
            held.append(batch)
            n += batch.num_rows
            last = batch.column(len(names))[-1].as_py() if given_bins else None
        if held:
            yield from packed()

    given_bins = len(kept) > len(names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return (
        rows.repartition(groups, deal)
        .sortWithinPartitions(deal)
        .select(*kept)
        .mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint, __open boolean")
    )


def pack(rows: DataFrame, count: int, capacity: int = SEQUENCE, group: int = GROUP, spare: int = SPARE) -> DataFrame:
    """Rows with a column length (1 to capacity) and columns sequence_id and offset; count: of rows below capacity, about.

    Rows are dealt by a hash of all their columns, so neither ids nor sources matter; equal rows beyond MOST in one
    group form groups of their own. The `spare` emptiest bins of each group meet in further rounds of local search,
    until they are one group, so a group's last bins are not lost. Rounds are cut by checkpoints: keep rows slim.
    """
    names = rows.columns
    groups = max(1, round(count / group))
    found = _search(rows.withColumn("__deal", F.xxhash64(*names)), "__deal", groups, capacity, spare, 0)
    done: list[DataFrame] = []
    turn = 0
    while groups > 1:
        found = cut(found)
        done.append(found.where(~F.col("__open")))
        found = found.where("__open")
        turn += 1
        groups = max(1, min(round(found.count() / group), groups // 2))
        found = _search(found.withColumn("__deal", F.xxhash64("sequence_id")), "__deal", groups, capacity, spare, turn)
    for part in done:
        found = found.unionByName(part)
    return found.drop("__open")
