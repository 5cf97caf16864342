import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborist.llm import suffixes


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(min_size=1, max_size=200), st.text("ab", min_size=1, max_size=300).map(str.encode), st.text("a\x00", min_size=1, max_size=80).map(str.encode)))
def test_suffix_array_and_common_prefixes(text):
    data = np.frombuffer(text, np.uint8)
    order = suffixes.suffix_array(data.copy())
    assert order.tolist() == sorted(range(len(text)), key=lambda k: text[k:])
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    want = [0] + [common(text[i:], text[j:]) for i, j in zip(order, order[1:])]
    assert suffixes.common_prefixes(data, order).tolist() == want


def plain(rows, window):
    """rows: (order key, bytes); removed byte places of each, by brute force."""
    seen, gone = set(), {k: set() for k, _ in rows}
    for k, text in sorted(rows):
        for s in range(len(text) - window + 1):
            w = text[s : s + window]
            if w in seen:
                gone[k] |= set(range(s, s + window))
            seen.add(w)
    return gone


def corpus(seed):
    rnd = random.Random(seed)
    noise = lambda n: "".join(rnd.choice("abcdeé ") for _ in range(n))
    passages = [noise(rnd.choice([30, 45, 80, 300])) for _ in range(8)]
    rows = []
    for k in range(120):
        text = noise(rnd.choice([0, 5, 60]))
        for _ in range(rnd.choice([0, 1, 1, 3])):
            text += rnd.choice(passages) + noise(rnd.choice([0, 3, 50]))
        if k % 17 == 0:
            text += "ab" * 60 + "x" * rnd.choice([10, 150])
        rows.append((k, text))
    return rows + [(900 + k, rows[k][1]) for k in (3, 9, 3 + 17)]


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 300}, {"hot": 3}])
@pytest.mark.parametrize("block", [4 << 20, 700])
def test_dedup_equals_brute_force(spark, monkeypatch, options, block):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", block)
    rows = corpus(len(options) + block)
    docs = spark.createDataFrame([(t, k, 0) for k, t in rows], "text string, doc_id long, start int").repartition(4)
    want = plain([(k, t.encode()) for k, t in rows], 40)
    got = suffixes.dedup(docs, window=40, kmer=16, **options).collect()
    assert len(got) == len(rows)
    text = {k: t.encode() for k, t in rows}
    for r in got:
        gone = {p for s in r.removed for p in range(s.start, s.end)}
        assert gone == want[r.doc_id], r.doc_id
        assert bytes(r.kept) == bytes(c for p, c in enumerate(text[r.doc_id]) if p not in gone) and r.n_bytes == len(text[r.doc_id])
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))


def test_contexts_are_compared_by_their_bytes():
    from arborist.llm.repeats import local_firsts

    rnd = np.random.default_rng(3)
    parts = [rnd.integers(97, 99, rnd.integers(1, 30), np.uint8).tobytes() for _ in range(60)]
    parts += parts[:20] + [p + b"x" for p in parts[:20]] + [p[:-1] + b"y" for p in parts[:20]]
    size = np.array([len(p) for p in parts])
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
    one, other = (x.ravel() for x in np.meshgrid(np.arange(len(parts)), np.arange(len(parts))))
    got = suffixes.equal_contexts(data, start, size, one, other)
    assert got.tolist() == [parts[i] == parts[j] for i, j in zip(one, other)]
    # every key collides: only rows whose bytes are those of the key's first are taken for repeated
    n = len(parts)
    zero = np.zeros(n, np.int64)
    found = local_firsts(zero, zero, np.arange(n), zero, zero, lambda a, b: suffixes.equal_contexts(data, start, size, a, b))
    seen = dict(zip(found["doc"].to_pylist(), found["seen"].to_pylist(), strict=True))
    assert seen == {k: k > 0 and p == parts[0] for k, p in enumerate(parts)}


def test_claims_are_removed_only_where_they_equal_their_source():
    assert suffixes.equal_runs(b"abcdef", b"abcdef", 6) == [(0, 6)] and suffixes.equal_runs(b"abc", b"abc", 4) == []
    assert suffixes.equal_runs(b"aaXbbbbYcc", b"aaZbbbbWccc", 3) == [(3, 7)]
    rows, pos = np.array([0, 0, 0, 1, 0]), np.array([5, 30, 200, 5, 31])
    found = suffixes.merged_claims(rows, pos, np.array([9, 9, 9, 9, 8]), np.zeros(5, np.int64), np.array([15, 40, 210, 5, 31]), 40, 25)
    assert [x.tolist() for x in found] == [[0, 0, 0, 1], [7, 0, 176, 0], [71, 70, 240, 45], [8, 9, 9, 9], [0, 0, 0, 0], [7, 10, 186, 0]]


def test_nulls_repeats_and_equal_ids(spark):
    rnd = random.Random(0)
    passage = "".join(rnd.choice("abcdefgh") for _ in range(130))
    rows = [(5, passage, "a"), (5, passage, "a"), (6, None, "b"), (7, "", None), (8, "pre " + passage, "c"), (None, passage[5:120], "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tie string")
    got = suffixes.dedup(docs).collect()
    gone = {r.doc_id: [(s.start, s.end) for s in r.removed] for r in got}
    assert len(got) == 6 and gone[None] == [] and gone[6] == gone[7] == []
    assert gone[5] == [(5, 120)] and gone[8] == [(4, 134)]
    assert suffixes.dedup(docs.limit(0)).count() == 0


def test_very_long_and_uniform_texts(spark):
    rows = [(1, "a" * 50_000), (2, "b" + "a" * 99), (3, "b" + "a" * 100), (4, "ab" * 20_000)]
    got = {r.doc_id: [(s.start, s.end) for s in r.removed] for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(1, 50_000)], 2: [], 3: [(0, 101)], 4: [(2, 40_000)]}
