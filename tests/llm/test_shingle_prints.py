"""SimHash candidates of the near-duplicate stage: fingerprints, tiles and links against plain versions."""

import random

import corpus_pipeline
import numpy as np
import pytest
import xxhash

from arborist.llm import shingles
from arborist.llm.components import components
from tests.llm.test_shingles import corpus, edited, plain_kept, plain_set

M = 2**64 - 1


def plain_print(found):
    """Majorities of the bits of 256-bit hashes, one bit at a time."""
    bits = []
    for seed in shingles._SEEDS.tolist():
        mixed = []
        for h in found.tolist():
            h = (h + seed) & M
            h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M
            h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M
            mixed.append(h ^ (h >> 31))
        bits.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mixed) > len(mixed)))
    return bits


def plain_components(prints, sizes, pairs):
    """The smallest row of each row's component; all given pairs compared."""
    root = list(range(len(prints)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        bits = [(x ^ y).bit_count() for x, y in zip(prints[a], prints[b], strict=True)]
        if sum(bits[:2]) <= 48 and sum(bits) <= 80 and min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b]) - 1e-9:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    return [top(k) for k in range(len(prints))]


def test_the_stage_links_by_fingerprints_only(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []

    def none(texts, *more):
        seen.append(more)
        return spark.createDataFrame([], "u long, v long")

    monkeypatch.setattr(shingles, "print_edges", none)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert len(seen) == 1 and len(kept) == len({t or "" for _, t in rows})


def test_both_kinds_of_candidates_give_the_same(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for edges in (shingles.print_edges, shingles.band_edges):
        assert {r.doc_id for r in shingles.keep_first(docs, edges=edges).collect()} == plain_kept(rows)


@pytest.mark.parametrize("tile", [5, shingles.PRINTS])
def test_print_edges_equal_all_pairs(spark, tile):
    texts = [(t or "").encode() for _, t in corpus()]
    texts = sorted(set(texts)) + [texts[0]]
    rows = [(xxhash.xxh64_intdigest(t) >> 1, t) for t in texts]
    sets = [shingles.shingles(t) for t in texts[:-1]]
    prints, sizes = [plain_print(s) for s in sets], [len(s) for s in sets]
    assert [shingles.fingerprint(s).tolist() for s in sets] == prints
    want = plain_components(prints, sizes, [(a, b) for a in range(len(sets)) for b in range(a)])
    table = spark.createDataFrame(rows, "node long, text binary").repartition(4)
    found = {r.node: r.root for r in components(shingles.print_edges(table, tile=tile)).collect()}
    got = [found.get(n, n) for n, _ in rows[:-1]]
    assert [got.index(x) for x in got] == want and len(set(got)) < len(got)


@pytest.mark.parametrize("split", [None, 0, 37, 150])
def test_blocks_of_a_tile_pair_equal_all_pairs(monkeypatch, split):
    monkeypatch.setattr(shingles, "ROW_BLOCK", 7)
    monkeypatch.setattr(shingles, "COLUMN_BLOCK", 19)
    monkeypatch.setattr(shingles, "LINKS", 10)
    rnd = random.Random(6)
    seeds = [[rnd.getrandbits(64) for _ in range(4)] for _ in range(25)]
    noise = lambda: rnd.getrandbits(64) & rnd.getrandbits(64) & (rnd.getrandbits(64) | rnd.getrandbits(64))
    rows = [([w ^ noise() for w in rnd.choice(seeds)], rnd.choice([0, 1, 50, 62, 63, 64, 78, 79, 80, 100])) for _ in range(150)]
    part = 150 if split is None else split
    rows = sorted(rows[:part], key=lambda r: r[1]) + sorted(rows[part:], key=lambda r: r[1])
    pairs = [(a, b) for b in range(150) for a in range(b if split is None else min(b, split)) if split is None or b >= split]
    prints, sizes = [r[0] for r in rows], [r[1] for r in rows]
    got = shingles.reached(list(np.array(prints, np.uint64).T.copy()), np.array(sizes), split)
    assert got.tolist() == plain_components(prints, sizes, pairs)


def test_sizes_that_fit_lie_in_neighbouring_classes():
    for similarity in (0.5, 0.8, 0.95):
        level = np.searchsorted(shingles.size_bounds(similarity), np.arange(4000), "right") - 1
        for t in range(1, 4000):
            assert level[t] - level[int(np.ceil(similarity * t - 1e-9))] <= 1


def test_fingerprints_of_planted_copies_are_near():
    rnd = random.Random(2)
    pairs = 0
    assert shingles.radius(256, 0.8) == 80 and shingles.radius(128, 0.8) == 48
    while pairs < 400:
        base = [f"w{rnd.randrange(9000)}" for _ in range(rnd.choice([25, 80, 150, 400]))]
        other = edited(rnd, base, rnd.randrange(1, 10))
        a, b = plain_set(" ".join(base)), plain_set(" ".join(other))
        if not 0.8 <= len(a & b) / len(a | b) <= 0.95:
            continue
        pairs += 1
        x, y = (shingles.fingerprint(shingles.shingles(" ".join(w).encode())) for w in (base, other))
        bits = np.bitwise_count(x ^ y)
        assert bits[:2].sum() <= 48 and bits.sum() <= 80


def test_edges_do_not_depend_on_the_order_of_rows(spark):
    rnd = random.Random(8)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(edited(rnd, base, 2)).encode()) for k in range(60)]
    found = []
    for parts in (1, 6):
        rnd.shuffle(rows)
        table = spark.createDataFrame(rows, "node long, text binary").repartition(parts)
        found.append({tuple(r) for r in shingles.print_edges(table).collect()})
    assert found[0] == found[1] and len(found[0]) >= 59
