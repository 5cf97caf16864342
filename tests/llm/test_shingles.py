import random

import corpus_pipeline
import numpy as np

from arborist.llm import shingles


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_kept(rows):
    """Smallest ids of components, all pairs compared."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), 10**9), i)
    return set(least.values())


def edited(rnd, words, edits):
    out = list(words)
    for at in rnd.sample(range(len(out)), edits):
        out[at] = f"x{rnd.randrange(10**6)}"
    return out


def corpus():
    rnd = random.Random(4)
    rows = []
    for n, edits in [(150, (1, 2)), (400, (1, 4, 8)), (60, (1,)), (1200, (9, 20)), (100, (4, 9))] * 5:
        base = [f"w{rnd.randrange(5000)}" for _ in range(n)]
        rows.append((len(rows), " ".join(base)))
        for e in edits:
            rows.append((len(rows), "  ".join(edited(rnd, base, e)).upper()))
    for text in (None, "", " \n", "one two", "One  two", "one two three"):
        rows.append((len(rows), text))
    return rows


def test_the_stage_equals_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, node string").repartition(5)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    got = sorted(r.doc_id for r in got.collect())
    assert got == sorted(plain_kept(rows))
    assert shingles.keep_first(docs.limit(0)).count() == 0


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(shingles, "BROADCAST", -1)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in shingles.keep_first(docs).collect()} == plain_kept(rows)


def test_crowds_are_compared_in_tiles(spark):
    """Chains and clusters of connected candidates larger than a tile, some not linked to the first text."""
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    texts = [" ".join(edited(rnd, base, rnd.choice([1, 2, 3, 5, 9, 14, 20]))) for _ in range(70)]
    chain = [f"c{k}" for k in range(400)]
    texts += [" ".join(chain[k * 8 : k * 8 + 130]) for k in range(30)] + [" ".join(chain[3:133]), texts[4]]
    rows = corpus() + [(1000 + k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_kept(rows)
    for tile in (4, 15):
        assert {r.doc_id for r in shingles.keep_first(docs, tile=tile).collect()} == want


def test_planted_copies_from_080_to_095():
    rnd = random.Random(2)
    pairs = 0
    while pairs < 200:
        n = rnd.choice([80, 150, 400])
        base = [f"w{rnd.randrange(9000)}" for _ in range(n)]
        other = edited(rnd, base, rnd.randrange(1, 10))
        a, b = plain_set(" ".join(base)), plain_set(" ".join(other))
        if not 0.8 <= len(a & b) / len(a | b) <= 0.95:
            continue
        pairs += 1
        x, y = (shingles.shingles(" ".join(w).encode()) for w in (base, other))
        assert np.intersect1d(shingles.band_keys(x), shingles.band_keys(y)).size
        assert len(set(shingles.linked([x, y]).tolist())) == 1


def test_linked_over_a_chain_and_many():
    rnd = random.Random(3)
    base = [f"w{k}" for k in range(300)]
    chain = [base[k * 10 : k * 10 + 120] for k in range(15)]
    loose = [[f"v{rnd.randrange(10**6)}" for _ in range(120)] for _ in range(40)]
    sets = [shingles.shingles(" ".join(x).encode()) for x in chain + loose]
    label = shingles.linked(sets).tolist()
    assert len(set(label[:15])) == 1 and len(set(label)) == 41
