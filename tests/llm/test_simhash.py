import random

import numpy as np
import pytest
import xxhash

from arborist.llm import shingles, simhash
from arborist.llm.components import components


def plain_fingerprint(text):
    words = []
    for c in text or "":
        pass
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(rows):
    prints = {}
    for i, text in rows:
        prints.setdefault(plain_fingerprint(text), []).append(i)
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    keys = list(prints)
    for a in range(len(keys)):
        for b in range(a):
            if (keys[a] ^ keys[b]).bit_count() <= 3:
                root[top(keys[a])] = top(keys[b])
    least = {}
    for p, ids in prints.items():
        least[top(p)] = min([least.get(top(p), 10**9), *[i for i in ids if i is not None]])
    return {i: least[top(p)] for p, ids in prints.items() for i in ids}


def corpus(seed=5):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["Été", "ÀB", "x y"]
    rows = []
    for i in range(120):
        base = [rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 3, 5, 40, 200]))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rnd.choice([0, 0, 1, 4])):
            other = list(base)
            if other:
                other[rnd.randrange(len(other))] = rnd.choice(words)
            rows.append((len(rows), " \n".join(other)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \t\n")]
    return rows


@pytest.mark.parametrize("tile", [4096, 8])
def test_near_duplicates_equal_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash.link, "__defaults__", (3, tile))
    rows = corpus()
    docs = spark.createDataFrame([(t, i, "k") for i, t in rows], "text string, doc_id bigint, fingerprint string")
    got = {r.id: (r.fingerprint % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    want = plain_components(rows)
    assert got == {i: (plain_fingerprint(t), want[i]) for i, t in rows}


def test_dense_prints_in_hot_bands(spark, monkeypatch):
    monkeypatch.setattr(simhash.link, "__defaults__", (3, 16))
    rnd = random.Random(1)
    prints = {rnd.getrandbits(12) | (rnd.getrandbits(3) << 60) for _ in range(600)}
    prints = list(np.array(list(prints), np.uint64).view(np.int64).tolist())
    edges = simhash.link(spark.createDataFrame([(p,) for p in prints], "fingerprint bigint"))
    found = {r.node: r.root for r in components(edges).collect()}
    unsigned = [p % 2**64 for p in prints]
    root = list(range(len(prints)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (unsigned[a] ^ unsigned[b]).bit_count() <= 3:
                root[top(a)] = top(b)
    parts = {}
    for k, p in enumerate(prints):
        parts.setdefault(top(k), set()).add(found.get(p, p))
    assert all(len(v) == 1 for v in parts.values())
    assert len({next(iter(v)) for v in parts.values()}) == len(parts)


def test_keep_first_with_repeats_nulls_and_none(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (2, "a b c d", "y"), (3, None, "z"), (4, "", None), (None, "q r s t", "n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id string")
    kept = sorted(simhash.keep_first(docs).collect(), key=str)
    assert sorted((r.doc_id for r in kept), key=str) == [1, 3, None]
    assert simhash.keep_first(docs.limit(0)).count() == 0
    assert simhash.keep_first(docs).columns == docs.columns


def test_keep_first_tells_null_and_repeated_ids_apart(spark):
    prose = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(None, prose(k)) for k in range(6)] + [(7, prose(k)) for k in range(6, 9)]
    rows += [(None, prose(20)), (3, prose(20)), (None, prose(0)), (7, prose(6)), (8, prose(8))]
    want = sorted([(None, prose(k)) for k in range(6)] + [(7, prose(k)) for k in range(6, 9)] + [(3, prose(20))], key=str)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for keep_first in (simhash.keep_first, shingles.keep_first):
        assert sorted(map(tuple, keep_first(docs).collect()), key=str) == want
