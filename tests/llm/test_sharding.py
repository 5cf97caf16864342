import random
import zlib

import pytest

from arborist.llm import sharding

SHAPE = "doc_id long, text string, source string, lang string"


def rows_of(kind):
    rnd = random.Random(2)
    rows = []
    for i in range(3000):
        size = rnd.choice([10, 200, 500, 3000])
        host = "hot" if kind == "hot" or i % 3 == 0 else f"h{i % 17}"
        text = "copy of one text " * 20 if kind == "copies" and i % 3 else "é" + "x" * rnd.randrange(size)
        if kind == "groups" and i % 4 == 0:
            text = f"group {i % 88} " * (i % 88)
        rows.append((i, text, host, rnd.choice(["en", "de", None])))
    return rows


@pytest.mark.parametrize(("kind", "leaves"), [("plain", 1), ("plain", 7), ("hot", 24), ("copies", 7), ("groups", 24)])
def test_shards_are_level_and_gapless(spark, kind, leaves):
    rows = rows_of(kind)
    docs = spark.createDataFrame(rows, SHAPE)
    got = sharding.shard(docs, leaves=leaves).collect()
    text = {i: t for i, t, _, _ in rows}
    assert sorted(r.id for r in got) == sorted(text)
    size, slots, group = [0] * leaves, [[] for _ in range(leaves)], {}
    for r in got:
        data = text[r.id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        group.setdefault(data, []).append(r)
    largest = 0
    for members in group.values():
        whole = sum(r.size for r in members)
        if whole <= sum(size) / leaves:  # a leaf can hold it
            assert len({r.shard for r in members}) == 1
            largest = max(largest, whole)
        else:
            largest = max(largest, members[0].size)
    assert max(abs(x - sum(size) / leaves) for x in size) <= largest
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def kd(units, node, leaves, heavy, dims_seen):
    """The k-d tree by plain lists: {(key, part): shard}."""
    if leaves == 1 or not units:
        return {(u.key, u.part): node for u in units}
    goal = sum(u.bytes for u in units) * (leaves // 2 / leaves)
    spread = [max(u.dims[d] for u in units) - min(u.dims[d] for u in units) for d in range(4)]
    dim = spread.index(max(spread))
    dims_seen.append(dim)
    units = sorted(units, key=lambda u: u.dims[dim])
    total = 0
    for u in units:
        total += u.bytes
        if total >= goal:
            value = u.dims[dim]
            break
    left, filled = set(), 0
    big = [u for u in units if u.bytes > heavy]
    room = goal - sum(u.bytes for u in units if u.dims[dim] < value)
    for u in big:
        if u.dims[dim] < value:
            left.add((u.key, u.part))
            filled += u.bytes
    taken = 0
    for u in sorted((u for u in big if u.dims[dim] == value), key=lambda u: (-u.bytes, u.u)):
        taken += u.bytes
        if taken > room:
            break
        left.add((u.key, u.part))
        filled += u.bytes
    want, small = goal - filled, [u for u in units if u.bytes <= heavy]
    total, at = 0, None
    for v in sorted({u.dims[dim] for u in small}):
        here = sum(u.bytes for u in small if u.dims[dim] == v)
        if total + here >= want:
            at = v
            break
        total += here
    for u in small:
        if at is None or u.dims[dim] < at:
            left.add((u.key, u.part))
    if at is not None:
        ties = {}
        for u in small:
            if u.dims[dim] == at:
                ties.setdefault(u.u % sharding.TIES, []).append(u)
        rest, upto, best, cut = want - total, 0, abs(want - total), -1
        gaps = []
        for t in sorted(ties):
            upto += sum(u.bytes for u in ties[t])
            gaps.append((abs(upto - rest), t))
        if gaps and min(gaps)[0] <= best:
            cut = min(gaps)[1]
        for t, members in ties.items():
            if t <= cut:
                left.update((u.key, u.part) for u in members)
    inside = [u for u in units if (u.key, u.part) in left]
    outside = [u for u in units if (u.key, u.part) not in left]
    return kd(inside, node, leaves // 2, heavy, dims_seen) | kd(outside, node + leaves // 2, leaves - leaves // 2, heavy, dims_seen)


@pytest.mark.parametrize(("kind", "leaves"), [("groups", 8), ("copies", 5)])
def test_against_a_plain_tree(spark, kind, leaves):
    docs = spark.createDataFrame(rows_of(kind)[:600], SHAPE)
    found, _, leaves, leaf = sharding.units(sharding.cut(sharding.points(docs)), leaves)
    found = sharding.cut(found)
    seen = []
    want = kd(found.collect(), 0, leaves, leaf / sharding.HEAVY, seen)
    got = {(r.key, r.part): r.shard for r in sharding.kd_shards(found, leaves, leaf).collect()}
    assert got == want
    assert {0, 3} & set(seen)


def test_the_size_is_an_axis_of_its_own(spark):
    rows = [(7, "x" * (1 + 3**k % 977) + str(k), "one host", "en") for k in range(300)]  # nothing but sizes differ
    docs = spark.createDataFrame(rows, SHAPE)
    got = sharding.shard(docs, leaves=2).collect()
    small, large = ([r.size for r in got if r.shard == k] for k in (0, 1))
    assert sorted(small)[len(small) // 2] < min(large) <= max(small) + 1 or max(small) <= min(large)


def test_names_keep_their_order(spark):
    names = ["host-a.example", "host-b.example", "host-bé.example", "host-c.example", "host-"]
    docs = spark.createDataFrame([(0, f"t{n}", n, "en") for n in names], SHAPE)
    found, *_ = sharding.units(sharding.points(docs), 2)
    by = {r.key: r.dims[1] for r in found.collect()}
    key = {r.host: r.key for r in sharding.points(docs).collect()}
    order = sorted(names, key=lambda n: by[key[n]])
    assert order == sorted(names) and by[key["host-"]] == 0 and by[key["host-c.example"]] == sharding.GRID - 1


def test_nulls_repeats_clashes_and_target(spark):
    rows = [(1, None, None, None), (None, "a", "h", "en"), (2, "", "h", "en"), (2, "", "h", "en"), (3, "z" * 100, "h", "en")]
    docs = spark.createDataFrame(rows, SHAPE).withColumn("node", sharding.F.lit(5)).withColumn("key", sharding.F.lit(6))
    got = sharding.shard(docs, target_bytes=40).collect()
    assert len(got) == 5 and {r.shard for r in got} <= set(range(4))
    null = next(r for r in got if r.id == 1)
    assert (null.size, null.text_crc32) == (8, 0)
    assert sharding.shard(docs.limit(0), leaves=24).count() == 0
    assert sharding.shard(docs.withColumn("doc_id", sharding.F.concat(sharding.F.lit("d"), "doc_id")), leaves=2).count() == 5


def test_blocks_of_slots(spark):
    docs = spark.createDataFrame([(i, "t", "h", "en") for i in range(500)], SHAPE)
    placed = sharding.points(docs).withColumn("shard", sharding.F.pmod("id", sharding.F.lit(3)))
    got = sharding.with_slots(placed, slot_rows=10).collect()
    for k in range(3):
        own = sorted(r.slot for r in got if r.shard == k)
        assert own == list(range(len(own)))
