"""The radius of op2: recall of planted near copies, and pairs and groups against brute force at it."""

import random
from itertools import combinations

import pytest

from fieldloom.llm import fingerprints


def planted(rnd, words, changed, copies):
    vocabulary = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    rows = []
    for k in range(copies):
        text = rnd.choices(vocabulary, k=words)
        copy = list(text)
        for at in rnd.sample(range(words), changed):
            copy[at] = rnd.choice(vocabulary)
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
    return rows


@pytest.mark.parametrize("words,changed,recall", [(100, 1, 0.45), (300, 1, 0.9), (1000, 2, 0.9)])
def test_near_copies_are_grouped(spark, words, changed, recall):
    rows = planted(random.Random(words), words, changed, 60)
    out = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    bits = {r["doc_id"]: int(r["fingerprint"], 16) for r in out}
    near = {i: (bits[i] ^ bits[i ^ 1]).bit_count() <= fingerprints.RADIUS for i in bits}
    assert all((r["near_group"] == r["doc_id"] & ~1) == (near[r["doc_id"]] or r["doc_id"] % 2 == 0) for r in out)
    assert sum(near.values()) >= recall * len(out)


@pytest.mark.parametrize("radius", [2, fingerprints.RADIUS])
def test_groups_are_the_components_of_all_pairs(spark, radius):
    rnd = random.Random(radius)
    fps = {0, 2**128 - 1}
    for _ in range(15):
        x = rnd.getrandbits(128)
        for _ in range(12):
            fps.add(x)
            for bit in rnd.sample(range(128), rnd.randint(1, radius + 2)):
                x ^= 1 << bit
    hub = rnd.getrandbits(128)
    fps = list(fps | {hub ^ (rnd.getrandbits(6) << 50) for _ in range(60)})
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            root[max(find(i), find(j))] = min(find(i), find(j))
    signed = lambda x: x - 2**64 if x >> 63 else x
    rows = [(signed(x >> 64), signed(x & (2**64 - 1)), i) for i, x in enumerate(fps)]
    got = {(r["hi"], r["lo"]): r["near_group"] for r in fingerprints.near_groups(spark.createDataFrame(rows + rows[:4], "hi long, lo long, doc_id long"), radius).collect()}
    assert got == {(hi, lo): find(i) for hi, lo, i in rows}


@pytest.mark.parametrize("spare", [2, 3, 4])
def test_more_blocks_find_the_same_pairs(spare):
    masks = [tuple(x & (2**64 - 1) for x in mask) for tables in fingerprints._masks(fingerprints.RADIUS, spare, 2) for mask in tables]
    rnd = random.Random(spare)
    for _ in range(3000):
        d = sum(1 << b for b in rnd.sample(range(128), fingerprints.RADIUS))
        assert any(not (d >> 64 & h) and not (d & (2**64 - 1) & low) for h, low in masks)


@pytest.mark.parametrize("radius", [0, 1, fingerprints.RADIUS])
def test_tables_of_parts_find_every_pair_once(spark, radius):
    rnd = random.Random(radius)
    fps = {0, 2**128 - 1}
    for _ in range(20):
        x = rnd.getrandbits(128)
        for _ in range(12):
            fps.add(x)
            for bit in rnd.sample(range(128), rnd.randint(1, radius + 2)):
                x ^= 1 << bit
    signed = lambda x: x - 2**64 if x >> 63 else x
    key = {x: (signed(x >> 64), signed(x & (2**64 - 1))) for x in fps}
    rows = fingerprints.near_fingerprints(spark.createDataFrame(list(key.values()), "hi long, lo long"), radius).collect()
    got = {frozenset([(r["hi_a"], r["lo_a"]), (r["hi_b"], r["lo_b"])]): r["distance"] for r in rows}
    want = {frozenset([key[a], key[b]]): (a ^ b).bit_count() for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= radius}
    assert got == want and len(rows) == len(got)
