"""Posting lists, which an explode makes of nodes, never go to the driver; what joins broadcast was counted."""

import random
from itertools import combinations

import pytest

from fieldloom.llm import common, fingerprints, neardup


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that operators write, as they stand before they run."""
    seen, write = [], common.write_once

    def written(df, path):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        write(df, path)

    monkeypatch.setattr(common, "write_once", written)
    return seen


def components(fps, radius):
    """The least member of each one's component, by all pairs."""
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= radius:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in fps}


def near_copies(bits):
    rnd, out = random.Random(bits), set()
    for _ in range(12):
        x = rnd.getrandbits(bits)
        for _ in range(8):
            out.add(x)
            for _ in range(rnd.choice([1, 2, 3, 9])):
                x ^= 1 << rnd.randrange(bits)
    return sorted(out)


def signed(x):
    return x - 2**64 if x >> 63 else x


def test_nothing_is_broadcast_that_was_not_counted(spark, plans, monkeypatch):
    small, large = common.sized(spark.range(5), common.FEW_ROWS), common.sized(spark.range(5), common.FEW_ROWS + 1)
    assert all((x in spark.range(9).join(side, "id")._jdf.queryExecution().executedPlan().toString()) for x, side in (("BroadcastHashJoin", small), ("SortMergeJoin", large)))

    monkeypatch.setattr(common, "FEW_ROWS", 0)
    short, long = near_copies(64), near_copies(128)
    df = spark.createDataFrame([(signed(x), k) for k, x in enumerate(short)], "fp long, first_id long")
    want = components(short, 4)
    assert {r["fp"]: r["component_id"] for r in neardup.linked_components(df, 4).collect()} == {signed(x): short.index(want[x]) for x in short}
    df = spark.createDataFrame([(signed(x >> 64), signed(x & (2**64 - 1)), k) for k, x in enumerate(long)], "hi long, lo long, doc_id long")
    want = components(long, 8)
    got = {(r["hi"], r["lo"]): r["near_group"] for r in fingerprints.near_groups(df, 8).collect()}
    assert got == {(signed(x >> 64), signed(x & (2**64 - 1))): long.index(want[x]) for x in long}
    assert any("Generate explode" in p for p in plans) and not [p for p in plans if "BroadcastExchange" in p]
