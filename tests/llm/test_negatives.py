"""Hard negatives against an exhaustive search."""

import math
import random

import pytest

from fieldloom.llm import negatives


def brute(rows, k=5):
    one = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = (label, tuple(math.floor(256 * x) for x in v))
            one[i] = min(one.get(i, w), w)
    out = set()
    for a, (la, va) in one.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, (label, v) in one.items() if i != a)
        for ps, p, _ in [s for s in scored if s[2] == la][:k]:
            fits = [(-s, i) for s, i, label in scored if label != la and 80 * -ps <= 100 * -s <= 100 * -ps][:k]
            out |= {(a, p, r + 1, i, -ps, s) for r, (s, i) in enumerate(fits)}
    return out


def clustered(rnd, n, dims, step):
    centres = [[rnd.uniform(-3, 3) for _ in range(dims)] for _ in range(12)]
    return [(i * step, rnd.randrange(4), [x + rnd.gauss(0, 0.2) for x in rnd.choice(centres)]) for i in range(n)]


def odd_rows(rnd, dims):
    rows = [(100_001 + i, 1, [0.5] * dims) for i in range(300)] + [(200_000 + 100 * i, 2, [0.5] * dims) for i in range(3)]
    rows += [(1, None, [0.1] * dims), (2, 1, None), (3, 1, [float("nan")] * dims), (4, 1, [None] + [0.1] * (dims - 1)), (6, 2, [float("-inf")] * dims), (None, 1, [0.1] * dims)]
    rows += [(300_000, 9, [1.0] * dims), (300_100, 8, [-1.0] * dims), (300_101, 8, [1.0] * dims), (400_000, 1, [0.0] * dims), (400_100, 1, []), (400_200, 3, [0.25]), (500_000, 1, [0.3] * dims), (500_000, 1, [0.2] * dims), (500_000, 0, [0.9] * dims)]
    return rows


@pytest.mark.parametrize("dims, pivots, page_rows, block", [(3, 8, 16, 4), (8, 64, 1024, 64), (2, 1, 5, 1)])
def test_results_equal_an_exhaustive_search(spark, monkeypatch, dims, pivots, page_rows, block):
    monkeypatch.setattr(negatives, "BLOCK_QUERIES", block)
    rnd = random.Random(dims)
    rows = clustered(rnd, 900, dims, 20) + odd_rows(rnd, dims)
    monkeypatch.setattr(negatives, "SAMPLE_ROWS", {3: 40, 8: 4096, 2: 300}[dims])
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, label int, embedding array<double>, page string, distance double").repartition(5)
    vectors = negatives.labelled_vectors(df)
    got = negatives.hard_negatives(vectors, "id % 100 = 0", pivots=pivots, page_rows=page_rows).collect()
    want = brute(rows)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100


def test_search_reads_fewer_pages_than_there_are(spark, monkeypatch):
    read, plain = [], negatives._read

    def counted(index, asked, pairs, k, same_label):
        read.append(pairs.count())
        return plain(index, asked, pairs, k, same_label)

    monkeypatch.setattr(negatives, "_read", counted)
    rnd = random.Random(4)
    df = spark.createDataFrame(clustered(rnd, 2000, 2, 10), "vec_id long, label int, embedding array<double>")
    vectors = negatives.labelled_vectors(df)
    with negatives.Workspace(spark) as work:
        index = negatives.build_index(vectors, work, 16, 20)
        asked = vectors.where("id % 1000 = 0").withColumn("windows", negatives.F.expr("array(struct(-9000000000000000000L as lo, 9000000000000000000L as hi))"))
        assert negatives.search(index, asked, 5, True).count() == 100
        pages = index.pages.count()
    assert len(read) >= 2 and sum(read) < 0.6 * pages * 16  # twenty queries lie near at most sixteen pivots


def test_large_numbers_stay_exact(spark):
    rows = [(100 * i, i % 2, [1e6 + i, -2e6, 3.0e6 - i]) for i in range(6)]
    vectors = negatives.labelled_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    assert {tuple(r) for r in negatives.hard_negatives(vectors, "id % 100 = 0").collect()} == brute(rows)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, 1, [0.5]), (5, 1, [0.2]), (6, 2, [0.19])], "vec_id long, label int, embedding array<float>")
    vectors = negatives.labelled_vectors(df)
    assert [tuple(r) for r in negatives.hard_negatives(vectors, "id % 100 = 0").collect()] == [(0, 5, 1, 6, 128 * 51, 128 * 48)]
    assert negatives.hard_negatives(vectors, "id = 77").count() == 0
    assert negatives.hard_negatives(vectors.limit(0), "id = 0").count() == 0
