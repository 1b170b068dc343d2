"""Exact dedup by content sort against plain Python."""

import hashlib
import random
import re

import pytest

from fieldloom.llm import contentsort


def brute(rows):
    norm = [re.sub(r"[ \t-\r]+", " ", t or "", flags=re.ASCII) for _, t in rows]
    groups = {}
    for k, n in enumerate(norm):
        groups.setdefault(n, []).append(k)
    out = []
    for n, members in groups.items():
        ids = [rows[k][0] for k in members]
        order = sorted(members, key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
        known = [i for i in ids if i is not None]
        out += [(rows[k][0], min(known) if known else None, len(members), k == order[0], hashlib.sha256(n.encode()).hexdigest()) for k in members]
    return sorted(out, key=repr)


def some_rows():
    rnd = random.Random(5)
    texts = ["", " ", None, "\t \n", "a b", "a  b", "a\tb", "a b", "A b", "é x", "é x", "long " * 30_000, "long " * 30_000 + "x", "漢字　漢字", "a\x00b", " a b", "a b "]
    rows = [(i, rnd.choice(texts)) for i in range(1000, 1400)]
    rows += [(2 * i, "the hot  text " + "w" * 100) for i in range(600)] + [(2 * i + 1, "the hot text\n" + "w" * 100) for i in range(300)]
    rows += [(i + 5000, "same head " * 20 + str(i % 40)) for i in range(120)]
    rows += [(None, "no id"), (None, "no id"), (None, "a b"), (7, "repeated row"), (7, "repeated row"), (7, "another text of seven")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions, coalesce", [(1, True), (3, True), (37, False)])
def test_report_equals_brute_force_wherever_partitions_cut(spark, partitions, coalesce):
    rows = some_rows()
    df = spark.createDataFrame([(i, t, "x", 1, True) for i, t in rows], "doc_id long, text string, keep string, part int, kept boolean").repartition(5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
        got = sorted(map(tuple, contentsort.duplicate_report(df).collect()), key=repr)
        kept = contentsort.without_duplicates(df).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute(rows)
    assert sum(r[3] for r in got) == len({g[4] for g in got})
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, len(re.sub(r"[ \t-\r]+", " ", r["text"] or ""))) for r in kept) == sorted((g[0] is None, g[0] or 0, len(re.sub(r"[ \t-\r]+", " ", text_of(rows, g)))) for g in got if g[3])
    assert kept[0].asDict().keys() == {"doc_id", "text", "keep", "part", "kept"} and all(r["keep"] == "x" for r in kept)


def text_of(rows, g):
    return next(t or "" for i, t in rows if i == g[0] and hashlib.sha256(re.sub(r"[ \t-\r]+", " ", t or "", flags=re.ASCII).encode()).hexdigest() == g[4])


def test_empty_and_single(spark):
    df = spark.createDataFrame([(3, None)], "doc_id long, text string")
    assert [tuple(r) for r in contentsort.duplicate_report(df).collect()] == [(3, 3, 1, True, hashlib.sha256(b"").hexdigest())]
    assert contentsort.duplicate_report(df.limit(0)).count() == 0 and contentsort.without_duplicates(df.limit(0)).count() == 0
    assert [tuple(r) for r in contentsort.without_duplicates(df).collect()] == [(3, None)]
