"""Exact top-k and token counts against brute force."""

import math
import random

from fieldloom.llm import tokencounts, topk


def brute(rows, k):
    vectors = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    vectors = [x for n, x in enumerate(vectors) if x not in vectors[:n]]
    out = set()
    for q, a in vectors:
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in vectors if c != q)[:k]
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)}
    return out


def test_top_k_is_exact_with_ties_odd_vectors_and_extra_columns(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([0.0, 0.5, -0.25, rnd.uniform(-1, 1)]) for _ in range(6)], 1, "x") for i in range(0, 420, 2)]
    rows += [(1, None, 1, "x"), (3, [float("nan")] * 6, 1, "x"), (5, [None] + [0.1] * 5, 1, "x"), (7, [float("inf")] * 6, 1, "x"), (None, [0.1] * 6, 1, "x"), (9, [], 1, "x")]
    rows += [(11 + 2 * i, [0.5] * 6, 1, "x") for i in range(40)] + [(400, rows[200][1], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, block string")
    terms = topk.weighted_terms(df)
    got = topk.exact_top_k(terms, terms.where("id % 100 = 0"), k=10, block_rows=64)
    assert {tuple(r) for r in got.collect()} == brute([(r[0], r[1]) for r in rows], 10)


def test_top_k_of_few_and_of_none(spark):
    df = spark.createDataFrame([(0, [0.5, 0.1]), (1, [0.2, 0.3])], "vec_id long, embedding array<float>")
    terms = topk.weighted_terms(df)
    assert [r["id"] for r in topk.exact_top_k(terms, terms.where("id = 0")).collect()] == [1]
    assert topk.exact_top_k(terms.limit(0), terms.limit(0)).count() == 0


def plain_count(word, scores, longest, unknown):
    piece = tokencounts.SPACE + word
    best = [(0.0, 0)]
    for end in range(1, len(piece) + 1):
        top = (best[end - 1][0] + unknown, best[end - 1][1] + 1)
        for start in range(max(0, end - longest), end):
            s = scores.get(piece[start:end])
            if s is not None and best[start][0] + s > top[0]:
                top = (best[start][0] + s, best[start][1] + 1)
        best.append(top)
    return best[-1][1]


def test_token_counts_match_a_plain_forward_pass(spark, monkeypatch):
    texts = ["the thing there then", "", None, "  ", "漢字 😀 naïve thea", "a" * 300, "the the the", "x\ty z"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(None, "the", "k"), (0, texts[0], "k")], "doc_id long, text string, n_tokens string")
    scores = tokencounts.unigram_scores(tokencounts.default_vocabulary())
    longest, unknown = max(map(len, scores)), min(scores.values()) - 10
    got = sorted((r["doc_id"], r["n_words"], r["n_tokens"]) for r in tokencounts.token_counts(df).where("doc_id is not null").collect())
    want = sorted((i, len((t or "").split()), sum(plain_count(w, scores, longest, unknown) for w in (t or "").split())) for i, t in [*enumerate(texts), (0, texts[0])])
    assert got == want
    assert tokencounts.token_counts(df.limit(0)).count() == 0


def test_a_full_trie_begins_anew_with_the_same_counts(monkeypatch):
    scores = {tokencounts.SPACE: -1.0, "ab": -2.0, "a": -3.0, "b": -3.0, tokencounts.SPACE + "a": -2.5}
    words = ["ab", "abab", "ba", "b", "zab"]
    big = tokencounts.ForwardTrie(scores)
    want = [big.insert(w) for w in words]
    monkeypatch.setattr(tokencounts, "MAX_NODES", 2)
    small = tokencounts.ForwardTrie(scores)
    assert [small.insert(w) for w in words] == want


def test_workspaces_of_threads_are_apart(spark):
    from threading import Event, Thread

    from fieldloom.llm.common import Workspace, materialize

    entered, done, read = Event(), Event(), []

    def other():
        with Workspace(spark):
            entered.set()
            done.wait(60)

    side = Thread(target=other)
    side.start()
    entered.wait(60)
    with Workspace(spark) as mine:
        table = materialize(spark.range(3), "mine")
        assert len(mine.paths) == 1
        done.set()
        side.join()
        read.append(table.count())  # the other block's end left it alone
        with Workspace(spark) as inner:
            kept = inner.give(spark.range(2), "kept")
        read.append(kept.count())
    assert read == [3, 2] and not mine.paths
