"""Document fingerprints and SimHash near-dedup against brute force."""

import hashlib
import random
import re
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from fieldloom.llm import fingerprints, graph, neardup


def reference_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps, radius):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    groups = {}
    for k, i in enumerate(ids):
        groups.setdefault(find(k), []).append(i)
    return {i: min(groups[find(k)]) for k, i in enumerate(ids)}


def test_simhash_fingerprints_follow_the_contract(spark):
    texts = [None, "", " \t\n", "One two", "a b c d", "A B C D", "é É x y z", "w " * 5000, "x y z u v", "the same line again " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in neardup.fingerprints(df).collect()}
    assert got == {i: reference_fp(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("radius", [3, 4, 6])
def test_linked_components_are_those_of_all_pairs(spark, radius):
    rnd = random.Random(radius)
    fps = {0, 2**64 - 1}
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(14):
            fps.add(x)
            for _ in range(rnd.randint(1, radius + 2)):
                x ^= 1 << rnd.randrange(64)
    hub = rnd.getrandbits(64)
    fps |= {hub ^ (rnd.getrandbits(8) << 20) for _ in range(60)}
    fps = list(fps)
    ids = [3 * k + 5 for k in range(len(fps))]
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    df = spark.createDataFrame(list(zip(signed, ids)), "fp long, first_id long")
    got = {r["fp"]: r["component_id"] for r in neardup.linked_components(df, radius).collect()}
    want = components(ids, fps, radius)
    assert got == {s: want[i] for s, i in zip(signed, ids)}


def test_every_four_positions_hold_a_set():
    sets = neardup.position_sets(4)
    assert len(sets) == 20 and all(any(set(s) <= set(q) for s in sets) for q in combinations(range(8), 4))


def test_copies_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(4, "a b c d e", 1), (2, "a b c d e", 1), (2, "a b c d e", 1), (None, "a b c d e", 1), (9, None, 1), (7, "", 1)], "doc_id long, text string, fp int")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in neardup.simhash_components(df).collect())
    assert got == [(-1, 2), (2, 2), (2, 2), (4, 2), (7, 7), (9, 7)]
    assert neardup.simhash_components(df.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(5, 5), (None, 3), (7, 6)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{200 + i: 100 for i in range(30)}}


def test_next_text_and_edited_text(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 5)
    rnd = random.Random(1)
    rows = [(i * i, "".join(rnd.choice("ab é😀") for _ in range(rnd.randint(0, 30)))) for i in range(57)] + [(-4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r["doc_id"]: (r["next_id"], r["next_text"]) for r in fingerprints.with_next_text(df).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert near == {i: order[(k + 1) % len(order)] for k, (i, _) in enumerate(order)}
    got = {i: t for i, (_, t) in near.items()}
    texts = dict(order)
    result = fingerprints.edited_fingerprints(df).collect()
    assert len(result) == len(rows)
    for r in result:
        t, n = texts[r["doc_id"]], got[r["doc_id"]]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == t:
            assert r["fingerprint"] == r["edited_fingerprint"] and r["near_edited"] == 1


def reference_votes(text):
    """The 128-bit fingerprint: two-word terms vote with their code points."""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    runs = [words[i : i + 2] for i in range(len(words) - 1)] or ([words] if words else [])
    votes = [0] * 128
    for run in runs:
        hi = 42
        for w in run if len(words) > 1 else [" ".join(run)]:
            hi = xxhash.xxh64_intdigest(w.encode(), hi)
        lo = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), xxhash.xxh64_intdigest(hi.to_bytes(8, "little"), 42))
        for bit in range(64):
            votes[64 + bit] += sum(map(len, run)) * (1 if hi >> bit & 1 else -1)
            votes[bit] += sum(map(len, run)) * (1 if lo >> bit & 1 else -1)
    return sum(1 << bit for bit, v in enumerate(votes) if v > 0)


@pytest.mark.parametrize("bucket_rows", [4, 2000])
def test_the_query_equals_brute_force(spark, monkeypatch, bucket_rows):
    """Nulls, shared and missing ids, repeated rows, copies, near copies, a very long text and columns of the query's own names."""
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", bucket_rows)
    rnd = random.Random(bucket_rows)
    vocabulary = ["".join(rnd.choice("aeioulmnrsté") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    rows = [(5 * i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 120)))) for i in range(60)]
    base = rnd.choices(vocabulary, k=400)
    for i in range(25):
        copy = list(base)
        for at in rnd.sample(range(400), i % 3):
            copy[at] = rnd.choice(vocabulary)
        rows.append((1000 + i, " ".join(copy)))
    rows += [(2000, None), (2001, ""), (2002, " \n\t "), (2003, "One"), (2004, rows[3][1]), (7, "shared a b"), (7, "shared c d"), (7, rows[9][1])]
    rows += [(None, f"none {i} x") for i in range(9)] + [(3000, "twice the same row")] * 2 + [(3001, " ".join(rnd.choices(vocabulary, k=40_000)))]
    names = "doc_id long, text string, next_id long, hi string, lo string, bucket int, rows int, at int, hash int"
    df = spark.createDataFrame([(*r, 1, "h", "l", 2, 3, 4, 5) for r in rows], names)
    got = fingerprints.edited_fingerprints(df).collect()

    signed = lambda t: spark_hash[t]
    texts = sorted({t or "" for _, t in rows})
    spark_hash = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(((-(2**63) if i is None else i, signed(t or ""), t or "", i) for i, t in rows), key=lambda x: x[:3], reverse=True)
    fps = {t: reference_votes(t) for t in texts}
    distinct = sorted(set(fps.values()))
    group = components(list(range(len(distinct))), distinct, fingerprints.RADIUS)
    least = {}
    for i, t in rows:
        g = group[distinct.index(fps[t or ""])]
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    want = []
    for k, (_, _, t, i) in enumerate(order):
        n = order[(k + 1) % len(order)][2]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        own, after, beside = fps[t], reference_votes(edited), fps[n]
        share = lambda x: 1 - (own ^ x).bit_count() / 128
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{own:032x}", f"{after:032x}", share(after), share(beside), least[group[distinct.index(own)]]))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_equal_texts_share_a_fingerprint_and_halves_stay_nearer_than_strangers(spark):
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=150))) for i in range(40)] + [(50, "same words here"), (51, "same words here"), (52, "")]
    out = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[50]["fingerprint"] == by_id[51]["fingerprint"] and by_id[52]["fingerprint"] == "0" * 32
    assert sum(r["near_edited"] > r["near_next"] for r in out if r["doc_id"] < 39) >= 38


def test_one_row_and_no_row(spark):
    one = spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")
    assert fingerprints.edited_fingerprints(one).first()["near_next"] == 1
    assert fingerprints.edited_fingerprints(one.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [2, 3, 5])
def test_block_tables_find_every_pair(spark, radius):
    rnd = random.Random(radius)
    fps = set()
    for _ in range(15):
        x = rnd.getrandbits(128)
        for _ in range(8):
            fps.add(x)
            for _ in range(rnd.randint(1, 3)):
                x ^= 1 << rnd.randrange(128)
    signed = lambda x: x - 2**64 if x >> 63 else x
    rows = [(signed(x >> 64), signed(x & (2**64 - 1))) for x in fps]
    df = spark.createDataFrame(rows + rows[:5] + [(None, 1)], "hi long, lo long")
    got = {frozenset([(r["hi_a"], r["lo_a"]), (r["hi_b"], r["lo_b"])]): r["distance"] for r in fingerprints.near_fingerprints(df, radius).collect()}
    key = dict(zip(fps, rows))
    want = {frozenset([key[a], key[b]]): (a ^ b).bit_count() for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= radius}
    assert got == want


def test_votes_are_signed_and_weighted(spark):
    df = spark.createDataFrame([(1, "aa bb aa bb cc")], "key long, text string")
    got = fingerprints.fingerprints(df, 2).first()
    pairs = [("aa", "bb"), ("bb", "aa"), ("aa", "bb"), ("bb", "cc")]
    hashes = [spark.range(1).select(F.xxhash64(F.lit(a), F.lit(b)).alias("h")).select("h", F.xxhash64("h", F.lit(1))).first() for a, b in pairs]
    for word, name in enumerate(("hi", "lo")):
        want = sum(1 << b for b in range(64) if sum(4 if h[word] >> b & 1 else -4 for h in hashes) > 0)
        assert got[name] & (2**64 - 1) == want
