"""The divergence audit against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from fieldloom.llm import divergence

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_docs, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))) for lang, source, text in rows]
    holds, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        holds[lang].update(set(terms))
        n[lang, source].update(terms)
    out = set()
    for lang in {d[0] for d in docs}:
        kept = [t for t, c in holds[lang].items() if c >= min_docs]
        groups = {s: c for (at, s), c in n.items() if at == lang}

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(sum(groups.values(), Counter()))
        for s, c in groups.items():
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found, k in (("pair", pair, len(pair)), ("term", term, top)):
                out |= {(lang, s, part, i, v, r + 1) for r, (v, i) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:k])}
    return out


def some_rows():
    rnd = random.Random(8)
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnop"] + ["Été", "ÉTÉ", "straße", "漢字", "don't", "A1b2", "x_y", "İ", "naïve blank", "zz\x00zz", "😀"]
    rows = [(rnd.choice(["en", "de", "EN", None]), f"s{int(rnd.expovariate(0.25))}", " ".join(rnd.choices(words, k=rnd.randrange(0, 60)))) for _ in range(500)]
    rows += [("en", "hot", "Wak wal " * 5)] * 150 + [("en", "long", "wam " * 50_000 + "wan")] + [("en", None, None), ("xx", "a", "rare"), ("xx", "b", None), ("xx", None, ""), ("yy", "alone", "")]
    return rows


@pytest.mark.parametrize("slice_terms, block_groups, pending", [(32768, 8, 400_000), (7, 2, 50), (1, 1, 1)])
def test_audit_equals_brute_force(spark, monkeypatch, slice_terms, block_groups, pending):
    monkeypatch.setattr(divergence, "PENDING", pending)
    rows = some_rows()
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "lang string, source string, text string, term int, value string")
    got = divergence.divergence_audit(df, min_docs=5, top_terms=10, slice_terms=slice_terms, block_groups=block_groups).collect()
    want = brute(rows, 5, 10)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_every_two_blocks_meet_once():
    for blocks in (1, 3, 5, 9):
        met = Counter(frozenset((b, (b - d) % blocks)) for b in range(blocks) for d in range(1, (blocks - 1) // 2 + 1))
        assert len(met) == blocks * (blocks - 1) // 2 and set(met.values()) <= {1}


def test_empty(spark):
    assert divergence.divergence_audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_shares_beyond_64_bits(spark):
    row = spark.range(1).select(divergence.F.expr(divergence._share("cast(9000000000000 as bigint)", "cast(90000000000000 as bigint)", "cast(7 as bigint)")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (9 * 10**12 + 5) // (9 * 10**13 + 35)
