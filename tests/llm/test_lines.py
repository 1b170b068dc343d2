"""Line dedup against a comparison of all pairs of lines."""

import random

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import lines

BITS = 10  # of the rarity table: many words share a bucket


def brute_lines(rows):
    """(row number, line number) of every line with an earlier similar one; rows of one id must have one text."""
    seen, out = [], set()
    order = sorted((-(2**63) if i is None else i, k, r, frozenset(line.lower().split(" ")) - {""}) for r, (i, t) in enumerate(rows) if t is not None for k, line in enumerate(t.split("\n")))
    for i, k, r, words in order:
        if words:
            if any((j, m) < (i, k) and 5 * len(words & w) >= 4 * len(words | w) for j, m, w in seen):
                out.add((r, k))
            seen.append((i, k, words))
    return out


def removed(spark, rows, names="doc_id long, text string, token string"):
    df = spark.createDataFrame([(*r, "c") for r in rows], names)
    got = lines.line_report(df, bits=BITS).collect()
    assert len(got) == len(rows)
    place = {i: r for r, (i, _) in enumerate(rows)}
    return {(place[x["doc_id"]], int(k)) for x in got for k in x["removed"].split(",") if k}


def made_lines(rnd, sizes, vocabulary, groups, change):
    made = []
    for _ in range(groups):
        base = rnd.sample(vocabulary, rnd.choice(sizes))
        for _ in range(rnd.randint(1, 6)):
            line = list(base)
            for _ in range(rnd.randint(0, max(1, int(change * len(line))))):
                at = rnd.randrange(len(line))
                line[at : at + 1] = rnd.choices(vocabulary, k=rnd.randint(0, 2))
            made.append(" ".join(line))
    rnd.shuffle(made)
    return made


@pytest.mark.parametrize("seed,expected,wide,crowd", [(1, 64, 400, 16), (2, 2, 400, 2), (3, 1, 9, 1), (4, 0.01, 400, 3), (5, 4, 6, 2), (6, 0.01, 6, 400), (7, 1, 7, 400)])
def test_line_dedup_is_exact(spark, monkeypatch, seed, expected, wide, crowd):
    """Keys of one, two and three words, neighbours of wide lines and crowds of any size find the same repeats as all pairs."""
    for name, value in (("LIST", expected), ("WIDE", wide), ("CROWD", crowd)):
        monkeypatch.setattr(lines, name, value)
    rnd = random.Random(seed)
    made = made_lines(rnd, range(1, 15), [f"w{i}" for i in range(60)], 40, 0.3)
    rows = [(10 * i, "\n".join(made[4 * i : 4 * i + 4])) for i in range(-(-len(made) // 4))]
    rows += [(3, ""), (4, None), (5, "\n \n"), (None, made[0]), (7, made[1].upper() + "\n" + made[1])]
    assert removed(spark, rows) == brute_lines(rows)


@pytest.mark.parametrize("expected,wide", [(64, 400), (1, 400), (1, 30), (0.01, 64)])
def test_long_lines_are_exact(spark, monkeypatch, expected, wide):
    monkeypatch.setattr(lines, "LIST", expected)
    monkeypatch.setattr(lines, "WIDE", wide)
    rnd = random.Random(wide + expected)
    made = made_lines(rnd, [20, 36, 45, 90, 700], [f"w{i}" for i in range(1500)], 14, 0.11)
    rows = list(enumerate(made))
    want = brute_lines(rows)
    assert want and removed(spark, rows) == want


@pytest.mark.parametrize("size", [60, 100, 200, 300])
def test_long_lines_of_common_words_are_exact(spark, monkeypatch, size):
    """All words are in many lines, so that every key is a run of neighbours (or a choice in the shortest)."""
    monkeypatch.setattr(lines, "LIST", 2)
    rnd = random.Random(size)
    made = made_lines(rnd, [size, size + 3, size + size // 5], [f"w{i}" for i in range(size * 3 // 2)], 25, 0.08)
    rows = list(enumerate(made))
    want = brute_lines(rows)
    assert want and removed(spark, rows) == want


def test_a_line_has_fewer_keys_than_words(spark):
    """Entries whose words all have the rarity of a word in half of 4,000 lines."""
    level = lines._steps(2000)
    entries = [(n, n, 0, 0, n, 0, 0, [(level << 56) + k for k in range(n)]) for n in (52, 64, 65, 100, 200, 300)]
    df = spark.createDataFrame(entries, "key long, doc long, text_key long, line_no int, n int, odd long, odder long, head array<long>")
    df = df.unionByName(spark.range(4000).select((F.col("id") + 1000).alias("key"), *(F.lit(0).cast(t).alias(c) for c, t in (("doc", "long"), ("text_key", "long"), ("line_no", "int"), ("n", "int"), ("odd", "long"), ("odder", "long"))), F.array().cast("array<long>").alias("head")))
    got = {r["key"]: r["count"] for r in lines.postings(df, spark.createDataFrame([], "key long")).groupBy("key").count().collect()}
    assert all(got[n] < n for n in (65, 100, 200, 300)) and got[52] < 700 and got[64] < 700


def test_a_crowd_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(lines, "LIST", 4)
    rnd = random.Random(9)
    base, other = ([f"{x}{i}" for i in range(12)] for x in "pq")
    rows = []
    for i in range(150):
        line = list(base if i % 3 else other)
        for _ in range(rnd.randint(0, 3)):
            line[rnd.randrange(12)] = f"z{rnd.randrange(400)}"
        rows.append((i, " ".join(line)))
    rnd.shuffle(rows)
    assert removed(spark, rows) == brute_lines(rows)


def test_words_with_equal_short_hashes(spark):
    """Two words whose 32-bit hashes are equal count as two."""
    one, two = "w254943", "w267111"
    assert spark.range(1).select(F.hash(F.lit(one)) == F.hash(F.lit(two))).first()[0]
    common = [f"c{i}" for i in range(10)]
    rows = [(1, " ".join([*common, one, two])), (2, " ".join([*common, one, two, "x", "y", "z"]))]
    assert removed(spark, rows) == brute_lines(rows) == {(1, 0)}


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    rows = [(1, "alpha beta gamma\nunique one two three"), (1, "zz yy xx ww\nalpha beta gamma"), (None, "k l m"), (None, "n o p\nk l m"), (5, "q r s"), (5, "q r s")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["text"] for r in lines.without_duplicate_lines(df, bits=BITS).collect())
    left = "\n".join(got).split("\n")
    assert len(got) == len(rows) and left.count("alpha beta gamma") == 1 and left.count("unique one two three") == 1 and left.count("zz yy xx ww") == 1
    assert left.count("k l m") == 1 and left.count("n o p") == 1 and left.count("q r s") == 2


def test_line_dedup_rewrites_texts_and_keeps_rows_and_columns(spark):
    names = "doc_id long, text string, gone int, doc string, text_key string, __doc int, __gone int, line_no int, key int"
    rows = [(1, "A b c\nx y"), (2, "a b c\nnew one\n\nx y"), (3, None), (4, "x y")]
    df = spark.createDataFrame([(*r, r[0], "d", "t", 1, 2, 3, 4) for r in rows], names)
    out = lines.without_duplicate_lines(df, bits=BITS)
    assert out.columns == df.columns
    got = {r["doc_id"]: (r["text"], r["gone"], r["doc"], r["__gone"]) for r in out.collect()}
    assert got == {1: ("A b c\nx y", 1, "d", 2), 2: ("new one\n", 2, "d", 2), 3: (None, 3, "d", 2), 4: ("", 4, "d", 2)}
    report = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed"]) for r in lines.line_report(df, bits=BITS).collect()}
    assert report == {1: (2, 0, ""), 2: (4, 2, "0,3"), 3: (0, 0, ""), 4: (1, 1, "0")}
    assert lines.duplicate_lines(df.limit(0), bits=BITS).count() == 0 and lines.without_duplicate_lines(df.limit(0), bits=BITS).count() == 0
    assert lines.line_report(df.limit(0), bits=BITS).count() == 0


def test_the_rarity_table(spark):
    df = spark.createDataFrame([("a a b\nA",), (None,), ("b",)], "text string")
    table = lines.word_rarity(df, bits=BITS).first()["rarity"]
    at = {w: spark.range(1).select(F.shiftrightunsigned(F.xxhash64(F.lit(w)), 64 - BITS)).first()[0] for w in "ab"}
    assert len(table) == 1 << BITS and table[at["a"]] == 3 and table[at["b"]] == 2 and sum(map(bool, table)) == 2
