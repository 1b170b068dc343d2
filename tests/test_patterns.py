"""Checked patterns and the index of required literals."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import patterns as P
from fieldloom.functions import text as X
from fieldloom.operators import extraction


def test_covers_hold_for_every_match():
    cases = {
        "abcd": [["abc"], ["bcd"]], "ab": [], "(abc)d": [["abc"], ["bcd"]], "abc?def": [["def"]], "(?:abc)?": [], "(?i)abc": [], "a[b]cde": [["abc"], ["bcd"], ["cde"]], "(one|three|four)x": None,
        r"\d{3}-total": [["-to"], ["tot"], ["ota"], ["tal"]], "(abc)+": [["abc"]], "(abc){0,3}": [], "x|abc": [], r"a\.bc": [["a.b"], [".bc"]],
    }
    for pattern, want in cases.items():
        got = P.inspect(pattern)["covers"]
        if pattern.startswith("(one"):
            assert len(got) == 1 and all(any(g in t for g in got[0]) for t in ("onex", "threex", "fourx"))
        else:
            assert sorted(got) == sorted(map(sorted, want)), pattern


BROKEN = ["a(", "[", "(?P<n>x", "*x", "(?<n>x", "a{2,1}", "\\", "[-.\\\\s]?\\\\(?[0-9]"]


def test_what_cannot_run_is_set_aside_with_a_reason(spark):
    given = [*BROKEN, "[(]x", r"(?P<first_name>\d+) y", r"\\(x)", r"(a)\1", r"\p{L}", r"(?(1)a|b)", "", None, "a+", "a+"]
    got = {r["pattern"]: r for r in P.checked(spark.createDataFrame([(p,) for p in given], "pattern string")).collect()}
    assert set(got) == {p for p in given if p is not None}
    assert all(got[p]["error"] for p in [*BROKEN, r"\p{L}", r"(?(1)a|b)", ""])
    assert [(got[p]["error"], got[p]["groups"]) for p in ("[(]x", r"(?P<first_name>\d+) y", r"\\(x)", r"(a)\1", "a+")] == [(None, 0), (None, 1), (None, 1), (None, 1), (None, 0)]


def test_matches_equal_trying_every_pattern(spark):
    rnd = random.Random(2)
    syllables = ["ab", "cd", "total", "12", "-", " ", "x.y", "é", "(", "No. "]
    texts = {(rnd.choice("AB"), "".join(rnd.choices(syllables, k=rnd.randrange(0, 9)))) for _ in range(400)} | {("A", ""), ("B", "漢字漢字")}
    patterns = [r"total(\d+)?", "abcd", "^ab", r"\d{2}", "(ab|cd)total", "x.y", r"x\.y", "(?i)TOTAL", "漢字漢", "é+", ".*", "", "a(", r"(?P<n>\d+)-", r"No\. (ab)", "(?:abab|cdcd|1212)", "ab(?=cd)cdab", None]
    table = spark.createDataFrame([(s, p) for p in patterns for s in "AB"], "scope string, pattern string")
    rows = spark.createDataFrame([*texts, ("A", None), (None, "abcd"), ("C", "abcd")], "scope string, text string")
    met = P.pattern_matches(rows, P.pattern_index(table, "scope"), "scope")
    got = {(r["scope"], r["text"], r["pattern"], r["v"]) for r in met.withColumn("v", P.found_value(F.col("text"), F.col("regex"), F.col("groups"))).collect()}
    want = set()
    for scope, text in texts:
        for p in patterns:
            if p and not P.inspect(p)["error"] and (m := re.search(p, text)):
                want.add((scope, text, p, ((m.group(1) or "") if m.groups() else m.group(0)).strip(" ")))
    assert got == want and len(want) > 500


def test_a_text_meets_few_patterns(spark):
    texts = spark.range(2000).select(F.lit("s").alias("scope"), F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" tail")).alias("text"))
    table = spark.range(2000).select(F.lit("s").alias("scope"), F.concat(F.lit("^word"), F.col("id").cast("string"), F.lit(" ")).alias("pattern"))
    index = P.pattern_index(table, "scope")
    posted = index.groupBy("gram").count()
    met = texts.select("scope", F.explode(P.grams(F.col("text"))).alias("gram")).join(posted, "gram").agg(F.sum("count")).first()[0]
    assert met < 0.05 * 2000 * 2000 and P.pattern_matches(texts, index, "scope").count() == 2000


@pytest.mark.parametrize("name", ["no_hp", "phone", "wa_1"])
def test_default_patterns_run_for_phone_fields(spark, name):
    df = spark.createDataFrame([(1, name, "c", "telp (021) 555-1234 x"), (2, name, "c", "none")], "document_id long, field_name string, field_config string, text string")
    empty = spark.createDataFrame([], "field_config string, pattern string, priority long")
    got = {r["document_id"]: r["value"] for r in extraction.rule_candidates(df, empty).collect()}
    assert set(got) == {1} and re.search(r"\d", got[1])


def test_groups_by_text(spark):
    df = spark.createDataFrame([("a(x", r"[(]x"), ("12 y", r"(?<n>\d+) y"), ("\\x", r"\\(x)"), ("ab", r"(?:a)b"), ("ab", r"(?=a)ab"), ("ab", r"(?<=a)b")], "t string, p string")
    assert [r[0] for r in df.select(X.pattern_value(F.col("t"), F.col("p"))).collect()] == ["(x", "12", "x", "ab", "ab", "b"]


def rated(text, pattern):
    """Value and confidence of a pattern in plain Python."""
    m = re.search(pattern, text)
    if not m:
        return None
    raw = ((m.group(1) or "") if m.groups() else m.group(0)).strip(" ")
    value = re.sub(" +", " ", raw).strip()
    if not value:
        return value, 0.15
    taken = 1 - len(value) / len(raw)
    c = 0.5 + (0 if raw == value else -0.2 if taken > 0.3 else -0.1 if taken > 0.15 else 0)
    c += 0.3 if re.fullmatch(pattern, value) else 0.15 if re.search(pattern, value) else -0.2
    c += -0.25 if len(value) == 1 else -0.1 if len(value) <= 3 else 0.1 if len(value) <= 100 else 0.05
    n = len(re.split(r"\s+", text.strip(" ")))
    c += (0.15 if n >= 3 else 0.1 if n == 2 else 0) - (0.15 if n > 10 else 0.1 if n > 7 else 0)
    c -= 0.15 if re.search(r"\\[dDwWsS]|[+*{]", pattern) and len(value) < 3 else 0
    return value, min(1.0, max(0.0, min(1.0, c)) + 0.15)


def walked(name, texts, learned):
    """The ladder over a field's places, one step at a time."""
    best, top, place = None, 0.0, None
    for k, text in enumerate(texts):
        for _, pattern in sorted((-p, x) for x, p in learned.items()):
            found = None if P.inspect(pattern)["error"] else rated(text, pattern)
            if found and found[1] > top:
                best, top, place = found[0], found[1], k
                if top >= 0.7:
                    return best, top, place
        if not learned or top < 0.3:
            base = next((p for key, p in X.DEFAULT_PATTERNS if re.search(key, name)), ".+")
            found = rated(text, base)
            if found and found[1] >= 0.5 and found[1] > top:
                best, top, place = found[0], found[1], k
    return None if best is None or learned and top < 0.5 else (best, top, place)


def test_the_ladder_over_places_equals_a_walk(spark):
    rnd = random.Random(11)
    words = ["a", "7", "ab", "12", "code", "x1", "total", "99 9", "usia 27", "08-12-2020", "name", "q  q"]
    names = ["age", "code", "nik", "tanggal_1", "x", "email"]
    learned = {"A": {r"\d": 5, r"code \w+": 5, "a": 3, "q +q": 9}, "B": {"total": 1, "a(": 9}, "C": {"zzz": 1}, "D": {r"\w": 2, r"x\d$": 1, r"(\d+) \d": 7}}
    fields = {(i, rnd.choice(names)): (rnd.choice(["A", "B", "C", "D", "none"]), [" ".join(rnd.choices(words, k=rnd.randrange(0, 5))) for _ in range(rnd.randrange(1, 4))]) for i in range(300)}
    rows = [(i, n, c, k, t) for (i, n), (c, ts) in fields.items() for k, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "document_id long, field_name string, field_config string, place int, text string")
    table = spark.createDataFrame([(c, p, k) for c, ps in learned.items() for p, k in ps.items()], "field_config string, pattern string, priority long")
    got = {(r["document_id"], r["field_name"]): (r["value"], round(r["confidence"], 9), r["place"]) for r in extraction.rule_candidates(df, table).collect()}
    want = {}
    for (i, n), (c, ts) in fields.items():
        w = walked(n, ts, learned.get(c, {}))
        if w:
            want[i, n] = (w[0], round(w[1], 9), w[2])
    assert got == want and {w[2] for w in want.values()} >= {0, 1}
    one = spark.createDataFrame([r[:3] + r[4:] for r in rows if r[3] == 0], "document_id long, field_name string, field_config string, text string")
    single = {(r["document_id"], r["field_name"]): (r["value"], round(r["confidence"], 9)) for r in extraction.rule_candidates(one, table).collect()}
    assert single == {k: (w[0], round(w[1], 9)) for k, (c, ts) in fields.items() if (w := walked(k[1], ts[:1], learned.get(c, {})))}
