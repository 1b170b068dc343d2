"""What is learned from corrections, and choices among strategies, against plain Python."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

from fieldloom.functions.similarity import _conflict
from fieldloom.operators import extraction, statistics


def feedback(rnd, n):
    values = ["Budi", "Jl. Merdeka", "", "a,b", "12 Mei 2020", "x"]
    heads, tails = ["", "(", '"', "[", "Depok, ", "Jl. ", "pre "], ["", ")", '"', "]", ",", ".", ", 12 Mei 2020", ") (Ani Wati", " tail"]
    for k in range(n):
        c = rnd.choice(values)
        yield k, rnd.randrange(2), rnd.choice("fg"), rnd.choice(heads) + c + rnd.choice(tails), c


def test_structural_noise_counts_what_corrections_take_off(spark):
    rows = list(feedback(random.Random(1), 400)) + [(900, 0, "h", None, "x"), (901, 0, "h", "(a", "(a)"), (902, 0, "h", "(", ""), (903, 0, "h", " 'q", None)]
    want = defaultdict(Counter)
    for _, _, field, o, c in rows:
        o, c = str(o).strip(), str(c).strip()
        want[field]["n"] += 1
        so, eo, sc, ec = o.startswith("("), o.endswith(")"), c.startswith("("), c.endswith(")")
        want[field]["has_parentheses_both"] += so and eo and not (sc and ec)
        want[field]["has_parentheses_start"] += so and not eo and not sc
        want[field]["has_parentheses_end"] += eo and not so and not ec
        for name, a, b in (("has_quotes", '"', '"'), ("has_brackets", "[", "]")):
            want[field][name] += o.startswith(a) and o.endswith(b) and not (c.startswith(a) and c.endswith(b))
        for name, m in (("has_trailing_comma", ","), ("has_trailing_period", ".")):
            want[field][name] += o.endswith(m) and not c.endswith(m)
    df = spark.createDataFrame([(i, f, o, c) for i, _, f, o, c in rows], "feedback_id long, field_name string, original_value string, corrected_value string")
    for r in statistics.structural_noise(df).collect():
        got = r.asDict()
        assert {k: v for k, v in got.items() if k != "field_name"} == {k: want[r["field_name"]][k] for k in got if k != "field_name"}


def test_pattern_statistics_equal_a_walk(spark):
    rows = list(feedback(random.Random(2), 900))
    counts, totals = Counter(), Counter()
    for _, t, field, o, c in rows:
        if o == c:
            continue
        totals[t] += 1
        told = []
        if o.startswith(c):
            told.append(("suffix", re.sub(r",\s*\d{1,2}\s+\w+\s+\d{4}", ", [DATE]", o[len(c) :].strip())))
        elif c in o:
            at = o.index(c)
            told.append(("prefix", re.sub("^[A-Z][a-z]+,", "[LOCATION],", o[:at].strip())))
            rest = re.sub(r",\s*\d{1,2}\s+\w+\s+\d{4}", ", [DATE]", o[at + len(c) :].strip())
            told.append(("suffix", re.sub(r"\)\s*\(.+", ") ([NAME]", rest)))
        told += [("structural_noise", n) for n, hit in (("has_parentheses_end", ")" in o and ")" not in c), ("has_parentheses_start", "(" in o and "(" not in c), ("has_trailing_comma", o.endswith(",") and not c.endswith(","))) if hit]
        counts.update((t, field, kind, p) for kind, p in told if p)
    want = {}
    for (t, field, kind, p), n in counts.items():
        if n >= 3:
            want[t, field, kind, p.lower()] = max(n, want.get((t, field, kind, p.lower()), 0))
    df = spark.createDataFrame(rows, "feedback_id long, template_id int, field_name string, original_value string, corrected_value string")
    got = {(r["template_id"], r["field_name"], r["kind"], r["pattern"]): (r["frequency"], r["confidence"]) for r in statistics.pattern_statistics(df).collect()}
    assert got == {k: (n, round(n / totals[k[0]], 9)) for k, n in want.items()}
    assert {k[2] for k in got} == {"prefix", "suffix", "structural_noise"} and any("[DATE]".lower() in k[3] for k in got) and any("[location]" in k[3] for k in got) and any("[name]" in k[3] for k in got)


def test_shapes_and_delimiters(spark):
    values = ["AB-12", "AB-12", "AB-12", "ab, cd", "ab, cd", "ab, cd", "a", "", None, "a.b.c", "a"]
    df = spark.createDataFrame([("f", v) for v in values], "field_name string, value string")
    got = {(r["kind"], r["item"]): r["n"] for r in statistics.shape_histograms(df, 2).collect()}
    assert got == {("shape", "A+-9+"): 3, ("shape", "a+, a+"): 3, ("shape", "a"): 2, ("delimiter", "-"): 3, ("delimiter", ","): 3, ("delimiter", "."): 2, ("length", "5"): 4, ("length", "6"): 3, ("length", "1"): 2,
                   ("prefix", "AB-"): 3, ("prefix", "ab,"): 3, ("suffix", "-12"): 3, ("suffix", " cd"): 3, ("words", "1"): 6, ("words", "2"): 3}


def test_layout_evidence(spark):
    words = [(d, w, x, t, t + 10) for d in range(8) for w, x, t in [("label", 0, 0), ("value", 50, 0), (f"Tail{d % 2}", 60, 20), ("far", 900, 20), ("deep", 60, 90)]]
    boxes = [(d, f, 50, 150, 10, n) for d in range(8) for f, n in ((0, 60), (1, None))]
    missing = [(d, 0, ["tail0"]) for d in range(8)] + [(d, 1, ["nothing", "DEEP", "x"]) for d in range(5)] + [(6, 1, []), (7, 2, ["tail1"])] + [(d, 3, ["far"]) for d in range(6)]
    boxes += [(d, 3, 50, 150, 10, 60) for d in range(6)]
    got = statistics.layout_evidence(
        spark.createDataFrame(words, "document_id long, word string, x0 int, top int, bottom int"), spark.createDataFrame(boxes, "document_id long, field int, x0 int, x1 int, y1 int, next_y int"), spark.createDataFrame(missing, "document_id long, field int, tokens array<string>")
    )
    assert {r["field"]: (r["n"], r["hits"], r["multiline"]) for r in got.collect()} == {0: (8, 4, True), 1: (5, 5, True), 3: (6, 0, False)}
    few = statistics.layout_evidence(spark.createDataFrame(words, "document_id long, word string, x0 int, top int, bottom int"), spark.createDataFrame(boxes, "document_id long, field int, x0 int, x1 int, y1 int, next_y int"), spark.createDataFrame(missing[:3], "document_id long, field int, tokens array<string>"))
    assert [(r["n"], r["multiline"]) for r in few.collect()] == [(3, None)]


STRATEGIES = ["crf", "rule_based", "position_based"]
WEIGHT = dict(zip(STRATEGIES, (0.4, 0.35, 0.25)))


def scored(c, acc, n):
    w = (0.15, 0.05, 0.8) if n >= 10 else (0.2, 0.1, 0.7) if n >= 5 else (0.35, 0.25, 0.4)
    return round(c[3] * w[0] + WEIGHT[c[0]] * w[1] + acc * w[2], 9)


def test_choices_by_history(spark):
    rnd = random.Random(3)
    history = {(t, f, s): (rnd.choice([0.2, 0.55, 0.8, 1.0]), rnd.choice([1, 6, 20])) for t in (1, 2) for f in "ab" for s in STRATEGIES if rnd.random() < 0.7}
    cases = {(d, rnd.choice("ab")): [(s, k, f"{s}{d % 3}", rnd.choice([0.0, 0.2, 0.3, 0.35, 0.45, 0.6, 0.9])) for k, s in enumerate(STRATEGIES) if rnd.random() < 0.8] for d in range(200)}
    rows = [(d, d % 2 + 1, f, *c) for (d, f), cs in cases.items() for c in cs]
    got = statistics.combined_by_history(spark.createDataFrame(rows, "document_id long, template_id long, field_name string, strategy string, idx int, value string, confidence double"), spark.createDataFrame([(*k, *v) for k, v in history.items()], "template_id long, field_name string, strategy string, accuracy double, attempts long"))
    want = {}
    for (d, f), cs in cases.items():
        past = {c[0]: history.get((d % 2 + 1, f, c[0]), (0.5, 0)) for c in cs}
        bar = lambda a, n: max(0.3, 0.3 if a >= 0.7 and n >= 10 else 0.4 if a >= 0.5 and n >= 5 else 0.5)
        good = [c for c in cs if c[3] >= bar(*past[c[0]])]
        if len(good) == 1:
            want[d, f] = (good[0][0], good[0][2], good[0][3])
        elif good:
            best = max(good, key=lambda c: (scored(c, *past[c[0]]), -c[1]))
            want[d, f] = (best[0], best[2], min(1.0, scored(best, *past[best[0]])))
        elif some := [c for c in cs if c[3] > 0]:
            best = max(some, key=lambda c: (c[3], -c[1]))
            want[d, f] = (best[0] + "_fallback", best[2], best[3])
    assert {(r["document_id"], r["field_name"]): (r["method"], r["value"], r["confidence"]) for r in got.collect()} == want
    assert any(w[0].endswith("_fallback") for w in want.values())


def test_extraction_end_to_end(spark):
    rnd = random.Random(4)
    values = ["Jalan Merdeka 10", "jalan merdeka 10", "Jalan Merdeka", " x ", "", "Budi Santoso", "Budi", "  a   b "]
    cases = {(d, "f"): [(s, k, rnd.choice(values), rnd.choice([0.1, 0.3, 0.5, 0.8])) for k, s in enumerate(STRATEGIES) if rnd.random() < 0.8] for d in range(150)}
    rows = [(d, f, *c) for (d, f), cs in cases.items() for c in cs]
    got = {r["document_id"]: r for r in extraction.extracted(spark.createDataFrame(rows, "document_id long, field_name string, strategy string, idx int, value string, confidence double")).collect()}
    levels, known = Counter(), 0
    for (d, _), cs in cases.items():
        able = [c for c in cs if c[3] >= 0.3]
        assert (d in got) == bool(able)
        if not able:
            continue
        best = max(able, key=lambda c: (scored(c, 0.5, 0), -c[1]))
        said = defaultdict(float)
        for c in cs:
            if c[2].strip():
                said[c[2].strip()] = max(said[c[2].strip()], c[3])
        level, value, confidence = "none", best[2], best[3] if len(able) == 1 else min(1.0, scored(best, 0.5, 0))
        if len(said) > 1:
            pairs = [_conflict(a, b) for a, b in combinations(sorted(said), 2)]
            mean = sum(pairs) / len(pairs)
            level = "minor" if mean > 0.8 else "moderate" if mean > 0.5 else "major"
            if level == "minor":
                value, confidence = max(said, key=lambda v: (len(v), v)), max(said.values()) * 0.95
        levels[level] += 1
        assert (got[d]["method"], got[d]["conflict"]) == (best[0], level) and abs(got[d]["confidence"] - confidence) < 1e-8
        assert got[d]["value"] == re.sub(" +", " ", value).strip()
        known += 1
    assert known > 100 and set(levels) == {"none", "minor", "moderate", "major"}


def test_post_processing_uses_what_corrections_show(spark):
    taught = [(k, "issue_place", f"Kota Depok{k}, 1 Mei 2020", f"Depok{k}, 1 Mei 2020") for k in range(12)] + [(50 + k, "q", f"v{k},", f"v{k}") for k in range(9)]
    values = [(1, "issue_place", "Kota Bogor,  2 Mei 2021"), (2, "q", "a  b,"), (3, "other", "x,"), (4, "supervisor_name", "(Dr.) Ani")]
    df = spark.createDataFrame(taught, "feedback_id long, field_name string, original_value string, corrected_value string")
    got = {r["feedback_id"]: r["value"] for r in statistics.post_processed(spark.createDataFrame(values, "feedback_id long, field_name string, original_value string"), df).collect()}
    assert got[1] == "Bogor" and got[2] == "a b" and "(" not in got[4]
