"""License scores against brute force over every line, block and file."""

import math
import random
import re
import textwrap
from collections import Counter

import pytest

from fieldloom.llm import licenses

PLANTED = [
    "# Released under the MIT License. See the LICENSE file in the project root for details.",
    "Copyright (c) 2020 Acme Corp. Released under the MIT License.",
    "import x\n\n# Released\n# under the\n# MIT\n# License.\n#\ncode of the project in one file",
    "Released under\n \nthe MIT\n\nLicense.",
    "\n".join(textwrap.wrap(max((t for name, t in licenses.TEMPLATES if name == "MIT"), key=len).replace("<year> <copyright holders>", "2021 Jane Roe"), 70)),
]


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def brute(rows):
    df = Counter(w for _, t in rows for w in set(words(t or "")))
    idf = lambda w: math.log((1 + len(rows)) / (1 + df[w])) + 1
    vector = lambda bag: {w: n * idf(w) for w, n in bag.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, vector(Counter(words(text)))) for name, text in licenses.TEMPLATES]
    out = {}
    for i, text in rows:
        blocks, lines = [[]], text.split("\n")
        for line in lines:
            blocks[-1].append(line) if words(line) else blocks.append([])
        units = [vector(Counter(words(u))) for u in (*lines, *("\n".join(b) for b in blocks), text)]
        scores = [(-round(sum(x * t.get(w, 0) for w, x in u.items()) / norm(u) / norm(t), 6), name) for u in units if u for name, t in templates]
        if scores and -min(scores)[0] >= licenses.THRESHOLD:
            out[i] = (min(scores)[1], -min(scores)[0])
    return out


@pytest.mark.parametrize("size", [200, 4000])
def test_headers_of_frequent_words_are_found_at_any_size(spark, size):
    rnd = random.Random(size)
    usual = "copyright c 2020 see the file in project root for details under of all rights one code import x".split()
    rows = [(i, " ".join(rnd.sample(usual, 14)) + f" w{rnd.randrange(size)}\n\n" + " ".join(rnd.sample(usual, 9))) for i in range(size)]
    rows += [(10**6 + k, text) for k, text in enumerate(PLANTED)]
    got = {r["doc_id"]: (r["license"], r["score"]) for r in licenses.line_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert {i: name for i, (name, _) in got.items()} == {i: name for i, (name, _) in want.items()} == {10**6 + k: "MIT" for k in range(len(PLANTED))}
    assert all(abs(got[i][1] - want[i][1]) < 2e-6 for i in want)


def test_whole_files_headers_and_repeated_rows(spark):
    """A file with a license's whole text or standard header names it, whatever its lines; equal rows have equal results, ties go to the first name."""
    longest = {name: max((t for n, t in licenses.TEMPLATES if n == name), key=len) for name, _ in licenses.TEMPLATES}
    rows = [(k, "\n\n".join(textwrap.wrap(text, 60))) for k, text in enumerate(longest.values())]
    rows += [(100, "// " + "\n// ".join(textwrap.wrap(longest["Apache-2.0"], 50)) + "\ncode here"), (100, None), (101, "x " * 50_000), (101, "x " * 50_000)]
    got = {r["doc_id"]: r["license"] for r in licenses.line_scores(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, df int")).collect()}
    assert got == {**dict(enumerate(longest)), 100: "Apache-2.0"}
    tied = [("B", "one two three"), ("A", "one two three")]
    df = spark.createDataFrame([(1, "p/LICENSE", "one two three"), (1, "p/LICENSE", "one two three"), (2, "p/q", None)], "doc_id long, path string, text string")
    assert sorted((r["doc_id"], r["license"], r["basis"]) for r in licenses.scan(df, tied).collect()) == [(1, "A", "header"), (1, "A", "header"), (2, "A", "inherited")]


def test_words_of_all_prose_anchor_no_unit(spark, monkeypatch):
    """Long templates repeat "the", "of" and "or": units that hold no rarer word of theirs are not scored, and the result is that of all units."""
    rnd = random.Random(6)
    usual = "the of or and to in any for be is as it with".split()
    rows = [(i, " ".join(rnd.choices(usual, k=30)) + f" w{i % 97}") for i in range(400)] + [(1000 + k, text) for k, text in enumerate(PLANTED)]
    kept, write = {}, licenses.materialize
    monkeypatch.setattr(licenses, "materialize", lambda df, name: kept.setdefault(name, write(df, name)))
    got = {r["doc_id"]: (r["license"], r["score"]) for r in licenses.line_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()} and len(want) == len(PLANTED)
    assert all(abs(got[i][1] - want[i][1]) < 2e-6 for i in want)
    assert kept["license-units"].where("doc_id < 1000").count() == 0
