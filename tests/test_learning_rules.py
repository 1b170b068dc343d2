"""Extraction, mining and learning rules against plain Python on small relations that have rows for every case."""

import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import text as X
from fieldloom.operators import extraction, jobs, mining, services, windows
from fieldloom.streaming import learning


def confidence(value, pattern, words, raw):
    if not value:
        return 0.0
    taken = 1 - len(value) / len(raw) if raw and raw != value else 0
    out = 0.5 - (0.2 if taken > 0.3 else 0.1 if taken > 0.15 else 0)
    out += 0.3 if re.fullmatch(pattern, value) else 0.15 if re.search(pattern, value) else -0.2
    out += -0.25 if len(value) == 1 else -0.1 if len(value) <= 3 else 0.1 if len(value) <= 100 else 0.05
    out += (0.15 if words >= 3 else 0.1 if words == 2 else 0) - (0.15 if words > 10 else 0.1 if words > 7 else 0)
    out -= 0.15 if re.search(r"\\[dDwWsS]|[+*{]", pattern) and len(value) < 3 else 0
    return max(0.0, min(1.0, out))


def find(text, pattern):
    m = re.search(pattern, text)
    if not m:
        return None, 0.0
    raw = (m.group(1) if m.groups() else m.group(0)).strip()
    value = re.sub(" +", " ", raw)
    return value, min(1.0, confidence(value, pattern, len(text.split()), raw) + 0.15)


def ladder(name, text, learned):
    best, top = None, 0.0
    for _, pattern in sorted(learned, key=lambda x: (-x[0], x[1])):
        value, c = find(text, pattern)
        if value is not None and c > top:
            best, top = value, c
            if c >= 0.7:
                return best, top
    if not learned or top < 0.3:
        base = next((p for key, p in X.DEFAULT_PATTERNS if re.search(key, name)), ".+")
        value, c = find(text, base)
        if value is not None and c >= 0.5 and c > top:
            best, top = value, c
    return (None, 0.0) if best is None or learned and top < 0.5 else (best, top)


def test_rule_candidates_follow_the_ladder(spark):
    texts = [
        (1, "code", "A", "abc 123 tail"), (2, "code", "A", "no digits here at all"), (3, "code", "B", "x"), (4, "age", "none", "usia 27 tahun"),
        (5, "zzz", "none", "anything goes here"), (6, "code", "C", "a  b   c"), (7, "nik", "A", "zz"), (8, "code", "A", " ".join("abc 9 w w w w w w w w w w".split())), (9, "code", "none", ""),
    ]
    patterns = [("A", r"^a\\w+ (\\d+)".replace("\\\\", "\\"), 5), ("A", r"[a-z]+", 3), ("A", r"[a-z]+", 9), ("B", r"\\d+".replace("\\\\", "\\"), 1), ("B", "x", 0), ("C", r"b\\s+(?:c)".replace("\\\\", "\\"), 2)]
    got = extraction.rule_candidates(spark.createDataFrame(texts, "document_id long, field_name string, field_config string, text string"), spark.createDataFrame(patterns, "field_config string, pattern string, priority long"))
    got = {r["document_id"]: (r["value"], round(r["confidence"], 9)) for r in got.collect()}
    want = {}
    for i, name, config, text in texts:
        best = {}
        for c, p, priority in patterns:
            if c == config:
                best[p] = max(best.get(p, priority), priority)
        value, c = ladder(name, text, [(k, p) for p, k in best.items()])
        if value is not None:
            want[i] = (value, round(c, 9))
    assert got == want and len(want) >= 5


def test_a_group_is_taken_before_the_whole_match(spark):
    df = spark.createDataFrame([("abc 123 tail", r"^a\w+ (\d+)"), ("abc 123 tail", r"a\w+ \d+"), ("abc", r"(?:a)b"), ("abc", r"\d")], "t string, p string")
    assert [r[0] for r in df.select(X.pattern_value(F.col("t"), F.col("p"))).collect()] == ["123", "abc 123", "ab", None]


def test_conflicts(spark):
    rows = [(1, "f", "A long value here x", 0.5), (1, "f", "a long value here", 0.9), (2, "f", "abc", 0.4), (2, "f", "xyz", 0.6), (3, "f", "same", 0.4), (3, "f", "same", 0.6), (4, "f", "", 0.4), (4, "f", "z", 0.2)]
    got = {r["document_id"]: r for r in extraction.conflicts(spark.createDataFrame(rows, "document_id long, field_name string, value string, confidence double")).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["level"], got[1]["resolved"], got[1]["requires_validation"]) == ("moderate", "a long value here", True) or (got[1]["level"], got[1]["resolved"]) == ("minor", "A long value here x")
    assert (got[2]["level"], got[2]["resolved"], got[2]["confidence"]) == ("major", "xyz", 0.6)
    close = [(5, "f", "Jalan Merdeka No 10 Bandung Kota", 0.5), (5, "f", "jalan merdeka no 10 bandung kotax", 0.9)]
    one = extraction.conflicts(spark.createDataFrame(close, "document_id long, field_name string, value string, confidence double")).first()
    assert one["level"] in ("minor", "moderate")
    if one["level"] == "minor":
        assert one["resolved"].endswith("kotax") and one["confidence"] == pytest.approx(0.9 * 0.95)
    minor = [(6, "f", "B" + "a" * 60 + " x", 0.8), (6, "f", "b" + "a" * 60 + " x", 0.5), (6, "f", "A" + "a" * 60 + " x y", 0.1)]
    for r in extraction.conflicts(spark.createDataFrame(minor[:2], "document_id long, field_name string, value string, confidence double")).collect():
        assert r["level"] == "minor" and r["resolved"] == "b" + "a" * 60 + " x" and r["confidence"] == pytest.approx(0.76)


def test_near_pairs_are_those_of_all_pairs(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choices("abcdefgh ", k=rnd.choice([4, 5, 6, 9, 14, 30, 90, 140]))) for _ in range(150)]
    values, others = [], []
    for b in base:
        for side in (values, others):
            x = list(b)
            for _ in range(rnd.randint(0, max(1, len(x) // 10))):
                at = rnd.randrange(len(x))
                x[at : at + 1] = rnd.choices("abcdefgh", k=rnd.choice([0, 1, 1, 2]))
            side.append("".join(x))
    values += ["alive in the city", "", "ab"]
    others += ["olive in the city", "ab", "abc"]
    got = {(r["value"], r["known"]) for r in services.near_pairs(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(v,) for v in others], "known string")).collect()}
    want = {(a, b) for a in values for b in others if a and b and a != b and abs(len(a) - len(b)) <= 0.1 * max(len(a), len(b)) and SequenceMatcher(None, a, b).ratio() >= 0.9}
    assert got == want and ("alive in the city", "olive in the city") in want and len(want) > 12


def test_root_causes_have_rows(spark):
    fb = [(1, "a", False)] * 101 + [(1, "b", True)] * 19 + [(2, "a", False)] * 100 + [(2, "b", True)] * 20
    at = [(1, "a", "rule_based", True)] * 8 + [(1, "a", "crf", False)] * 2 + [(2, "a", "rule_based", True)] * 7 + [(2, "a", "crf", True)] * 2 + [(2, "b", "crf", False)] * 1
    got = services.root_causes(spark.createDataFrame(fb, "template_id long, field_name string, used boolean"), spark.createDataFrame(at, "template_id long, field_name string, strategy string, correct boolean"))
    assert {(r["template_id"], r["issue"]): r["evidence"] for r in got.collect()} == {(1, "unused feedback"): 101.0, (1, "rules dominate"): 0.8, (1, "weak crf"): 0.0, (1, "few samples"): 1.0}


def test_multiline_fields(spark):
    rows = [("break", "a\nb")] + [("break", "x")] * 4 + [("few", "a\nb")] * 4 + [("long", "y" * 90)] * 5 + [("short", "y" * 69)] * 4 + [("short", "y" * 73)]
    got = {r["field_name"]: r["multiline"] for r in services.multiline_fields(spark.createDataFrame(rows, "field_name string, corrected_value string")).collect()}
    assert got == {"break": 1, "few": 0, "long": 1, "short": 0}


def test_removed_affixes(spark):
    rows = [("f", "Mr. Budi", "Budi")] * 3 + [("f", "Budi (ketua)", "Budi")] * 2 + [("f", "same", "same")] * 20 + [("f", "Dr. X", "X")] + [("g", "a,", "a")] * 2
    got = sorted(map(tuple, mining.common_affixes(spark.createDataFrame(rows, "field_name string, original_value string, corrected_value string")).collect()))
    assert got == [("f", "prefix", "mr.", 3), ("g", "suffix", ",", 2)]


def test_suggestions(spark):
    rows = [("name", v) for v in ["Budi Santoso", "Siti Aminah Putri", "Andi"] * 3] + [("code", v) for v in ["AB-12", "CD-34", "EF-5"] * 2] + [("flat", v) for v in ["Jakarta", "Bandung"]]
    got = {(r["field_name"], r["type"], r["pattern"], r["frequency"], r["priority"]) for r in jobs.regex_suggestions(spark.createDataFrame(rows, "field_name string, value string")).collect()}
    assert ("name", "flexible", r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})", 9, 10) in got and ("flat", "specific", "([A-Z][a-z]+)", 2, 10) in got
    assert ("code", "shape", r"([A-Z]{2,}\-[0-9]{2,})", 4, 5) in got and ("code", "delimiter", r"([^\-]+(?:\-[^\-]+)*)", 6, 3) in got
    assert not any(f == "flat" and t != "specific" for f, t, *_ in got)
    for f, t, p, *_ in got:
        assert t == "specific" or any(re.search(p, v) for name, v in rows if name == f), (t, p)


def test_line_groups(spark):
    words = [(1, i, top) for i, top in enumerate([0, 0, 12, 40, 40, 52, 90])]
    got = {r["idx"]: (r["line_group"], r["rank"]) for r in jobs.line_groups(spark.createDataFrame(words, "document_id long, idx int, top int")).collect()}
    assert got == {0: (0, 1), 1: (0, 2), 2: (0, 3), 3: (1, 1), 4: (1, 2), 5: (1, 3), 6: (2, 1)}


@pytest.mark.parametrize("chunk", [3, 1000])
def test_windows_over_chunks_equal_plain_ones(spark, monkeypatch, chunk):
    """Numbers, trailing means, lags and running sums do not depend on where days and chunks are cut."""
    monkeypatch.setattr(windows, "CHUNK", chunk)
    rnd = random.Random(chunk)
    rows = [(rnd.randint(1, 2), i, f"2020-01-{rnd.randint(1, 6):02d} {rnd.randint(0, 23):02d}:00:00", rnd.randint(0, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "template_id long, document_id long, at string, v long").withColumn("created_at", F.col("at").cast("timestamp"))
    numbered = windows.numbered(df, total="of")
    sums = {(r["template_id"], r["rn"]): (r["upto_v"], r["of"], r["document_id"]) for r in windows.running(numbered, "rn", "v").collect()}
    before = {(r["template_id"], r["rn"]): r["upto_v"] for r in windows.running(numbered, "rn", "v", inclusive=False).collect()}
    trail = windows.Trail(numbered, "rn", back=2).add(mean=lambda w: F.avg("v").over(w.rowsBetween(-2, 0)), last=lambda w: F.lag("v").over(w))
    near = {(r["template_id"], r["rn"]): (round(r["mean"], 9), r["last"]) for r in trail.collect()}
    assert len(near) == len(rows)
    for t in (1, 2):
        own = sorted((r for r in rows if r[0] == t), key=lambda r: (r[2], r[1]))
        for k, r in enumerate(own, 1):
            assert sums[t, k] == (sum(x[3] for x in own[:k]), len(own), r[1]) and before[t, k] == sum(x[3] for x in own[: k - 1])
            some = [x[3] for x in own[max(0, k - 3) : k]]
            assert near[t, k] == (round(sum(some) / len(some), 9), own[k - 2][3] if k > 1 else None)


def test_upserts_over_batches(spark, tmp_path):
    """Several micro-batches: the newest row of each key, and only touched parts are rewritten."""
    schema, source = "k long, at long, v string", str(tmp_path / "in")
    for b in range(4):
        rows = [(k, b, f"{k}-{b}") for k in range(b, 12, b + 1)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    learning.upsert_latest(stream, ["k"], ["at"], str(tmp_path / "t"), str(tmp_path / "s"), parts=3)
    got = {r["k"]: r["at"] for r in learning.upserted(spark, str(tmp_path / "t"), spark.createDataFrame([], schema).schema).collect()}
    assert got == {k: max(b for b in range(4) if k in range(b, 12, b + 1)) for k in range(12)}


def test_first_of_each_key_and_the_queue(spark, tmp_path):
    schema = "k long, at timestamp, job_id long, created_at timestamp, status string"
    rows = [(1, 1, "pending"), (1, 2, "pending"), (2, 3, "running"), (3, 4, "pending")]
    df = spark.createDataFrame([(k, j, s) for k, j, s in rows], "k long, job_id long, status string").select("k", F.timestamp_seconds("job_id").alias("at"), "job_id", F.timestamp_seconds(100 - F.col("job_id")).alias("created_at"), "status")
    df.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(tmp_path / "in"))
    once = learning.available_now(learning.once_per_key(read(), ["k"], "at"))
    assert Counter(r["k"] for r in once.collect()) == {1: 1, 2: 1, 3: 1}
    seen = []
    learning.work_queue(read(), lambda batch, number: seen.extend(r["job_id"] for r in batch.collect()), str(tmp_path / "state"))
    assert seen == [4, 2, 1]
