"""WARC round trips, licences and mixing."""

import hashlib

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import licenses, mixing, warc

PAGES = [
    (1, "http://a/x y", "<p>" + "a" * 2000, "z"),
    (2, "http://a/2", "<p>" + "a" * 2000, "z"),
    (5, None, "<p>" + "a" * 2000, "z"),
    (3, "http://b", "short", "z"),
    (4, "http://c", "short", "z"),
    (6, "http://d", None, "z"),
    (7, "http://e", "é\r\n\r\nWARC/1.1\r\n\r\nContent-Length: 3\n" * 60, "z"),
    (8, "http://f", "b" * 999, "z"),
    (9, "http://g", "b" * 999, "z"),
    (None, "http://h", "<p>" + "a" * 2000, "z"),
    (7, "http://e", "é\r\n\r\nWARC/1.1\r\n\r\nContent-Length: 3\n" * 60, "z"),
]


def test_pages_survive_both_archive_kinds(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string").coalesce(1)
    got = sorted(map(tuple, warc.pages_through_archives(df).collect()), key=repr)
    want = []
    for page, _, html, _ in PAGES:
        data = (html or "").encode()
        equal = [p for p, _, h, _ in PAGES if (h or "").encode() == data]
        last = max((p for p in equal if p is not None), default=None)
        revisit = len(data) >= 1000 and len(equal) > 1 and page != last
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    assert got == sorted(want, key=repr)
    assert warc.pages_through_archives(df.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_headers_of_both_versions(version):
    data = warc.arc_bytes([(3, "http://x/a b", b"<p>\n\nhttp://y 1 2 3 4\n"), (None, "u", b"")], version, "n.arc")
    a, b = warc.parse_arc(data)
    assert (a["URL"], a["IP-address"], a["Archive-date"]) == ("http://x/a%20b", "0.0.0.0", "20000101000003")
    fields, _, payload = warc.http_parts(a["block"])
    assert fields["X-Page-Id"] == "3" and payload == b"<p>\n\nhttp://y 1 2 3 4\n"
    assert "X-Page-Id" not in warc.http_parts(b["block"])[0]
    if version == 2:
        assert data[int(a["Offset"]) :].startswith(b"http://x/a%20b") and data[int(b["Offset"]) :].startswith(b"u ")
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-5]))


def test_warc_records_read_back():
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    one = warc.warc_record("u", "i", "20000101000003", 3, "d" * 40, block, None)
    two = warc.warc_record("u", "i", "20000101000003", 4, "d" * 40, block, 3)
    (h1, b1), (h2, b2) = warc.parse_warc(one + b"\r\n\r\n" + two + b"\r\n\r\n")
    assert b1 == block and b2.endswith(b"\r\n\r\n") and h1["WARC-Date"] == "2000-01-01T00:00:03Z"
    assert h2["WARC-Refers-To"] == h1["WARC-Record-ID"]
    with pytest.raises(ValueError):
        list(warc.parse_warc(one[:-1]))


def test_licenses_are_found_and_inherited(spark):
    rows = [
        (1, "r/LICENSE", "Released under the MIT License."),
        (2, "r/a/b.txt", "prose words\nmore of it"),
        (3, "r/a/LICENSE.md", "intro\nLicensed under the Apache License, Version 2.0.\nend"),
        (4, "r/x/y/z.txt", None),
        (5, "q/f", ""),
        (6, "r/a/own", "text\nthis work is licensed under the gnu general public license, version 3"),
        (7, "r/a/noise", "We went to the license office under the bridge and released many birds there on that work day"),
        (None, None, "Released under the MIT License."),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, path string, text string, license string")
    got = {r["doc_id"]: (r["license"], r["basis"], r["inherited_from"]) for r in licenses.scan(df).collect()}
    assert got == {
        1: ("MIT", "header", None), 2: ("Apache-2.0", "inherited", "r/a"), 3: ("Apache-2.0", "header", None), 4: ("MIT", "inherited", "r"),
        5: (None, "none", None), 6: ("GPL-3.0", "header", None), 7: ("Apache-2.0", "inherited", "r/a"), None: ("MIT", "header", None),
    }
    assert licenses.scan(df.limit(0)).count() == 0


def test_raking_meets_the_targets(spark):
    cells = spark.createDataFrame([(s, la, t, n) for n, (s, la, t) in enumerate([(s, la, t) for s in "ab" for la in "xy" for t in "pq"], 3)], "source string, lang string, topic string, tokens long")
    target = lambda **x: spark.createDataFrame(list(x.items()), "value string, share double")
    targets = {"source": target(a=0.7, b=0.3), "lang": target(x=0.2, y=0.8), "topic": target(p=0.5, q=0.5)}
    raked = mixing.rake(cells, targets, rounds=12).collect()
    for dim, value, share in [("source", "a", 0.7), ("lang", "x", 0.2), ("topic", "q", 0.5)]:
        assert abs(sum(r["weight"] for r in raked if r[dim] == value) - share) < 1e-6


def test_the_budget_is_met_and_no_cell_is_asked_for_more_than_it_has(spark):
    cells = [("a", 1000, 0.5), ("b", 100, 0.3), ("c", 10, 0.15), ("d", 5, 0.05), ("e", 0, 0.0)]
    raked = spark.createDataFrame(cells, "source string, tokens long, weight double")
    for budget in (0.2, 0.6, 0.9, 1.0):
        p = {r["source"]: r["p"] for r in mixing.probabilities(raked, budget).collect()}
        assert abs(sum(n * p[c] for c, n, _ in cells) - budget * 1115) < 1e-6 and all(0 <= x <= 1 for x in p.values())
        free = [(n * p[c] / w) for c, n, w in cells if n and p[c] < 1]
        assert max(free, default=0) - min(free, default=0) < 1e-6
    none = spark.createDataFrame([("a", 0, 0.0)], "source string, tokens long, weight double")
    assert mixing.probabilities(none).first()["p"] == 1.0


@pytest.mark.parametrize("small", [200_000, 0])
def test_mixing_of_nulls_repeats_and_nothing(spark, monkeypatch, small):
    monkeypatch.setattr(mixing, "SMALL_CELLS", small)
    names = "doc_id long, text string, lang string, source string, p double, topic string, __topic string, tokens int"
    rows = [(1, "a b", None, "s"), (1, "a b", None, "s"), (2, None, "en", None), (None, "", "en", "s"), (3, "x " * 30_000, "en", "t")]
    df = spark.createDataFrame([(*r, 0.5, "mine", "own", 7) for r in rows], names)
    got = mixing.mix_report(df).collect()
    assert len(got) == 5 and len({r["sampled"] for r in got if r["doc_id"] == 1}) == 1
    kept = mixing.mix(df, budget=1.0)
    assert kept.columns == df.columns and {(r["topic"], r["__topic"], r["p"]) for r in kept.collect()} == {("mine", "own", 0.5)}
    assert {r["topic"] for r in mixing.mix_report(df, topics=F.col("topic")).collect()} == {"mine"}
    assert mixing.mix_report(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
