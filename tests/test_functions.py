"""Functions, ladders, similarities and statistics against plain Python and golden values."""

import random
import re
import statistics
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import decisions as D
from fieldloom.functions import similarity as S
from fieldloom.functions import text as X
from fieldloom.operators import evaluation, sequence
from fieldloom.operators.relational import dynamic_filter, page


def col(spark, f, *values):
    """``f`` of each value."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalisers(spark):
    odd = ["  a  b\t c ", " x y", None, "", "None", "a\n\nb"]
    assert col(spark, X.strict_norm, *odd) == [str(x).strip() for x in odd]
    assert col(spark, X.ws_collapse, *odd) == [" ".join(str(x).split()) for x in odd]
    assert col(spark, X.ws_regex_norm, *odd) == [" ".join((x or "").split()) for x in odd]
    assert col(spark, X.collapse_blanks, "a   b\t\tc") == ["a b\t\tc"]


def test_cleaners(spark):
    assert col(spark, X.generic_clean, ': "Jakarta" ', "(abc)", "a  b,", "") == ["Jakarta", "abc", "a b", ""]
    assert col(spark, X.token_shape, "Abc 12-X9", "aB++") == ["Aa+ 9+-A9", "aA++"]
    assert col(spark, X.ocr_fixes, "l am 0 vv rn x0") == ["I am O w m x0"]
    flags = {"parentheses_both": F.lit(True), "trailing_comma": F.lit(True), "quotes": F.lit(False)}
    assert col(spark, lambda c: X.structural_clean(c, flags), "(a),", "(a)", '"b",') == ["(a)", "a", '"b"']
    affixes = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert col(spark, lambda c: X.affix_clean(c, affixes("Mr ", "Dr "), affixes(" jr")), "dr Who Jr", "Mr ", "plain") == ["Who", "Mr", "plain"]
    assert col(spark, X.generalise_affix, "Jakarta, 12 May 2020") == ["[LOCATION], [DATE]"]
    assert col(spark, X.row_number_of, "item_12_x_3", "name") == [3, None]
    assert col(spark, X.is_tabular, "qty_1", "qty_b", "quantity") == [True, True, False]
    assert col(spark, X.field_keywords, "total_harga_1_x") == [["total", "harga"]]
    names = ["user_email", "no_hp", "nik", "tgl_lahir", "usia", "nomor_urut", "nama", "alamat", "zzz", "birth_date"]
    found = col(spark, X.default_pattern, *names)
    assert found == [next((p for key, p in X.DEFAULT_PATTERNS if re.search(key, n)), ".+") for n in names]
    assert (found[2], found[3], found[4], found[8]) == (r"(\d{16})", r"(\d{2}-\d{2}-\d{4})", r"(\d+)", ".+")
    start, end = {"parentheses_start": F.lit(True)}, {"parentheses_end": F.lit(True)}
    assert col(spark, lambda c: X.structural_clean(c, start), "(a", "(a)", "((a") == ["a", "(a)", "(a"]
    assert col(spark, lambda c: X.structural_clean(c, end), "a)", "(a)", "a))") == ["a", "(a)", "a)"]
    assert col(spark, X.sanitise_pattern, "/ab+/gi", "r'a\\d'", '"x"', " [a-z]+ ", "r\"y'") == ["ab+", "a\\d", "x", "[a-z]+", "r\"y'"]
    assert col(spark, X.keywords_by_length, "no_total_harga_qty_1") == [["harga", "total", "qty", "no"]]
    assert col(spark, lambda c: X.field_clean(F.lit("chairman_name"), c), " Dr. (A) B  C", None) == ["Dr. A B C", "None"]
    assert col(spark, lambda c: X.field_clean(F.lit("issue_place"), c), "Bandung, 3 May 2020") == ["Bandung"]
    assert col(spark, lambda c: X.field_clean(F.lit("other"), c), "a  (b)") == ["a  (b)"]
    assert col(spark, X.should_normalise, "short", "a" * 25, "one two three four") == [False, True, False]


def test_ladders(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert [one(D.strategy_name(lit(x))) for x in ("my_CRF", "rule-based", "position", "", None)] == ["crf", "rule_based", "position_based", "rule_based", "rule_based"]
    assert [one(D.confidence_threshold(lit(a), lit(n))) for a, n in ((0.7, 10), (0.5, 5), (0.9, 1))] == [0.3, 0.4, 0.5]
    assert [one(D.conflict_level(lit(x))) for x in (0.81, 0.6, 0.5)] == ["minor", "moderate", "major"]
    assert [one(D.validation_choice(lit(f), lit(p).cast("long"), lit(c), lit(i))) for f, p, c, i in ((True, 5, 5, True), (False, None, 5, False), (False, 10, 16, False), (False, 10, 12, False), (False, 10, 11, False), (False, 10, 99, True))] == ["full", "full", "full", "sample", "skip", "skip"]
    assert [one(D.template_kind(lit(x))) for x in ("Form A", "a letter", "q")] == ["form", "letter", "unknown"]
    assert [one(D.training_trigger(lit(u), lit(t))) for u, t in ((4, 100), (6, 43), (6, 50))] == ["none", "full", "incremental"]
    assert [one(D.multiline_by_length(*map(lit, x))) for x in ((5, True, 0, 0, 0), (9, False, 90, 70, 0), (4, True, 0, 0, 1), (4, True, 0, 0, 0))] == [1, 1, 1, 0]
    assert one(D.needs_validation(F.array().cast("array<double>"), F.array().cast("array<string>"))) is True
    assert one(D.crf_weight(lit(None).cast("double"), lit(3))) == 0.5
    assert one(D.position_confidence(lit("x"), lit(True), lit(True))) == pytest.approx(0.98)
    assert [one(D.traffic_light(lit(x))) for x in (0.4, 0.7, 0.8)] == ["Low", "Medium", "Good"]


def test_similarities_are_difflib_s(spark):
    rnd = random.Random(1)
    pairs = [("abc", "abd"), ("", "x"), (None, "x"), ("Same", "same "), ("ab" * 150, "ba" * 140)] + [("".join(rnd.choices("abc ", k=20)), "".join(rnd.choices("abc ", k=15))) for _ in range(20)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r["x"] for r in df.select("i", S.fuzzy_ratio("a", "b").alias("x")).orderBy("i").collect()]
    norm = lambda x: (x or "").strip().lower()
    assert got == [SequenceMatcher(None, norm(a), norm(b)).ratio() if norm(a) and norm(b) else 0.0 for a, b in pairs]
    both = [r["x"] for r in df.select("i", S.conflict_similarity("a", "b").alias("x")).orderBy("i").collect()]
    assert both[3] == 1.0 and both[1] == 0.0 and 0 < both[0] < 1
    pieces = F.array(*map(F.lit, ["jalan", "raya", "kota", "baru"]))
    assert col(spark, lambda c: S.segmented(c, pieces), "jalanrayakota", "kotabaru", "xyz", None, "") == ["jalan raya kota", "kota baru", "xyz", None, ""]


def test_paired_t_and_its_p_value(spark):
    rows = [(0.7676, 1.0), (0.7478, 1.0), (0.6952, 0.9483), (0.6952, 0.9959)]
    got = evaluation.paired_t(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()
    d = [b - a for a, b in rows]
    assert got["t"] == pytest.approx(statistics.mean(d) / (statistics.stdev(d) / 2))
    assert got["t"] == pytest.approx(17.89, abs=0.01) and evaluation.t_pvalue(got["t"], 3) == pytest.approx(3.8e-4, rel=0.02)
    assert evaluation.t_pvalue(0.0, 5) == 1.0 and evaluation.t_pvalue(1.32, 3) == pytest.approx(0.277, abs=0.003)


def test_boosts_matches_and_scores(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert [one(D.usage_boost(lit(r), lit(m), lit(0.3))) for r, m in ((0.95, True), (0.8, True), (0.5, True), (0.2, False), (0.5, False))] == [0.2, 0.1, 0.0, -0.1, 0.3]
    df = spark.createDataFrame([("Jakarta", "jakarta "), ("abcdefghij", "abcdefghix"), ("abc", "xyz"), ("", "a")], "a string, b string")
    assert [r[0] for r in df.select(S.fuzzy_match("a", "b")).collect()] == [True, True, False, False]
    got = [r[0] for r in df.select(S.sequence_score("a", "b")).collect()]
    assert got[1] == pytest.approx(0.8 * 0.9 + 0.2) and got[3] == 0.0


def test_experiments_and_curves_from_json(spark, tmp_path):
    (tmp_path / "baseline_template_2.json").write_text('{\n "template": 2, "accuracy": 0.5\n}')
    (tmp_path / "adaptive_template_2.json").write_text('{"template": 2, "accuracy": 0.75, "corrections": 4}')
    got = evaluation.experiments_from_json(spark, str(tmp_path / "*_template_*.json")).collect()
    assert sorted((r["kind"], r["template_id"], r["accuracy"], r["corrections"]) for r in got) == [("adaptive", 2, 0.75, 4), ("baseline", 2, 0.5, None)]
    (tmp_path / "learning_curve_1.json").write_text('[{"batch": 0, "accuracy": 0.5}, {"batch": 1, "accuracy": 0.75}, {"batch": 2, "accuracy": 0.7}]')
    curve = evaluation.learning_points(evaluation.curves_from_json(spark, str(tmp_path / "learning_curve_*.json")), "template_id", "batch", "accuracy")
    assert [(r["template_id"], r["batch"], round(r["improvement"], 9), round(r["delta"], 9)) for r in curve.orderBy("batch").collect()] == [(1, 0, 0.0, 0.0), (1, 1, 0.25, 0.25), (1, 2, 0.2, -0.05)]


def test_bootstrap_equals_a_plain_loop(spark):
    rows = [("a" if i % 3 else "b", float(i % 7), "x") for i in range(210)] + [("c", 2.5, "x"), ("c", None, "x"), ("d", None, "x"), ("a", float("nan"), "x"), (None, 1.0, "x"), (None, 3.0, "x")]
    df = spark.createDataFrame(rows, "g string, v double, n string").repartition(3)
    got = {r["g"]: r for r in evaluation.bootstrap(df, "v", ["g"], replicates=150).collect()}
    keys = {(r["g"], r["v"]): (r["n"], r["h"]) for r in df.where("v is not null and not isnan(v)").groupBy("g", "v").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("v", "g")).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g in got:
        means = []
        drawn = {v: evaluation.poisson_weights(h, n, 150, 42) for (k, v), (n, h) in keys.items() if k == g}
        for rep in range(150):
            weight = sum(int(w[rep]) for w in drawn.values())
            if weight:
                means.append(sum(float(v) * int(w[rep]) for v, w in drawn.items()) / weight)
        want = (np.mean(means), np.std(means), min(means), max(means), np.percentile(means, 2.5), np.percentile(means, 97.5))
        assert got[g]["n"] == sum(n for (k, _), (n, _) in keys.items() if k == g)
        assert np.allclose([got[g][c] for c in ("mean", "std", "least", "most", "low", "high")], want)
    again = {r["g"]: r["low"] for r in evaluation.bootstrap(df.repartition(7), "v", ["g"], replicates=150).collect()}
    assert all(abs(again[g] - got[g]["low"]) < 1e-12 for g in got)


def test_bootstrap_covers_the_mean(spark):
    rows = [(i, float(i % 10)) for i in range(200)]
    got = evaluation.bootstrap(spark.createDataFrame(rows, "id long, v double"), "v", replicates=200).first()
    assert got["low"] < 4.5 < got["high"] and 0.4 < got["high"] - got["low"] < 1.2 and got["n"] == 200
    assert evaluation.bootstrap(spark.createDataFrame([], "v double"), "v").count() == 0


def test_results_round_trip_through_json(spark, tmp_path):
    facts = spark.createDataFrame([(1, "a", "x", 0.5, "crf"), (1, "b", "", 0.1, "rule_based"), (2, "a", "y", None, "crf")], "document_id long, field_name string, value string, confidence double, method string")
    evaluation.write_results(facts, str(tmp_path / "out"))
    (tmp_path / "out" / "broken.json").write_text("{not json\n")
    assert sorted(map(tuple, evaluation.facts_from_json(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, facts.collect()))
    (tmp_path / "truth").mkdir()
    (tmp_path / "truth" / "doc_17.json").write_text('{"a": "x", "b": "y"}')
    assert sorted(map(tuple, evaluation.truth_from_json(spark, str(tmp_path / "truth")).collect())) == [(17, "a", "x"), (17, "b", "y")]


def test_filters_and_pages(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(9)], "n int, s string")
    assert dynamic_filter(df, {"n": (">", 3), "s": ("~", "a"), "z": ("=", 1)}, {"n", "s"}).count() == 3
    rows, pages = page(df, 2, 4, [F.col("n")])
    assert [r["n"] for r in rows.collect()] == [4, 5, 6, 7] and pages == 3


def test_bio_labels_and_crf():
    assert sequence.bio_labels("Name : Budi Santoso born".split(), "Budi Santoso", "N") == ["O", "O", "B-N", "I-N", "O"]
    assert sequence.bio_labels(["a", "b"], "zzzzzz", "N") == ["O", "O"]
    data = [(f"Item : {w} {v} end".split(), ["O", "O", "B", "I", "O"]) for w, v in [("red", "box"), ("old", "tin"), ("big", "cup"), ("new", "pan")]]
    model = sequence.fit(data)
    labels, marginals = sequence.predict("Item : odd jar end".split(), model)
    assert labels == ["O", "O", "B", "I", "O"] and all(0 < p <= 1 for p in marginals)
    more = sequence.fit(data + [(["x"], ["Z"])], start=model)
    assert more[0] == ["B", "I", "O", "Z"]
