"""Retraining runs that resume, and cascading deletes."""

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import runs
from fieldloom.operators.config import analysed_templates, cascade


def samples(spark):
    rows = [(i, 1, "f", f"v{i % 9}", f"w{i % 9}") for i in range(60)] + [(100 + i, 2, "f", "a", "b") for i in range(40)] + [(200 + i, 3, "f", "a", f"b{i}") for i in range(5)]
    return spark.createDataFrame(rows, "feedback_id long, template_id long, field_name string, original_value string, corrected_value string")


def test_a_failed_run_goes_on_at_its_stage(spark, tmp_path):
    ledger, rows, calls = runs.Ledger(spark, str(tmp_path)), samples(spark), []

    def broken(train, test):
        calls.append("broken")
        raise RuntimeError("no model")

    def scorer(train, test):
        calls.append("scorer")
        return runs.most_common_correction(train, test)

    with pytest.raises(RuntimeError):
        runs.retrain(rows, ledger, "one", broken, min_diversity=0.1)
    assert ledger.complete("runs/one/split") and not ledger.complete("runs/one/evaluate") and ledger.history().count() == 0
    first = runs.retrain(rows.limit(0), ledger, "one", scorer, min_diversity=0.1)  # what is complete is not made again
    got = {r["template_id"]: (r["status"], r["reason"], r["samples"], r["train"], r["test"], r["correct"]) for r in first.collect()}
    assert got == {1: ("completed", None, 60, 48, 12, 12), 2: ("rejected", "too little diversity", 40, 0, 0, 0), 3: ("rejected", "too few samples", 5, 0, 0, 0)}
    runs.retrain(rows, ledger, "zero", scorer, min_diversity=0.0)
    runs.retrain(rows, ledger, "one", scorer)
    assert calls == ["broken", "scorer", "scorer"]
    assert [(r["entry"], r["run_id"]) for r in ledger.history().select("entry", "run_id").distinct().orderBy("entry").collect()] == [(0, "one"), (1, "zero")]


def test_a_run_over_nothing(spark, tmp_path):
    assert runs.retrain(samples(spark).limit(0), runs.Ledger(spark, str(tmp_path)), "none").count() == 0


def test_cascades_follow_every_path_and_keep_strays(spark):
    tables = {
        "a": spark.createDataFrame([(1,), (2,), (3,)], "a long"), "b": spark.createDataFrame([(10, 1), (20, 2), (30, None), (40, 9)], "b long, a long"),
        "c": spark.createDataFrame([(100, 10, 3), (200, 20, 3), (300, 30, 1), (400, 30, 2), (500, None, None)], "c long, b long, owner long"), "d": spark.createDataFrame([(100, "x"), (200, "y"), (300, "z"), (500, "w")], "of long, name string"),
    }
    links = [("d", "of", "c", "c"), ("c", "b", "b", "b"), ("c", "owner", "a", "a"), ("b", "a", "a", "a")]
    left = cascade(tables, links, {"a": spark.createDataFrame([(1,)], "a long"), "d": spark.createDataFrame([("w",)], "name string")})
    assert {t: sorted(r[0] for r in df.collect()) for t, df in left.items()} == {"a": [2, 3], "b": [20, 30, 40], "c": [200, 400, 500], "d": [200]}
    with pytest.raises(ValueError):
        cascade(tables, [*links, ("a", "a", "d", "of")], {})


def test_markers_make_fields(spark):
    df = spark.createDataFrame([(1, "<p>Name: {name} and {name} of ${place: x}</p> end"), (2, "no markers"), (3, None), (4, "")], "page_id long, html string")
    got = {r["page_id"]: r for r in analysed_templates(df).collect()}
    fields = spark.createDataFrame([(got[1]["fields"],)], "j string").select(F.from_json("j", "array<struct<idx:int,name:string,before:array<string>,after:array<string>,next_field:string>>").alias("f")).first()["f"]
    assert set(got) == {1} and got[1]["n_fields"] == 3
    assert [tuple(f) for f in fields] == [(1, "name", ["Name:"], ["and", "of", "x}"], "name_2"), (3, "name_2", ["Name:", "and"], ["of", "x}", "end"], "place"), (5, "place", ["Name:", "and", "of"], ["x}", "end"], "")]
