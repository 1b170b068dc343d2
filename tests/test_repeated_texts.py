"""Steps that meet a text once, however many rows repeat it: same results, and work that follows the distinct texts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import sequence
from fieldloom.operators.evaluation import weighted_scores

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def relations(spark):
    from fieldloom.sources.relations import Relations

    return Relations(spark, SF)


def test_equal_sequences_are_labelled_once(relations, monkeypatch):
    met = []
    label = sequence.label
    monkeypatch.setattr(sequence, "label", lambda sequences, models, **k: met.append(sequences) or label(sequences, models, **k))
    got = sequence.e10_crf_labels(relations).collect()
    rows = sequence.labelled_sequences(relations)
    assert met[0].count() == met[0].select("template_id", "words").distinct().count() < rows.count() == met[0].agg(F.sum("n")).first()[0]
    # As over every sequence by itself.
    gold = rows.select("sequence_id", F.posexplode("labels").alias("position", "gold"))
    each = label(rows, sequence.train(rows)).join(gold, ["sequence_id", "position"]).where("gold <> 'O'")
    assert got == weighted_scores(each.select("gold", "pred")).collect()


def test_labelling_groups_follow_the_sequences(relations):
    rows = sequence.labelled_sequences(relations)
    models = sequence.train(rows)
    few, many = (sequence.label(rows, models, share=n).groupBy("pred").count().collect() for n in (10_000, 50))
    assert sorted(few) == sorted(many)


def test_equal_corrections_are_aligned_once(relations, monkeypatch):
    met = []
    aligned = sequence.aligned
    monkeypatch.setattr(sequence, "aligned", lambda pairs, field: met.append(pairs) or aligned(pairs, field))
    got = dict(map(tuple, sequence.e09_bio_labels(relations).collect()))
    rows = relations.feedback.select("original_value", "corrected_value").collect()
    assert met[0].count() == len(set(rows)) < len(rows)
    plan = sequence.e09_bio_labels(relations)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Aggregate [original_value")
    want = Counter()
    for (original, corrected), n in Counter(map(tuple, rows)).items():
        words = f"Name : {original} type steel".split(" ")
        for label in sequence.bio_labels(words, corrected.strip(), "FIELD") if corrected.strip() else ["O"] * len(words):
            want[label] += n
    assert got == want
