"""What the layout reads from arrays of words against windows over rows; no shuffle in either word query."""

from fieldloom.operators.extraction import Layout, w14_word_features
from fieldloom.operators.features import e11_sequence_features, e11_spatial_features, neighbours, page_labels, page_words, spatial_features
from fieldloom.operators.services import f22_segmented_words


class Tables:
    def __init__(self, spark, rows):
        self.spark, self.docs = spark, spark.createDataFrame(rows, "doc_id long, text string")

    def table(self, name):
        return self.docs


ROWS = [(1, " ".join(f"w{i}" for i in range(27))), (2, " one "), (3, ""), (4, None), (5, "a b"), (6, " ".join("x" * 10))]


def test_neighbours_are_those_of_windows(spark):
    layout = Layout(Tables(spark, ROWS))
    want = neighbours(layout.words.select("document_id", "idx", "word", "top"))
    got = layout.neighbours.select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count() == 41


def test_word_features_shuffle_nothing(spark):
    for f in (w14_word_features, e11_sequence_features):
        plan = f(Tables(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_pieces_are_counted_by_no_aggregate(spark):
    words = "steelplumforestmaroonhoneydew"
    r = Tables(spark, [(1, f"{words} 0123456789abcdef0123456789abcdef")] + [(k, "steel plum forest maroon honeydew") for k in range(2, 8)])
    df = f22_segmented_words(r)
    assert {x["segmented"] for x in df.collect()} >= {"steel plum forest maroon honeydew"}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate [" in x and "fixed#" in x and "piece#" in x]


def test_nearest_labels_are_sought_once_a_place(spark):
    """Neither a sort nor a shuffle of words; the same rows by a window for the width, by a join that isn't broadcast, and by a comparison with every label."""
    r = Tables(spark, ROWS + [(k, " ".join("y" * (13 * k % 400))) for k in range(7, 30)])
    df = e11_spatial_features(r)
    plan = df._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and "[document_id" not in "".join(x for x in plan.splitlines() if "Exchange hash" in x or "Window [" in x)
    got = sorted(map(repr, df.collect()))
    words = page_words(r)
    assert got == sorted(map(repr, spatial_features(words.drop("widest"), page_labels(r), few=0).collect()))
    labels = {}
    for x in page_labels(r).collect():
        labels.setdefault(x["layout"], []).append(x)
    least = {(w["document_id"], w["idx"]): min(((w["x0"] - n["x1"]) ** 2 + (w["top"] - n["y0"]) ** 2, n["field"]) for n in labels[w["layout"]])[1] for w in words.collect()}
    assert {(x["document_id"], x["idx"]): x["label"] for x in df.collect()} == least and len(least) == len(got) > 1000
