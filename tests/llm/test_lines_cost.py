"""What line dedup computes once a text, and by what its postings are sorted."""

import re

from fieldloom.llm import lines


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_text_is_hashed_and_cut_below_the_explode(spark):
    text = plan(lines._lines(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"), "doc_id", "text"))
    assert "Generate" in text and text.count("split(") == 1
    assert text.index("Generate") < text.index("xxhash64(text") and text.index("Generate") < text.index("split(")


def test_postings_are_sorted_by_one_long(spark):
    entry = "key long, doc long, text_key long, line_no int, n int, odd long, odder long, head array<long>"
    rows = [(k, k, 0, 0, 2, 0, 0, [(2 << 56) + 1, (2 << 56) + k]) for k in range(1, 4)]
    met = lines._met(lines.postings(spark.createDataFrame(rows, entry), spark.createDataFrame([], "key long")).hint("merge"))
    assert re.findall(r"SortMergeJoin \[token#\d+L?\], \[token#\d+L?\]", plan(met))


def test_every_level_of_the_rarity_table_fits_its_byte(spark):
    rows = [(" ".join(f"w{i}" for i in range(1500)),)] * 3 + [("w1 " * 5000,)]
    table = lines.word_rarity(spark.createDataFrame(rows, "text string"), bits=6).first()["rarity"]
    counts = spark.createDataFrame(rows, "text string").selectExpr("explode(split(text, ' ')) w").selectExpr("shiftrightunsigned(xxhash64(w), 58) b").groupBy("b").count()
    assert table == [r["l"] for r in counts.selectExpr("b", "cast(floor(log2(count) * 2) as int) l").orderBy("b").collect()]


def test_halves_of_the_bits_are_made_of_long_lines_only(spark, monkeypatch):
    """Whatever lines count as brief, similar ones pass the filter; those of few words need one half less."""
    kept = {}
    keep = lines.Workspace.keep

    def note(self, df, name):
        kept[name] = keep(self, df, name)
        return kept[name]

    monkeypatch.setattr(lines.Workspace, "keep", note)
    monkeypatch.setattr(lines.Workspace, "clear", lambda self: None)
    near = [f"w{i}" for i in range(lines.BRIEF + 2)]
    rows = [(1, " ".join(near)), (2, " ".join(near[: lines.BRIEF])), (3, " ".join(near[:20])), (4, " ".join(near[:24]))]
    got = {r["doc_id"]: r["removed"] for r in lines.line_report(spark.createDataFrame(rows, "doc_id long, text string"), bits=10).collect()}
    assert got == {1: "", 2: "0", 3: "", 4: "0"}
    assert {r["n"]: r["odder"] != 0 for r in kept["line-entries"].collect()} == {lines.BRIEF + 2: True, lines.BRIEF: False, 20: False, 24: False}
