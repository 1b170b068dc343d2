"""Fields in tables (F29, F30): the column whose header fits best, then the cell in it that the field's name asks for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.binding import let
from fieldloom.functions.similarity import exact_ratio
from fieldloom.functions.text import field_keywords, keywords_by_length, row_number_of
from fieldloom.plans.registry import query
from fieldloom.sources.relations import Relations

LEAST_RATIO = 0.6  # a header must be more alike to a label
KEYWORD_SCORE = 0.8  # what a keyword in a header counts
BY_HEADER, BY_KEYWORD = 0.9, 0.8  # confidence of a value by the way its column was found

KEYS = ["document_id", "field_name"]


def matching_columns(headers: DataFrame, fields: DataFrame) -> DataFrame:
    """``document_id``, ``field_name``, ``table``, ``by_label``, ``by_keyword``: the column of each table for a field, by either way; null: none.

    ``headers`` has ``document_id``, ``table``, ``col`` and ``cell``, ``fields`` has ``document_id``, ``field_name`` and ``label``. By label: the
    first header that contains the label; without one, headers count in their order: a ratio above ``LEAST_RATIO``
    that beats the best so far, and a keyword of the field's name as ``KEYWORD_SCORE`` if the best so far is below that.
    By keyword: the first header with the most letters of the name's keywords. Blank headers count for nothing;
    without a label nothing is found by it.
    """
    head = headers.where(F.col("cell") != "").select("document_id", "table", "col", F.lower("cell").alias("raw"))
    f = fields.select(*KEYS, F.lower("label").alias("label"), keywords_by_length(F.col("field_name")).alias("keywords"))
    # Made after the join, so that a header is shuffled once.
    pairs = head.join(f, "document_id").withColumn("header", F.trim("raw"))
    # Only headers that may be taken by ratio are compared: no more than three times as long or short as the label.
    able = (F.coalesce("label", F.lit("")) != "") & (F.length("header") <= 3 * F.length("label")) & (F.length("label") <= 3 * F.length("header"))
    contains = (F.coalesce("label", F.lit("")) != "") & F.contains("header", F.col("label"))
    hits = F.filter("keywords", lambda k: F.contains("header", k))
    letters = F.aggregate(F.filter("keywords", lambda k: F.contains(F.col("raw"), k)), F.lit(0), lambda a, k: a + F.length(k))
    pairs = pairs.select(*KEYS, "table", "col", contains.alias("contains"), F.when(able, F.col("label")).alias("a"), F.when(able, F.col("header")).alias("b"), (F.size(hits) > 0).alias("keyword"), letters.alias("letters"), (F.coalesce("label", F.lit("")) != "").alias("told"))
    pairs = pairs.withColumn("ratio", F.when(F.col("a").isNotNull(), exact_ratio("a", "b")).otherwise(0.0))
    # A header of neither kind changes nothing in the walk below, so it needn't be shuffled.
    each = F.when((F.col("ratio") > LEAST_RATIO) | F.col("keyword"), F.struct("col", "ratio", "keyword"))
    t = pairs.groupBy(*KEYS, "table").agg(
        F.min(F.when(F.col("contains"), F.col("col"))).alias("inside"),
        F.sort_array(F.collect_list(each)).alias("headers"),
        F.bool_or("told").alias("told"),
        F.min(F.when(F.col("letters") > 0, F.struct((-F.col("letters")).alias("k"), "col")))["col"].alias("by_keyword"),
    )

    def state(score: Column, col: Column) -> Column:
        return F.struct(score.alias("score"), col.alias("col"))

    def step(s: Column, h: Column) -> Column:
        liked = F.when((h["ratio"] > s["score"]) & (h["ratio"] > LEAST_RATIO), state(h["ratio"], h["col"])).otherwise(s)
        return F.when(h["keyword"] & (liked["score"] < KEYWORD_SCORE), state(F.lit(KEYWORD_SCORE), h["col"])).otherwise(liked)

    best = F.aggregate("headers", state(F.lit(0.0), F.lit(None).cast("int")), step)["col"]
    return t.select(*KEYS, "table", F.when(F.col("told"), F.coalesce("inside", best)).alias("by_label"), "by_keyword")


def table_fields(cells: DataFrame, fields: DataFrame, whole: tuple[DataFrame, Callable[[Column], Column]] | None = None) -> DataFrame:
    """``document_id``, ``field_name``, ``value``, ``confidence``, ``method``, ``table``, ``col`` of the fields that a table has.

    ``cells`` has ``document_id``, ``table``, ``row``, ``col`` and ``cell`` (rows and columns from 0, row 0 the header). A field's name may
    end in its row number. In the first table where it succeeds: of the column by label, the value of that
    number among its cells that aren't blank (number 0: the last), or its only value for a field without a
    number. Else, in the first table where that succeeds, the cell of the column by keyword in the row of that
    number, if it isn't blank. Tables without a row below the header have nothing.

    A table meets all fields that ask for it at once, as one row. ``whole`` tells how such rows are had where
    they come in a more compact form: a table with ``document_id``, ``table`` and ``body``, one row a table, and
    what makes the body an array of ``row``, ``col``, ``cell``. Then of ``cells`` only the headers are shuffled.
    """
    if whole is None:
        whole = cells.groupBy("document_id", "table").agg(F.collect_list(F.struct("row", "col", "cell")).alias("body")), lambda body: body
    body, cells_of = whole
    headers = cells.where("row = 0").withColumn("cell", F.trim("cell"))
    found = matching_columns(headers, fields.where(F.col("field_name").isNotNull())).where("by_label is not null or by_keyword is not null")
    each = F.struct("field_name", row_number_of(F.col("field_name")).alias("nth"), "by_label", "by_keyword")
    asked = found.groupBy("document_id", "table").agg(F.collect_list(each).alias("asked"))

    def answers(cs: Column) -> Column:
        filled = F.filter(cs, lambda c: F.trim(c["cell"]) != "")
        return let(F.struct(F.array_max(cs["row"]).alias("last"), filled.alias("filled")), lambda t: F.transform("asked", lambda q: answer(t, q)))

    def answer(t: Column, q: Column) -> Column:
        nth = q["nth"]
        below = F.sort_array(F.filter(t["filled"], lambda c: (c["col"] == q["by_label"]) & (c["row"] > 0)))
        place = lambda own: F.when(nth == 0, F.size(own)).when(nth.isNotNull(), nth).when(F.size(own) == 1, 1)
        one = let(below, lambda own: F.get(own, place(own) - 1)["cell"])
        two = F.array_min(F.filter(t["filled"], lambda c: (c["col"] == q["by_keyword"]) & (c["row"] == nth))["cell"])
        told = lambda way, col, value: F.when(value.isNotNull(), F.struct(F.lit(way).alias("way"), col.alias("col"), F.trim(value).alias("value")))
        best = F.coalesce(let(one, lambda v: told(0, q["by_label"], v)), let(two, lambda v: told(1, q["by_keyword"], v)))
        return F.struct(q["field_name"].alias("field_name"), F.when(t["last"] >= 1, best).alias("x"))

    every = body.join(asked, ["document_id", "table"]).select("document_id", "table", F.inline_outer(let(cells_of(F.col("body")), answers))).where("x is not null")
    best = every.groupBy(*KEYS).agg(F.min(F.struct("x.way", "table", "x.col", "x.value")).alias("x"))
    header = F.col("x.way") == 0
    return best.select(*KEYS, "x.value", F.when(header, BY_HEADER).otherwise(BY_KEYWORD).alias("confidence"), F.when(header, "table_header_match").otherwise("table_keyword_match").alias("method"), "x.table", "x.col")


def turns_as_tables(r: Relations) -> DataFrame:
    """Each turn of a conversation as a table: its lines are rows, its words cells."""
    lines = r.table("conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").cast("int").alias("table"), F.posexplode(F.split("text", "\\n")).alias("row", "line"))
    return lines.select("document_id", "table", "row", F.posexplode(F.split("line", " ")).alias("col", "cell"))


def turns_as_texts(r: Relations) -> tuple[DataFrame, Callable[[Column], Column]]:
    """``turns_as_tables`` with a row a turn, whose text is cut only where it is read; turns of one number are one table."""
    texts = r.table("conversations").groupBy(F.col("conv_id").alias("document_id"), F.col("turn").cast("int").alias("table")).agg(F.collect_list("text").alias("body"))
    line = lambda words, row: F.transform(words, lambda w, col: F.struct(row.alias("row"), col.alias("col"), w.alias("cell")))
    cut = lambda text: F.flatten(F.transform(F.split(text, "\\n"), lambda x, row: line(F.split(x, " "), row)))
    return texts, lambda body: F.flatten(F.transform(body, cut))


def turn_fields(r: Relations) -> DataFrame:
    """Fields to look for: a header's second word as label, its third without its first letter in a longer label, its fourth as keyword."""
    first = r.table("conversations").where("turn = 0").select(F.col("conv_id").alias("document_id"), F.split(F.element_at(F.split("text", "\\n"), 1), " ").alias("w"))
    bare = lambda k: F.regexp_replace(F.lower(F.coalesce(F.get("w", F.lit(k)), F.lit(""))), "[^a-z]", "")
    each = F.array(
        F.struct(F.concat(bare(1), F.lit("_1")).alias("field_name"), F.get("w", F.lit(1)).alias("label")),
        F.struct(F.lit("alike_2").alias("field_name"), F.concat(F.substring(F.get("w", F.lit(2)), 2, 99), F.lit("o")).alias("label")),
        F.struct(F.concat(F.lit("key_"), bare(3), F.lit("_3")).alias("field_name"), F.lit("").alias("label")),
        F.struct(F.concat(F.lit("only_"), bare(4)).alias("field_name"), F.lower(F.get("w", F.lit(4))).alias("label")),
    )
    return first.select("document_id", F.explode(each).alias("x")).select("document_id", "x.*").groupBy("document_id", "field_name").agg(F.min("label").alias("label"))


@query()
def f30_table_fields(r: Relations) -> DataFrame:
    """Fields in the tables of all turns, by header and by keyword."""
    return table_fields(turns_as_tables(r), turn_fields(r), turns_as_texts(r))
