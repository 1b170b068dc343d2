"""The ordered walk over a field's labelled words, with its early stops (W24), as windows over the words of a field."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.extraction import WORDS_SQL, Layout
from fieldloom.plans.registry import query
from fieldloom.sources.relations import Relations

TOLERANCE = 1.3  # of a field's typical length, where nothing else bounds it
MIN_GAP = 1.0  # heights of a line that the next field must lie below a field to bound it


def bounded_fields(fields: DataFrame) -> DataFrame:
    """``fields`` with the bounds of a walk: ``next_x``, ``next_y`` (null where it lies closer below than ``MIN_GAP`` lines) and ``max_length``.

    ``fields`` has ``bottom``, ``height`` (of a line), ``next_x``, ``next_y``, ``typical_length`` and ``multiline``. A typical
    length counts only where neither neighbour bounds the field and its values keep to one line.
    """
    out = fields.withColumn("next_y", F.when(F.col("next_y") - F.col("bottom") >= F.col("height") * MIN_GAP, F.col("next_y")))
    # A neighbour at 0 bounds nothing.
    free = (F.coalesce("next_y", F.lit(0)) == 0) & (F.coalesce("next_x", F.lit(0)) == 0) & ~F.coalesce("multiline", F.lit(False))
    return out.withColumn("max_length", F.when(free & (F.col("typical_length") > 0), F.floor(F.col("typical_length") * TOLERANCE).cast("int")))


def ordered_walk(words: DataFrame, fields: DataFrame) -> DataFrame:
    """``document_id``, ``field``, ``value``, ``n``, ``confidence``, ``stop``, ``stop_idx`` of each field with a word left.

    ``words`` has ``document_id``, ``field`` (whose label the word was given), ``idx``, ``word``, ``x0``, ``top`` and ``score``;
    ``fields`` has ``document_id``, ``field``, ``next_x``, ``next_y``, ``max_length``. Words are walked in order. The walk
    ends (``stop``) before the first word at or right of the next field on the line (``next_x``), or, where no field
    follows on the line, at or below the next field (``next_y``), or with which the value would be longer than
    ``max_length`` (``length``); else it ends with the words (``end``). Words between a word ``(`` and the next word ``)``
    are left out, the parentheses too. The value joins the words left by blanks; its confidence is their mean score.

    Every rule but the last needs only what stood before, so each is a running figure over the field's words, and
    the first word that breaks a rule ends the value. Work and memory follow the words of one document and field.
    """
    keys = ["document_id", "field"]
    order = Window.partitionBy(*keys).orderBy("idx")
    until, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    bound = F.coalesce("next_x", F.lit(0)) != 0
    below = ~bound & (F.coalesce("next_y", F.lit(0)) != 0) & (F.col("top") >= F.col("next_y"))
    paren = F.when(F.col("word") == "(", True).when(F.col("word") == ")", False)
    w = words.join(fields.select(*keys, "next_x", "next_y", "max_length"), keys)
    w = w.withColumn("skipped", F.col("word").isin("(", ")") | F.coalesce(F.last(paren, ignorenulls=True).over(until), F.lit(False)))
    size = F.coalesce(F.sum(F.when(~F.col("skipped"), F.char_length("word") + 1)).over(before), F.lit(0)) + F.char_length("word")
    w = w.withColumn("size", size)
    stop = F.when(bound & (F.col("x0") >= F.col("next_x")), "next_x").when(below, "next_y").when(F.col("size") > F.col("max_length"), "length")
    w = w.withColumn("why", stop).withColumn("first", F.min(F.when(F.col("why").isNotNull(), F.struct("idx", "why"))).over(until))
    told = w.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("first").isNull() & ~F.col("skipped"), F.struct("idx", "word")))).alias("kept"),
        F.avg(F.when(F.col("first").isNull() & ~F.col("skipped"), F.col("score"))).alias("confidence"),
        F.min(F.when(F.col("why").isNotNull(), F.struct("idx", "why"))).alias("at"),
    )
    told = told.where(F.size("kept") > 0)
    return told.select(*keys, F.array_join(F.col("kept.word"), " ").alias("value"), F.size("kept").cast("long").alias("n"), "confidence", F.coalesce("at.why", F.lit("end")).alias("stop"), F.col("at.idx").alias("stop_idx"))


def labelled_words(r: Relations) -> DataFrame:
    """Words of three lines from a field's place on, as its labels; a word in 23 opens a parenthesis and one closes it."""
    layout = Layout(r)
    loc = layout.locations.select("document_id", "field", F.col("x0").alias("lx"), F.col("top").alias("lt"))
    hit = layout.words.join(loc, "document_id").where("x0 >= lx and top >= lt and top < lt + 36")
    word = F.when(F.col("idx") % 23 == 5, "(").when(F.col("idx") % 23 == 8, ")").otherwise(F.col("word"))
    return hit.select("document_id", "field", "idx", word.alias("word"), "x0", "top", ((F.col("idx") * 37 % 100) / 100.0).alias("score"))


def walk_fields(r: Relations) -> DataFrame:
    """The fields of the layout with a neighbour on the line, below, too close below, or none at all."""
    k, d = F.col("field"), F.col("document_id")
    loc = Layout(r).locations
    given = loc.select(
        "document_id", "field", "bottom", F.lit(10).alias("height"), F.when(k == 0, 250).alias("next_x"), F.when((k == 1) | (k == 0), F.col("top") + F.when(d % 3 == 0, 12).otherwise(24)).alias("next_y"),
        F.when(k >= 2, 20 + d % 50).alias("typical_length"), ((k == 3) & (d % 2 == 0)).alias("multiline"),
    )
    return bounded_fields(given)


@query(WORDS_SQL + """,
lw as (select w.document_id, l.field, idx, case idx % 23 when 5 then '(' when 8 then ')' else word end as word, w.x0, w.top, (idx * 37 % 100) / 100.0 as score,
  row_number() over (partition by w.document_id, l.field order by idx) as i from words w join loc l on l.document_id = w.document_id and w.x0 >= l.x0 and w.top >= l.top and w.top < l.top + 36),
fb as (select document_id, field, bottom, case when field = 0 then 250 end as next_x, case when field <= 1 then top + case when document_id % 3 = 0 then 12 else 24 end end as y, case when field >= 2 then 20 + document_id % 50 end as typical, field = 3 and document_id % 2 = 0 as multi from loc),
fx as (select document_id, field, next_x, case when y - bottom >= 10 then y end as next_y, typical, multi from fb),
fl as (select *, case when next_y is null and next_x is null and not multi then cast(floor(typical * 1.3) as integer) end as max_length from fx),
wf as (select lw.*, next_x, next_y, max_length from lw join fl using (document_id, field)),
step as (
  select document_id, field, 0 as i, '' as value, 0 as n, cast(0 as double) as total, false as inside, null::varchar as stop, null::bigint as stop_idx from fl
  union all
  select s.document_id, s.field, w.i,
    case when halt or skip then s.value when s.n = 0 then w.word else s.value || ' ' || w.word end,
    case when halt or skip then s.n else s.n + 1 end, case when halt or skip then s.total else s.total + w.score end,
    case w.word when '(' then true when ')' then false else s.inside end,
    case when halt then w.why end, case when halt then w.idx end
  from step s join (select * from wf) v on v.document_id = s.document_id and v.field = s.field and v.i = s.i + 1 and s.stop is null,
  lateral (select v.i, v.idx, v.word, v.score, case when v.next_x is not null then case when v.x0 >= v.next_x then 'next_x' end when v.next_y is not null and v.top >= v.next_y then 'next_y' end as hit,
    case when v.max_length is not null and length(case when s.n = 0 then v.word else s.value || ' ' || v.word end) > v.max_length then 'length' end as long) w0,
  lateral (select w0.*, coalesce(w0.hit, w0.long) as why, coalesce(w0.hit, w0.long) is not null as halt, w0.word in ('(', ')') or s.inside as skip) w)
select document_id, field, value, cast(n as bigint) as n, round(total / n, 9) as confidence, coalesce(stop, 'end') as stop, stop_idx from step where n > 0 qualify row_number() over (partition by document_id, field order by i desc) = 1""")
def w24_ordered_walk(r: Relations) -> DataFrame:
    """Values of labelled words, walked in order up to a neighbour or a length, without what stands in parentheses."""
    return ordered_walk(labelled_words(r), walk_fields(r)).withColumn("confidence", F.round("confidence", 9))
