"""Statistics that rules are learned from: shapes, noise and affixes of corrections, layout evidence, choices by history, training times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import decisions as D
from fieldloom.functions import text as X
from fieldloom.functions.binding import let
from fieldloom.operators.extraction import WORDS_SQL, Layout
from fieldloom.operators.windows import BATCH, numbered
from fieldloom.plans.registry import query
from fieldloom.sources.relations import Relations

#: The shape of a value: letters and digits by kind, runs with a plus.
SHAPE_SQL = "regexp_replace(regexp_replace(regexp_replace({0}, '[A-Z]', chr(2), 'g'), '[a-z]', chr(3), 'g'), '[0-9]', chr(4), 'g')"
for _code, _kind in ((2, "A"), (3, "a"), (4, "9")):
    SHAPE_SQL = f"regexp_replace(regexp_replace({SHAPE_SQL}, chr({_code}) || '{{{{2,}}}}', '{_kind}+', 'g'), chr({_code}), '{_kind}', 'g')"

NOISE_SQL = """, noise as (select feedback_id, document_id, field_name, trim(corrected_value) as corrected_value,
  case feedback_id % 10 when 0 then '(' || trim(corrected_value) || ')' when 1 then trim(corrected_value) || ',' when 2 then 'Depok, ' || trim(corrected_value) when 3 then trim(corrected_value) || ', 12 Mei 2020'
  when 4 then '(' || trim(corrected_value) || ') (Budi Santoso' when 5 then '"' || trim(corrected_value) || '"' when 6 then '[' || trim(corrected_value) || ']' when 7 then trim(corrected_value) || '.'
  when 8 then 'Jl. ' || trim(corrected_value) || ', 3 Juni 2021' else trim(corrected_value) end as original_value from feedback)"""


def noisy_feedback(r: Relations) -> DataFrame:
    """Corrections whose original value carried what extraction drags along: brackets, quotes, marks, places, dates, names."""
    c, k = F.trim("corrected_value"), F.col("feedback_id") % 10
    frames = [("(", ")"), ("", ","), ("Depok, ", ""), ("", ", 12 Mei 2020"), ("(", ") (Budi Santoso"), ('"', '"'), ("[", "]"), ("", "."), ("Jl. ", ", 3 Juni 2021")]
    out = F
    for n, (head, tail) in enumerate(frames):
        out = out.when(k == n, F.concat(F.lit(head), c, F.lit(tail)))
    return r.feedback.select("feedback_id", "document_id", "field_name", c.alias("corrected_value"), out.otherwise(c).alias("original_value"))


def shape_histograms(values: DataFrame, min_frequency: int = 3) -> DataFrame:
    """``field_name``, ``kind``, ``item``, ``n``: shapes, delimiters, lengths, three-character prefixes and suffixes and word counts of ``value``, from ``min_frequency`` on.

    A value counts once a kind, but once for each delimiter in it; empty and null values count nowhere, values
    under three characters have no prefix and suffix. All kinds are one unpivot and one aggregate.
    """
    v = F.col("value")
    long = F.length(v) >= 3
    kinds = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(k).alias("kind"), e.alias("item"))) for k, e, when in (
        ("shape", X.token_shape(v), F.lit(True)), ("length", F.length(v).cast("string"), F.lit(True)), ("prefix", F.substring(v, 1, 3), long), ("suffix", F.substring(v, -3, 3), long), ("words", F.size(F.filter(F.split(v, r"\s+"), lambda w: w != "")).cast("string"), F.lit(True)),
    ))))
    marks = F.transform(F.regexp_extract_all(v, F.lit(r"[,.\-/\\:;]"), F.lit(0)), lambda d: F.struct(F.lit("delimiter").alias("kind"), d.alias("item")))
    each = values.where(v != "").select("field_name", F.explode(F.concat(kinds, marks)).alias("x"))
    return each.groupBy("field_name", "x.kind", "x.item").agg(F.count("*").alias("n")).where(F.col("n") >= min_frequency)


@query(NOISE_SQL + r""", v as (select field_name, original_value as v from noise where original_value <> ''),
x as (select field_name, 'shape' as kind, """ + SHAPE_SQL.format("v") + r""" as item from v union all select field_name, 'length', cast(length(v) as varchar) from v union all select field_name, 'prefix', v[:3] from v where length(v) >= 3
  union all select field_name, 'suffix', v[-3:] from v where length(v) >= 3 union all select field_name, 'words', cast(len(list_filter(string_split_regex(v, '\s+'), lambda w: w <> '')) as varchar) from v
  union all select field_name, 'delimiter', unnest(regexp_extract_all(v, '[,.\-/\\:;]')) from v)
select field_name, kind, item, count(*) as n from x group by all having count(*) >= 3""")
def a45_shape_histograms(r: Relations) -> DataFrame:
    """All six histograms of values as they were extracted, shapes and delimiters included."""
    return shape_histograms(noisy_feedback(r).withColumnRenamed("original_value", "value"))


def _taken(original: Column, corrected: Column, opens: str, closes: str) -> tuple[Column, Column]:
    """Whether the original stands between two marks, and the correction doesn't."""
    o = F.startswith(original, F.lit(opens)) & F.endswith(original, F.lit(closes))
    return o, o & ~(F.startswith(corrected, F.lit(opens)) & F.endswith(corrected, F.lit(closes)))


def structural_noise(feedback: DataFrame) -> DataFrame:
    """``field_name``, ``n`` and seven counters of what corrections take off a value's ends; values are trimmed, null is the word None."""
    o, c = X.strict_norm(F.col("original_value")), X.strict_norm(F.col("corrected_value"))
    starts, ends = (lambda x, m: F.startswith(x, F.lit(m))), (lambda x, m: F.endswith(x, F.lit(m)))
    rules = {
        "has_parentheses_both": _taken(o, c, "(", ")")[1], "has_parentheses_start": starts(o, "(") & ~ends(o, ")") & ~starts(c, "("), "has_parentheses_end": ~starts(o, "(") & ends(o, ")") & ~ends(c, ")"),
        "has_quotes": _taken(o, c, '"', '"')[1], "has_brackets": _taken(o, c, "[", "]")[1], "has_trailing_comma": ends(o, ",") & ~ends(c, ","), "has_trailing_period": ends(o, ".") & ~ends(c, "."),
    }
    return feedback.groupBy("field_name").agg(F.count("*").alias("n"), *(F.count_if(e).alias(k) for k, e in rules.items()))


@query(NOISE_SQL + """ select field_name, count(*) as n, count(*) filter (o like '(%)' and not c like '(%)') as has_parentheses_both, count(*) filter (o like '(%' and o not like '%)' and c not like '(%') as has_parentheses_start,
  count(*) filter (o not like '(%' and o like '%)' and c not like '%)') as has_parentheses_end, count(*) filter (o like '"%"' and not c like '"%"') as has_quotes, count(*) filter (o like '[%]' and not c like '[%]') as has_brackets,
  count(*) filter (o like '%,' and c not like '%,') as has_trailing_comma, count(*) filter (o like '%.' and c not like '%.') as has_trailing_period from (select field_name, trim(original_value) as o, trim(corrected_value) as c from noise) x group by all""")
def a49_correction_noise(r: Relations) -> DataFrame:
    """The seven counters of structural noise of each field's corrections."""
    return structural_noise(noisy_feedback(r))


def pattern_statistics(feedback: DataFrame, min_frequency: int = 3) -> DataFrame:
    """``template_id``, ``field_name``, ``kind``, ``pattern``, ``frequency``, ``confidence``: affixes and noise that corrections take off, from ``min_frequency`` on.

    Of rows whose value changed: where the original begins with the correction, the rest is a suffix; where it
    holds the correction elsewhere, what stands before and after its first occurrence are prefix and suffix.
    Dates after a comma become ``[DATE]``, a capitalised word before a comma at the start of a prefix
    ``[LOCATION]``, and what follows ``) (`` in the suffix of the second case ``[NAME]``. A closing or opening parenthesis or a
    trailing comma that goes is structural noise. ``confidence`` is the share of all changed rows of the
    template. Patterns are lower-cased after counting; of those that then agree the most frequent stays.
    """
    o, c = F.col("original_value"), F.col("corrected_value")
    rows = feedback.where(o != c)
    at = F.instr(o, c)  # from 1; 1 for an empty correction
    begins, inside = F.startswith(o, c), ~F.startswith(o, c) & (at > 1)
    date = lambda x: F.regexp_replace(x, r",\s*\d{1,2}\s+\w+\s+\d{4}", ", [DATE]")
    rest = F.trim(F.substr(o, at + F.length(c)))
    suffix = F.when(begins, date(F.trim(F.substr(o, F.length(c) + 1)))).when(inside, F.regexp_replace(date(rest), r"\)\s*\(.+", ") ([NAME]"))
    prefix = F.when(inside, F.regexp_replace(F.trim(F.substr(o, F.lit(1), at - 1)), r"^[A-Z][a-z]+,", "[LOCATION],"))
    lost = lambda m: F.contains(o, F.lit(m)) & ~F.contains(c, F.lit(m))
    comma = F.endswith(o, F.lit(",")) & ~F.endswith(c, F.lit(","))
    told = lambda kind, x: F.when(x != "", F.struct(F.lit(kind).alias("kind"), x.alias("pattern")))
    each = F.array_compact(F.array(told("prefix", prefix), told("suffix", suffix), *(told("structural_noise", F.when(when, name)) for name, when in (("has_parentheses_end", lost(")")), ("has_parentheses_start", lost("(")), ("has_trailing_comma", comma)))))
    n = rows.select("template_id", "field_name", F.explode(each).alias("x")).groupBy("template_id", "field_name", "x.kind", "x.pattern").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= min_frequency)
    best = n.groupBy("template_id", "field_name", "kind", F.lower("pattern").alias("pattern")).agg(F.max("frequency").alias("frequency"))
    totals = rows.groupBy("template_id").agg(F.count("*").alias("total"))
    return best.join(totals, "template_id").select("template_id", "field_name", "kind", "pattern", "frequency", F.round(F.col("frequency") / F.col("total"), 9).alias("confidence"))


@query(NOISE_SQL + r""", ch as (select template_id, field_name, original_value as o, corrected_value as c, instr(original_value, corrected_value) as pos from noise join docs_x using (document_id) where original_value <> corrected_value),
pr as (select template_id, field_name, 'prefix' as kind, regexp_replace(trim(substr(o, 1, pos - 1)), '^[A-Z][a-z]+,', '[LOCATION],') as pattern from ch where pos > 1),
su as (select template_id, field_name, 'suffix' as kind, case when pos = 1 then d else regexp_replace(d, '\)\s*\(.+', ') ([NAME]') end as pattern from (select *, regexp_replace(trim(substr(o, pos + length(c))), ',\s*\d{1,2}\s+\w+\s+\d{4}', ', [DATE]', 'g') as d from ch where pos > 0) x),
st as (select template_id, field_name, 'structural_noise' as kind, unnest(list_filter([case when contains(o, ')') and not contains(c, ')') then 'has_parentheses_end' end, case when contains(o, '(') and not contains(c, '(') then 'has_parentheses_start' end, case when o like '%,' and c not like '%,' then 'has_trailing_comma' end], lambda x: x is not null)) as pattern from ch),
al as (select template_id, field_name, kind, pattern, count(*) as frequency from (from pr union all from su union all from st) x where pattern <> '' group by all having count(*) >= 3),
tt as (select template_id, count(*) as total from ch group by all)
select template_id, field_name, kind, lower(pattern) as pattern, max(frequency) as frequency, round(max(frequency) / any_value(total), 9) as confidence from al join tt using (template_id) group by template_id, field_name, kind, lower(pattern)""")
def a50_all_statistics(r: Relations) -> DataFrame:
    """Prefixes, suffixes and structural noise that corrections take off, generalised, with their share of the template's corrections."""
    return pattern_statistics(noisy_feedback(r).join(r.documents.select("document_id", "template_id"), "document_id"))


def layout_evidence(words: DataFrame, boxes: DataFrame, missing: DataFrame, min_samples: int = 5, min_hits: int = 2, min_ratio: float = 0.3, x_tolerance: float = 0.25, y_gap: float = 0.6) -> DataFrame:
    """``field``, ``n``, ``hits``, ``multiline``: whether corrections show that a field's values go on below its box.

    ``words`` has ``document_id``, ``word``, ``x0``, ``top``, ``bottom``; ``boxes`` has ``document_id``, ``field``, ``x0``, ``x1``, ``y1``, ``next_y``; ``missing`` has
    ``document_id``, ``field`` and ``tokens``, what a correction appended (of which five count). A correction is a hit if a word of it, case
    ignored, stands in the box's column (wider by ``x_tolerance`` of its width) below it by ``y_gap`` line heights and as
    far above the next field. The height is the upper median of the document's, 10 without one. From ``min_samples``
    corrections on ``multiline`` is true with ``min_hits`` hits that are ``min_ratio`` of them; below it is null, undecided.
    """
    high = words.where("bottom > top").groupBy("document_id").agg(X.upper_median(F.collect_list((F.col("bottom") - F.col("top")).cast("double"))).alias("height"))
    asked = missing.select("document_id", "field", F.transform(F.slice("tokens", 1, 5), lambda t: F.lower(t)).alias("tokens")).where(F.size("tokens") > 0)
    wide = (F.col("bx1") - F.col("bx0")).cast("double")
    wide = F.greatest(F.lit(1.0), wide) * x_tolerance
    box = boxes.select("document_id", "field", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), "y1", "next_y")
    cases = asked.join(box, ["document_id", "field"]).join(high, "document_id", "left").withColumn("gap", F.coalesce("height", F.lit(10.0)) * y_gap)
    wanted = cases.select("document_id", "field", (F.col("bx0") - wide).alias("left"), (F.col("bx1") + wide).alias("right"), (F.col("y1") + F.col("gap")).alias("above"), (F.col("next_y") - F.col("gap")).alias("below"), F.explode(F.array_distinct("tokens")).alias("token"))
    met = wanted.join(words.select("document_id", F.lower("word").alias("token"), "x0", "top"), ["document_id", "token"])
    hit = met.where("x0 between left and right and top >= above and (below is null or top <= below)").select("document_id", "field", "token").distinct()
    # Corrections of one field of one document with the same words count together, as their evidence is the same.
    key = F.sort_array(F.array_distinct("tokens"))
    hits = hit.groupBy("document_id", "field").agg(F.collect_set("token").alias("seen"))
    judged = cases.select("document_id", "field", key.alias("tokens")).join(hits, ["document_id", "field"], "left").withColumn("hit", F.coalesce(F.arrays_overlap("tokens", "seen"), F.lit(False)))
    told = judged.groupBy("field").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    enough = (F.col("hits") >= min_hits) & (F.col("hits") / F.col("n") >= min_ratio)
    return told.select("field", "n", "hits", F.when(F.col("n") >= min_samples, enough).alias("multiline"))


@query(WORDS_SQL + """, ms as (select doc_id as document_id, field, list_filter(list_transform(string_split_regex(trim(text), '\\s+')[12 * field + 14:12 * field + 16 + field], lambda x: lower(regexp_replace(x, '^[^\\w]+|[^\\w]+$', '', 'g'))), lambda x: x <> '') as tokens from documents, (values (0), (1), (2), (3)) v(field)),
bx as (select document_id, field, x0, x0 + 200 as x1, bottom as y1, next_top as next_y from loc),
hi as (select m.document_id, m.field, bool_or(list_contains(m.tokens[:5], lower(w.word)) and w.x0 between b.x0 - 50 and b.x1 + 50 and w.top >= b.y1 + 6 and (b.next_y is null or w.top <= b.next_y - 6)) as hit
  from ms m join bx b on b.document_id = m.document_id and b.field = m.field left join words w on w.document_id = m.document_id where len(m.tokens) > 0 group by all)
select field, count(*) as n, count(*) filter (hit) as hits, case when count(*) >= 5 then count(*) filter (hit) >= 2 and count(*) filter (hit) / count(*) >= 0.3 end as multiline from hi group by all""")
def p29_layout_decision(r: Relations) -> DataFrame:
    """Which fields' values go on below their box, by the words of their corrections."""
    layout = Layout(r)
    boxes = layout.locations.select("document_id", "field", "x0", (F.col("x0") + 200).alias("x1"), F.col("bottom").alias("y1"), F.col("next_top").alias("next_y"))
    k = F.col("field")
    parts = F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s+")
    tail = F.slice(parts, 12 * k + 14, 3 + k)
    bare = F.filter(F.transform(tail, lambda t: F.regexp_replace(t, r"^[^\w]+|[^\w]+$", "")), lambda t: t != "")
    missing = layout.docs.select("document_id", "text", F.explode(F.array(*map(F.lit, range(4)))).alias("field")).select("document_id", "field", bare.alias("tokens"))
    return layout_evidence(layout.words, boxes, missing)


def combined_by_history(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """``document_id``, ``field_name``, ``method``, ``value``, ``confidence``: the choice among strategies by what each achieved on the field before.

    ``candidates`` has ``document_id``, ``template_id``, ``field_name``, ``strategy``, ``idx``, ``value``, ``confidence``; ``history`` has ``template_id``,
    ``field_name``, ``strategy``, ``accuracy``, ``attempts``; without a history accuracy is 0.5. A candidate is valid from its
    strategy's threshold on. One valid candidate passes with its own confidence; of several the best score wins,
    the first of equals. Where none is valid the most confident above 0 is a fallback, marked in the method. A
    field's candidates come together once, in an array bounded by strategies.
    """
    keys = ["document_id", "field_name"]
    c = candidates.join(history, ["template_id", "field_name", "strategy"], "left").withColumns({"accuracy": F.coalesce("accuracy", F.lit(0.5)), "attempts": F.coalesce("attempts", F.lit(0))})
    weight = F.when(F.col("strategy") == "crf", 0.4).when(F.col("strategy") == "rule_based", 0.35).otherwise(0.25)
    score = F.round(D.hybrid_score(F.col("confidence"), weight, F.col("accuracy"), F.col("attempts")), 9)
    valid = F.col("confidence") >= D.confidence_threshold(F.col("accuracy"), F.col("attempts"))
    row = F.struct((-score).alias("k"), "idx", "strategy", "value", "confidence", valid.alias("valid"), (-F.col("confidence")).alias("c"))
    fields = c.groupBy(*keys).agg(F.collect_list(row).alias("all"))

    def chosen(rows: Column) -> Column:
        good = F.filter(rows, lambda x: x["valid"])
        one = lambda x, method, confidence: F.struct(method.alias("method"), x["value"].alias("value"), confidence.alias("confidence"))
        best = let(F.array_min(good), lambda x: one(x, x["strategy"], F.when(F.size(good) == 1, x["confidence"]).otherwise(F.least(-x["k"], F.lit(1.0)))))
        some = F.filter(rows, lambda x: x["confidence"] > 0)
        back = let(F.array_min(F.transform(some, lambda x: F.struct(x["c"].alias("c"), x["idx"].alias("idx"), x["strategy"].alias("strategy"), x["value"].alias("value"), x["confidence"].alias("confidence")))), lambda x: F.when(x.isNotNull(), one(x, F.concat(x["strategy"], F.lit("_fallback")), x["confidence"])))
        return F.when(F.size(good) > 0, best).otherwise(back)

    return fields.select(*keys, F.explode(F.array(let(F.col("all"), chosen))).alias("x")).where("x is not null").select(*keys, "x.method", "x.value", F.round("x.confidence", 9).alias("confidence"))


@query(""", tc as (select a.*, template_id from attempts a join docs_x using (document_id) where success),
hs as (select template_id, a.field_name, strategy, count(*) as attempts, count(*) filter (a.value = f.truth) / count(*) as accuracy from tc a join facts f on f.document_id = a.document_id and f.field_name = a.field_name where a.document_id % 3 = 0 group by all),
sc as (select tc.*, coalesce(accuracy, 0.5) as acc, coalesce(attempts, 0) as n, case strategy when 'crf' then 0.4 when 'rule_based' then 0.35 else 0.25 end as w from tc left join hs using (template_id, field_name, strategy) where tc.document_id % 3 <> 0),
st as (select *, confidence >= greatest(0.3, case when acc >= 0.7 and n >= 10 then 0.3 when acc >= 0.5 and n >= 5 then 0.4 else 0.5 end) as valid,
  round(case when n >= 10 then confidence * 0.15 + w * 0.05 + acc * 0.8 when n >= 5 then confidence * 0.2 + w * 0.1 + acc * 0.7 else confidence * 0.35 + w * 0.25 + acc * 0.4 end, 9) as score from sc),
rk as (select *, count(*) filter (valid) over f as good, row_number() over (partition by document_id, field_name order by valid desc, case when valid then -score else -confidence end, idx) as rn from st window f as (partition by document_id, field_name))
select document_id, field_name, strategy || case when valid then '' else '_fallback' end as method, value, round(case when not valid or good = 1 then confidence else least(score, 1.0) end, 9) as confidence from rk where rn = 1 and (valid or confidence > 0)""")
def e06_by_history(r: Relations) -> DataFrame:
    """The choice among strategies for two thirds of the documents, by what each strategy achieved on the others."""
    tried = r.attempts.where("success").join(r.documents.select("document_id", "template_id"), "document_id")
    past = tried.where("document_id % 3 = 0").join(r.facts.select("document_id", "field_name", "truth"), ["document_id", "field_name"])
    history = past.groupBy("template_id", "field_name", "strategy").agg(F.count("*").alias("attempts"), (F.count_if(F.col("value") == F.col("truth")) / F.count("*")).alias("accuracy"))
    return combined_by_history(tried.where("document_id % 3 <> 0"), history)


@query(NOISE_SQL + r""", fn as (select *, case feedback_id % 7 when 0 then 'supervisor_name' when 1 then 'issue_place' when 2 then 'event_name' when 3 then 'recipient_name' when 4 then 'issue_date' else 'other' end as name from noise),
fc as (select *, case when name in ('supervisor_name', 'recipient_name') then regexp_replace(original_value, '[()]', '', 'g') when name = 'issue_place' then regexp_replace(original_value, ',\s*\d{1,2}\s+\w+\s+\d{4}', '', 'g') else original_value end as v from fn)
select feedback_id, name, case when name <> 'other' then regexp_replace(trim(v), '\s+', ' ', 'g') else v end as value from fc""")
def f38_field_rules(r: Relations) -> DataFrame:
    """Values by the rules of their fields: parentheses, dates after a place, blanks."""
    k, name = F.col("feedback_id") % 7, F
    for n, field in enumerate(("supervisor_name", "issue_place", "event_name", "recipient_name", "issue_date")):
        name = name.when(k == n, field)
    rows = noisy_feedback(r).withColumn("name", name.otherwise("other"))
    return rows.select("feedback_id", "name", X.field_clean(F.col("name"), F.col("original_value")).alias("value"))


@query()
def e08_post_process(r: Relations) -> DataFrame:
    """Extracted values through the whole chain: generic cleaning, what corrections of the field showed to be noise, the field's own rules, single blanks (E08 with F04 to F07 and F38)."""
    rows = noisy_feedback(r)
    return post_processed(rows.where("feedback_id % 3 <> 0"), rows.where("feedback_id % 3 = 0"))


def post_processed(values: DataFrame, feedback: DataFrame, share: float = 0.1) -> DataFrame:
    """``feedback_id``, ``field_name``, ``value``: ``values`` cleaned by what ``feedback`` (``original_value``, ``corrected_value``) teaches of each field.

    Affixes are the ten commonest that corrections took off either end; structural noise counts from a ``share`` of the
    field's corrections on.
    """
    from fieldloom.operators.mining import common_affixes

    affix = common_affixes(feedback, share).groupBy("field_name", "kind").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "affix")))["affix"].alias("list"))
    learned = affix.groupBy("field_name").agg(*(F.first(F.when(F.col("kind") == k, F.col("list")), ignorenulls=True).alias(k) for k in ("prefix", "suffix")))
    counters = ["has_quotes", "has_brackets", "has_trailing_comma", "has_trailing_period"]
    noise = structural_noise(feedback).select("field_name", *((F.col(c) >= F.col("n") * share).alias(c) for c in counters))
    out = values.join(learned, "field_name", "left").join(noise, "field_name", "left")
    none = F.array().cast("array<string>")
    v = X.generic_clean(F.col("original_value"))
    v = F.when(F.coalesce("has_trailing_comma", F.lit(False)), F.regexp_replace(v, r",\z", "")).otherwise(v)
    v = X.affix_clean(v, F.coalesce("prefix", none), F.coalesce("suffix", none))
    v = F.when(F.coalesce("has_brackets", F.lit(False)), F.regexp_replace(v, r"^\[|\]$", "")).otherwise(v)
    return out.select("feedback_id", "field_name", X.collapse_blanks(X.field_clean(F.col("field_name"), v)).alias("value"))


@query(""", nu as (select template_id, created_at, row_number() over (partition by template_id order by created_at, document_id) - 1 as rn from docs_x), ba as (select template_id, rn // 5 as batch, max(created_at) as at from nu group by all),
gp as (select b.template_id, (epoch(cast(c.at as timestamp)) - epoch(cast(b.at as timestamp))) / 60 as minutes from ba b join ba c on c.template_id = b.template_id and c.batch = b.batch + 1)
select template_id, count(*) as gaps, round(avg(minutes), 6) as mean, median(minutes) as median, min(minutes) as least, max(minutes) as most from gp group by all""")
def a43_training_minutes(r: Relations) -> DataFrame:
    """Minutes from each batch of documents to the next of its template: batches meet their successors by number, so no window spans a template."""
    n = numbered(r.documents.select("template_id", "document_id", "created_at"))
    batch = n.groupBy("template_id", F.expr(f"cast((rn - 1) div {BATCH} as long)").alias("batch")).agg(F.max("created_at").cast("timestamp").alias("at"))
    after = batch.select("template_id", (F.col("batch") - 1).alias("batch"), F.col("at").alias("then"))
    minutes = (F.unix_micros("then") - F.unix_micros("at")) / 60e6
    gaps = batch.join(after, ["template_id", "batch"]).select("template_id", minutes.alias("minutes"))
    return gaps.groupBy("template_id").agg(F.count("*").alias("gaps"), F.round(F.avg("minutes"), 6).alias("mean"), F.median("minutes").alias("median"), F.min("minutes").alias("least"), F.max("minutes").alias("most"))
