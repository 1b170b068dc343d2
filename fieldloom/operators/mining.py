"""Pattern mining from corrections: shapes, affixes, noise and the suggestions they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import text as X
from fieldloom.functions.patterns import checked, pattern_index, pattern_matches
from fieldloom.operators.metrics import changed
from fieldloom.plans.registry import query
from fieldloom.sources.relations import Relations

SHAPE_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[A-Z]', chr(2), 'g'), '[a-z]', chr(3), 'g'), '[0-9]', chr(4), 'g'), chr(2) || '+', 'A', 'g'), chr(3) || '+', 'a', 'g'), chr(4) || '+', '9', 'g')"


def value_shapes(df: DataFrame, value: str = "corrected_value") -> DataFrame:
    """A row per value and kind of shape: one unpivot, so that all histograms are one aggregate."""
    v = F.col(value)
    kinds = {
        "length": F.length(v).cast("string"),
        "prefix": F.substring(v, 1, 3),
        "suffix": F.substr(v, F.greatest(F.length(v) - 2, F.lit(1))),
        "words": F.size(F.split(F.trim(v), r"\s+")).cast("string"),
        "shape": X.token_shape(v),
    }
    return df.select("field_name", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), e.alias("item")) for k, e in kinds.items()))).alias("x")).select("field_name", "x.*")


@query(""", x as (select field_name, unnest([{'kind': 'length', 'item': cast(length(corrected_value) as varchar)}, {'kind': 'prefix', 'item': substr(corrected_value, 1, 3)},
  {'kind': 'suffix', 'item': substr(corrected_value, greatest(length(corrected_value) - 2, 1))}, {'kind': 'words', 'item': cast(len(string_split_regex(trim(corrected_value), '\\s+')) as varchar)}]) as x from feedback)
select field_name, x.kind as kind, x.item as item, count(*) as n from x group by all having count(*) >= 3""")
def a45_value_histograms(r: Relations) -> DataFrame:
    """Lengths, prefixes, suffixes and word counts that occur at least three times."""
    return value_shapes(r.feedback).where("kind <> 'shape'").groupBy("field_name", "kind", "item").agg(F.count("*").alias("n")).where("n >= 3")


@query(""", v as (select field_name, len(string_split_regex(trim(corrected_value), '\\s+')) as w, corrected_value from feedback)
select field_name, min(w) as low, max(w) as high, round(avg(w), 9) as mean, case when max(w) - min(w) > 2 then 'high' when max(w) > min(w) then 'medium' else 'low' end as variability,
  bool_or(regexp_matches(corrected_value, '^[A-Z]')) as capitalised from v group by all""")
def a46_value_insight(r: Relations) -> DataFrame:
    """Word counts of each field's values and how much they vary."""
    w = F.size(F.split(F.trim("corrected_value"), r"\s+"))
    spread = F.max(w) - F.min(w)
    return r.feedback.groupBy("field_name").agg(
        F.min(w).alias("low"), F.max(w).alias("high"), F.round(F.avg(w), 9).alias("mean"),
        F.when(spread > 2, "high").when(spread > 0, "medium").otherwise("low").alias("variability"), F.bool_or(F.col("corrected_value").rlike("^[A-Z]")).alias("capitalised"),
    )


@query(""" select field_name, count(*) filter (length(original_value) > 1.5 * length(corrected_value)) as too_long, count(*) filter (length(original_value) < 0.5 * length(corrected_value)) as too_short,
count(*) as n from feedback group by all""")
def a47_error_classes(r: Relations) -> DataFrame:
    """Values that were far too long or too short, paired row by row."""
    a, b = F.length("original_value"), F.length("corrected_value")
    return r.feedback.groupBy("field_name").agg(F.count_if(a > 1.5 * b).alias("too_long"), F.count_if(a < 0.5 * b).alias("too_short"), F.count("*").alias("n"))


def removed_affixes(feedback: DataFrame) -> DataFrame:
    """``field_name``, ``kind`` (prefix or suffix), ``affix``: what corrections take off the start or the end, lower-cased."""
    o, c = F.trim("original_value"), F.trim("corrected_value")
    longer = (c != "") & (F.length(o) > F.length(c))
    prefix = F.when(longer & F.endswith(o, c), F.trim(F.substr(o, F.lit(1), F.length(o) - F.length(c))))
    suffix = F.when(longer & F.startswith(o, c), F.trim(F.substr(o, F.length(c) + 1)))
    both = F.explode(F.array(F.struct(F.lit("prefix").alias("kind"), F.lower(prefix).alias("affix")), F.struct(F.lit("suffix").alias("kind"), F.lower(suffix).alias("affix"))))
    return feedback.select("field_name", both.alias("x")).select("field_name", "x.*").where("affix <> ''")


def common_affixes(feedback: DataFrame, share: float = 0.1, most: int = 10) -> DataFrame:
    """The ``most`` commonest affixes of each field and kind, from two and that share of the field's feedback on."""
    total = feedback.groupBy("field_name").agg(F.count("*").alias("total"))
    c = removed_affixes(feedback).groupBy("field_name", "kind", "affix").agg(F.count("*").alias("n")).join(total, "field_name")
    c = c.where(F.col("n") >= F.greatest(F.lit(2.0), F.col("total") * share))
    w = Window.partitionBy("field_name", "kind").orderBy(F.desc("n"), "affix")
    return c.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select("field_name", "kind", "affix", "n")


@query(""", o as (select field_name, trim(original_value) as o, trim(corrected_value) as c from feedback),
x as (select field_name, 'prefix' as kind, lower(trim(o[:length(o) - length(c)])) as affix from o where c <> '' and length(o) > length(c) and ends_with(o, c)
  union all select field_name, 'suffix', lower(trim(o[length(c) + 1:])) from o where c <> '' and length(o) > length(c) and starts_with(o, c)),
n as (select field_name, count(*) as total from feedback group by all), c as (select field_name, kind, affix, count(*) as n from x where affix <> '' group by all)
select c.field_name, kind, affix, n from c join n using (field_name) where n >= greatest(2, total * 0.1) qualify row_number() over (partition by c.field_name, kind order by n desc, affix) <= 10""")
def a48_common_affixes(r: Relations) -> DataFrame:
    """The ten commonest texts that corrections take off either end, from a tenth of the field's feedback on."""
    return common_affixes(r.feedback)


@query(r""" select lang, count(*) filter (regexp_matches(trim(text), '^\(.*\)$')) as parentheses, count(*) filter (starts_with(text, '(')) as opens, count(*) filter (regexp_matches(text, ',$')) as comma,
count(*) filter (regexp_matches(text, '\.$')) as period, count(*) filter (contains(text, '"')) as quotes, count(*) filter (contains(text, '[')) as brackets from documents group by all""")
def a49_structural_noise(r: Relations) -> DataFrame:
    """Counters of brackets, quotes and trailing marks."""
    t, n = F.col("text"), F.count_if
    return r.table("documents").groupBy("lang").agg(
        n(F.trim(t).rlike(r"^\(.*\)$")).alias("parentheses"), n(t.startswith("(")).alias("opens"), n(t.rlike(r",\z")).alias("comma"),
        n(t.rlike(r"\.\z")).alias("period"), n(t.contains('"')).alias("quotes"), n(t.contains("[")).alias("brackets"),
    )


@query(""", x as (select d.template_id, f.field_name, trim(substr(corrected_value, length(original_value) + 1)) as suffix from feedback f join docs_x d using (document_id)
  where original_value <> '' and starts_with(corrected_value, original_value)), n as (select template_id, count(*) as total from feedback join docs_x using (document_id) group by all)
select x.template_id, field_name, suffix, count(*) as frequency, round(count(*) / any_value(total), 9) as confidence from x join n using (template_id) where suffix <> '' group by all having count(*) >= 3""")
def a50_pattern_statistics(r: Relations) -> DataFrame:
    """Generalised suffixes per template and field from three occurrences on, with their share of all the template's corrections."""
    rows = r.feedback.join(r.documents.select("document_id", "template_id"), "document_id")
    total = rows.groupBy("template_id").agg(F.count("*").alias("total"))
    x = rows.withColumn("suffix", X.generalise_affix(X.missing_suffix(F.col("original_value"), F.col("corrected_value")))).where("suffix <> ''")
    c = x.groupBy("template_id", "field_name", "suffix").agg(F.count("*").alias("frequency")).where("frequency >= 3")
    return c.join(total, "template_id").select("template_id", "field_name", "suffix", "frequency", F.round(F.col("frequency") / F.col("total"), 9).alias("confidence"))


@query(""" select field_config, string_agg(distinct case when is_active then pattern end, ',' order by case when is_active then pattern end) as active, count(distinct pattern) as patterns, max(usage_count) as samples from patterns group by all""")
def a51_statistics_by_field(r: Relations) -> DataFrame:
    """Patterns of each field in one row."""
    return r.patterns.groupBy("field_config").agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("is_active"), F.col("pattern")))), ",").alias("active"), F.countDistinct("pattern").alias("patterns"), F.max("usage_count").alias("samples"))


@query(""", s as (select document_id, string_agg(method, ' ' order by position) as labels from facts group by all), t as (select template_id, labels from s join docs_x using (document_id))
select template_id, count(*) as samples, count(distinct labels) / count(*) as diversity from t group by all""")
def a52_diversity(r: Relations) -> DataFrame:
    """Distinct label sequences over samples."""
    s = r.facts.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "method"))), lambda x: x["method"]), " ").alias("labels"))
    return s.join(r.documents, "document_id").groupBy("template_id").agg(F.count("*").alias("samples"), (F.countDistinct("labels") / F.count("*")).alias("diversity"))


@query(""", t as (select distinct value from facts where document_id % 5 <> 0 and value <> '')
select f.field_name, count(*) as n, count(t.value) as leaked, count(t.value) / count(*) as ratio, count(t.value) / count(*) > 0.1 as flagged from facts f left join t using (value) where document_id % 5 = 0 and f.value <> '' group by all""")
def a53_leakage(r: Relations) -> DataFrame:
    """Share of test values that training has; flagged over a tenth. Always computed."""
    train = r.facts.where("document_id % 5 <> 0 and value <> ''").select("value").distinct().withColumn("hit", F.lit(1))
    test = r.facts.where("document_id % 5 = 0 and value <> ''").join(train, "value", "left")
    x = test.groupBy("field_name").agg(F.count("*").alias("n"), F.count("hit").alias("leaked"))
    return x.withColumn("ratio", F.col("leaked") / F.col("n")).withColumn("flagged", F.col("ratio") > 0.1)


@query(""" select field_name, count(*) filter (contains(original_value, ' ')) as before, count(*) filter (contains(original_value, ' ') and not contains(corrected_value, ' ')) as removed,
count(*) filter (corrected_value like '% ' and original_value not like '% ') as added from feedback group by all""")
def a55_inconsistency(r: Relations) -> DataFrame:
    """How consistently corrections drop or add a mark."""
    o, c = F.col("original_value"), F.col("corrected_value")
    return r.feedback.groupBy("field_name").agg(F.count_if(o.contains(" ")).alias("before"), F.count_if(o.contains(" ") & ~c.contains(" ")).alias("removed"), F.count_if(c.endswith(" ") & ~o.endswith(" ")).alias("added"))


@query(r""", v as (select distinct field_name, p_brand as field_config, corrected_value as v from feedback join lines_x on l_orderkey = document_id and field_name = 'field_' || l_linenumber), p as (select distinct field_config, pattern from patterns where is_active)
select field_config, pattern, count(*) filter (regexp_matches(v, pattern)) as hits, count(*) as tried from p join v using (field_config) group by all""")
def j25_pattern_validation(r: Relations) -> DataFrame:
    """Each learned pattern against the distinct corrected values of its own field configuration, through the index of the literals that patterns require."""
    own = r.lines.select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("field_"), F.col("l_linenumber").cast("string")).alias("field_name"), F.col("p_brand").alias("field_config"))
    v = r.feedback.join(own, ["document_id", "field_name"]).select("field_name", "field_config", F.col("corrected_value").alias("v")).distinct()
    p = r.patterns.where("is_active").select("field_config", "pattern").distinct()
    counted = v.groupBy("field_config", "v").agg(F.count("*").alias("n"))
    met = pattern_matches(counted.select("field_config", "v"), pattern_index(p, "field_config"), "field_config", "v").join(counted, ["field_config", "v"])
    hits = met.groupBy("field_config", "pattern").agg(F.sum("n").alias("hits"))
    tried = counted.groupBy("field_config").agg(F.sum("n").alias("tried"))
    return p.join(tried, "field_config").join(hits, ["field_config", "pattern"], "left").select("field_config", "pattern", F.coalesce("hits", F.lit(0)).alias("hits"), "tried")


@query(r""", p as (select pattern_id, field_config, case pattern_id % 6 when 0 then '/' || pattern || '/gi' when 1 then 'r' || chr(39) || pattern || chr(39) when 2 then '"' || pattern || '"' when 3 then ' (' || pattern || ' ' when 4 then '' else pattern end as given from patterns where is_active)
select pattern_id, field_config, given, case pattern_id % 6 when 4 then null when 3 then null when 5 then trim(given) else '^' || substr(given, instr(given, '^') + 1, 4) end as pattern, pattern_id % 6 not in (3, 4) as valid from p""")
def f32_pattern_checks(r: Relations) -> DataFrame:
    """Patterns as people type them, between slashes, as literals or broken, out of their delimiters and checked (F32)."""
    k, p = F.col("pattern_id") % 6, F.col("pattern")
    q = F.lit("'")
    given = F.when(k == 0, F.concat(F.lit("/"), p, F.lit("/gi"))).when(k == 1, F.concat(F.lit("r"), q, p, q)).when(k == 2, F.concat(F.lit('"'), p, F.lit('"'))).when(k == 3, F.concat(F.lit(" ("), p, F.lit(" "))).when(k == 4, "").otherwise(p)
    typed = r.patterns.where("is_active").select("pattern_id", "field_config", given.alias("given")).withColumn("bare", X.sanitise_pattern(F.col("given")))
    looked = checked(typed, "bare").select(F.col("pattern").alias("bare"), F.col("error").isNull().alias("valid"))
    return typed.join(looked, "bare").select("pattern_id", "field_config", "given", F.when(F.col("valid"), F.col("bare")).alias("pattern"), "valid")


@query()
def f10_shape_regexes(r: Relations) -> DataFrame:
    """The five commonest shapes of each field as capturing regular expressions."""
    from fieldloom.operators.jobs import shape_pattern

    n = value_shapes(changed(r)).where("kind = 'shape'").groupBy("field_name", "item").agg(F.count("*").alias("n"))
    w = Window.partitionBy("field_name").orderBy(F.desc("n"), "item")
    top = n.withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    return top.select("field_name", F.col("item").alias("shape"), shape_pattern(F.col("item")).alias("regex"), "n")


@query(r""" select doc_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') as collapsed, regexp_replace(text, ' +', ' ', 'g') as blanks from documents""")
def f02_normalisers(r: Relations) -> DataFrame:
    """White-space normalisers over whole texts."""
    return r.table("documents").select("doc_id", X.ws_collapse(F.col("text")).alias("collapsed"), X.collapse_blanks(F.col("text")).alias("blanks"))


@query(f""" select feedback_id, {SHAPE_SQL.format("corrected_value")} as shape, len(list_filter(string_split_regex(trim(corrected_value), '\\s+'), lambda w: w <> '')) as tokens,
  case when original_value <> '' and starts_with(corrected_value, original_value) and length(corrected_value) > length(original_value) then trim(substr(corrected_value, length(original_value) + 1)) end as suffix from feedback""")
def f09_value_functions(r: Relations) -> DataFrame:
    """Shape (runs as one sign), tokens and missing suffix of corrected values."""
    c = F.col("corrected_value")
    return r.feedback.select("feedback_id", F.replace(X.token_shape(c), F.lit("+"), F.lit("")).alias("shape"), F.size(X.simple_tokens(c)).alias("tokens"), X.missing_suffix(F.col("original_value"), c).alias("suffix"))


@query(r""" select document_id, field_name, cast(regexp_extract(field_name, '_([0-9]+)$', 1) as integer) as row_number, regexp_matches(field_name, '(?i)_([0-9]+|[a-z])$') as tabular, 'field' as keyword,
  case when length(truth) < 10 then false else length(truth) - length(replace(truth, ' ', '')) < 0.05 * length(truth) or len(list_filter(string_split_regex(truth, '\s+'), lambda w: length(w) > 20)) > 0 end as normalise from facts""")
def f26_field_names(r: Relations) -> DataFrame:
    """What field names and values say: keywords, row, table or not, whether to segment."""
    n = F.col("field_name")
    return r.facts.select("document_id", "field_name", X.row_number_of(n).alias("row_number"), X.is_tabular(n).alias("tabular"), F.array_join(X.field_keywords(n), " ").alias("keyword"), X.should_normalise(F.col("truth")).alias("normalise"))


@query(r""" select document_id, field_name, case when len(list_distinct(list_filter(string_split_regex(lower(truth), '\s+'), lambda w: w <> ''))) = 0 then 0.0 else
  len(list_intersect(list_distinct(list_filter(string_split_regex(lower(value), '\s+'), lambda w: w <> '')), list_distinct(list_filter(string_split_regex(lower(truth), '\s+'), lambda w: w <> '')))) / len(list_distinct(list_filter(string_split_regex(lower(truth), '\s+'), lambda w: w <> ''))) end as overlap from facts""")
def f18_token_overlap(r: Relations) -> DataFrame:
    """Share of the true value's words that were extracted."""
    return r.facts.select("document_id", "field_name", X.token_overlap(F.col("value"), F.col("truth")).alias("overlap"))


@query(""", h as (select document_id, list(confidence order by confidence) as c from facts group by all)
select document_id, c[len(c) // 2 + 1] as middle from h""")
def f42_upper_median(r: Relations) -> DataFrame:
    """The element at half the length of the sorted confidences."""
    return r.facts.groupBy("document_id").agg(F.collect_list("confidence").alias("c")).select("document_id", X.upper_median(F.col("c")).alias("middle"))


@query(""" select job_id, cast(json_extract(payload, '$.k') as integer) as k from jobs where json_extract(payload, '$.k') is not null""")
def s08_json_parse(r: Relations) -> DataFrame:
    """JSON payloads parsed once; what doesn't parse is null and left out."""
    return r.jobs.select("job_id", F.from_json("payload", "k int")["k"].alias("k")).where("k is not null")
