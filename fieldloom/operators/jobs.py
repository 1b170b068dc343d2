"""What the learning loop's jobs compute: suggestions, mining, replay of corrections, and the status reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.text import token_shape
from fieldloom.operators.extraction import WORDS_SQL, Layout
from fieldloom.operators.metrics import PERF, changed, document_counts, strategy_performance
from fieldloom.operators.windows import BATCHES, Trail, w02_row_batches
from fieldloom.plans.registry import query
from fieldloom.sources.relations import Relations

DELIMITERS = (",", "-", "/", ":", ";", "|")
SUGGESTED = 2  # shapes and delimiters of a field that become patterns
LAST_JOBS = 10  # of a template that its status reports on
ALPHA, REACH = 0.3, 200  # of an exponential mean; values further back weigh under 1e-30


def shape_pattern(shape: Column) -> Column:
    """The regular expression of a token shape, as one group."""
    regex = F.regexp_replace(shape, r"([.()\[\]{}*?^$|\\/-])", r"\\$1")
    # Signs stand for the classes until all are in, as the classes hold letters and digits themselves.
    for part, sign in (("A\\+", "\u0001"), ("a\\+", "\u0002"), ("9\\+", "\u0003"), ("A", "\u0004"), ("a", "\u0005"), ("9", "\u0006")):
        regex = F.regexp_replace(regex, part, sign)
    for sign, part in (("\u0001", "[A-Z]{2,}"), ("\u0002", "[a-z]{2,}"), ("\u0003", "[0-9]{2,}"), ("\u0004", "[A-Z]"), ("\u0005", "[a-z]"), ("\u0006", "[0-9]")):
        regex = F.replace(regex, F.lit(sign), F.lit(part))
    return F.concat(F.lit("("), regex, F.lit(")"))


def regex_suggestions(values: DataFrame, least: int = 3) -> DataFrame:
    """``field_name``, ``type``, ``pattern``, ``frequency``, ``priority`` from ``values`` (``field_name``, ``value``).

    Fields with a capitalised word get a pattern of capitalised words: of the range of word counts where these
    vary, of their commonest where they don't (priority 10). The two commonest shapes become patterns of
    priority 5, the two commonest delimiters of priority 3; both from ``least`` values on. Ties go to the
    first in the alphabet.
    """
    v = values.where("trim(value) <> ''").select("field_name", F.trim("value").alias("value"))
    words = F.size(F.split("value", r"\s+"))
    shaped = v.select("field_name", "value", words.alias("words"), token_shape(F.col("value")).alias("shape"))
    counts = shaped.groupBy("field_name").agg(F.min("words").alias("low"), F.max("words").alias("high"), F.bool_or(F.col("value").rlike(r"(^|\s)[A-Z]")).alias("capital"), F.count_if(F.col("shape").contains("Aa+")).alias("frequency"))
    one, more = r"[A-Z][a-z]+", r"(?:\s+[A-Z][a-z]+)"
    span = F.when(F.col("high") == 1, F.lit(f"({one})")).when(F.col("low") == F.col("high"), F.concat(F.lit(f"({one}{more}{{"), F.col("low") - 1, F.lit("})")))
    span = span.otherwise(F.concat(F.lit(f"({one}{more}{{"), F.greatest(F.col("low") - 1, F.lit(0)), F.lit(","), F.col("high") - 1, F.lit("})")))
    kind = F.when(F.col("low") == F.col("high"), "specific").otherwise("flexible")
    flexible = counts.where("capital").select("field_name", kind.alias("type"), span.alias("pattern"), "frequency", F.lit(10).alias("priority"))

    def commonest(items: DataFrame, kind: str, pattern: Column, priority: int) -> DataFrame:
        w = Window.partitionBy("field_name").orderBy(F.desc("frequency"), "item")
        n = items.groupBy("field_name", "item").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)
        return n.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= SUGGESTED).select("field_name", F.lit(kind).alias("type"), pattern.alias("pattern"), "frequency", F.lit(priority).alias("priority"))

    marks = F.explode(F.filter(F.array(*map(F.lit, DELIMITERS)), lambda d: F.contains("value", d)))
    escaped = F.concat(F.lit("\\"), "item")
    parted = F.concat(F.lit("([^"), escaped, F.lit("]+(?:"), escaped, F.lit("[^"), escaped, F.lit("]+)*)"))
    shapes = commonest(shaped.select("field_name", F.col("shape").alias("item")), "shape", shape_pattern(F.col("item")), 5)
    return flexible.unionByName(shapes).unionByName(commonest(v.select("field_name", "value", marks.alias("item")), "delimiter", parted, 3))


@query()
def f11_suggestions(r: Relations) -> DataFrame:
    """Patterns that the corrected values of each field suggest."""
    return regex_suggestions(changed(r).select("field_name", F.col("corrected_value").alias("value")))


def merged_patterns(existing: DataFrame, found: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """Patterns of both sides by key: frequencies add up, the highest priority stays, the rate is weighted by frequency, examples are joined, the first ``most`` in the alphabet."""
    both = existing.unionByName(found)
    sums = both.groupBy(*keys).agg(F.sum("frequency").alias("frequency"), F.max("priority").alias("priority"), (F.sum(F.col("match_rate") * F.col("frequency")) / F.sum("frequency")).alias("match_rate"))
    w = Window.partitionBy(*keys).orderBy("example")
    first = both.select(*keys, "example").where("example is not null").distinct().withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    return sums.join(first.groupBy(*keys).agg(F.sort_array(F.collect_list("example")).alias("examples")), keys, "left")


@query(""", s as (select field_config, pattern_type, frequency, priority, match_rate, pattern as example from patterns),
m as (select field_config, pattern_type, cast(sum(frequency) as bigint) as frequency, max(priority) as priority, round(sum(match_rate * frequency) / sum(frequency), 9) as match_rate from s group by all),
e as (select field_config, pattern_type, example from (select distinct field_config, pattern_type, example from s) x qualify row_number() over (partition by field_config, pattern_type order by example) <= 10)
select m.*, x.examples from m join (select field_config, pattern_type, string_agg(example, ',' order by example) as examples from e group by all) x using (field_config, pattern_type)""")
def k04_pattern_merge(r: Relations) -> DataFrame:
    """Patterns merged by key, with at most ten of their examples."""
    p = r.patterns.select("field_config", "pattern_type", "frequency", "priority", "match_rate", F.col("pattern").alias("example"))
    odd = F.pmod(F.xxhash64("example"), F.lit(2)) == 0
    m = merged_patterns(p.where(odd), p.where(~odd), ["field_config", "pattern_type"])
    return m.select("field_config", "pattern_type", "frequency", "priority", F.round("match_rate", 9).alias("match_rate"), F.array_join("examples", ",").alias("examples"))


@query()
def e15_pattern_mining(r: Relations) -> DataFrame:
    """The mining job: suggestions from corrections, each tried on its field's values, those that match three tenths of them merged with what is known."""
    values = changed(r).select("field_name", F.col("corrected_value").alias("value"))
    found = regex_suggestions(values).distinct()
    tried = values.distinct().join(found, "field_name").groupBy("field_name", "pattern", "type", "frequency", "priority").agg(
        F.avg(F.expr("value rlike pattern").cast("int")).alias("match_rate"), F.min(F.when(F.expr("value rlike pattern"), F.col("value"))).alias("example"))
    columns = ["field_name", "pattern", "frequency", "priority", "match_rate", "example"]
    known = r.patterns.where("is_active").select(F.lit("field_1").alias("field_name"), "pattern", "frequency", F.col("priority").cast("int").alias("priority"), "match_rate", F.lit(None).cast("string").alias("example"))
    merged = merged_patterns(known, tried.where("match_rate >= 0.3").select(*columns), ["field_name", "pattern"])
    return merged.select("field_name", "pattern", "frequency", "priority", F.round("match_rate", 9).alias("match_rate"), F.array_join("examples", ",").alias("examples"))


@query(PERF + """, c as (select a.*, d.template_id, v.confidence, d.created_at from a join docs_x d using (document_id) join attempts v using (document_id, field_name, strategy) where v.success),
o as (select *, row_number() over (partition by template_id, strategy, field_name order by created_at desc, document_id desc) as back from c)
select template_id, strategy, field_name, count(*) as total, count(*) filter (correct) as correct, round(count(*) filter (correct) / count(*), 9) as accuracy, round(sum(0.3 * pow(0.7, back - 1) * confidence) filter (back <= 200), 9) as ema from o group by all""")
def e16_replay(r: Relations) -> DataFrame:
    """Corrections replayed in order of time through the attempts' scoring: counters, accuracy and the exponential mean of confidence per template, strategy and field."""
    counters = strategy_performance(r)
    keys = ["template_id", "strategy", "field_name"]
    tried = r.attempts.where("success").join(r.documents.select("document_id", "template_id", "created_at"), "document_id")
    w = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("document_id"))
    last = tried.withColumn("back", F.row_number().over(w)).where(F.col("back") <= REACH)
    ema = last.groupBy(*keys).agg(F.round(F.sum(ALPHA * F.pow(F.lit(1 - ALPHA), F.col("back") - 1) * F.col("confidence")), 9).alias("ema"))
    return counters.join(ema, keys).select(*keys, "total", "correct", F.round(F.col("correct") / F.col("total"), 9).alias("accuracy"), "ema")


@query(BATCHES + """, c as (select template_id, batch, case when fields > 0 then correct / fields else 0.0 end as accuracy from bt),
d as (select template_id, accuracy - lag(accuracy) over w as gain, lag(accuracy) over w as before from c window w as (partition by template_id order by batch)),
g as (select template_id, coalesce(avg(gain) filter (before > 0), 0.0) as improvement from d group by all),
f as (select template_id, field_name, count(*) as n from feedback join docs_x using (document_id) group by all),
t as (select template_id, field_name, n from f qualify row_number() over (partition by template_id order by n desc, field_name) <= 10),
k as (select template_id, string_agg(field_name || ':' || n, ',' order by n desc, field_name) as fields, (select sum(n) from f where f.template_id = t.template_id) as feedback from t group by all)
select g.template_id, round(improvement, 9) as improvement, round(improvement / feedback * 100, 12) as per_feedback, fields from g join k using (template_id)""")
def a15_hitl_efficiency(r: Relations) -> DataFrame:
    """What corrections brought: mean change of accuracy from batch to batch, that per correction, and the ten fields corrected most (the rest of A15)."""
    gains = Trail(w02_row_batches(r)).add(before=lambda w: F.lag("accuracy").over(w)).where("before > 0")
    gain = gains.groupBy("template_id").agg(F.avg(F.col("accuracy") - F.col("before")).alias("improvement"))
    n = r.feedback.join(r.documents.select("document_id", "template_id"), "document_id").groupBy("template_id", "field_name").agg(F.count("*").alias("n"))
    top = n.withColumn("rn", F.row_number().over(Window.partitionBy("template_id").orderBy(F.desc("n"), "field_name"))).where("rn <= 10")
    fields = top.groupBy("template_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "field_name", "n"))), lambda x: F.concat(x["field_name"], F.lit(":"), x["n"])), ",").alias("fields"))
    out = fields.join(n.groupBy("template_id").agg(F.sum("n").alias("feedback")), "template_id").join(gain, "template_id", "left").fillna(0.0, ["improvement"])
    return out.select("template_id", F.round("improvement", 9).alias("improvement"), F.round(F.col("improvement") / F.col("feedback") * 100, 12).alias("per_feedback"), "fields")


@query(f""", l as (select *, row_number() over (partition by template_id order by created_at desc, job_id desc) as rn from jobs qualify rn <= {LAST_JOBS}),
x as (select template_id, count(*) as total, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed,
  date_diff('day', cast(min(created_at) filter (status = 'completed') as date), cast(max(created_at) filter (status = 'completed') as date)) as days,
  coalesce(sum(cast(json_extract(payload, '$.k') as bigint)) filter (status = 'completed'), 0)::bigint as discovered, max(created_at) as newest from l group by all)
select template_id, total, completed, failed, case when completed >= 2 and days > 0 then days // completed end as every_days, discovered, newest from x""")
def a16_job_status(r: Relations) -> DataFrame:
    """The last ten jobs of each template: how they ended, every how many days one completed, what they found (the rest of A16)."""
    w = Window.partitionBy("template_id").orderBy(F.desc("created_at"), F.desc("job_id"))
    last = r.jobs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= LAST_JOBS)
    done = lambda c: F.when(F.col("status") == "completed", c)
    x = last.groupBy("template_id").agg(
        F.count("*").alias("total"), F.count(done(F.lit(1))).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.datediff(F.max(done(F.col("created_at"))).cast("date"), F.min(done(F.col("created_at"))).cast("date")).alias("days"),
        F.coalesce(F.sum(done(F.from_json("payload", "k long")["k"])), F.lit(0)).alias("discovered"), F.max("created_at").alias("newest"),
    )
    return x.select("template_id", "total", "completed", "failed", F.when((F.col("completed") >= 2) & (F.col("days") > 0), F.expr("days div completed")).alias("every_days"), "discovered", "newest")


@query(WORDS_SQL + """, k as (select * from words where regexp_matches(word, '^[A-Z]')), tops as (select distinct document_id, top from k),
s as (select *, case when top - lag(top) over w >= 20 then 1 else 0 end as opens from tops window w as (partition by document_id order by top)),
g as (select document_id, top, sum(opens) over (partition by document_id order by top) as grp from s)
select k.document_id, k.idx, cast(grp as bigint) as line_group, row_number() over (partition by k.document_id, grp order by k.top, k.idx) <= 5 as opens from k join g on g.document_id = k.document_id and g.top = k.top""")
def w17_line_groups(r: Relations) -> DataFrame:
    """Capitalised words in groups of lines: a new group where the next such line is 20 or more below; and whether a word is among its group's first five."""
    return line_groups(Layout(r).words.where(F.col("word").rlike("^[A-Z]"))).select("document_id", "idx", "line_group", (F.col("rank") <= 5).alias("opens"))


def line_groups(words: DataFrame, gap: int = 20) -> DataFrame:
    """``words`` with ``line_group`` (from 0) and ``rank`` in it by line, then index. Windows lie within a document."""
    w = Window.partitionBy("document_id").orderBy("top")
    lines = words.select("document_id", "top").distinct().withColumn("opens", F.when(F.col("top") - F.lag("top").over(w) >= gap, 1).otherwise(0))
    groups = lines.select("document_id", "top", F.sum("opens").over(w).alias("line_group"))
    rank = F.row_number().over(Window.partitionBy("document_id", "line_group").orderBy("top", "idx"))
    return words.join(groups, ["document_id", "top"]).withColumn("rank", rank)


@query(""", n as (select document_id, count(*) as fields from facts group by all), b as (select document_id, count(*) as corrections from feedback group by all),
a as (select template_id, phase, greatest(0, fields - coalesce(corrections, 0)) / fields as accuracy from docs_x join n using (document_id) left join b using (document_id) where phase is not null)
select template_id, phase, count(*) as documents, round(avg(accuracy), 9) as accuracy from a group by all""")
def e14_phase_report(r: Relations) -> DataFrame:
    """What a retraining run records: documents and mean accuracy of each template before and after (the evaluation part of E14)."""
    rows = document_counts(r).where("phase is not null and fields > 0")
    return rows.groupBy("template_id", "phase").agg(F.count("*").alias("documents"), F.round(F.avg("accuracy"), 9).alias("accuracy"))
