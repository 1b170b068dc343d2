"""Joins, filters, top-k, set operations and merges of the repositories, as Spark SQL over the relations.

The reports of this module are relational from end to end, so their text is plain SQL: relations are named
in braces and bound as DataFrames, and Catalyst plans them like any DataFrame. ``AS_OF`` stands for now.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import decisions as D
from fieldloom.plans.registry import query
from fieldloom.sources.relations import Relations

AS_OF = "2020-01-15 00:00:00"
#: Relation -> its name in the SQL of checks.
NAMES = {"lines": "lines_x", "templates": "templates_x", "documents": "docs_x", "facts": "facts", "feedback": "feedback", "attempts": "attempts", "patterns": "patterns", "jobs": "jobs"}


def relational(name: str, about: str, text: str) -> None:
    """Register a report given by SQL over relations in braces."""
    used = set(re.findall(r"\{(\w+)\}", text))

    def run(r: Relations) -> DataFrame:
        return r.spark.sql(text, **{x: getattr(r, x) for x in used})

    run.__name__, run.__doc__ = name, about
    body = text.format(**{x: NAMES[x] for x in used}).strip()
    query(f", {body[5:]}" if body.startswith("with ") else f" {body}")(run)


relational("j01_feedback_of_template", "Feedback with its template.", """
select f.feedback_id, d.template_id, f.field_name from {feedback} f join {documents} d on d.document_id = f.document_id where d.template_id = 1""")
relational("j02_documents_with_template", "All documents with their template's name.", """
select d.document_id, t.name from {documents} d left join {templates} t on t.template_id = d.template_id""")
relational("j03_documents_without_feedback", "Documents nobody corrected.", """
select d.document_id, d.status from {documents} d anti join {feedback} f on f.document_id = d.document_id""")
relational("j04_validated_without_field_feedback", "Validated documents without feedback on one field; null-aware, as ids are never null.", """
select document_id from {documents} where status = 'validated' and document_id not in (select document_id from {feedback} where field_name = 'field_1')""")
relational("j05_pattern_star", "Active patterns with the configuration of their field and the template it belongs to: a star of three relations.", """
with c as (select distinct p_brand as field_config, d.template_id from {lines} l join {documents} d on d.document_id = l.l_orderkey)
select p.pattern_id, p.field_config, t.template_id, t.name from {patterns} p join c on c.field_config = p.field_config join {templates} t on t.template_id = c.template_id where p.is_active""")
relational("j06_active_star", "Templates with documents and distinct corrected documents; the predicate belongs to the join, so templates without stay.", """
select t.template_id, t.name, count(distinct d.document_id) as documents, count(distinct f.document_id) as corrected, count(f.feedback_id) as feedback
from {templates} t left join {documents} d on d.template_id = t.template_id and d.status = 'validated'
left join {feedback} f on f.document_id = d.document_id and f.used group by t.template_id, t.name""")
relational("j07_pattern_performance", "Success rates of active patterns in percent.", """
select pattern_id, field_config, case when usage_count > 0 then round(100.0 * success_count / usage_count, 2) else 0.0 end as success_rate from {patterns} where is_active""")
relational("j08_latest_feedback", "Each document's latest feedback, by the largest id, for all documents.", """
with l as (select document_id, max(feedback_id) as latest from {feedback} group by document_id)
select d.document_id, l.latest, f.field_name from {documents} d left join l on l.document_id = d.document_id left join {feedback} f on f.feedback_id = l.latest""")
relational("j09_top_one_per_document", "The most confident field of each document.", """
with k as (select document_id, field_name, confidence, row_number() over (partition by document_id order by confidence desc, position) as rn from {facts})
select d.document_id, k.field_name, k.confidence from {documents} d left join k on k.document_id = d.document_id and k.rn = 1""")
relational("j10_newer_than_last_job", "Unused feedback newer than its template's last completed job, or than 2000 where there is none.", """
with l as (select template_id, max(created_at) as done from {jobs} where status = 'completed' and type = 'purchase' group by template_id)
select d.template_id, count(*) as fresh from {feedback} f join {documents} d on d.document_id = f.document_id left join l on l.template_id = d.template_id
where not f.used and f.created_at > coalesce(l.done, timestamp '2000-01-01 00:00:00') group by d.template_id""")
relational("j11_fields_to_learn", "Fields with at least five unused corrections since the last used one.", """
with l as (select field_name, max(created_at) as done from {feedback} where used group by field_name)
select f.field_name, count(*) as n from {feedback} f left join l on l.field_name = f.field_name
where not f.used and f.created_at > coalesce(l.done, timestamp '2000-01-01 00:00:00') group by f.field_name having count(*) >= 5""")
relational("j12_latest_by_subquery", "The newest document of each template.", """
select document_id, template_id, status from {documents} where document_id in (select max(document_id) from {documents} group by template_id)""")
relational("j13_nested_in", "Feedback on fields whose name is among those of one template's validated documents.", """
with n as (select distinct f.field_name from {facts} f join {documents} d on d.document_id = f.document_id where d.template_id = 2 and d.status = 'validated')
select f.field_name, count(*) as n from {feedback} f where f.field_name in (select field_name from n) group by f.field_name""")
relational("j14_typical_length", "Typical corrected length per template and field, from five values on; the template is part of the key.", """
select d.template_id, f.field_name, cast(floor(avg(length(f.corrected_value))) as bigint) as typical from {feedback} f join {documents} d on d.document_id = f.document_id
group by d.template_id, f.field_name having count(*) >= 5""")
relational("j15_feedback_counts", "Feedback per document, zero where there is none.", """
with b as (select document_id, count(*) as n from {feedback} group by document_id)
select d.document_id, coalesce(b.n, 0) as n from {documents} d left join b on b.document_id = d.document_id""")
relational("j16_fields_with_feedback", "Fields that have feedback, by key and not by nested loops.", """
select f.document_id, f.field_name, f.method from {facts} f semi join {feedback} b on b.document_id = f.document_id and b.field_name = f.field_name""")
relational("j17_extracted_and_true", "Extracted and corrected fields side by side, whichever has them.", """
select coalesce(f.document_id, b.document_id) as document_id, coalesce(f.field_name, b.field_name) as field_name, coalesce(f.value, '') as extracted, coalesce(b.corrected_value, '') as truth
from {facts} f full join {feedback} b on b.document_id = f.document_id and b.field_name = f.field_name""")
relational("j18_overlay", "Corrections over extracted values, fields known only from feedback included.", """
select coalesce(f.document_id, b.document_id) as document_id, coalesce(f.field_name, b.field_name) as field_name, coalesce(b.corrected_value, f.value) as value
from {facts} f full join {feedback} b on b.document_id = f.document_id and b.field_name = f.field_name""")
relational("j26_exact_leakage", "Test documents' values that training documents have too, and the first training document; a hash join on content.", """
with t as (select lower(trim(value)) as v, min(document_id) as first_train from {facts} where document_id % 5 <> 0 and value <> '' group by lower(trim(value)))
select f.document_id, f.field_name, t.first_train from {facts} f join t on t.v = lower(trim(f.value)) where f.document_id % 5 = 0""")
relational("j28_phase_join", "Baseline against adaptive documents of each template.", """
with p as (select template_id, phase, count(*) as n, avg(extraction_time_ms) as t from {documents} where phase is not null group by template_id, phase)
select b.template_id, b.n as baseline, a.n as adaptive, a.t - b.t as slower from p b join p a on a.template_id = b.template_id where b.phase = 'baseline' and a.phase = 'adaptive'""")
relational("p01_phase_filter", "The three kinds of phase filter: none given (phase is null), all, one.", """
select 'production' as filter, count(*) as n from {documents} where phase is null union all select 'all', count(*) from {documents} union all select 'baseline', count(*) from {documents} where phase = 'baseline'""")
relational("p02_visibility", "Documents that a plain user sees.", """
select document_id, template_id from {documents} where (0 = 1 or created_by = 7)""")
relational("p03_validated_unused", "Validated documents with feedback that training hasn't used.", """
select d.document_id from {documents} d semi join (select document_id from {feedback} where not used) f on f.document_id = d.document_id where d.status = 'validated'""")
relational("p05_substring_search", "Case-blind substring search.", """
select field_config, count(*) as n from {patterns} where lower(pattern_type) like lower('%StEeL%') or lower(pattern) like '%e%' group by field_config""")
relational("p15_usage_update", "Match rate and boost after one more hit for even ids and one more miss for odd ones.", """
with u as (select pattern_id, boost, pattern_id % 2 = 0 as hit, (success_count + case when pattern_id % 2 = 0 then 1 else 0 end) / cast(usage_count + 1 as double) as rate from {patterns})
select pattern_id, rate, case when hit then case when rate >= 0.9 then 0.2 when rate >= 0.7 then 0.1 else 0.0 end when rate < 0.3 then -0.1 else boost end as boost from u""")
relational("p20_problematic_fields", "Fields whose best strategy is right less than half of the time.", """
with s as (select a.field_name, a.strategy, avg(case when a.value = f.truth then cast(1 as double) else cast(0 as double) end) as acc from {attempts} a join {facts} f on f.document_id = a.document_id and f.field_name = a.field_name where a.success group by a.field_name, a.strategy)
select field_name, round(max(acc), 9) as best from s group by field_name having max(acc) < 0.5""")
relational("p22_changed_only", "Corrections of known fields that differ after stripping.", """
select b.feedback_id from {feedback} b join {facts} f on f.document_id = b.document_id and f.field_name = b.field_name where trim(b.original_value) <> trim(b.corrected_value)""")
relational("p24_low_performers", "Active patterns used often enough and right too rarely.", """
select pattern_id, success_count / cast(usage_count as double) as rate from {patterns} where usage_count >= 10 and success_count / cast(usage_count as double) < 0.3 and is_active""")
relational("p26_stale_jobs", "Jobs that run for over half an hour, against a given now.", f"""
select job_id, template_id from {{jobs}} where status = 'running' and created_at < timestamp '{AS_OF}' - interval '30' minute""")
relational("t01_recent_feedback", "The ten most recent corrections.", """
select feedback_id, document_id, field_name from {feedback} order by created_at desc, feedback_id desc limit 10""")
relational("t04_top_and_bottom", "Best and worst three fields of each method by confidence.", """
with f as (select method, field_name, avg(confidence) as c from {facts} group by method, field_name),
     k as (select method, field_name, row_number() over (partition by method order by round(c, 9) desc, field_name) as top, row_number() over (partition by method order by round(c, 9), field_name) as low from f)
select method, field_name, top, low from k where top <= 3 or low <= 3""")
relational("t05_pattern_order", "Patterns by priority, then frequency.", """
select pattern_id, priority, frequency from {patterns} where is_active order by priority desc, frequency desc, pattern_id limit 50""")
relational("t07_worst_fields", "The five least confident fields.", """
select field_name, round(avg(confidence), 9) as confidence from {facts} group by field_name order by 2, 1 limit 5""")
relational("t08_largest_gains", "The three documents whose values grew most.", """
select document_id, sum(length(corrected_value) - length(original_value)) as gain from {feedback} group by document_id order by 2 desc, 1 limit 3""")
relational("t10_next_job", "The pending job that waits longest, of each template.", """
with k as (select *, row_number() over (partition by template_id order by created_at, job_id) as rn from {jobs} where status = 'pending') select template_id, job_id from k where rn = 1""")
relational("t13_page", "One page of a listing.", """
select document_id, created_at from {documents} where template_id = 3 order by created_at, document_id limit 20 offset 40""")
relational("u01_union_all", "Corrected values and validated values in one column.", """
select field_name, corrected_value as value, 'corrected' as origin from {feedback} union all
select f.field_name, f.value, 'validated' from {facts} f join {documents} d on d.document_id = f.document_id where d.status = 'validated' and d.template_id = 1""")
relational("u02_key_union", "Keys that either side has.", """
select document_id, field_name from {facts} union select document_id, field_name from {feedback}""")
relational("u03_not_corrected", "Fields of corrected documents that were left alone.", """
select f.document_id, f.field_name from {facts} f semi join {feedback} d on d.document_id = f.document_id anti join {feedback} b on b.document_id = f.document_id and b.field_name = f.field_name""")
relational("u05_distinct_values", "Distinct values per field.", """
select field_name, count(distinct value) as n from {facts} group by field_name""")
relational("u06_pseudo_labels", "Feedback, and confident values of documents without any until a template has 2200 samples, in a fixed order.", """
with b as (select d.template_id, count(*) as n from {feedback} f join {documents} d on d.document_id = f.document_id group by d.template_id),
     p as (select d.template_id, f.document_id, f.field_name from {facts} f join {documents} d on d.document_id = f.document_id anti join {feedback} b on b.document_id = f.document_id where f.confidence >= 0.8),
     k as (select template_id, rn from (select template_id, row_number() over (partition by template_id order by document_id, field_name) as rn from p) x where rn <= 2200)
select template_id, 'feedback' as origin, n from b
union all select k.template_id, 'pseudo', count(*) from k left join b on b.template_id = k.template_id where k.rn <= 2200 - coalesce(b.n, 0) group by k.template_id""")
relational("u07_training_union", "Documents with feedback and confident validated ones without.", """
select document_id, 'feedback' as origin from {feedback} group by document_id
union all select d.document_id, 'validated' from {documents} d anti join {feedback} b on b.document_id = d.document_id
semi join (select document_id from {facts} where confidence >= 0.3) f on f.document_id = d.document_id where d.status = 'validated'""")
relational("k02_feedback_upsert", "Latest feedback per document and field; an update is unused again.", """
with s as (select feedback_id, document_id, field_name, corrected_value, 0 as gen from {feedback} union all
           select feedback_id, document_id, field_name, corrected_value || '!', 1 from {feedback} where feedback_id % 3 = 0),
     k as (select *, row_number() over (partition by document_id, field_name order by gen desc, feedback_id desc) as rn from s)
select document_id, field_name, corrected_value, gen = 0 as untouched from k where rn = 1""")
relational("k05_statistic_merge", "Statistics merged by key, the latest confidence stays.", """
select field_config, pattern, cast(sum(frequency) as bigint) as frequency, max(usage_count) as samples, max_by(match_rate, pattern_id) as confidence from {patterns} group by field_config, pattern""")
relational("k07_dead_letters", "Failed jobs as they are copied to the dead letters.", """
select job_id, template_id, type, payload, created_at as failed_at from {jobs} where status = 'failed'""")
relational("k08_cascading_delete", "What is left of facts and feedback after a template is deleted.", """
select 'facts' as relation, count(*) as n from {facts} f anti join (select document_id from {documents} where template_id = 2) d on d.document_id = f.document_id
union all select 'feedback', count(*) from {feedback} f anti join (select document_id from {documents} where template_id = 2) d on d.document_id = f.document_id""")
relational("k09_mark_used", "Feedback after that of one template's documents was used for training.", """
with u as (select document_id from {documents} where template_id = 4) select f.feedback_id, f.used or u.document_id is not null as used from {feedback} f left join u on u.document_id = f.document_id""")
relational("k13_versions", "Versions of a field's patterns; only the newest is active.", """
select pattern_id, field_config, row_number() over (partition by field_config order by pattern_id) as version, row_number() over (partition by field_config order by pattern_id desc) = 1 as is_active from {patterns}""")
relational("r02_field_trigger", "Fields whose unused corrections reached five, with what the trigger asks for.", """
with c as (select d.template_id, f.field_name, count(*) as total, count(case when not f.used then 1 end) as unused from {feedback} f join {documents} d on d.document_id = f.document_id group by d.template_id, f.field_name)
select template_id, field_name, case when unused < 5 then 'none' when total % 20 < unused then 'full' else 'incremental' end as action from c""")
relational("r04_active_jobs", "Failed jobs to add again: those of keys whose newest job is neither pending nor running.", """
with k as (select template_id, field_id, status, row_number() over (partition by template_id, field_id order by created_at desc, job_id desc) as rn from {jobs}),
     a as (select template_id, field_id from k where rn = 1 and status in ('pending', 'running'))
select j.template_id, j.field_id, count(*) as n from {jobs} j anti join a on a.template_id = j.template_id and a.field_id = j.field_id where j.status = 'failed' group by j.template_id, j.field_id""")


COMPARE = {"=": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v}


def dynamic_filter(df: DataFrame, filters: dict[str, tuple[str, object]], allowed: set[str]) -> DataFrame:
    """All filters that name an allowed column and have a value; an unknown operator means equality."""
    tests: list[Column] = [COMPARE.get(op, COMPARE["="])(F.col(name), value) for name, (op, value) in filters.items() if name in allowed and value not in (None, "")]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def page(df: DataFrame, number: int, size: int, by: list[Column]) -> tuple[DataFrame, int]:
    """A page of the ordered rows (numbers from 1) and the number of pages."""
    return df.orderBy(*by).offset((number - 1) * size).limit(size), -(-df.count() // size)


def parameterised(spark: SparkSession, text: str, args: dict | list | None = None, **relations: DataFrame) -> DataFrame:
    """SQL text with bound arguments over the given relations; values never become part of the text."""
    return spark.sql(text, args, **relations)


@query(" select document_id, status from docs_x where status = 'validated' and extraction_time_ms >= 4000")
def p04_dynamic_filters(r: Relations) -> DataFrame:
    """Conjunction of whitelisted filters."""
    given = {"status": ("=", "validated"), "extraction_time_ms": (">=", 4000), "secret": ("=", 1), "phase": ("=", "")}
    return dynamic_filter(r.documents, given, {"status", "extraction_time_ms", "phase"}).select("document_id", "status")


@query(" select field_name, count(*) as n from feedback where used group by all having count(*) > 10")
def s01_parameterised_sql(r: Relations) -> DataFrame:
    """A bound query over a relation."""
    return parameterised(r.spark, "select field_name, count(*) as n from {feedback} where used = :used group by field_name having count(*) > :least", {"used": True, "least": 10}, feedback=r.feedback)


@query(" select status, count(*) as n from docs_x where template_id = 1 group by all")
def s03_filtered_count(r: Relations) -> DataFrame:
    """Counts under the same predicates as a page, without its join."""
    return dynamic_filter(r.documents, {"template_id": ("=", 1)}, {"template_id"}).groupBy("status").agg(F.count("*").alias("n"))


@query(""" select pattern_id, case when idle_days > 30 then 'delete' when usage_count < 10 then 'keep' when boost < -0.2 then 'deactivate' when success_count / usage_count < 0.3 then 'deactivate' else 'keep' end as decision,
concat_ws(', ', case when idle_days > 30 then 'unused' end, case when usage_count >= 10 and success_count / usage_count < 0.3 then 'low success' end, case when boost < -0.2 then 'negative boost' end) as reason from patterns""")
def p13_pattern_lifecycle(r: Relations) -> DataFrame:
    """What cleanup does with each pattern and why."""
    args = [F.col(c) for c in ("idle_days", "usage_count", "success_count", "boost")]
    return r.patterns.select("pattern_id", D.pattern_decision(*args).alias("decision"), D.decision_reason(*args).alias("reason"))


@query(""", s as (select document_id, list(confidence order by position) as c, list(method order by position) as m from facts group by all)
select document_id, coalesce(round(list_avg(c), 9) < 0.5 or list_min(c) < 0.1 or (len(list_distinct(m)) = 1 and m[1] = 'rule_based'), true) as needed from s""")
def p12_needs_validation(r: Relations) -> DataFrame:
    """Documents that a person should look at; a document is bounded by its fields."""
    s = r.facts.groupBy("document_id").agg(F.collect_list("confidence").alias("c"), F.collect_set("method").alias("m"))
    mean = F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x) / F.size("c"), 9)
    only = (F.size("m") == 1) & F.array_contains("m", "rule_based")
    return s.select("document_id", ((mean < 0.5) | F.exists("c", lambda x: x < 0.1) | only).alias("needed"))


@query(""", x as (select template_id, count(*) as n, count(distinct field_name) / count(*) as v from feedback join docs_x using (document_id) group by all),
t as (select distinct template_id, value from facts join docs_x using (document_id) where document_id % 5 <> 0 and value <> ''),
k as (select d.template_id, count(t.value) / count(*) > 0.1 as leak from facts f join docs_x d using (document_id) left join t on t.template_id = d.template_id and t.value = f.value where f.document_id % 5 = 0 and f.value <> '' group by all)
select template_id, concat_ws('; ', case when n < 20 then 'collect more samples' when n < 50 then 'more samples help' when n < 100 then 'enough samples' end,
  case when v < 0.3 then 'very low diversity' when v < 0.5 then 'low diversity' when v < 0.7 then 'moderate diversity' end, case when leak then 'remove leaked samples' end) as advice from x left join k using (template_id)""")
def p18_recommendations(r: Relations) -> DataFrame:
    """Advice on each template's training set: its size, its diversity, and whether over a tenth of the test values are among its own training values."""
    templates = r.documents.select("document_id", "template_id")
    x = r.feedback.join(templates, "document_id").groupBy("template_id").agg(F.count("*").alias("n"), (F.countDistinct("field_name") / F.count("*")).alias("v"))
    values = r.facts.where("value <> ''").join(templates, "document_id")
    train = values.where("document_id % 5 <> 0").select("template_id", "value").distinct().withColumn("hit", F.lit(1))
    leak = values.where("document_id % 5 = 0").join(train, ["template_id", "value"], "left").groupBy("template_id").agg((F.count("hit") / F.count("*") > 0.1).alias("leak"))
    return x.join(leak, "template_id", "left").select("template_id", F.array_join(D.recommendations(F.col("n"), F.col("v"), F.coalesce("leak", F.lit(False))), "; ").alias("advice"))


@query(""", x as (select template_id, count(*) as total, count(*) filter (not used) as unused from feedback join docs_x using (document_id) group by all)
select template_id, case when unused < 5 then 'none' when total % 20 < unused then 'full' else 'incremental' end as action from x""")
def p25_training_trigger(r: Relations) -> DataFrame:
    """Whether each template is due for training, and how."""
    x = r.feedback.join(r.documents.select("document_id", "template_id"), "document_id").groupBy("template_id").agg(F.count("*").alias("total"), F.count_if(~F.col("used")).alias("unused"))
    return x.select("template_id", D.training_trigger(F.col("unused"), F.col("total")).alias("action"))


@query(""", x as (select strategy, field_name, count(*) as n, count(*) filter (success) / count(*) as acc from attempts group by all)
select strategy, field_name, greatest(case when acc >= 0.7 and n >= 10 then 0.3 when acc >= 0.5 and n >= 5 then 0.4 else 0.5 end, 0.3) as threshold,
  case when n >= 10 then 0.8 when n >= 5 then 0.7 else 0.4 end as weight from x""")
def p08_thresholds(r: Relations) -> DataFrame:
    """Confidence threshold and performance weight by history."""
    x = r.attempts.groupBy("strategy", "field_name").agg(F.count("*").alias("n"), (F.count_if("success") / F.count("*")).alias("acc"))
    return x.select("strategy", "field_name", D.confidence_threshold(F.col("acc"), F.col("n")).alias("threshold"), D.scoring_weights(F.col("n"))["performance"].alias("weight"))


WIDE = ", ".join(f"max(case when field_name = 'field_{k}' then v end) as field_{k}" for k in range(1, 8))


@query(f""", o as (select f.document_id, f.field_name, coalesce(b.corrected_value, f.value) as v from facts f left join feedback b using (document_id, field_name))
select document_id, {WIDE} from o group by all""")
def k12_wide_export(r: Relations) -> DataFrame:
    """A row per document and a column per field in a given order; corrections override. The listed fields spare a pass that finds them."""
    keys = ["document_id", "field_name"]
    o = r.facts.select(*keys, "value").join(r.feedback.select(*keys, "corrected_value"), keys, "left").withColumn("v", F.coalesce("corrected_value", "value"))
    return o.groupBy("document_id").pivot("field_name", [f"field_{k}" for k in range(1, 8)]).agg(F.first("v"))
