"""Quality metrics over documents, field facts and feedback. Each accuracy keeps its own definition and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import decisions as D
from fieldloom.functions.text import f1, safe_div, strict_norm, without_fallback, ws_collapse
from fieldloom.plans.registry import query
from fieldloom.sources.relations import Relations

COUNTS = """n as (select document_id, count(*) as fields from facts group by all),
b as (select document_id, count(*) as corrections from feedback group by all),
acc as (select d.*, coalesce(fields, 0) as fields, coalesce(corrections, 0) as corrections,
        case when coalesce(fields, 0) > 0 then greatest(0, fields - coalesce(corrections, 0)) / fields end as accuracy
        from docs_x d left join n using (document_id) left join b using (document_id))"""


def document_counts(r: Relations) -> DataFrame:
    """Documents with their fields, corrections and per-document accuracy. Both sides are summed before the joins."""
    fields = r.facts.groupBy("document_id").agg(F.count("*").alias("fields"))
    corrections = r.feedback.groupBy("document_id").agg(F.count("*").alias("corrections"))
    out = r.documents.join(fields, "document_id", "left").join(corrections, "document_id", "left").fillna(0, ["fields", "corrections"])
    kept = F.greatest(F.lit(0), F.col("fields") - F.col("corrections"))
    return out.withColumn("accuracy", F.when(F.col("fields") > 0, kept / F.col("fields")))


def changed(r: Relations, norm=strict_norm) -> DataFrame:
    """Feedback whose corrected value really differs under ``norm``."""
    return r.feedback.where(norm(F.col("original_value")) != norm(F.col("corrected_value")))


@query(f""", {COUNTS}
select template_id, count(*) as documents, count(*) filter (status = 'validated') as validated, cast(sum(corrections) as bigint) as corrections,
       round(coalesce(avg(accuracy) filter (corrections > 0), 0.0), 9) as accuracy, count(*) filter (status = 'validated') / count(*) as validation_rate
from acc group by template_id""")
def a01_overview(r: Relations) -> DataFrame:
    """Documents, validated ones, corrections, and accuracy averaged over documents that have feedback."""
    return document_counts(r).groupBy("template_id").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("status") == "validated").alias("validated"),
        F.sum("corrections").alias("corrections"),
        F.round(F.coalesce(F.avg(F.when(F.col("corrections") > 0, F.col("accuracy"))), F.lit(0.0)), 9).alias("accuracy"),
        (F.count_if(F.col("status") == "validated") / F.count("*")).alias("validation_rate"),
    )


@query(""", v as (select field_name, count(*) filter (value <> '') as total, round(avg(confidence), 9) as confidence, count(*) filter (method = 'crf') as crf,
                        count(*) filter (method = 'rule_based') as rule_based, count(*) filter (method = 'position_based') as position_based from facts group by all),
c as (select field_name, count(*) as corrections from feedback where trim(original_value) <> trim(corrected_value) group by all)
select coalesce(v.field_name, c.field_name) as field_name, coalesce(total, 0) as total, coalesce(corrections, 0) as corrections,
       case when coalesce(total, 0) > 0 then (total - coalesce(corrections, 0)) / total else 0.0 end as accuracy, confidence, crf, rule_based, position_based
from v full join c on v.field_name = c.field_name""")
def a02_field_performance(r: Relations) -> DataFrame:
    """Per field: non-empty values, real corrections, unclamped accuracy, mean confidence and values by method."""
    m = lambda x: F.count_if(F.col("method") == x).alias(x)
    v = r.facts.groupBy("field_name").agg(F.count_if(F.col("value") != "").alias("total"), F.round(F.avg("confidence"), 9).alias("confidence"), m("crf"), m("rule_based"), m("position_based"))
    c = changed(r).groupBy("field_name").agg(F.count("*").alias("corrections"))
    out = v.join(c, "field_name", "full").fillna(0, ["total", "corrections"])
    accuracy = F.when(F.col("total") > 0, (F.col("total") - F.col("corrections")) / F.col("total")).otherwise(0.0)
    return out.select("field_name", "total", "corrections", accuracy.alias("accuracy"), "confidence", "crf", "rule_based", "position_based")


@query(""", v as (select field_name, count(*) filter (trim(value) <> '') as filled, count(*) filter (trim(value) = '') as fn from facts group by all),
c as (select field_name, count(*) as fp from feedback where trim(regexp_replace(original_value, '\\s+', ' ', 'g')) <> trim(regexp_replace(corrected_value, '\\s+', ' ', 'g')) group by all),
x as (select field_name, greatest(filled - coalesce(fp, 0), 0) as tp, coalesce(fp, 0) as fp, fn from v left join c using (field_name)),
m as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as recall from x)
select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1, tp + fn as support from m""")
def a03_field_prf(r: Relations) -> DataFrame:
    """Precision, recall and F1 per field, with white-space changes ignored."""
    v = r.facts.groupBy("field_name").agg(F.count_if(strict_norm(F.col("value")) != "").alias("filled"), F.count_if(strict_norm(F.col("value")) == "").alias("fn"))
    c = changed(r, ws_collapse).groupBy("field_name").agg(F.count("*").alias("fp"))
    out = v.join(c, "field_name", "left").fillna(0, ["fp"]).withColumn("tp", F.greatest(F.col("filled") - F.col("fp"), F.lit(0))).drop("filled")
    out = out.withColumn("precision", safe_div(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe_div(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall"))).withColumn("support", F.col("tp") + F.col("fn"))


@query(", x as (select method, count(*) as n from facts group by all) select method, n, n / sum(n) over () as share from x")
def a04_strategy_distribution(r: Relations) -> DataFrame:
    """Values by method and their share."""
    x = r.facts.groupBy("method").agg(F.count("*").alias("n"))
    return x.withColumn("all", x.agg(F.sum("n")).scalar()).select("method", "n", (F.col("n") / F.col("all")).alias("share"))


PERF = """, a as (select a.document_id, a.field_name, a.strategy, a.value = coalesce(f.corrected_value, v.value) as correct
  from attempts a join facts v on v.document_id = a.document_id and v.field_name = a.field_name
  left join feedback f on f.document_id = a.document_id and f.field_name = a.field_name where a.success),
perf as (select template_id, strategy, field_name, count(*) as total, count(*) filter (correct) as correct from a join docs_x using (document_id) group by all)"""


def strategy_performance(r: Relations) -> DataFrame:
    """Successful attempts and right ones per template, strategy and field, derived from facts: counters can't drift."""
    truth = r.facts.select("document_id", "field_name", F.col("value").alias("extracted")).join(r.feedback.select("document_id", "field_name", "corrected_value"), ["document_id", "field_name"], "left")
    tried = r.attempts.where("success").join(truth, ["document_id", "field_name"])
    right = F.col("value") == F.coalesce("corrected_value", "extracted")
    by = tried.join(r.documents.select("document_id", "template_id"), "document_id").groupBy("template_id", "strategy", "field_name")
    return by.agg(F.count("*").alias("total"), F.count_if(right).alias("correct"))


@query(PERF + " select template_id, strategy, cast(sum(total) as bigint) as total, cast(sum(correct) as bigint) as correct, sum(correct) / sum(total) as accuracy from perf group by all")
def a05_strategy_rollup(r: Relations) -> DataFrame:
    """Strategy counters over all fields of a template."""
    out = strategy_performance(r).groupBy("template_id", "strategy").agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"))
    return out.withColumn("accuracy", F.col("correct") / F.col("total"))


@query(f", {COUNTS} select document_id, template_id, created_at, coalesce(accuracy, 1.0) as accuracy, corrections from acc")
def a06_accuracy_timeline(r: Relations) -> DataFrame:
    """Accuracy of each document over time; one without feedback counts as right."""
    return document_counts(r).select("document_id", "template_id", "created_at", F.coalesce("accuracy", F.lit(1.0)).alias("accuracy"), "corrections")


@query(" select field_name, count(*) as n, count(distinct document_id) as documents, max(created_at) as latest from feedback group by all")
def a07_feedback_stats(r: Relations) -> DataFrame:
    """Feedback by field."""
    return r.feedback.groupBy("field_name").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"), F.max("created_at").alias("latest"))


@query(""", x as (select field_name, count(*) as n from feedback group by all), y as (select *, n / sum(n) over () as share from x)
select * from y where share > 0.1 order by n desc, field_name limit 5""")
def a09_problematic_fields(r: Relations) -> DataFrame:
    """The five fields with over a tenth of all feedback."""
    x = r.feedback.groupBy("field_name").agg(F.count("*").alias("n"))
    y = x.withColumn("all", x.agg(F.sum("n")).scalar()).select("field_name", "n", (F.col("n") / F.col("all")).alias("share"))
    return y.where("share > 0.1").orderBy(F.desc("n"), "field_name").limit(5)


@query(" select method, round(avg(confidence), 9) as mean, min(confidence) as low, max(confidence) as high, count(*) as n from facts group by all")
def a10_confidence_by_strategy(r: Relations) -> DataFrame:
    """Confidence statistics by method."""
    return r.facts.groupBy("method").agg(F.round(F.avg("confidence"), 9).alias("mean"), F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.count("*").alias("n"))


@query(", x as (select document_id, avg(confidence) as c from facts group by all) select template_id, round(avg(c), 9) as confidence from x join docs_x using (document_id) group by all")
def a10_overall_confidence(r: Relations) -> DataFrame:
    """Mean of the documents' mean confidences."""
    per = r.facts.groupBy("document_id").agg(F.avg("confidence").alias("c"))
    return per.join(r.documents, "document_id").groupBy("template_id").agg(F.round(F.avg("c"), 9).alias("confidence"))


@query(""", c as (select *, row_number() over (partition by field_name order by feedback_id) as rn, count(*) over (partition by field_name) as n from feedback
  where trim(regexp_replace(original_value, '\\s+', ' ', 'g')) <> trim(regexp_replace(corrected_value, '\\s+', ' ', 'g'))),
t as (select field_name, max(n) as n from c group by all order by n desc, field_name limit 10)
select field_name, t.n, string_agg(substr(original_value, 1, 50) || ' -> ' || substr(corrected_value, 1, 50), '; ' order by feedback_id) as examples
from c join t using (field_name) where rn <= 3 group by all""")
def a11_error_patterns(r: Relations) -> DataFrame:
    """The ten fields with most real corrections and their first three examples; only three rows a field are gathered."""
    real = changed(r, ws_collapse)
    top = real.groupBy("field_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field_name").limit(10)
    first = Window.partitionBy("field_name").orderBy("feedback_id")
    text = F.concat(F.substring("original_value", 1, 50), F.lit(" -> "), F.substring("corrected_value", 1, 50))
    kept = real.join(F.broadcast(top), "field_name").withColumn("rn", F.row_number().over(first)).where("rn <= 3").select("field_name", "n", F.struct("feedback_id", text.alias("t")).alias("x"))
    return kept.groupBy("field_name", "n").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "; ").alias("examples"))


DOMINANT = """, m as (select document_id, method, count(*) as n from facts group by all),
dom as (select document_id, method from m qualify row_number() over (partition by document_id order by n desc, method) = 1)"""


def dominant_strategy(r: Relations) -> DataFrame:
    """The method behind most values of each document; ties go to the first name."""
    n = r.facts.groupBy("document_id", "method").agg(F.count("*").alias("n"))
    return n.groupBy("document_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "method")).alias("x")).select("document_id", "x.method")


@query(DOMINANT + """ select method, avg(extraction_time_ms) / 1000 as mean_s, min(extraction_time_ms) as low, max(extraction_time_ms) as high, sum(extraction_time_ms)::bigint / 1000 as total_s, count(*) as n
from docs_x join dom using (document_id) where extraction_time_ms > 0 group by all""")
def a12_extraction_time(r: Relations) -> DataFrame:
    """Extraction times by dominant strategy."""
    t = F.col("extraction_time_ms")
    timed = r.documents.where(t > 0).join(dominant_strategy(r), "document_id")
    return timed.groupBy("method").agg((F.avg(t) / 1000).alias("mean_s"), F.min(t).alias("low"), F.max(t).alias("high"), (F.sum(t) / 1000).alias("total_s"), F.count("*").alias("n"))


@query(DOMINANT + " select method, count(*) as documents from dom group by all")
def a13_dominant_strategy(r: Relations) -> DataFrame:
    """Documents by dominant strategy."""
    return dominant_strategy(r).groupBy("method").agg(F.count("*").alias("documents"))


@query(""", t as (select v.document_id, v.field_name, v.value, coalesce(f.corrected_value, v.value) as truth from facts v left join feedback f using (document_id, field_name)),
h as (select count(*) as n, count(*) filter (trim(value) = trim(truth)) as k from t),
s as (select strategy, count(*) as total, count(*) filter (trim(a.value) = trim(truth)) as correct from attempts a join t using (document_id, field_name) where success group by all)
select strategy, total, correct, correct / total as accuracy, total / h.n as coverage, h.k / h.n as hybrid, (h.k / h.n - correct / total) / (correct / total) * 100 as improvement from s, h""")
def a14_ablation(r: Relations) -> DataFrame:
    """Each strategy alone against the combination: accuracy of its successes, coverage, and the combination's gain in percent."""
    keys = ["document_id", "field_name"]
    truth = r.facts.select(*keys, F.col("value").alias("own")).join(r.feedback.select(*keys, "corrected_value"), keys, "left").withColumn("truth", F.coalesce("corrected_value", "own"))
    hybrid = truth.agg((F.count_if(strict_norm(F.col("own")) == strict_norm(F.col("truth"))) / F.count("*")).alias("a"), F.count("*").alias("n"))
    s = r.attempts.where("success").join(truth, keys).groupBy("strategy").agg(F.count("*").alias("total"), F.count_if(strict_norm(F.col("value")) == strict_norm(F.col("truth"))).alias("correct"))
    s = s.withColumn("accuracy", F.col("correct") / F.col("total")).withColumn("hybrid", hybrid.select("a").scalar()).withColumn("n", hybrid.select("n").scalar())
    return s.select("strategy", "total", "correct", "accuracy", (F.col("total") / F.col("n")).alias("coverage"), "hybrid", ((F.col("hybrid") - F.col("accuracy")) / F.col("accuracy") * 100).alias("improvement"))


@query(f""", {COUNTS}, x as (select template_id, count(*) as documents, cast(sum(corrections) as bigint) as feedback, count(*) filter (corrections > 0) as touched from acc group by all)
select *, feedback / documents as per_document, least(1.0, 1 / (feedback / documents + 1)) as quality, documents // 5 as batches from x""")
def a15_hitl(r: Relations) -> DataFrame:
    """Corrections per document and the quality they imply."""
    x = document_counts(r).groupBy("template_id").agg(F.count("*").alias("documents"), F.sum("corrections").alias("feedback"), F.count_if(F.col("corrections") > 0).alias("touched"))
    x = x.withColumn("per_document", F.col("feedback") / F.col("documents"))
    return x.withColumn("quality", F.least(F.lit(1.0), 1 / (F.col("per_document") + 1))).withColumn("batches", F.expr("documents div 5"))


@query(""" select pattern_type, count(*) filter (is_active) as active, count(*) as patterns, cast(sum(usage_count) as bigint) as used, cast(sum(success_count) as bigint) as hits,
case when sum(usage_count) > 0 then sum(success_count) / sum(usage_count) else 0.0 end as effectiveness, avg(usage_count) as mean_usage from patterns group by all""")
def a16_adaptive_status(r: Relations) -> DataFrame:
    """Learned patterns by type and how well they do."""
    x = r.patterns.groupBy("pattern_type").agg(F.count_if("is_active").alias("active"), F.count("*").alias("patterns"), F.sum("usage_count").alias("used"), F.sum("success_count").alias("hits"), F.avg("usage_count").alias("mean_usage"))
    return x.withColumn("effectiveness", safe_div(F.col("hits"), F.col("used")))


@query(""", s as (select strategy, count(*) as n, count(*) filter (a.value = coalesce(f.corrected_value, v.value)) as k, sum(d.extraction_time_ms)::bigint as ms
  from attempts a join facts v using (document_id, field_name) left join feedback f using (document_id, field_name) join docs_x d using (document_id) where d.status = 'validated' and success group by all),
y as (select *, k / n as accuracy, ms * (n / sum(n) over ()) as time_share from s)
select strategy, n, k, accuracy, round(time_share, 6) as time_share, (max(accuracy) over () - accuracy) * 100 as behind_best from y""")
def a18_baseline_comparison(r: Relations) -> DataFrame:
    """Strategies over validated documents only; distances in percentage points."""
    keys = ["document_id", "field_name"]
    truth = r.facts.select(*keys, F.col("value").alias("own")).join(r.feedback.select(*keys, "corrected_value"), keys, "left")
    docs = r.documents.where("status = 'validated'").select("document_id", "extraction_time_ms")
    rows = r.attempts.where("success").join(truth, keys).join(docs, "document_id").withColumn("strategy", without_fallback(F.col("strategy")))
    s = rows.groupBy("strategy").agg(F.count("*").alias("n"), F.count_if(F.col("value") == F.coalesce("corrected_value", "own")).alias("k"), F.sum("extraction_time_ms").alias("ms"))
    s = s.withColumn("accuracy", F.col("k") / F.col("n")).withColumn("all", s.agg(F.sum("n")).scalar())
    best = s.agg(F.max("accuracy")).scalar()
    return s.withColumn("best", best).select("strategy", "n", "k", "accuracy", F.round(F.col("ms") * (F.col("n") / F.col("all")), 6).alias("time_share"), ((F.col("best") - F.col("accuracy")) * 100).alias("behind_best"))


@query(f", {COUNTS} select template_id, phase, sum(greatest(0, fields - corrections)) / sum(fields) as accuracy, cast(sum(fields) as bigint) as fields from acc group by all having sum(fields) > 0")
def a19_batch_accuracy(r: Relations) -> DataFrame:
    """Right fields over all fields of a set of documents, here each template and phase."""
    x = document_counts(r).groupBy("template_id", "phase").agg(F.sum(F.greatest(F.lit(0), F.col("fields") - F.col("corrections"))).alias("right"), F.sum("fields").alias("fields"))
    return x.where("fields > 0").select("template_id", "phase", (F.col("right") / F.col("fields")).alias("accuracy"), "fields")


@query(" select coalesce(phase, 'unknown') as phase, count(*) as n from docs_x group by all")
def a20_group_count(r: Relations) -> DataFrame:
    """Documents by phase, unknown where there is none."""
    return r.documents.groupBy(F.coalesce("phase", F.lit("unknown")).alias("phase")).agg(F.count("*").alias("n"))


@query(PERF + """, p as (select *, correct / total as accuracy from perf),
w as (select *, row_number() over (partition by template_id, strategy order by accuracy desc, field_name) as hi, row_number() over (partition by template_id, strategy order by accuracy, field_name) as lo from p)
select template_id, strategy, count(distinct field_name) as fields, round(avg(accuracy) * 100, 9) as mean, cast(sum(total) as bigint) as total, cast(sum(correct) as bigint) as correct,
       max(case when hi = 1 then field_name end) as best, max(case when lo = 1 then field_name end) as worst from w group by all""")
def a21_strategy_stats(r: Relations) -> DataFrame:
    """Counters, mean accuracy and the best and worst field in one pass."""
    p = strategy_performance(r).withColumn("accuracy", F.col("correct") / F.col("total"))
    return p.groupBy("template_id", "strategy").agg(
        F.countDistinct("field_name").alias("fields"), F.round(F.avg("accuracy") * 100, 9).alias("mean"), F.sum("total").alias("total"), F.sum("correct").alias("correct"),
        F.min(F.struct((-F.col("accuracy")).alias("k"), "field_name"))["field_name"].alias("best"), F.min(F.struct("accuracy", "field_name"))["field_name"].alias("worst"),
    )


@query(PERF + " select template_id, field_name, strategy, correct / total as accuracy from perf qualify row_number() over (partition by template_id, field_name order by correct / total desc, total desc, strategy) = 1")
def a22_best_strategy_per_field(r: Relations) -> DataFrame:
    """The most accurate strategy of each field; then more attempts, then the first name."""
    p = strategy_performance(r).withColumn("accuracy", F.col("correct") / F.col("total"))
    best = p.groupBy("template_id", "field_name").agg(F.min(F.struct((-F.col("accuracy")).alias("a"), (-F.col("total")).alias("t"), "strategy", "accuracy")).alias("x"))
    return best.select("template_id", "field_name", "x.strategy", "x.accuracy")


@query(PERF + " select strategy, round(avg(correct / total), 9) as mean, cast(sum(total) as bigint) as total, cast(sum(correct) as bigint) as correct from perf where strategy = 'crf' group by all")
def a23_one_strategy(r: Relations) -> DataFrame:
    """Summary of one strategy."""
    p = strategy_performance(r).where("strategy = 'crf'")
    return p.groupBy("strategy").agg(F.round(F.avg(F.col("correct") / F.col("total")), 9).alias("mean"), F.sum("total").alias("total"), F.sum("correct").alias("correct"))


@query(" select field_name, count(*) as n, count(*) filter (original_value = corrected_value) / count(*) as ratio from feedback group by all")
def a24_correct_ratio(r: Relations) -> DataFrame:
    """Feedback that changed nothing."""
    return r.feedback.groupBy("field_name").agg(F.count("*").alias("n"), (F.count_if(F.col("original_value") == F.col("corrected_value")) / F.count("*")).alias("ratio"))


@query(""" select field_config, pattern, count(*) as n, string_agg(cast(pattern_id as varchar), ',' order by pattern_id) as ids, cast(sum(frequency) as bigint) as frequency,
max(priority) as priority, round(avg(match_rate), 9) as mean_rate, round(sum(match_rate * frequency) / sum(frequency), 9) as weighted_rate from patterns group by all having count(*) > 1""")
def a25_duplicate_patterns(r: Relations) -> DataFrame:
    """Patterns that occur more than once in a field; the plain and the frequency-weighted mean rate under names of their own."""
    x = r.patterns.groupBy("field_config", "pattern").agg(
        F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("pattern_id")), ",").alias("ids"), F.sum("frequency").alias("frequency"), F.max("priority").alias("priority"),
        F.round(F.avg("match_rate"), 9).alias("mean_rate"), F.round(F.sum(F.col("match_rate") * F.col("frequency")) / F.sum("frequency"), 9).alias("weighted_rate"),
    )
    return x.where("n > 1")


@query(""" select count(*) as total, count(distinct pattern || '/' || field_config) as distinct_patterns, count(*) filter (is_active) as active, count(*) filter (not is_active) as inactive,
count(*) filter (usage_count > 0) as used, count(*) - count(distinct pattern || '/' || field_config) as duplicates from patterns""")
def a26_pattern_stats(r: Relations) -> DataFrame:
    """Patterns in numbers."""
    unique = F.countDistinct(F.concat_ws("/", "pattern", "field_config"))
    return r.patterns.agg(
        F.count("*").alias("total"), unique.alias("distinct_patterns"), F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive"),
        F.count_if(F.col("usage_count") > 0).alias("used"), (F.count("*") - unique).alias("duplicates"),
    )


DECISION = "case when idle_days > 30 then 'delete' when usage_count < 10 then 'keep' when boost < -0.2 then 'deactivate' when success_count / usage_count < 0.3 then 'deactivate' else 'keep' end"


@query(f" select {DECISION} as decision, count(*) as n, cast(sum(usage_count) as bigint) as usage from patterns group by all")
def a27_cleanup_report(r: Relations) -> DataFrame:
    """Patterns by what cleanup would do with them."""
    decision = D.pattern_decision(F.col("idle_days"), F.col("usage_count"), F.col("success_count"), F.col("boost"))
    return r.patterns.groupBy(decision.alias("decision")).agg(F.count("*").alias("n"), F.sum("usage_count").alias("usage"))


@query(PERF + """, x as (select template_id, avg(correct / total) as a, count(*) as n from perf where strategy = 'crf' and total >= 5 group by all)
select template_id, round(greatest(0.3, least(0.9, (0.3 + 0.6 * a) * least(1.0, n / 10) + 0.5 * (1 - least(1.0, n / 10)))), 9) as weight from x""")
def a28_crf_weight(r: Relations) -> DataFrame:
    """How much the sequence model may weigh, by its accuracy and the fields behind it."""
    x = strategy_performance(r).where("strategy = 'crf' and total >= 5").groupBy("template_id").agg(F.avg(F.col("correct") / F.col("total")).alias("a"), F.count("*").alias("n"))
    return x.select("template_id", F.round(D.crf_weight(F.col("a"), F.col("n")), 9).alias("weight"))


@query(PERF + """, x as (select template_id, strategy, sum(correct) / sum(total) as a from perf group by all)
select template_id, strategy, round(a / sum(a) over (partition by template_id), 9) as weight from x""")
def a29_strategy_weights(r: Relations) -> DataFrame:
    """Accuracies scaled to one within a template."""
    x = strategy_performance(r).groupBy("template_id", "strategy").agg((F.sum("correct") / F.sum("total")).alias("a"))
    return x.select("template_id", "strategy", F.round(F.col("a") / F.sum("a").over(Window.partitionBy("template_id")), 9).alias("weight"))


@query(""", x as (select document_id, confidence, row_number() over (partition by document_id order by position) as i, count(*) over (partition by document_id) as n from facts)
select document_id, round(sum(0.3 * pow(0.7, n - i) * confidence), 9) as ema from x group by all""")
def a30_confidence_ema(r: Relations) -> DataFrame:
    """Exponential mean of a document's confidences in field order, from zero."""
    values = F.transform(F.sort_array(F.collect_list(F.struct("position", "confidence"))), lambda x: x["confidence"])
    folded = F.aggregate(F.col("v"), F.lit(0.0), lambda a, x: a * 0.7 + x * 0.3)
    return r.facts.groupBy("document_id").agg(values.alias("v")).select("document_id", F.round(folded, 9).alias("ema"))


@query(PERF + " select template_id, strategy, field_name, total, correct from perf")
def a31_attempt_scoring(r: Relations) -> DataFrame:
    """Right and tried per template, strategy and field, scored from feedback."""
    return strategy_performance(r)


@query(f""", {COUNTS} select count(*) as documents, cast(sum(corrections) as bigint) as corrections, cast(sum(fields) as bigint) as fields,
sum(greatest(0, fields - corrections)) / sum(fields) as accuracy from acc""")
def a32_system_totals(r: Relations) -> DataFrame:
    """All templates together."""
    x = document_counts(r)
    right = F.sum(F.greatest(F.lit(0), F.col("fields") - F.col("corrections")))
    return x.agg(F.count("*").alias("documents"), F.sum("corrections").alias("corrections"), F.sum("fields").alias("fields"), (right / F.sum("fields")).alias("accuracy"))


@query(f""", {COUNTS}, m as (select template_id, method, count(*) as k from facts join docs_x using (document_id) group by all)
select a.template_id, a.documents, a.accuracy, m.method from (select template_id, count(*) as documents, round(avg(coalesce(accuracy, 1.0)), 9) as accuracy from acc group by all) a
join m on m.template_id = a.template_id qualify row_number() over (partition by a.template_id order by k desc, method) = 1""")
def a33_template_comparison(r: Relations) -> DataFrame:
    """Templates side by side with the method behind most of their values."""
    a = document_counts(r).groupBy("template_id").agg(F.count("*").alias("documents"), F.round(F.avg(F.coalesce("accuracy", F.lit(1.0))), 9).alias("accuracy"))
    m = r.facts.join(r.documents.select("document_id", "template_id"), "document_id").groupBy("template_id", "method").agg(F.count("*").alias("k"))
    top = m.groupBy("template_id").agg(F.min(F.struct((-F.col("k")).alias("k"), "method")).alias("x")).select("template_id", "x.method")
    return a.join(top, "template_id")


@query(f""", {COUNTS}, t as (select template_id, sum(greatest(0, fields - corrections)) filter (phase = 'baseline') / sum(fields) filter (phase = 'baseline') as base,
  sum(greatest(0, fields - corrections)) filter (phase = 'adaptive') / sum(fields) filter (phase = 'adaptive') as adaptive from acc group by all)
select round(avg(base), 9) as base, round(avg(adaptive), 9) as adaptive, round(avg(adaptive - base), 9) as gain from t""")
def a34_phase_averages(r: Relations) -> DataFrame:
    """Unweighted means over templates, baseline and adaptive."""
    right, of = F.greatest(F.lit(0), F.col("fields") - F.col("corrections")), lambda p, x: F.sum(F.when(F.col("phase") == p, x))
    t = document_counts(r).groupBy("template_id").agg(*((of(p, right) / of(p, F.col("fields"))).alias(n) for p, n in (("baseline", "base"), ("adaptive", "adaptive"))))
    return t.agg(F.round(F.avg("base"), 9).alias("base"), F.round(F.avg("adaptive"), 9).alias("adaptive"), F.round(F.avg(F.col("adaptive") - F.col("base")), 9).alias("gain"))


@query(" select template_id, count(*) as total, count(*) filter (used) as used, count(*) filter (not used) as unused from feedback join docs_x using (document_id) group by all")
def a54_feedback_used(r: Relations) -> DataFrame:
    """Feedback that training has and hasn't used."""
    rows = r.feedback.join(r.documents.select("document_id", "template_id"), "document_id")
    return rows.groupBy("template_id").agg(F.count("*").alias("total"), F.count_if("used").alias("used"), F.count_if(~F.col("used")).alias("unused"))


@query(PERF + " select template_id, strategy, coalesce(field_name, 'ALL') as field_name, grouping(field_name)::int as level, cast(sum(total) as bigint) as total, cast(sum(correct) as bigint) as correct from perf group by grouping sets ((template_id, strategy, field_name), (template_id, strategy))")
def a56_grouping_sets(r: Relations) -> DataFrame:
    """Counters per field and their totals in one pass; the totals are marked by ``level``."""
    perf = strategy_performance(r)
    sets = perf.groupingSets([["template_id", "strategy", "field_name"], ["template_id", "strategy"]], "template_id", "strategy", "field_name")
    rows = sets.agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"), F.grouping("field_name").cast("int").alias("level"))
    return rows.select("template_id", "strategy", F.when(F.col("level") == 1, "ALL").otherwise(F.col("field_name")).alias("field_name"), "level", "total", "correct")


@query(" select document_id, count(*) as corrections from feedback where original_value <> corrected_value group by all having count(*) > 0")
def a57_documents_with_corrections(r: Relations) -> DataFrame:
    """Documents that were corrected."""
    return r.feedback.where("original_value <> corrected_value").groupBy("document_id").agg(F.count("*").alias("corrections"))


@query(" select field_config, count(distinct pattern_type) as types, count(distinct case when is_active then pattern_type end) as active_types, count(*) as patterns from patterns group by all")
def a58_pattern_summary(r: Relations) -> DataFrame:
    """Patterns and types per field."""
    return r.patterns.groupBy("field_config").agg(F.countDistinct("pattern_type").alias("types"), F.countDistinct(F.when(F.col("is_active"), F.col("pattern_type"))).alias("active_types"), F.count("*").alias("patterns"))


@query(f", {COUNTS} select template_id, count(*) as documents, count(*) filter (status = 'validated') as validated, count(*) filter (status = 'pending') as pending, round(avg(accuracy), 9) as accuracy from acc group by all")
def a59_export_summary(r: Relations) -> DataFrame:
    """What an export's first sheet says."""
    s = lambda x: F.count_if(F.col("status") == x).alias(x)
    return document_counts(r).groupBy("template_id").agg(F.count("*").alias("documents"), s("validated"), s("pending"), F.round(F.avg("accuracy"), 9).alias("accuracy"))


@query(""", v as (select field_name, avg(confidence) as c, count(*) filter (value = '') / count(*) as blank from facts group by all)
select round(avg(c), 9) as macro_confidence, round(avg(blank), 9) as macro_blank, max(blank) as worst_blank, count(*) as fields from v""")
def a60_macro_averages(r: Relations) -> DataFrame:
    """Unweighted means over fields."""
    v = r.facts.groupBy("field_name").agg(F.avg("confidence").alias("c"), (F.count_if(F.col("value") == "") / F.count("*")).alias("blank"))
    return v.agg(F.round(F.avg("c"), 9).alias("macro_confidence"), F.round(F.avg("blank"), 9).alias("macro_blank"), F.max("blank").alias("worst_blank"), F.count("*").alias("fields"))
