"""Listings, configuration assembly, cleaning pipelines and the remaining ladders of the services."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import decisions as D
from fieldloom.functions import text as X
from fieldloom.functions.similarity import exact_ratio, segmented
from fieldloom.operators.evaluation import against_truth, fuzzy_confusion
from fieldloom.operators.relational import AS_OF, page, relational
from fieldloom.plans.registry import query
from fieldloom.sources.relations import Relations

relational("s13_template_configs", "The active configuration of each field as one row: version, best patterns and their number.", """
with k as (select field_config, pattern, priority, frequency, row_number() over (partition by field_config order by priority desc, frequency desc, pattern_id) as rn from {patterns} where is_active),
     v as (select field_config, count(*) as version from {patterns} group by field_config)
select v.field_config, v.version, max(case when rn = 1 then pattern end) as first_pattern, max(case when rn = 2 then pattern end) as second_pattern, count(k.pattern) as active from v left join k on k.field_config = v.field_config group by v.field_config, v.version""")
relational("s14_job_list", "Jobs of some kinds and states, newest first.", """
select job_id, type, status, created_at from {jobs} where type in ('click', 'error') and status in ('pending', 'failed') order by created_at desc, job_id desc limit 50""")
relational("k03_strategy_counters", "Counters per template, strategy and field, summed from attempts whatever their order.", """
select d.template_id, a.strategy, a.field_name, count(*) as total, count(case when a.value = f.truth then 1 end) as correct, count(case when a.value = f.truth then 1 end) / cast(count(*) as double) as accuracy
from {attempts} a join {documents} d on d.document_id = a.document_id join {facts} f on f.document_id = a.document_id and f.field_name = a.field_name where a.success group by d.template_id, a.strategy, a.field_name""")
relational("p06_in_list", "Feedback of a list of documents, as a semi-join with the list.", """
select feedback_id, field_name from {feedback} f semi join (select document_id from {documents} where template_id = 5 and status = 'pending') d on d.document_id = f.document_id""")
relational("p16_success_rate", "Success in percent with two decimals, zero without use.", """
select pattern_id, case when usage_count > 0 then round(cast(100 as double) * success_count / usage_count, 2) else cast(0 as double) end as rate from {patterns}""")
relational("t02_top_fields_by_error", "The ten fields with most real corrections.", """
select field_name, count(*) as n from {feedback} where trim(original_value) <> trim(corrected_value) group by field_name order by 2 desc, 1 limit 10""")
relational("t03_last_hundred", "The last hundred feedback rows of the trend.", """
select feedback_id, created_at from {feedback} order by created_at desc, feedback_id desc limit 100""")
relational("t06_suggestion_order", "The five patterns to suggest first in each type.", """
with k as (select pattern_id, pattern_type, row_number() over (partition by pattern_type order by match_rate desc, frequency desc, pattern_id) as rn from {patterns} where is_active) select pattern_type, pattern_id, rn from k where rn <= 5""")
relational("t14_multi_key_listing", "Statistics by several keys.", """
select pattern_id, pattern_type, frequency, priority from {patterns} where frequency > 20 order by pattern_type, frequency desc, priority desc, pattern_id limit 30""")
relational("r05_job_timeouts", "What is to become of running jobs after half an hour: back to pending at first, then failed.", f"""
select job_id, case when created_at < timestamp '{AS_OF}' - interval '30' minute then case when job_id % 3 < 2 then 'pending' else 'failed' end else status end as status from {{jobs}} where status = 'running'""")
relational("a43_throughput", "Documents a minute and training minutes of each phase.", """
select phase, cast(60000 as double) / avg(extraction_time_ms) as per_minute, max(extraction_time_ms) / cast(60000 as double) as longest_minutes from {documents} where phase is not null and extraction_time_ms > 0 group by phase""")


@query(" select document_id, created_at from docs_x where template_id = 2 and status = 'validated' order by created_at, document_id limit 25 offset 25")
def s02_filtered_page(r: Relations) -> DataFrame:
    """The second page of a filtered listing."""
    rows, _ = page(r.documents.where("template_id = 2 and status = 'validated'"), 2, 25, [F.col("created_at"), F.col("document_id")])
    return rows.select("document_id", "created_at")


@query(""" select method, case when contains(lower(method), 'crf') then 'crf' when contains(lower(method), 'rule') then 'rule_based' when contains(lower(method), 'position') then 'position_based' else 'rule_based' end as strategy,
  count(*) as n, case when avg(confidence) > 0.8 then 'minor' when avg(confidence) > 0.49 then 'moderate' else 'major' end as level from (select case when l_partkey % 2 = 0 then upper(method) || '_fallback' else method end as method, confidence from facts) x group by all""")
def p07_strategy_names(r: Relations) -> DataFrame:
    """Normalised strategy names."""
    m = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.upper("method"), F.lit("_fallback"))).otherwise(F.col("method"))
    x = r.facts.select(m.alias("method"), "confidence").groupBy("method").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    level = F.when(F.col("c") > 0.8, "minor").when(F.col("c") > 0.49, "moderate").otherwise("major")
    return x.select("method", D.strategy_name(F.col("method")).alias("strategy"), "n", level.alias("level"))


@query(""", g as (select template_id, count(*) filter (created_at < timestamp '2000-01-01') as previous, count(*) as current from docs_x group by all)
select template_id, case when previous = 0 then 'full' when abs(current - previous) / previous > 0.5 then 'full' when abs(current - previous) / previous > 0.1 then 'sample' else 'skip' end as choice,
  case when previous / current < 0.5 then 'Low' when previous / current < 0.8 then 'Medium' else 'Good' end as light from g""")
def p17_validation_choice(r: Relations) -> DataFrame:
    """Whether each template's data needs checking again, and its light."""
    g = r.documents.groupBy("template_id").agg(F.count_if(F.col("created_at") < F.lit("2000-01-01").cast("timestamp_ntz")).alias("previous"), F.count("*").alias("current"))
    choice = D.validation_choice(F.lit(False), F.col("previous"), F.col("current"), F.lit(False))
    return g.select("template_id", choice.alias("choice"), D.traffic_light(F.col("previous") / F.col("current")).alias("light"))


@query()
def f08_clean_values(r: Relations) -> DataFrame:
    """Values through the learned cleaning steps in order: structure, affixes, blanks.

    What is learned is aggregated per field first: flags, and at most ten affixes, so each is a bounded array.
    """
    marks = r.feedback.groupBy("field_name").agg((F.count_if(F.col("original_value").endswith(",")) > 2).alias("comma"), (F.count_if(F.col("original_value").startswith("(")) > 2).alias("open"))
    n = r.feedback.withColumn("affix", X.missing_suffix(F.col("original_value"), F.col("corrected_value"))).where("affix <> ''").groupBy("field_name", "affix").agg(F.count("*").alias("n"))
    w = Window.partitionBy("field_name").orderBy(F.desc("n"), "affix")
    affixes = n.withColumn("rn", F.row_number().over(w)).where("rn <= 10").groupBy("field_name").agg(F.sort_array(F.collect_list(F.concat(F.lit(" "), "affix"))).alias("suffixes"))
    rows = r.facts.join(marks, "field_name", "left").join(affixes, "field_name", "left")
    flags: dict[str, Column] = {"trailing_comma": F.coalesce("comma", F.lit(False)), "parentheses_start": F.coalesce("open", F.lit(False))}
    none = F.array().cast("array<string>")
    value = X.affix_clean(X.structural_clean(X.generic_clean(F.col("truth")), flags), none, F.coalesce("suffixes", none))
    return rows.select("document_id", "field_name", X.collapse_blanks(value).alias("value"))


def multiline_fields(feedback: DataFrame) -> DataFrame:
    """``field_name``, ``multiline``: 1 from five values on if one holds a line break, or if the longest tenth has 90 characters and the mean is 70."""
    size = F.length("corrected_value")
    # The longest length from rank 0.9 n on is the longest of all.
    x = feedback.groupBy("field_name").agg(F.count("*").alias("n"), F.bool_or(F.col("corrected_value").contains("\n")).alias("newline"), F.max(size).alias("p90"), F.avg(size).alias("mean"))
    return x.select("field_name", D.multiline_by_length(F.col("n"), F.col("newline"), F.col("p90"), F.col("mean"), F.lit(0)).alias("multiline"))


@query(""" select field_name, case when count(*) >= 5 and (bool_or(contains(corrected_value, chr(10))) or max(length(corrected_value)) >= 90 and avg(length(corrected_value)) >= 70) then 1 else 0 end as multiline from feedback group by all""")
def p28_multiline(r: Relations) -> DataFrame:
    """Fields whose values span lines, by line breaks and lengths."""
    return multiline_fields(r.feedback)


def root_causes(feedback: DataFrame, attempts: DataFrame) -> DataFrame:
    """``template_id``, ``issue``, ``evidence``: what holds a template's quality back.

    Over 100 corrections unused; rules behind more than 0.7 of the attempts; a mean accuracy of the CRF's
    fields under 0.5; fields with fewer than 20 corrections used. ``feedback`` has ``template_id``,
    ``field_name``, ``used``; ``attempts`` has ``template_id``, ``field_name``, ``strategy``, ``correct``.
    """
    unused = feedback.where("not used").groupBy("template_id").agg(F.count("*").cast("double").alias("evidence")).where("evidence > 100")
    share = attempts.groupBy("template_id").agg((F.count_if(F.col("strategy") == "rule_based") / F.count("*")).alias("evidence")).where("evidence > 0.7")
    fields = attempts.where("strategy = 'crf'").groupBy("template_id", "field_name").agg(F.avg(F.col("correct").cast("int")).alias("accuracy"))
    crf = fields.groupBy("template_id").agg(F.avg("accuracy").alias("evidence")).where("evidence < 0.5")
    few = feedback.where("used").groupBy("template_id", "field_name").agg(F.count("*").alias("n")).where("n < 20").groupBy("template_id").agg(F.count("*").cast("double").alias("evidence"))
    issues = {"unused feedback": unused, "rules dominate": share, "weak crf": crf, "few samples": few}
    return reduce(DataFrame.unionByName, (x.select("template_id", F.lit(name).alias("issue"), F.round("evidence", 9).alias("evidence")) for name, x in issues.items()))


@query(""", fb as (select template_id, field_name, used from feedback join docs_x using (document_id)),
tr as (select template_id, a.field_name, strategy, a.value = f.truth as correct from attempts a join facts f using (document_id, field_name) join docs_x using (document_id) where success),
i as (select template_id, 'unused feedback' as issue, cast(count(*) as double) as evidence from fb where not used group by template_id having count(*) > 100
  union all select template_id, 'rules dominate', avg(case when strategy = 'rule_based' then 1.0 else 0.0 end) from tr group by template_id having avg(case when strategy = 'rule_based' then 1.0 else 0.0 end) > 0.7
  union all select template_id, 'weak crf', avg(k) from (select template_id, field_name, avg(case when correct then 1.0 else 0.0 end) as k from tr where strategy = 'crf' group by all) x group by template_id having avg(k) < 0.5
  union all select template_id, 'few samples', count(*) from (select template_id, field_name from fb where used group by template_id, field_name having count(*) < 20) x group by template_id)
select template_id, issue, round(evidence, 9) as evidence from i""")
def p21_root_causes(r: Relations) -> DataFrame:
    """Four rules on what holds each template's quality back, with their evidence."""
    templates = r.documents.select("document_id", "template_id")
    truth = r.facts.select("document_id", "field_name", "truth")
    tried = r.attempts.where("success").join(truth, ["document_id", "field_name"]).join(templates, "document_id")
    return root_causes(r.feedback.join(templates, "document_id"), tried.select("template_id", "field_name", "strategy", (F.col("value") == F.col("truth")).alias("correct")))


@query()
def j29_exact_and_fuzzy(r: Relations) -> DataFrame:
    """Exact and fuzzy accuracy of each field side by side: an inner join of both evaluations."""
    rows = against_truth(r)
    exact = rows.groupBy("field_name").agg((F.count_if(F.col("extracted") == F.col("truth")) / F.count("*")).alias("exact_accuracy"))
    fuzzy = fuzzy_confusion(rows).select("field_name", (F.col("correct") / F.col("total")).alias("fuzzy_accuracy"), "similarity")
    return exact.join(fuzzy, "field_name").withColumn("gain", F.col("fuzzy_accuracy") - F.col("exact_accuracy"))


@query()
def f22_segmented_words(r: Relations) -> DataFrame:
    """Run-together words of the documents split by the words of all documents (F22 to F24), and the pieces' shares of the box.

    The dictionary is every word of four letters or more that occurs five times in the corpus. The pieces of at
    most 20 letters of each long word meet it in an equi-join, so the dictionary is gathered nowhere; a task
    gets each long word with the known pieces of its own. ``boxes`` are start and end of each piece in
    thousandths of the word's width, by its letters.
    """
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    known = r.table("documents").select(words.alias("piece")).where(F.length("piece").between(4, 20)).groupBy("piece").agg(F.count("*").alias("n")).where("n >= 5").select("piece")
    long = r.table("documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("word")).where(F.length("word") > 25).distinct()
    # Known pieces are of letters only, so others needn't meet them. A word has its cuts in one array, without an
    # aggregate over them, and words spread over all tasks by number, as each becomes hundreds of rows.
    spread = int(r.spark.conf.get("spark.sql.shuffle.partitions"))
    clean = long.select("word").distinct().repartition(spread, "word").withColumn("fixed", X.ocr_fixes(F.col("word")))
    starts = F.sequence(F.lit(1), F.greatest(F.length("fixed") - 3, F.lit(1)))
    every = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(4), F.lit(20)), lambda n: F.lower(F.substr("fixed", i, n)))))
    cuts = clean.select("word", F.explode_outer(F.array_distinct(F.filter(every, lambda p: p.rlike(r"^\p{L}+$")))).alias("piece")).where("piece is not null")
    own = cuts.join(known, "piece").groupBy("word").agg(F.collect_set("piece").alias("pieces"))
    split = clean.join(own, "word", "left").withColumn("segmented", segmented(F.col("fixed"), F.coalesce("pieces", F.array().cast("array<string>"))))
    parts, whole = F.split("segmented", " "), F.length(F.replace("segmented", F.lit(" "), F.lit("")))
    ends = F.transform(parts, lambda p, i: F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x)))
    boxes = F.transform(ends, lambda e, i: F.concat_ws("-", F.floor((e - F.length(F.get(parts, i))) * 1000 / whole), F.floor(e * 1000 / whole)))
    return long.join(split.select("word", "segmented", F.array_join(boxes, ",").alias("boxes")), "word").select("doc_id", "word", "segmented", "boxes")


def near_pairs(values: DataFrame, others: DataFrame, ratio: float = 0.9) -> DataFrame:
    """``value``, ``known``, ``ratio``: pairs of different strings of both sides with a matching ratio of at least 9/10 and lengths within a tenth.

    Of la and lb characters at most e = (la + lb) / 10 are unmatched, so lb is at most 11/9 of la. A block's
    end spoils at most two trigrams of either string and an unmatched character one more, at most
    3e <= 2 la / 3 of them; so the rarest floor(2 la / 3) + 1 trigrams of both strings share one. Candidates
    are an equi-join on these, and the matcher decides.
    """
    def grams(df: DataFrame, name: str) -> DataFrame:
        n = F.greatest(F.length(name) - 2, F.lit(1))
        return df.select(name).where(F.col(name) != "").distinct().withColumn("grams", F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(F.col(name), i, F.lit(3)))))

    a, b = grams(values, "value"), grams(others, "known")
    counts = a.select(F.explode("grams").alias("gram")).unionByName(b.select(F.explode("grams").alias("gram"))).groupBy("gram").agg(F.count("*").alias("n"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        ranked = df.select(name, F.explode("grams").alias("gram")).join(counts, "gram").groupBy(name).agg(F.sort_array(F.collect_list(F.struct("n", "gram")))["gram"].alias("grams"))
        return ranked.select(name, F.explode(F.slice("grams", F.lit(1), F.floor(F.length(name) * 2 / 3).cast("int") + 1)).alias("gram"))

    met = prefix(a, "value").join(prefix(b, "known"), "gram").where("value <> known and abs(length(value) - length(known)) <= 0.1 * greatest(length(value), length(known))")
    return met.select("value", "known").distinct().withColumn("ratio", exact_ratio("value", "known")).where(F.col("ratio") >= ratio)


@query()
def j27_near_leakage(r: Relations) -> DataFrame:
    """Test values close to a training value: how many, and the closest ratio. Lossless candidates by trigrams (``near_pairs``)."""
    train, test = r.facts.where("document_id % 5 <> 0").select(F.col("truth").alias("known")), r.facts.where("document_id % 5 = 0").select(F.col("truth").alias("value"))
    return near_pairs(test, train).groupBy("value").agg(F.count("*").alias("n"), F.max("ratio").alias("ratio"))


TABLE_SQL = """, cells as (select conv_id as document_id, turn as row, generate_subscripts(string_split(text, ' '), 1) as col, unnest(string_split(text, ' ')) as cell from conversations where role = 'user')"""


@query(TABLE_SQL + """, h as (select document_id, row, count(*) filter (not regexp_matches(cell, '^[0-9.,]+$')) / count(*) as words, avg(length(cell)) as mean, bool_or(regexp_matches(cell, '^[A-Z]')) as capital from cells group by all)
select document_id, row, words > 0.5 and (mean < 30 or capital) as header from h""")
def f28_header_rows(r: Relations) -> DataFrame:
    """Which rows of a table look like headers."""
    cells = r.table("conversations").where("role = 'user'").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("row"), F.posexplode(F.split("text", " ")).alias("col", "cell"))
    h = cells.groupBy("document_id", "row").agg((F.count_if(~F.col("cell").rlike("^[0-9.,]+$")) / F.count("*")).alias("words"), F.avg(F.length("cell")).alias("mean"), F.bool_or(F.col("cell").rlike("^[A-Z]")).alias("capital"))
    return h.select("document_id", "row", ((F.col("words") > 0.5) & ((F.col("mean") < 30) | F.col("capital"))).alias("header"))


@query(TABLE_SQL + """, k as (select document_id, row, col from cells where col <= 6 and contains(lower(cell), 'th')),
b as (select document_id, row, min(col) as col from k group by all)
select c.document_id, c.row, c.col, c.cell as value from cells c join b on b.document_id = c.document_id and b.row = c.row - 2 and b.col = c.col""")
def f30_table_lookup(r: Relations) -> DataFrame:
    """The cell below the first header that holds a keyword: a self-join of cells on place."""
    cells = r.table("conversations").where("role = 'user'").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("row"), F.posexplode(F.split("text", " ")).alias("col", "cell")).withColumn("col", F.col("col") + 1)
    b = cells.where((F.col("col") <= 6) & F.lower("cell").contains("th")).groupBy("document_id", "row").agg(F.min("col").alias("col")).withColumn("row", F.col("row") + 2)
    return cells.join(b, ["document_id", "row", "col"]).select("document_id", "row", "col", F.col("cell").alias("value"))


@query(""" select feedback_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as iso, date_diff('day', cast(created_at as date), date '2020-01-15') as age, length(corrected_value) as size, instr(corrected_value, ' ') as blank, substr(corrected_value, 1, 50) as short from feedback""")
def f39_dates_and_lengths(r: Relations) -> DataFrame:
    """ISO timestamps, day differences, lengths, positions and cuts."""
    c = F.col("corrected_value")
    age = F.datediff(F.lit("2020-01-15").cast("date"), F.col("created_at").cast("date"))
    return r.feedback.select("feedback_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), age.alias("age"), F.length(c).alias("size"), F.instr(c, " ").alias("blank"), F.substring(c, 1, 50).alias("short"))


@query(""", t as (select unnest([{'f': 'shape=' || method, 'w': confidence - 0.5}, {'f': 'name=' || field_name, 'w': confidence - 0.4}]) as x from facts)
select x.f as feature, round(sum(abs(x.w)), 6) as importance from t group by all""")
def a61_feature_importance(r: Relations) -> DataFrame:
    """Sum of absolute weights by feature."""
    t = F.explode(F.array(F.struct(F.concat(F.lit("shape="), "method").alias("f"), (F.col("confidence") - 0.5).alias("w")), F.struct(F.concat(F.lit("name="), "field_name").alias("f"), (F.col("confidence") - 0.4).alias("w"))))
    return r.facts.select(t.alias("x")).groupBy(F.col("x.f").alias("feature")).agg(F.round(F.sum(F.abs("x.w")), 6).alias("importance"))


@query(""", o as (select document_id, idx, word, row_number() over (partition by document_id order by top, idx) as rn, top, x0 from (
  select doc_id as document_id, unnest(string_split_regex(trim(text), '\\s+')) as word, generate_subscripts(string_split_regex(trim(text), '\\s+'), 1) - 1 as idx, 12 * ((generate_subscripts(string_split_regex(trim(text), '\\s+'), 1) - 1) // 10) as top,
  50 * ((generate_subscripts(string_split_regex(trim(text), '\\s+'), 1) - 1) % 10) as x0 from documents) x)
select document_id, idx, (rn - 1) % 10 < 5 as opens, regexp_matches(word, '[.,]$') and lead(word) over (partition by document_id order by idx) is not null as goes_on from o""")
def w18_group_flags(r: Relations) -> DataFrame:
    """The first five words of each line, and words after which a value may go on."""
    from fieldloom.operators.extraction import Layout

    w = Window.partitionBy("document_id").orderBy("idx")
    rn = F.row_number().over(Window.partitionBy("document_id").orderBy("top", "idx"))
    return Layout(r).words.select("document_id", "idx", ((rn - 1) % 10 < 5).alias("opens"), (F.col("word").rlike("[.,]$") & F.lead("word").over(w).isNotNull()).alias("goes_on"))
