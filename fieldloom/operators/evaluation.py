"""Evaluation against ground truth, significance and resampling."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.similarity import fuzzy_ratio
from fieldloom.functions.text import f1, safe_div, strict_norm, token_overlap, ws_regex_norm
from fieldloom.plans.registry import query
from fieldloom.sources.relations import Relations

KEYS = ["document_id", "field_name"]


def against_truth(r: Relations) -> DataFrame:
    """Extracted and true values of every key that either side has; a missing side is empty."""
    extracted = r.facts.where("position <> 4").select(*KEYS, F.col("value").alias("extracted"), "confidence")
    truth = r.facts.where("position <> 5").select(*KEYS, F.when(F.col("l_partkey") % 3 == 0, F.col("truth")).when(F.col("l_partkey") % 11 == 0, "").otherwise(F.col("value")).alias("truth"))
    return extracted.join(truth, KEYS, "full").fillna("", ["extracted", "truth"])


TRUTH = """, ex as (select document_id, field_name, value as extracted, confidence from facts where position <> 4),
tr as (select document_id, field_name, case when l_partkey % 3 = 0 then truth when l_partkey % 11 = 0 then '' else value end as truth from facts where position <> 5),
g as (select coalesce(ex.document_id, tr.document_id) as document_id, coalesce(ex.field_name, tr.field_name) as field_name, coalesce(extracted, '') as extracted, coalesce(truth, '') as truth, confidence
  from ex full join tr on ex.document_id = tr.document_id and ex.field_name = tr.field_name)"""


def confusion(rows: DataFrame, norm, by: list[str]) -> DataFrame:
    """TP, FP and FN under a comparator: right and non-empty; wrong or spurious; missed. Keys empty on both sides count in the total only."""
    e, t = norm(F.col("extracted")), norm(F.col("truth"))
    tp, fp, fn = (e != "") & (t != "") & (e == t), (e != "") & (e != t), (e == "") & (t != "")
    x = rows.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for c, n in ((tp, "tp"), (fp, "fp"), (fn, "fn"))))
    x = x.withColumn("accuracy", F.col("tp") / F.col("total")).withColumn("precision", safe_div(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe_div(F.col("tp"), F.col("tp") + F.col("fn")))
    return x.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def confusion_sql(norm: str, by: str) -> str:
    e, t = norm.format("extracted"), norm.format("truth")
    return TRUTH + f""", x as (select {by}, count(*) as total, count(*) filter ({e} <> '' and {e} = {t}) as tp, count(*) filter ({e} <> '' and {e} <> {t}) as fp, count(*) filter ({e} = '' and {t} <> '') as fn from g group by all),
m as (select *, tp / total as accuracy, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as recall from x)
select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1 from m"""


@query(confusion_sql("trim({})", "field_name"))
def a35_ground_truth(r: Relations) -> DataFrame:
    """Confusion counts per field, strict comparison."""
    return confusion(against_truth(r), strict_norm, ["field_name"])


@query(confusion_sql("trim(regexp_replace({}, '\\s+', ' ', 'g'))", "field_name"))
def a36_ground_truth_tolerant(r: Relations) -> DataFrame:
    """Confusion counts per field, white space ignored; both phases of a comparison should use one comparator."""
    return confusion(against_truth(r), ws_regex_norm, ["field_name"])


@query(TRUTH + """ select field_name, count(*) filter (trim(regexp_replace(extracted, '\\s+', ' ', 'g')) = trim(regexp_replace(truth, '\\s+', ' ', 'g'))) / count(*) as accuracy from g where confidence is not null group by all""")
def acc7_learning_curve(r: Relations) -> DataFrame:
    """Equal over extracted fields only; empty on both sides is equal."""
    rows = against_truth(r).where("confidence is not null")
    return rows.groupBy("field_name").agg((F.count_if(ws_regex_norm(F.col("extracted")) == ws_regex_norm(F.col("truth"))) / F.count("*")).alias("accuracy"))


def fuzzy_confusion(rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Matches by ratio or equality; where a field counts as right, precision, recall and accuracy are one number."""
    scored = rows.withColumn("ratio", fuzzy_ratio("extracted", "truth"))
    right = (F.col("ratio") >= threshold) | (F.col("extracted") == F.col("truth"))
    return scored.groupBy("field_name").agg(F.count("*").alias("total"), F.count_if(right).alias("correct"), F.avg("ratio").alias("similarity"), F.avg(token_overlap(F.col("extracted"), F.col("truth"))).alias("overlap"))


@query()
def a38_fuzzy_per_field(r: Relations) -> DataFrame:
    """Fuzzy evaluation per field (A37 and F16 to F19 share the matcher)."""
    x = fuzzy_confusion(against_truth(r))
    return x.withColumn("accuracy", F.col("correct") / F.col("total"))


@query(TRUTH + " select field_name, count(*) filter (extracted = truth) as tp, count(*) filter (extracted <> truth) as fn, 0 as fp, 0 as tn from g group by all")
def a39_binary_confusion(r: Relations) -> DataFrame:
    """Every key is positive, so there are no false positives."""
    same = F.col("extracted") == F.col("truth")
    return against_truth(r).groupBy("field_name").agg(F.count_if(same).alias("tp"), F.count_if(~same).alias("fn"), F.lit(0).alias("fp"), F.lit(0).alias("tn"))


def paired_t(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """``n``, ``df``, ``t`` and Cohen's ``d`` of paired differences, deviations with one degree of freedom taken."""
    x = F.col(after) - F.col(before)
    s = pairs.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    return s.select("n", (F.col("n") - 1).alias("df"), (F.col("mean") / (F.col("sd") / F.sqrt("n"))).alias("t"), (F.col("mean") / F.col("sd")).alias("d"))


def t_pvalue(t: float, df: int) -> float:
    """Two-sided p-value of a t statistic: the regularised incomplete beta function by its continued fraction."""
    from math import exp, lgamma, log

    x, a, b = df / (df + t * t), df / 2, 0.5
    if x in (0.0, 1.0):
        return x

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
        h = d
        for m in range(1, 400):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + k * d or tiny)
                c = 1 + k / c or tiny
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


@query(""", p as (select template_id, avg(extraction_time_ms) filter (phase = 'baseline') as b, avg(extraction_time_ms) filter (phase = 'adaptive') as a from docs_x group by all)
select count(*) as n, count(*) - 1 as df, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) as t, round(avg(a - b) / stddev_samp(a - b), 6) as d from p""")
def a40_paired_t(r: Relations) -> DataFrame:
    """Paired test over templates, baseline against adaptive."""
    of = lambda p: F.avg(F.when(F.col("phase") == p, F.col("extraction_time_ms")))
    p = r.documents.groupBy("template_id").agg(of("baseline").alias("b"), of("adaptive").alias("a"))
    return paired_t(p, "b", "a").select("n", "df", F.round("t", 6).alias("t"), F.round("d", 6).alias("d"))


def bootstrap(values: DataFrame, column: str, by: list[str] | None = None, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """``n``, ``mean``, ``std``, ``least``, ``most``, ``low``, ``high`` of the means of ``replicates`` resamples of all rows, for each group of ``by``.

    A row's weight in a resample is a Poisson(1) number, so rows need not know each other (Poisson bootstrap).
    Rows of equal value are drawn together: n of them have a Poisson(n) weight. Draws are seeded by value, group
    and ``seed`` and so are the same on every run and in any partitioning. ``low`` and ``high`` are percentiles 2.5
    and 97.5 with linear interpolation; ``std`` is that of the population. Nulls and NaN take no part; a group
    without values has no row.

    Rows are counted by value first. A task then keeps two arrays of ``replicates`` sums for the group at hand and hands
    on one row per group, so what is shuffled is groups x tasks x replicates numbers, whatever the rows.
    """
    if not by:  # all rows are one group
        return bootstrap(values.select(F.lit(1).alias("all"), column), column, ["all"], replicates, seed).drop("all")
    x = F.col(column).cast("double")
    counted = values.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by, x.alias("v")).agg(F.count("*").alias("n"))
    keyed = counted.select(F.to_json(F.struct(F.lit(1).alias("_"), *by)).alias("g"), F.struct(F.lit(1).alias("_"), *by).alias("group"), "v", "n", F.xxhash64("v", *by).alias("h"))
    keyed = keyed.sortWithinPartitions("g", "v")
    shape = T.StructType([keyed.schema["group"], T.StructField("n", T.LongType()), T.StructField("totals", T.ArrayType(T.DoubleType())), T.StructField("weights", T.ArrayType(T.LongType()))])

    def draw(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def row(group, n, totals, weights):
            return pa.RecordBatch.from_arrays([group, pa.array([n]), pa.array([totals], pa.list_(pa.float64())), pa.array([weights], pa.list_(pa.int64()))], names=["group", "n", "totals", "weights"])

        now, group, n, totals, weights = None, None, 0, None, None
        for batch in batches:
            for k, (g, v, count, h) in enumerate(zip(batch.column(0).to_pylist(), *(batch.column(c).to_pylist() for c in (2, 3, 4)))):
                if g != now:
                    if now is not None:
                        yield row(group, n, totals, weights)
                    now, group, n, totals, weights = g, batch.column(1).slice(k, 1), 0, np.zeros(replicates), np.zeros(replicates, np.int64)
                w = poisson_weights(h, count, replicates, seed)
                n += count
                totals += w * v
                weights += w
        if now is not None:
            yield row(group, n, totals, weights)

    sums = keyed.mapInArrow(draw, shape)
    keys = [F.col(f"group.{c}").alias(c) for c in by]
    each = sums.select(*keys, "n", F.posexplode(F.arrays_zip("totals", "weights")).alias("rep", "x")).groupBy(*by, "rep").agg(F.sum("n").alias("n"), F.try_divide(F.sum("x.totals"), F.sum("x.weights")).alias("m"))
    return each.where("m is not null").groupBy(*by).agg(
        F.max("n").alias("n"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.min("m").alias("least"), F.max("m").alias("most"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")
    )


def poisson_weights(h: int, n: int, replicates: int, seed: int):
    """The weights of ``n`` equal rows in every resample."""
    import numpy as np

    return np.random.Generator(np.random.Philox(key=[h & (2**64 - 1), seed])).poisson(n, replicates)


@query()
def a41_bootstrap(r: Relations) -> DataFrame:
    """Confidence intervals of each field's mean confidence over all facts."""
    return bootstrap(r.facts, "confidence", ["field_name"])


@query()
def a41_bootstrap_accuracy(r: Relations) -> DataFrame:
    """Confidence intervals of accuracy by template, resampling the documents' fields, and of all together."""
    hits = against_truth(r).join(r.documents.select("document_id", "template_name"), "document_id").select("template_name", (F.col("extracted") == F.col("truth")).cast("double").alias("hit"))
    return bootstrap(hits, "hit", ["template_name"])


@query(TRUTH + """, x as (select count(*) as n, count(*) filter (extracted <> truth) as wrong, count(*) filter (extracted = truth) as correct from g)
select wrong / n as rate, wrong / (correct / n * 100) as per_point from x""")
def a44_correction_rate(r: Relations) -> DataFrame:
    """Corrections per field, and per percentage point of accuracy."""
    same = F.col("extracted") == F.col("truth")
    x = against_truth(r).agg(F.count("*").alias("n"), F.count_if(~same).alias("wrong"), F.count_if(same).alias("correct"))
    return x.select((F.col("wrong") / F.col("n")).alias("rate"), (F.col("wrong") / (F.col("correct") / F.col("n") * 100)).alias("per_point"))


@query(""", y as (select method as gold, case when l_partkey % 6 = 0 then 'crf' else method end as pred from facts),
l as (select gold as label, count(*) as support, count(*) filter (gold = pred) as tp from y group by all), q as (select pred as label, count(*) as n from y group by all),
m as (select support, tp / nullif(n, 0) as p, tp / support as r from l left join q using (label))
select round(sum(support * p) / sum(support), 9) as precision, round(sum(support * r) / sum(support), 9) as recall, round(sum(support * 2 * p * r / (p + r)) / sum(support), 9) as f1 from m""")
def a62_sequence_scores(r: Relations) -> DataFrame:
    """Support-weighted precision, recall and F1 of a label column."""
    y = r.facts.select(F.col("method").alias("gold"), F.when(F.col("l_partkey") % 6 == 0, "crf").otherwise(F.col("method")).alias("pred"))
    return weighted_scores(y)


def weighted_scores(y: DataFrame, times: Column | None = None) -> DataFrame:
    """Scores of ``gold`` against ``pred``, labels weighted by support; a row counts ``times`` (default: once)."""
    y = y.groupBy("gold", "pred").agg((F.count("*") if times is None else F.sum(times)).alias("n"))
    gold = y.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.coalesce(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n"))), F.lit(0)).alias("tp"))
    m = gold.join(y.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("n")), "label", "left")
    p, q, s = F.coalesce(F.try_divide("tp", "n"), F.lit(0.0)), F.col("tp") / F.col("support"), F.col("support")
    mean = lambda x: F.round(F.sum(s * x) / F.sum(s), 9)
    return m.agg(mean(p).alias("precision"), mean(q).alias("recall"), mean(f1(p, q)).alias("f1"))


RESULT = T.StructType(
    [
        T.StructField("document_id", T.LongType()),
        T.StructField("extracted_data", T.MapType(T.StringType(), T.StringType())),
        T.StructField("confidence_scores", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("extraction_methods", T.MapType(T.StringType(), T.StringType())),
        T.StructField("extraction_time_ms", T.LongType()),
    ]
)


def facts_from_json(spark: SparkSession, path: str) -> DataFrame:
    """The long fact table from JSON extraction results, one per line; each blob is parsed once and what doesn't parse is left out."""
    parsed = spark.read.text(path).select(F.from_json("value", RESULT).alias("x")).where("x.extracted_data is not null").select("x.*")
    long = parsed.select("document_id", F.explode("extracted_data").alias("field_name", "value"), "confidence_scores", "extraction_methods")
    return long.select("document_id", "field_name", "value", F.col("confidence_scores")[F.col("field_name")].alias("confidence"), F.coalesce(F.col("extraction_methods")[F.col("field_name")], F.lit("unknown")).alias("method"))


def truth_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth from files named by document, each a map of field to value."""
    files = spark.read.option("wholetext", True).text(path).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json$", 1).cast("long").alias("document_id"))
    return files.select("document_id", F.explode(F.from_json("value", "map<string,string>")).alias("field_name", "truth"))


def experiments_from_json(spark: SparkSession, path: str) -> DataFrame:
    """``kind``, ``template_id`` from names like ``baseline_template_2.json``, and the figures in each file."""
    name = F.col("_metadata.file_name")
    rows = spark.read.option("multiLine", True).json(path).select("*", F.regexp_extract(name, r"^([a-z]+)_", 1).alias("kind"), F.regexp_extract(name, r"(\d+)\.json$", 1).cast("long").alias("template_id"))
    return rows


def curves_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Points of learning curves, arrays of ``batch`` and ``accuracy``, with ``template_id`` from the file's name."""
    points = spark.read.option("multiLine", True).schema("batch long, accuracy double").json(path)
    return points.select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json$", 1).cast("long").alias("template_id"), "batch", "accuracy")


def write_results(facts: DataFrame, path: str, kind: str = "json") -> None:
    """Facts as JSON results per document, or as CSV rows."""
    if kind == "csv":
        facts.write.mode("overwrite").option("header", True).csv(path)
        return
    cells = facts.groupBy("document_id").agg(*(F.map_from_entries(F.collect_list(F.struct("field_name", c))).alias(n) for c, n in (("value", "extracted_data"), ("confidence", "confidence_scores"), ("method", "extraction_methods"))))
    cells.write.mode("overwrite").json(path)


def as_column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def learning_points(curve: DataFrame, series: str, order: str, accuracy: str) -> DataFrame:
    """A learning curve with each point's gain on the first and on the one before."""
    w = Window.partitionBy(series).orderBy(order)
    a = as_column(accuracy)
    return curve.withColumn("improvement", a - F.first(a).over(w)).withColumn("delta", F.coalesce(a - F.lag(a).over(w), F.lit(0.0)))
