"""Ordered operators: row batches, trailing means, deltas, sessions and folds. Every order has a total key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.metrics import COUNTS, document_counts
from fieldloom.plans.registry import query
from fieldloom.sources.relations import Relations

BATCH = 5
ORDER = ("created_at", "document_id")


CHUNK = 1000  # rows of a dense order that a window holds at once


def numbered(rows: DataFrame, number: str = "rn", total: str | None = None) -> DataFrame:
    """``rows`` with their number (from 1) within their template by ``ORDER``, and the template's total if named.

    Rows are ranked within a template and day; the days before add up in a table of one row per template and
    day. So no task sorts a whole template, however large.
    """
    day = F.to_date("created_at")
    sizes = rows.groupBy("template_id", day.alias("day")).agg(F.count("*").alias("size"))
    days = Window.partitionBy("template_id")
    base = F.coalesce(F.sum("size").over(days.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    bases = sizes.select("template_id", "day", base, F.sum("size").over(days).alias("of"))
    local = F.row_number().over(Window.partitionBy("template_id", "day").orderBy(*ORDER))
    out = rows.withColumn("day", day).withColumn("local", local).join(bases, ["template_id", "day"])
    kept = [*rows.columns, (F.col("base") + F.col("local")).alias(number)]
    return out.select(*kept, F.col("of").alias(total)) if total else out.select(*kept)


class Trail:
    """Windows of a few rows back over a dense order ``at`` within a template, in chunks that bring along the rows before them."""

    def __init__(self, rows: DataFrame, at: str = "batch", back: int = 1):
        chunk = ((F.col(at) - 1) / CHUNK).cast("long")
        near = F.when((F.col(at) - 1) % CHUNK >= CHUNK - back, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
        self.rows = rows.withColumn("chunk", F.explode(near)).withColumn("own", F.col("chunk") == chunk)
        self.order = Window.partitionBy("template_id", "chunk").orderBy(at)

    def add(self, **columns) -> DataFrame:
        """The rows with columns made by functions of the window."""
        return self.rows.withColumns({name: f(self.order) for name, f in columns.items()}).where("own").drop("chunk", "own")


def running(rows: DataFrame, at: str, *columns: str, inclusive: bool = True) -> DataFrame:
    """``rows`` with the sums of ``columns`` over all rows of the template up to ``at`` (or before it): sums in a chunk plus sums of the chunks before."""
    chunk = ((F.col(at) - 1) / CHUNK).cast("long")
    keyed = rows.withColumn("chunk", chunk)
    before = Window.partitionBy("template_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("template_id", "chunk").agg(*(F.sum(c).alias(f"sum_{c}") for c in columns))
    sums = sums.select("template_id", "chunk", *(F.coalesce(F.sum(f"sum_{c}").over(before), F.lit(0)).alias(f"base_{c}") for c in columns))
    inside = Window.partitionBy("template_id", "chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = keyed.withColumns({f"upto_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns}).join(sums, ["template_id", "chunk"])
    return out.select(*rows.columns, *((F.col(f"upto_{c}") + F.col(f"base_{c}")).alias(f"upto_{c}") for c in columns))


BATCHES = f""", {COUNTS}, o as (select *, (row_number() over (partition by template_id order by created_at, document_id) - 1) // {BATCH} + 1 as batch from acc),
bt as (select template_id, batch, count(*) as documents, cast(sum(fields) as bigint) as fields, cast(sum(greatest(0, fields - corrections)) as bigint) as correct from o group by all)"""


def batches(r: Relations) -> DataFrame:
    """Fields and right fields of each batch."""
    right = F.greatest(F.lit(0), F.col("fields") - F.col("corrections"))
    rows = numbered(document_counts(r)).withColumn("batch", F.expr(f"(rn - 1) div {BATCH} + 1"))
    return rows.groupBy("template_id", "batch").agg(F.count("*").alias("documents"), F.sum("fields").alias("fields"), F.sum(right).alias("correct"))


@query(BATCHES + " select template_id, batch, documents, case when fields > 0 then correct / fields else 0.0 end as accuracy from bt")
def w02_row_batches(r: Relations) -> DataFrame:
    """Accuracy of every batch of five documents, the last partial one kept."""
    return batches(r).select("template_id", "batch", "documents", F.when(F.col("fields") > 0, F.col("correct") / F.col("fields")).otherwise(0.0).alias("accuracy"))


@query(BATCHES + """, f as (select * from bt where documents = 5),
c as (select template_id, batch, sum(correct) over w / nullif(sum(fields) over w, 0) as after from f window w as (partition by template_id order by batch))
select template_id, batch, after, coalesce(lag(after) over (partition by template_id order by batch), 0.0) as before from c""")
def w03_cumulative_batches(r: Relations) -> DataFrame:
    """Accuracy over all documents up to each full batch, and before it."""
    full = running(batches(r).where(F.col("documents") == BATCH), "batch", "correct", "fields").withColumn("after", F.try_divide("upto_correct", "upto_fields"))
    return Trail(full).add(before=lambda w: F.coalesce(F.lag("after").over(w), F.lit(0.0))).select("template_id", "batch", "after", "before")


@query(BATCHES + """, a as (select template_id, batch, case when fields > 0 then correct / fields else 0.0 end as accuracy from bt)
select template_id, batch, round(avg(accuracy) over (partition by template_id order by batch rows 2 preceding), 9) as smooth from a""")
def w04_trailing_mean(r: Relations) -> DataFrame:
    """Mean of each batch's accuracy and the two before it."""
    s = Trail(w02_row_batches(r), back=2).add(smooth=lambda w: F.avg("accuracy").over(w.rowsBetween(-2, 0)))
    return s.select("template_id", "batch", F.round("smooth", 9).alias("smooth"))


@query(BATCHES + """, a as (select template_id, batch, case when fields > 0 then correct / fields else 0.0 end as accuracy from bt),
s as (select template_id, batch, avg(accuracy) over (partition by template_id order by batch rows 2 preceding) as smooth from a)
select template_id, count(*) as batches, round((max_by(smooth, batch) - min_by(smooth, batch)) / nullif(min_by(smooth, batch), 0) * 100, 6) as improvement, round(greatest(0.0, 1 - stddev_pop(smooth)), 6) as stability from s group by all""")
def a08_learning_progress(r: Relations) -> DataFrame:
    """Improvement from the first to the last smoothed batch in percent, and one minus their deviation."""
    s = Trail(w02_row_batches(r), back=2).add(smooth=lambda w: F.avg("accuracy").over(w.rowsBetween(-2, 0)))
    first, last = F.min_by("smooth", "batch"), F.max_by("smooth", "batch")
    return s.groupBy("template_id").agg(F.count("*").alias("batches"), F.round(F.try_divide(last - first, first) * 100, 6).alias("improvement"), F.round(F.greatest(F.lit(0.0), 1 - F.stddev_pop("smooth")), 6).alias("stability"))


@query(BATCHES + """, f as (select * from bt where documents = 5),
c as (select template_id, batch, sum(correct) over w / nullif(sum(fields) over w, 0) as after from f window w as (partition by template_id order by batch)),
d as (select template_id, batch, after - lag(after) over (partition by template_id order by batch) as gain from c)
select template_id, count(*) as batches, round(avg(gain) filter (gain > 0), 9) as mean_gain, round(sum(gain), 9) as total_gain, max_by(batch, gain) as best_batch from d group by all""")
def a17_incremental_summary(r: Relations) -> DataFrame:
    """Gains from batch to batch: mean of the positive ones, their sum, the best batch."""
    d = w03_cumulative_batches(r).withColumn("gain", F.when(F.col("batch") > 1, F.col("after") - F.col("before")))
    return d.groupBy("template_id").agg(F.count("*").alias("batches"), F.round(F.avg(F.when(F.col("gain") > 0, F.col("gain"))), 9).alias("mean_gain"), F.round(F.sum("gain"), 9).alias("total_gain"), F.max_by("batch", "gain").alias("best_batch"))


LENGTHS = """, v as (select field_name, length(corrected_value) as vlen, row_number() over (partition by field_name order by length(corrected_value), feedback_id) as rn,
  count(*) over (partition by field_name) as cnt from feedback)"""


@query(LENGTHS + " select field_name, max(case when rn >= cast(floor(0.9 * cnt) as integer) then vlen end) as p90, any_value(cnt) as n from v group by all")
def w01_p90_literal(r: Relations) -> DataFrame:
    """The longest length from rank 0.9 n on, which is the longest of all; ``w01_p90`` is the percentile."""
    return r.feedback.groupBy("field_name").agg(F.max(F.length("corrected_value")).alias("p90"), F.count("*").alias("n"))


@query(" select field_name, round(quantile_cont(length(corrected_value), 0.9), 6) as p90, count(*) as n from feedback group by all")
def w01_p90(r: Relations) -> DataFrame:
    """The 90th percentile of corrected lengths, interpolated."""
    return r.feedback.groupBy("field_name").agg(F.round(F.percentile(F.length("corrected_value"), F.lit(0.9)), 6).alias("p90"), F.count("*").alias("n"))


@query(""" select document_id, template_id, row_number() over (partition by template_id order by created_at, document_id) as idx,
avg(extraction_time_ms) over (partition by template_id order by created_at, document_id rows 4 preceding) as smooth from docs_x where extraction_time_ms > 0""")
def w05_time_trend(r: Relations) -> DataFrame:
    """Mean of each document's extraction time and the four before it."""
    timed = numbered(r.documents.where("extraction_time_ms > 0").select("document_id", "template_id", "created_at", "extraction_time_ms"), "idx")
    s = Trail(timed, "idx", back=4).add(smooth=lambda w: F.avg("extraction_time_ms").over(w.rowsBetween(-4, 0)))
    return s.select("document_id", "template_id", "idx", "smooth")


@query(f""", {COUNTS}, l as (select * from acc qualify row_number() over (partition by template_id order by created_at desc, document_id desc) <= 100)
select document_id, template_id, round(avg(coalesce(accuracy, 1.0)) over (partition by template_id order by created_at, document_id rows 4 preceding), 9) as smooth from l""")
def w06_last_hundred(r: Relations) -> DataFrame:
    """Trailing mean of five over a template's last hundred documents."""
    rows = numbered(document_counts(r), total="n").where("rn > n - 100")
    w = Window.partitionBy("template_id").orderBy("rn").rowsBetween(-4, 0)  # a hundred rows each
    return rows.select("document_id", "template_id", F.round(F.avg(F.coalesce("accuracy", F.lit(1.0))).over(w), 9).alias("smooth"))


@query(""", o as (select template_id, extraction_time_ms as t, row_number() over (partition by template_id order by created_at, document_id) as a,
  row_number() over (partition by template_id order by created_at desc, document_id desc) as z from docs_x where extraction_time_ms > 0)
select template_id, avg(t) filter (a <= 10) as first_ten, avg(t) filter (z <= 10) as last_ten, (avg(t) filter (z <= 10) - avg(t) filter (a <= 10)) / avg(t) filter (a <= 10) * 100 as change from o group by all""")
def w07_first_and_last(r: Relations) -> DataFrame:
    """The first ten documents against the last ten; they overlap where there are fewer than twenty."""
    timed = r.documents.where("extraction_time_ms > 0").select("document_id", "template_id", "created_at", "extraction_time_ms")
    o = numbered(timed, "a", "n").withColumn("z", F.col("n") - F.col("a") + 1).where("a <= 10 or z <= 10")
    first, last = (F.avg(F.when(F.col(c) <= 10, F.col("extraction_time_ms"))) for c in "az")
    return o.groupBy("template_id").agg(first.alias("first_ten"), last.alias("last_ten"), ((last - first) / first * 100).alias("change"))


@query(BATCHES + """, a as (select template_id, batch, case when fields > 0 then correct / fields else 0.0 end as accuracy from bt)
select template_id, batch, coalesce(accuracy - lag(accuracy) over w, 0.0) as delta, accuracy - first_value(accuracy) over w as gain from a window w as (partition by template_id order by batch)""")
def w08_batch_delta(r: Relations) -> DataFrame:
    """Each batch against the one before and against the first."""
    rows, a = w02_row_batches(r), F.col("accuracy")
    first = rows.where("batch = 1").select("template_id", a.alias("first"))
    d = Trail(rows).add(delta=lambda w: F.coalesce(a - F.lag(a).over(w), F.lit(0.0)))
    return d.join(first, "template_id").select("template_id", "batch", "delta", (a - F.col("first")).alias("gain"))


@query(BATCHES + """, a as (select template_id, batch, case when fields > 0 then correct / fields else 0.0 end as accuracy from bt),
d as (select template_id, batch, abs(accuracy - lag(accuracy) over (partition by template_id order by batch)) as delta from a)
select template_id, min(batch) filter (coalesce(delta, 0.0) < 0.01) as literal, min(batch) filter (delta < 0.01) as settled from d group by all""")
def w10_convergence(r: Relations) -> DataFrame:
    """First batch that changed by under a hundredth: ``literal`` counts the first one's zero, ``settled`` doesn't."""
    d = Trail(w02_row_batches(r)).add(delta=lambda w: F.abs(F.col("accuracy") - F.lag("accuracy").over(w)))
    at = lambda c: F.min(F.when(c < 0.01, F.col("batch")))
    return d.groupBy("template_id").agg(at(F.coalesce("delta", F.lit(0.0))).alias("literal"), at(F.col("delta")).alias("settled"))


@query(""", s as (select document_id, field_name, strategy, idx, confidence * 0.35 + (3 - idx) / 3.0 * 0.25 + 0.5 * 0.4 as score from attempts where success)
select document_id, field_name, strategy, round(score - coalesce(lead(score) over w, 0.0), 9) as margin from s window w as (partition by document_id, field_name order by score desc, idx) qualify row_number() over w = 1""")
def w11_winner_selection(r: Relations) -> DataFrame:
    """The best-scoring strategy of each field and its lead over the next."""
    score = F.col("confidence") * 0.35 + (3 - F.col("idx")) / F.lit(3.0) * 0.25 + F.lit(0.5) * 0.4
    w = Window.partitionBy("document_id", "field_name").orderBy(F.desc("score"), "idx")
    s = r.attempts.where("success").withColumn("score", score).withColumn("next", F.lead("score").over(w)).withColumn("rn", F.row_number().over(w))
    return s.where("rn = 1").select("document_id", "field_name", "strategy", F.round(F.col("score") - F.coalesce("next", F.lit(0.0)), 9).alias("margin"))


@query(" select document_id, field_name, strategy || '_fallback' as method, confidence from attempts where confidence > 0 and success qualify row_number() over (partition by document_id, field_name order by confidence desc, idx) = 1")
def w12_fallback_selection(r: Relations) -> DataFrame:
    """Most confident attempt above zero; ties to the strategy tried first."""
    best = F.min(F.struct((-F.col("confidence")).alias("k"), "idx", "strategy", "confidence")).alias("x")
    x = r.attempts.where("confidence > 0 and success").groupBy("document_id", "field_name").agg(best)
    return x.select("document_id", "field_name", F.concat("x.strategy", F.lit("_fallback")).alias("method"), "x.confidence")


@query(" select template_id, type, job_id, created_at from jobs qualify row_number() over (partition by template_id, type order by created_at desc, job_id desc) = 1")
def w13_latest_per_key(r: Relations) -> DataFrame:
    """The newest job of each template and type, by a hash aggregate rather than a sort."""
    x = r.jobs.groupBy("template_id", "type").agg(F.max(F.struct("created_at", "job_id")).alias("x"))
    return x.select("template_id", "type", "x.job_id", "x.created_at")


@query(""", s as (select field_id, job_id, created_at, case when epoch_us(created_at) - epoch_us(lag(created_at) over w) < 3600000000 then 0 else 1 end as opens from jobs window w as (partition by field_id order by created_at, job_id)),
g as (select *, sum(opens) over (partition by field_id order by created_at, job_id) as session from s)
select field_id, cast(session as bigint) as session, count(*) as n, min(created_at) as begins, max(created_at) as ends from g group by all""")
def w17_sessions(r: Relations) -> DataFrame:
    """Gaps and islands: a new group where the gap to the row before is an hour or more."""
    w = Window.partitionBy("field_id").orderBy("created_at", "job_id")
    gap = F.unix_micros(F.col("created_at").cast("timestamp")) - F.lag(F.unix_micros(F.col("created_at").cast("timestamp"))).over(w)
    g = r.jobs.withColumn("opens", F.when(gap < 3_600_000_000, 0).otherwise(1)).withColumn("session", F.sum("opens").over(w))
    return g.groupBy("field_id", "session").agg(F.count("*").alias("n"), F.min("created_at").alias("begins"), F.max("created_at").alias("ends"))


@query(""", k as (select type, percentile_cont(0.5) within group (order by duration) as median from jobs group by all),
d as (select field_id, type, (epoch_us(created_at) - epoch_us(lag(created_at) over (partition by field_id order by created_at, job_id))) / 1e6 as seconds from jobs)
select type, round(avg(seconds), 6) as mean, round(median(seconds), 6) as middle, min(seconds) as low, max(seconds) as high, round(stddev_pop(seconds), 3) as deviation, round(60 / avg(seconds), 9) as per_minute from d where seconds is not null group by all""")
def a42_interval_stats(r: Relations) -> DataFrame:
    """Seconds between successive points and their statistics, with the throughput they imply."""
    w = Window.partitionBy("field_id").orderBy("created_at", "job_id")
    micros = F.unix_micros(F.col("created_at").cast("timestamp"))
    d = r.jobs.select("type", ((micros - F.lag(micros).over(w)) / F.lit(1e6)).alias("s")).where("s is not null")
    return d.groupBy("type").agg(
        F.round(F.avg("s"), 6).alias("mean"), F.round(F.median("s"), 6).alias("middle"), F.min("s").alias("low"), F.max("s").alias("high"),
        F.round(F.stddev_pop("s"), 3).alias("deviation"), F.round(60 / F.avg("s"), 9).alias("per_minute"),
    )


@query(""", o as (select template_id, document_id, status, row_number() over (partition by template_id order by created_at, document_id) as rn, count(*) over (partition by template_id) as n from docs_x),
b as (select template_id, (rn - 1) // 1000 + 1 as fold, count(*) as size from o group by all)
select b.template_id, b.fold as step, coalesce(sum(t.size), 0)::bigint as train, any_value(b.size) as test from b left join b t on t.template_id = b.template_id and t.fold < b.fold group by all""")
def w23_incremental_evaluation(r: Relations) -> DataFrame:
    """Sizes of the training prefix and the test batch of each step; the prefix is a running sum, not a self-join."""
    rows = numbered(r.documents.select("document_id", "template_id", "created_at"))
    b = rows.groupBy("template_id", F.expr("(rn - 1) div 1000 + 1").alias("step")).agg(F.count("*").alias("test"))
    return running(b, "step", "test", inclusive=False).select("template_id", "step", F.col("upto_test").alias("train"), "test")


@query()
def w22_folds(r: Relations) -> DataFrame:
    """Five folds and an 80/20 split by a hash of id and seed: the same on every run and machine."""
    h = F.xxhash64("document_id", F.lit(42))
    return r.documents.select("document_id", F.pmod(h, F.lit(5)).cast("int").alias("fold"), (F.pmod(F.xxhash64("document_id", F.lit(43)), F.lit(10)) >= 8).alias("test"))
