"""Retraining runs (E14): gated stages, each written once under the run's id, and the history of what runs came to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.plans.registry import query
from fieldloom.sources.relations import Relations
from fieldloom.streaming.learning import scratch

MIN_SAMPLES, MIN_DIVERSITY = 20, 0.3
HELD_OUT = 5  # one sample in so many is for evaluation
RECORD = "run_id string, template_id long, status string, reason string, samples long, train long, test long, correct long, accuracy double"


class Ledger:
    """Stages and records of runs below one path that all of the cluster shares.

    A stage's result is a table under the run's id. One that is complete (Spark's ``_SUCCESS`` lies in it) is read,
    not made again, so a run that failed and is started again goes on at the stage that failed; a table that a
    failure left in part is replaced. Records go to ``history`` under the number of the run's entry, which is
    given once, when the run first records, and counts the runs recorded before.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def complete(self, table: str) -> bool:
        make, fs = self._files()
        return fs.exists(make(f"{self.path}/{table}/_SUCCESS"))

    def stage(self, run_id: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The result of a stage of a run: read if it is complete, else made by ``make`` and written."""
        table = f"runs/{run_id}/{name}"
        if not self.complete(table):
            make().write.mode("overwrite").parquet(f"{self.path}/{table}")
        return self.spark.read.parquet(f"{self.path}/{table}")

    def record(self, run_id: str, rows: DataFrame) -> None:
        """Add a run's records to the history, once."""
        make, fs = self._files()
        found = [x.getPath().getName() for x in fs.globStatus(make(f"{self.path}/history/*")) or ()]
        mine = next((n for n in found if n.split("-", 1)[1] == run_id), f"{len(found):08d}-{run_id}")
        if not self.complete(f"history/{mine}"):
            rows.write.mode("overwrite").parquet(f"{self.path}/history/{mine}")

    def history(self) -> DataFrame:
        """``RECORD`` and ``entry``: all records, ``entry`` in the order in which runs were recorded."""
        make, fs = self._files()
        done = [str(x.getPath().getParent()) for x in fs.globStatus(make(f"{self.path}/history/*/_SUCCESS")) or ()]
        if not done:
            return self.spark.createDataFrame([], RECORD + ", entry long")
        entry = F.regexp_extract(F.input_file_name(), r"/(\d{8})-[^/]*/[^/]*$", 1).cast("long")
        return self.spark.read.schema(RECORD).parquet(*done).withColumn("entry", entry)


def most_common_correction(train: DataFrame, test: DataFrame) -> DataFrame:
    """``test`` plus ``predicted``: the commonest correction of the same value of the same field, else of the value as it is. A stand-in for a model."""
    n = train.groupBy("template_id", "field_name", "original_value", "corrected_value").agg(F.count("*").alias("n"))
    best = n.groupBy("template_id", "field_name", "original_value").agg(F.min(F.struct((-F.col("n")).alias("k"), "corrected_value"))["corrected_value"].alias("learned"))
    return test.join(best, ["template_id", "field_name", "original_value"], "left").withColumn("predicted", F.coalesce("learned", "original_value"))


def retrain(samples: DataFrame, ledger: Ledger, run_id: str, scorer: Callable[[DataFrame, DataFrame], DataFrame] = most_common_correction, min_samples: int = MIN_SAMPLES, min_diversity: float = MIN_DIVERSITY) -> DataFrame:
    """One run over all templates of ``samples``: validate, split, evaluate, record; returns the run's records.

    ``samples`` has ``feedback_id``, ``template_id``, ``field_name``, ``original_value``, ``corrected_value``. Templates with less than
    ``min_samples`` samples, or less than ``min_diversity`` distinct corrections a sample, are rejected with the reason
    and go no further. Of the others a fifth, by id, is held out; ``scorer`` learns from the rest and gives the held-out
    rows a ``predicted``. Any model fits there.
    """
    checked = ledger.stage(run_id, "validate", lambda: _validated(samples, min_samples, min_diversity))
    parts = ledger.stage(run_id, "split", lambda: samples.join(checked.where("reason is null").select("template_id"), "template_id", "left_semi").withColumn("held_out", F.pmod(F.col("feedback_id"), F.lit(HELD_OUT)) == 0))

    def evaluated() -> DataFrame:
        scored = scorer(parts.where("not held_out"), parts.where("held_out"))
        return scored.groupBy("template_id").agg(F.count("*").alias("test"), F.count_if(F.col("predicted").eqNullSafe(F.col("corrected_value"))).alias("correct"))

    scores = ledger.stage(run_id, "evaluate", evaluated)
    train = parts.where("not held_out").groupBy("template_id").agg(F.count("*").alias("train"))
    rows = checked.join(train, "template_id", "left").join(scores, "template_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    status = F.when(F.col("reason").isNull(), "completed").otherwise("rejected")
    rows = rows.select(F.lit(run_id).alias("run_id"), "template_id", status.alias("status"), "reason", "samples", none("train"), none("test"), none("correct"), F.try_divide("correct", "test").alias("accuracy"))
    ledger.record(run_id, rows)
    return ledger.history().where(F.col("run_id") == run_id).drop("entry")


def _validated(samples: DataFrame, min_samples: int, min_diversity: float) -> DataFrame:
    counts = samples.groupBy("template_id", "corrected_value").agg(F.count("*").alias("n")).groupBy("template_id").agg(F.sum("n").alias("samples"), (F.count("*") / F.sum("n")).alias("diversity"))
    reason = F.when(F.col("samples") < min_samples, "too few samples").when(F.col("diversity") < min_diversity, "too little diversity")
    return counts.withColumn("reason", reason)


@query(""", s as (select feedback_id, template_id, field_name, original_value, corrected_value, feedback_id % 5 = 0 as held from feedback join docs_x using (document_id)),
v as (select template_id, count(*) as samples, count(distinct corrected_value) / count(*) as diversity from s group by all), ok as (select template_id from v where samples >= 20 and diversity >= 0.3),
n as (select template_id, field_name, original_value, corrected_value, count(*) as n from s join ok using (template_id) where not held group by all),
b as (select * from n qualify row_number() over (partition by template_id, field_name, original_value order by n desc, corrected_value) = 1),
e as (select s.template_id, count(*) as test, count(*) filter (coalesce(b.corrected_value, s.original_value) = s.corrected_value) as correct from s join ok using (template_id)
  left join b on b.template_id = s.template_id and b.field_name = s.field_name and b.original_value = s.original_value where held group by all),
t as (select template_id, count(*) as train from s join ok using (template_id) where not held group by all)
select template_id, case when samples < 20 or diversity < 0.3 then 'rejected' else 'completed' end as status, case when samples < 20 then 'too few samples' when diversity < 0.3 then 'too little diversity' end as reason, samples,
  coalesce(train, 0) as train, coalesce(test, 0) as test, coalesce(correct, 0) as correct, correct / test as accuracy from v left join t using (template_id) left join e using (template_id)""")
def e14_retraining_run(r: Relations) -> DataFrame:
    """What a retraining run of every template records: gate, split and held-out accuracy."""
    samples = r.feedback.join(r.documents.select("document_id", "template_id"), "document_id").select("feedback_id", "template_id", "field_name", "original_value", "corrected_value")
    return retrain(samples, Ledger(r.spark, scratch(r.spark, "ledger")), "all").drop("run_id")
