"""The learning loop on streams: counters that trigger jobs, upserts, running means and event-time windows.

Every stage is keyed (template, field) so that state spreads over the cluster, and keeps one small row a key.
``available_now`` runs a stream over what is there and stops, which is also how tests compare it with batch.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldloom.plans.registry import query
from fieldloom.sources.relations import Relations

TRIGGER_AT = 5


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share; a local one only where none is set and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def available_now(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run ``stream`` over all input there is, into Parquet, and read the result; in complete mode the last batch is the result.

    A batch is written under its number, so one that is tried again after a failure replaces its own rows.
    """
    spark = stream.sparkSession
    out, state = scratch(spark, "stream"), scratch(spark, "stream-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/number={number}")

    schema = stream.schema
    stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    try:
        return spark.read.schema(schema).parquet(out if mode == "complete" else f"{out}/number=*")
    except AnalysisException:  # no batch was written: the input is empty
        return spark.createDataFrame([], schema)


def table_stream(r: Relations, name: str, files: int = 4) -> DataFrame:
    """A table as a stream, ``files`` files a micro-batch."""
    schema = r.table(name).schema
    return r.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{r.sf_dir}/{name}.parquet*")


def count_triggers(feedback: DataFrame, at: int = TRIGGER_AT) -> DataFrame:
    """A row (``template_id``, ``field_id``, ``job``, ``seen``) each time a key's count passes a multiple of ``at``; the rest carries over."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        before = seen
        seen += sum(len(b) for b in batches)
        state.update((seen,))
        jobs = list(range(before // at + 1, seen // at + 1))
        if jobs:
            yield pd.DataFrame({"template_id": key[0], "field_id": key[1], "job": jobs, "seen": [j * at for j in jobs]})

    keyed = feedback.groupBy("template_id", "field_id")
    return keyed.applyInPandasWithState(step, "template_id long, field_id long, job long, seen long", "seen long", "append", GroupStateTimeout.NoTimeout)


def running_means(values: DataFrame, alpha: float = 0.3) -> DataFrame:
    """``key``, ``n``, ``ema`` after each micro-batch, values of a batch in order of ``at``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values("at")
        for v in rows["value"]:
            n, ema = n + 1, alpha * v + (1 - alpha) * ema
        state.update((n, float(ema)))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "ema": [ema]})

    return values.groupBy("key").applyInPandasWithState(step, "key string, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)


def once_per_key(stream: DataFrame, keys: list[str], at: str, delay: str = "7 days") -> DataFrame:
    """The first row of each key within the watermark: counters fed by it can't count a correction twice."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def upsert_latest(stream: DataFrame, keys: list[str], order: list[str], target: str, state: str, parts: int = 16) -> None:
    """Merge a stream into the table at ``target``: the newest row of each key stays.

    The table lies in ``parts`` folders by a hash of the key. A batch rewrites the folders that its keys fall
    in, under the batch's own number, and reads those of earlier batches only; ``upserted`` reads of each
    folder the highest number. A batch that is tried again after a failure writes the same folders anew.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        touched = {r["part"] for r in rows.select("part").distinct().collect()}  # at most ``parts``
        newest = newest_parts(spark, target, number)
        old = [f"{target}/part={p}/v={newest[p]}" for p in touched if p in newest]
        every = rows
        for path in old:
            part = int(re.search(r"part=(\d+)", path)[1])
            every = every.unionByName(spark.read.schema(batch.schema).parquet(path).withColumn("part", F.lit(part)))
        rest = [c for c in batch.columns if c not in keys and c not in order]
        best = every.groupBy("part", *keys).agg(F.max(F.struct(*order, *rest)).alias("x")).select("part", *keys, *(f"x.{c}" for c in (*order, *rest)))
        for p in touched:
            best.where(F.col("part") == p).select(*batch.columns).write.mode("overwrite").parquet(f"{target}/part={p}/v={number}")

    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()


def newest_parts(spark: SparkSession, target: str, before: int | None = None) -> dict[int, int]:
    """The highest version of each part of an upserted table, below ``before`` if given."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = {}
    for x in jvm.org.apache.hadoop.fs.Path(target).getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(f"{target}/part=*/v=*/_SUCCESS")) or ():
        part, version = map(int, re.search(r"part=(\d+)/v=(\d+)", x.getPath().toString()).groups())
        if before is None or version < before:
            found[part] = max(version, found.get(part, -1))
    return found


def upserted(spark: SparkSession, target: str, schema) -> DataFrame:
    """The table that ``upsert_latest`` wrote."""
    paths = [f"{target}/part={p}/v={v}" for p, v in newest_parts(spark, target).items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def work_queue(jobs: DataFrame, handle, state: str) -> None:
    """Hand pending jobs to ``handle`` in order of arrival, one micro-batch at a time (R01); a failed batch is taken up again."""

    def run(batch: DataFrame, number: int) -> None:
        handle(batch.where("status = 'pending'").orderBy("created_at", "job_id"), number)

    jobs.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(run).start().awaitTermination()


@query(""", c as (select template_id, field_id, count(*) as n from jobs group by all) select template_id, field_id, unnest(generate_series(1, n // 5)) as job, unnest(generate_series(1, n // 5)) * 5 as seen from c where n >= 5""")
def r03_stream_triggers(r: Relations) -> DataFrame:
    """Training jobs that a stream of events asks for, every fifth event of a key."""
    events = table_stream(r, "events").select((F.col("user_id") % 5 + 1).alias("template_id"), F.col("user_id").alias("field_id"))
    return available_now(count_triggers(events))


@query(" select type, time_bucket(interval '1 hour', created_at) as begins, count(*) as n from jobs group by all")
def r08_tumbling_windows(r: Relations) -> DataFrame:
    """Events per type and hour (an extension: the loop's row batches on event time)."""
    events = table_stream(r, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    counts = events.groupBy(F.col("event_type").alias("type"), F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    each = available_now(counts.select("type", F.col("w.start").alias("begins"), "n"), "update")
    return each.groupBy("type", "begins").agg(F.max("n").alias("n"))  # counts only grow, so the last one of a window is the largest


@query(" select field_id, job_id, created_at from jobs qualify row_number() over (partition by field_id order by created_at desc, job_id desc) = 1")
def r07_stream_upsert(r: Relations) -> DataFrame:
    """The latest row of each key after all batches of a stream were merged."""
    rows = table_stream(r, "events").select(F.col("user_id").alias("field_id"), F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"))
    target = scratch(r.spark, "upsert")
    upsert_latest(rows, ["field_id"], ["created_at", "job_id"], target, scratch(r.spark, "upsert-state"))
    return upserted(r.spark, target, rows.schema)


@query(""", o as (select field_id, duration, row_number() over (partition by field_id order by job_id desc) as back, count(*) over (partition by field_id) as n from jobs where duration is not null)
select cast(field_id as varchar) as key, any_value(n) as n, round(sum(0.3 * pow(0.7, back - 1) * duration), 6) as ema from o group by all""")
def r06_running_means(r: Relations) -> DataFrame:
    """Counter and exponential mean of each key after all batches of a stream, in order of arrival."""
    values = table_stream(r, "events").where("value is not null").select(F.col("user_id").cast("string").alias("key"), F.col("value").cast("double").alias("value"), F.col("event_id").alias("at"))
    last = available_now(running_means(values), "update").groupBy("key").agg(F.max(F.struct("n", "ema")).alias("x"))
    return last.select("key", "x.n", F.round("x.ema", 6).alias("ema"))
