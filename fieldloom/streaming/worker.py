"""The job worker on streams: state by job with timers for those that hang (R05), and a queue that is worked off in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldloom.plans.registry import query
from fieldloom.sources.relations import Relations
from fieldloom.streaming.learning import available_now, scratch, table_stream

MAX_AGE_MS = 30 * 60 * 1000  # without a sign of life a running job has failed
DELAY = "10 minutes"  # how late an event may come
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRANSITION = "job_id long, at_ms long, status string, reason string, event_id long"
STALE = "stale running job"


def next_status(status: str, event: str) -> tuple[str, str | None] | None:
    """The status that an event leads to, and why; None where it changes nothing.

    A submitted job waits unless it waits or runs already (R04); a waiting one starts; a running one finishes or fails.
    """
    if event == "submit" and status not in ("pending", "running"):
        return "pending", None
    if event == "start" and status == "pending":
        return "running", None
    if status == "running" and event in ("finish", "fail"):
        return ("completed", None) if event == "finish" else ("failed", "reported")
    return None


class JobStates(StatefulProcessor):
    """A job's status and the time it counts as hung from, moved by its events and by a timer at that time."""

    def __init__(self, max_age_ms: int):
        self.max_age = max_age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, until = self.state.get() if self.state.exists() else ("none", 0)
        timer, out = until, []
        events = pd.concat(list(rows)).sort_values(["at_ms", "event_id"])
        for at, event_id, event in zip(events["at_ms"], events["event_id"], events["event"]):
            if status == "running" and at > until:
                out.append((until, "failed", STALE, None))
                status, until = "failed", 0
            moved = next_status(status, event)
            if moved:
                status = moved[0]
                out.append((int(at), *moved, int(event_id)))
            if status == "running" and event == "start":
                until = int(at) + self.max_age
            elif status != "running":
                until = 0
        if timer != until:
            if timer:
                self.handle.deleteTimer(timer)
            if until:
                self.handle.registerTimer(until)
        self.state.update((status, until))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, until = self.state.get() if self.state.exists() else ("none", 0)
        out = []
        if status == "running" and expiredTimerInfo.getExpiryTimeInMs() >= until:
            out = [(until, "failed", STALE, None)]
            self.state.update(("failed", 0))
        yield self._rows(key, out)

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(key, out: list) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["at_ms", "status", "reason", "event_id"])
        frame.insert(0, "job_id", key[0])
        return frame.astype({"job_id": "int64", "at_ms": "int64", "event_id": "Int64"})


def job_transitions(events: DataFrame, max_age_ms: int = MAX_AGE_MS, delay: str = DELAY) -> DataFrame:
    """``job_id``, ``at_ms``, ``status``, ``reason``, ``event_id`` of every change of a job's status, from a stream of ``job_id``, ``event_id``, ``event``, ``at``.

    A running job without a further ``start`` for ``max_age_ms`` fails at that time: when a later event shows that it
    has passed, or else by a timer as soon as the watermark (``delay`` behind the latest event) passes it. A
    job's events are applied in order of time, then id, within a batch, and batch by batch. State is one row a
    job and needs the RocksDB state store (``run_transitions`` sets it).
    """
    timed = events.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))
    return timed.groupBy("job_id").transformWithStateInPandas(JobStates(max_age_ms), TRANSITION, "Append", "EventTime")


def run_transitions(spark: SparkSession, events: DataFrame, run: Callable[[DataFrame], DataFrame] = available_now, **options) -> DataFrame:
    """``job_transitions`` run by ``run`` with the state store that it needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        return run(job_transitions(events, **options))
    finally:
        spark.conf.set(name, before)


def work_off(jobs: DataFrame, handle: Callable[[dict], None], target: str, state: str) -> None:
    """Run ``handle`` on the pending jobs of a stream and keep what came of each at ``target``.

    ``jobs`` has ``job_id``, ``template_id``, ``status``, ``created_at``, ``payload``. Of a micro-batch, jobs of one template
    run one after the other, oldest first, in a task; templates run side by side. A job that raises has failed
    with its message, and the next one follows. Results (``job_id``, ``template_id``, ``status``, ``error``) lie under
    the batch's number: a batch that is tried again after a failure replaces its own results.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ended = []
            for job in frame.to_dict("records"):
                try:
                    handle(job)
                    ended.append((job["job_id"], job["template_id"], "completed", None))
                except Exception as e:  # a failed job is a result
                    ended.append((job["job_id"], job["template_id"], "failed", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(ended, columns=["job_id", "template_id", "status", "error"])

    def run(batch: DataFrame, number: int) -> None:
        waiting = batch.where("status = 'pending'").dropDuplicates(["job_id"])
        queued = waiting.repartition("template_id").sortWithinPartitions("template_id", "created_at", "job_id")
        queued.mapInPandas(work, "job_id long, template_id long, status string, error string").write.mode("overwrite").parquet(f"{target}/batch={number}")

    jobs.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(run).start().awaitTermination()


EVENTS_SQL = """, ev as (select user_id as job_id, event_id, case event_type when 'signup' then 'submit' when 'click' then 'submit' when 'view' then 'start' when 'error' then 'fail' else 'finish' end as event,
  epoch_us(ts) // 1000 as at_ms, row_number() over (partition by user_id order by epoch_us(ts) // 1000, event_id) as i from events),"""


def job_events(r: Relations) -> DataFrame:
    """The event stream as events of jobs, one job a user."""
    kind = F.when(F.col("event_type").isin("signup", "click"), "submit").when(F.col("event_type") == "view", "start").when(F.col("event_type") == "error", "fail").otherwise("finish")
    return table_stream(r, "events").select(F.col("user_id").alias("job_id"), "event_id", kind.alias("event"), F.col("ts").cast("timestamp").alias("at"))


@query(EVENTS_SQL + """ step as (
  select distinct job_id, 0::bigint as i, 'none' as status, 0::bigint as until, []::struct(at_ms bigint, status varchar, reason varchar, event_id bigint)[] as told from ev
  union all
  select s.job_id, e.i, coalesce(m.moved, m.now),
    case when coalesce(m.moved, m.now) = 'running' then case when e.event = 'start' then e.at_ms + 1800000 else s.until end else 0 end,
    list_concat(case when m.late then [{'at_ms': s.until, 'status': 'failed', 'reason': 'stale running job', 'event_id': null::bigint}] else [] end,
                case when m.moved is not null then [{'at_ms': e.at_ms, 'status': m.moved, 'reason': case when m.moved = 'failed' then 'reported' end, 'event_id': e.event_id}] else [] end)
  from step s join ev e on e.job_id = s.job_id and e.i = s.i + 1,
  lateral (select s.status = 'running' and e.at_ms > s.until as late, case when s.status = 'running' and e.at_ms > s.until then 'failed' else s.status end as now) n,
  lateral (select n.late, n.now, case when e.event = 'submit' and n.now not in ('pending', 'running') then 'pending' when e.event = 'start' and n.now = 'pending' then 'running'
    when n.now = 'running' and e.event = 'finish' then 'completed' when n.now = 'running' and e.event = 'fail' then 'failed' end as moved) m),
tail as (select job_id, status, until from step qualify row_number() over (partition by job_id order by i desc) = 1)
select job_id, t.at_ms, t.status, t.reason, t.event_id from (select job_id, unnest(told) as t from step) x
union all select job_id, until, 'failed', 'stale running job', null from tail where status = 'running' and until <= (select max(at_ms) from ev) - 600000""")
def r05_job_states(r: Relations) -> DataFrame:
    """Every change of a job's status, with jobs that hang for half an hour failed by a timer."""
    return run_transitions(r.spark, job_events(r))


@query(r""" select job_id, template_id, case when k % 10 = 0 then 'failed' else 'completed' end as status, case when k % 10 = 0 then 'ValueError: no data for ' || k end as error
from (select *, cast(regexp_extract(payload, '(\d+)', 1) as bigint) as k from jobs where status = 'pending')""")
def r01_job_runs(r: Relations) -> DataFrame:
    """Pending jobs worked off oldest first; those whose payload names a round number raise, and the next one follows."""

    def train(job: dict) -> None:
        import json

        k = json.loads(job["payload"])["k"]
        if k % 10 == 0:
            raise ValueError(f"no data for {k}")

    status = F.when(F.col("event_type") == "click", "pending").otherwise("completed")
    jobs = table_stream(r, "events").select(F.col("event_id").alias("job_id"), (F.col("user_id") % 5 + 1).alias("template_id"), status.alias("status"), F.col("ts").alias("created_at"), F.col("props").alias("payload"))
    target = scratch(r.spark, "job-runs")
    work_off(jobs, train, target, scratch(r.spark, "job-runs-state"))
    return r.spark.read.schema("job_id long, template_id long, status string, error string").parquet(target).select("job_id", "template_id", "status", "error")
