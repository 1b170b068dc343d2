"""The ordered walk and the job worker against plain Python."""

import random
import time

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import walk
from fieldloom.streaming import worker
from fieldloom.streaming.learning import available_now


def walked(words, field):
    """Value, words, mean score and reason of stopping, one word at a time."""
    kept, scores, inside, stop, at = [], [], False, "end", None
    for idx, word, x0, top, score in sorted(words):
        why = None
        if field["next_x"]:
            why = "next_x" if x0 >= field["next_x"] else None
        elif field["next_y"]:
            why = "next_y" if top >= field["next_y"] else None
        if why is None and field["max_length"] and len(" ".join([*kept, word])) > field["max_length"]:
            why = "length"
        if why:
            stop, at = why, idx
            break
        if word in "()" and word:
            inside = word == "("
        elif not inside:
            kept.append(word)
            scores.append(score)
    return (" ".join(kept), len(kept), round(sum(scores) / len(scores), 9), stop, at) if kept else None


def test_a_walk_ends_where_its_rules_say(spark):
    rnd = random.Random(1)
    words, fields, want = [], [], {}
    for d in range(120):
        for f in range(2):
            mine = [(i, rnd.choice(["(", ")", "a", "bcd", "é", "漢字", "longer-word", "x"]), rnd.randrange(0, 300, 10), 12 * (i // 4), rnd.randrange(100) / 100) for i in range(rnd.randrange(0, 14))]
            field = {"next_x": rnd.choice([None, None, 0, 250]), "next_y": rnd.choice([None, None, 0, 24]), "max_length": rnd.choice([None, 5, 20])}
            words += [(d, f, *w) for w in mine]
            fields.append((d, f, *field.values()))
            if w := walked(mine, field):
                want[d, f] = w
    rnd.shuffle(words)
    got = walk.ordered_walk(spark.createDataFrame(words, "document_id long, field int, idx int, word string, x0 int, top int, score double"), spark.createDataFrame(fields, "document_id long, field int, next_x int, next_y int, max_length int"))
    assert {(r["document_id"], r["field"]): (r["value"], r["n"], round(r["confidence"], 9), r["stop"], r["stop_idx"]) for r in got.collect()} == want
    assert {w[3] for w in want.values()} == {"end", "next_x", "next_y", "length"}


def test_bounds_of_fields(spark):
    rows = [(0, 10, 10, None, 15, 40, False), (1, 10, 10, None, 20, 40, False), (2, 10, 10, 5, None, 40, False), (3, 10, 10, None, None, 40, True), (4, 10, 10, None, None, 41, None), (5, 10, 10, 0, 0, 40, False), (6, 10, 10, None, None, 0, False)]
    df = spark.createDataFrame(rows, "i long, bottom int, height int, next_x int, next_y int, typical_length int, multiline boolean")
    got = {r["i"]: (r["next_y"], r["max_length"]) for r in walk.bounded_fields(df).collect()}
    assert got == {0: (None, 52), 1: (20, None), 2: (None, None), 3: (None, None), 4: (None, 53), 5: (None, 52), 6: (None, None)}


MINUTE, DAY = 60_000, 86_400_000


def replayed(events, max_age, watermark):
    """All changes of status, one event at a time."""
    out, jobs = [], {}
    for at, event_id, job, event in sorted(events):
        status, until = jobs.get(job, ("none", 0))
        if status == "running" and at > until:
            out.append((job, until, "failed", worker.STALE, None))
            status, until = "failed", 0
        moved = worker.next_status(status, event)
        if moved:
            status = moved[0]
            out.append((job, at, *moved, event_id))
        until = at + max_age if status == "running" and event == "start" else until if status == "running" else 0
        jobs[job] = (status, until)
    return sorted([*out, *((j, until, "failed", worker.STALE, None) for j, (s, until) in jobs.items() if s == "running" and until <= watermark)], key=repr)


def some_events():
    rnd = random.Random(6)
    rows = [(k * MINUTE, k, rnd.randrange(12), rnd.choice(["submit", "start", "start", "finish", "fail"])) for k in range(400)]
    rows += [(500 * MINUTE, 900, 99, "submit"), (501 * MINUTE, 901, 99, "start"), (600 * MINUTE, 902, 98, "submit")]
    return [(DAY + at, *rest) for at, *rest in rows]


def written(spark, path, rows, number):
    df = spark.createDataFrame([(j, i, e, at) for at, i, j, e in rows], "job_id long, event_id long, event string, at_ms long")
    df.select("job_id", "event_id", "event", F.timestamp_millis("at_ms").alias("at")).coalesce(1).write.parquet(f"{path}/{number:03d}")
    time.sleep(0.01)  # files are read in order of time


def stream_of(spark, path):
    return spark.readStream.schema("job_id long, event_id long, event string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


@pytest.mark.parametrize("batches", [1, 7])
def test_states_on_a_stream_equal_a_replay(spark, tmp_path, batches):
    events = some_events()
    for k in range(batches):
        written(spark, tmp_path / "in", events[k * len(events) // batches : (k + 1) * len(events) // batches], k)
    got = worker.run_transitions(spark, stream_of(spark, tmp_path / "in"), available_now).collect()
    want = replayed(events, worker.MAX_AGE_MS, DAY + 590 * MINUTE)
    assert sorted(map(tuple, got), key=repr) == want
    assert {w[3] for w in want} == {None, "reported", worker.STALE} and (99, DAY + 531 * MINUTE, "failed", worker.STALE, None) in want


def test_states_go_on_after_a_restart(spark, tmp_path):
    events = some_events()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run(stream):
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    for k in range(3):
        written(spark, tmp_path / "in", events[k * len(events) // 3 : (k + 1) * len(events) // 3], k)
        worker.run_transitions(spark, stream_of(spark, tmp_path / "in"), run)
    got = spark.read.parquet(out).select("job_id", "at_ms", "status", "reason", "event_id")
    assert sorted(map(tuple, got.collect()), key=repr) == replayed(events, worker.MAX_AGE_MS, DAY + 590 * MINUTE)


def test_jobs_run_oldest_first_and_failures_do_not_stop_the_queue(spark, tmp_path):
    rows = [(i, i % 3, "pending" if i % 4 else "running", 100 - i, str(i)) for i in range(40)]
    spark.createDataFrame([*rows, rows[1]], "job_id long, template_id long, status string, created_at long, payload string").coalesce(1).write.parquet(str(tmp_path / "in"))
    log = str(tmp_path)

    def handle(job):
        with open(f"{log}/log-{job['template_id']}", "a") as f:
            f.write(f"{job['job_id']}\n")
        if job["job_id"] % 5 == 0:
            raise KeyError(job["payload"])

    stream = spark.readStream.schema("job_id long, template_id long, status string, created_at long, payload string").parquet(str(tmp_path / "in"))
    worker.work_off(stream, handle, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r["job_id"]: (r["status"], r["error"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: ("failed", f"KeyError: '{i}'") if i % 5 == 0 else ("completed", None) for i, _, s, _, _ in rows if s == "pending"}
    for t in range(3):
        ran = [int(x) for x in open(f"{log}/log-{t}")]
        assert ran == sorted((i for i in range(40) if i % 3 == t and i % 4), reverse=True)
