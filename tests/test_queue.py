"""Queues and admission: leases, retries, reaping; the stream against the table; levels against a plain reading."""

import random

from grainline.plans.registry import QUERIES
from grainline.streaming import queue

from .conftest import SF


def play(*commands):
    job, out = queue.Job(), []
    for at, command, token in commands:
        job, outcome = queue.apply(job, at, command, token, "parse")
        out.append((outcome, job.status, job.attempts))
    return out


def test_only_the_holder_of_a_live_lease_acts():
    assert play((0, "enqueue", ""), (1, "claim", "a"), (2, "claim", "b"), (3, "complete", "b"), (200, "renew", "a"), (400, "stage", "a"), (450, "complete", "a"), (451, "fail", "a")) == [
        ("done", "queued", 0), ("done", "running", 0), ("idle", "running", 0), ("stale", "running", 0), ("done", "running", 0), ("done", "running", 0), ("done", "done", 0), ("stale", "done", 0),
    ]


def test_failures_wait_longer_and_die():
    assert play((0, "enqueue", ""), (0, "claim", "a"), (1, "fail", "a"), (2, "claim", "b"), (3, "claim", "b"), (400, "reap", ""), (403, "claim", "c"), (404, "claim", "c"), (405, "fail", "c"), (900, "claim", "d")) == [
        ("done", "queued", 0), ("done", "running", 0), ("done", "queued", 1), ("idle", "queued", 1), ("done", "running", 1), ("done", "queued", 2), ("idle", "queued", 2), ("done", "running", 2), ("done", "dead", 3), ("idle", "dead", 3),
    ]
    assert [queue.delay(n) for n in (0, 1, 3, 9, 99)] == [0.0, 2.0, 8.0, 60.0, 60.0]
    assert play((0, "enqueue", ""), (0, "claim", "a"), (100, "reap", ""), (1, "nonsense", "a"))[2:] == [("idle", "running", 0), ("refused", "running", 0)]


def commands(spark, n=400):
    rng = random.Random(3)
    kinds = ("enqueue", "claim", "claim", "renew", "stage", "complete", "fail", "reap")
    rows = [(rng.randrange(12), i, float(i * rng.choice((1, 40))), rng.choice(kinds), rng.choice("ab"), "s") for i in range(n)]
    return spark.createDataFrame(rows, "job_id long, seq long, at double, command string, token string, note string"), rows


def test_replay_and_stream_agree_with_a_plain_fold(spark, tmp_path):
    table, rows = commands(spark)
    jobs, expected = {}, {}
    for job, seq, at, command, token, note in sorted(rows, key=lambda r: (r[2], r[1])):
        jobs[job], outcome = queue.apply(jobs.get(job, queue.Job()), at, command, token, note)
        expected[seq] = (outcome, jobs[job].status, jobs[job].attempts)
    assert {r.seq: (r.outcome, r.status, r.attempts) for r in queue.replay(table).collect()} == expected
    ordered = table.orderBy("at", "seq").collect()
    for part in range(4):
        spark.createDataFrame(ordered[part * 100 : part * 100 + 100], table.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = queue.streamed(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r.seq: (r.outcome, r.status, r.attempts) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == expected


def test_admission_at_two_levels(spark):
    found = {r.seq: r.admitted for r in QUERIES["admission_levels"](spark, SF).collect()}
    rows = sorted(((r.ts.timestamp() * 1000, r.event_id, r.user_id) for r in spark.read.parquet(f"{SF}/events.parquet").collect()), key=lambda r: r[:2])
    admitted = []
    for at, seq, user in rows:
        own = [t for t, u in admitted if u == user]
        all_ = [t for t, u in admitted if u % 8 == user % 8]
        live = lambda ts, width, now=at: sum(t > now - width for t in ts)
        ok = live(own, queue.LEASE_MS) < 1 and live(all_, queue.LEASE_MS) < 3 and live(own, queue.WINDOW_MS) < 2 and live(all_, queue.WINDOW_MS) < 4
        assert found[seq] == ok
        if ok:
            admitted.append((at, user))
    gate = queue.Gate((1,), (9,))
    assert [gate.acquire(0, "a", ("u",), ("u",)), gate.acquire(5, "b", ("u",), ("u",)), gate.renew(100, "a", ("u",)), gate.renew(100, "b", ("u",))] == [True, False, True, False]
    gate.release("a", ("u",))
    assert gate.acquire(101, "c", ("u",), ("u",))


def test_finished_jobs_are_forgotten(spark, tmp_path):
    schema = "job_id long, seq long, at double, command string, token string, note string"
    parts = [
        [(1, 1, 0.0, "enqueue", "", ""), (1, 2, 1.0, "claim", "a", ""), (1, 3, 2.0, "complete", "a", ""), (2, 4, 3.0, "enqueue", "", "")],
        [(3, 5, 500.0, "enqueue", "", "")], [(3, 6, 900.0, "claim", "b", "")], [(1, 7, 901.0, "complete", "a", ""), (2, 8, 902.0, "claim", "c", "")],
    ]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        run = queue.streamed(source, retain_ms=60_000, late="10 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    found = {r.seq: (r.outcome, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # job 1 was done and is forgotten; job 2 was still open
    assert found[3] == ("done", "done") and found[7] == ("stale", "new") and found[8] == ("done", "running")
