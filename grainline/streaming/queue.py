"""A job queue with leases, and admission at several levels, as folds over their commands.

The fold is the same for a table of commands and for a stream of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEASE_SECONDS, MAX_ATTEMPTS, MAX_DELAY = 300.0, 3, 60.0
#: Admission: leases end after LEASE_MS at the latest, requests count for WINDOW_MS.
LEASE_MS, WINDOW_MS = 120_000, 60_000
#: How long a finished job's state is kept for commands that come late.
RETAIN_MS = 24 * 3600 * 1000


@dataclass
class Job:
    status: str = "new"
    stage: str = ""
    attempts: int = 0
    available_at: float = 0.0
    token: str = ""
    lease_until: float = 0.0


def delay(attempts: int) -> float:
    return min(MAX_DELAY, 2.0 ** min(attempts, 30)) if attempts > 0 else 0.0


def failed(job: Job, at: float, most: int = MAX_ATTEMPTS) -> Job:
    """One attempt more: queued again after a growing delay, or dead."""
    attempts = job.attempts + 1
    return Job("queued" if attempts < most else "dead", job.stage, attempts, at + delay(attempts))


def apply(job: Job, at: float, command: str, token: str = "", note: str = "") -> tuple[Job, str]:
    """The job after a command at a time, and what came of it: done, stale, idle or refused.

    Only the holder of a lease that hasn't ended may renew it, set a stage, complete or
    fail; ``claim`` takes a queued job that is due, ``reap`` one whose lease has ended.
    """
    held = job.status == "running" and job.token == token and job.lease_until > at
    if command == "enqueue":
        return Job("queued", job.stage, job.attempts, at), "done"
    if command == "claim":
        due = job.status == "queued" and job.available_at <= at
        return (Job("running", job.stage, job.attempts, job.available_at, token, at + LEASE_SECONDS), "done") if due else (job, "idle")
    if command == "reap":
        over = job.status == "running" and job.lease_until <= at
        return (failed(job, at), "done") if over else (job, "idle")
    if command not in ("renew", "stage", "complete", "fail"):
        return job, "refused"
    if not held:
        return job, "stale"
    if command == "renew":
        return Job(**asdict(job) | {"lease_until": at + LEASE_SECONDS}), "done"
    if command == "stage":
        return Job(**asdict(job) | {"stage": note}), "done"
    if command == "complete":
        return Job("done", "done", job.attempts), "done"
    return failed(job, at), "done"


OUT = "job_id long, seq long, outcome string, status string, stage string, attempts int"


def replay(commands: DataFrame) -> DataFrame:
    """``job_id, seq, at, command, token, note`` -> each command's outcome and the job after it.

    Rows arrive sorted by job and time; a task holds one job's state, never its rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, job = None, Job()
        for frame in batches:
            rows = []
            for r in frame.itertuples(index=False):
                if r.job_id != key:
                    key, job = r.job_id, Job()
                job, outcome = apply(job, r.at, r.command, r.token or "", r.note or "")
                rows.append((r.job_id, r.seq, outcome, job.status, job.stage, job.attempts))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    rows = commands.select("job_id", "seq", F.col("at").cast("double").alias("at"), "command", "token", "note")
    return rows.repartition("job_id").sortWithinPartitions("job_id", "at", "seq").mapInPandas(run, OUT)


def streamed(commands: DataFrame, retain_ms: int = RETAIN_MS, late: str = "1 day") -> DataFrame:
    """The same over a stream: a job's state is kept by its key from batch to batch.

    A job that is done or dead is forgotten once the watermark, ``late`` behind the newest
    command, is ``retain_ms`` beyond its last one, so that state grows with the open jobs
    only; a command after that meets a new job.
    """

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        job, last = Job(*state.get) if state.exists else Job(), 0
        for frame in frames:
            rows, last = [], max(last, int(frame["at"].max() * 1000))
            for r in frame.sort_values(["at", "seq"]).itertuples(index=False):
                job, outcome = apply(job, r.at, r.command, r.token or "", r.note or "")
                rows.append((r.job_id, r.seq, outcome, job.status, job.stage, job.attempts))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
        state.update((job.status, job.stage, job.attempts, job.available_at, job.token, job.lease_until))
        if job.status in ("done", "dead"):
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + retain_ms)

    kept = "status string, stage string, attempts int, available_at double, token string, lease_until double"
    rows = commands.select("job_id", "seq", F.col("at").cast("double").alias("at"), "command", "token", "note")
    timed = rows.withColumn("_time", F.timestamp_millis((F.col("at") * 1000).cast("long") + 1)).withWatermark("_time", late)
    return timed.groupBy("job_id").applyInPandasWithState(step, OUT, kept, "append", "EventTimeTimeout")


@dataclass
class Gate:
    """Open leases and recent requests of the levels a request has to pass, all or none."""

    limits: tuple[int, ...]
    rates: tuple[int, ...]

    def __post_init__(self) -> None:
        self.leases: dict[tuple, dict[str, float]] = {}
        self.recent: dict[tuple, list[float]] = {}

    def acquire(self, at: float, token: str, keys: tuple[str, ...], rated: tuple[str, ...]) -> bool:
        """``keys`` are what is limited in number (request's user, tenant, all), ``rated`` in number by minute."""
        open_now = [self.leases.setdefault((i, k), {}) for i, k in enumerate(keys)]
        seen = [self.recent.setdefault((i, k), []) for i, k in enumerate(rated)]
        for held in open_now:
            for t in [t for t, until in held.items() if until <= at]:
                del held[t]
        for times in seen:
            times[:] = [t for t in times if t > at - WINDOW_MS]
        if any(len(h) >= n for h, n in zip(open_now, self.limits, strict=True)) or any(len(t) >= n for t, n in zip(seen, self.rates, strict=True)):
            return False
        for held in open_now:
            held[token] = at + LEASE_MS
        for times in seen:
            times.append(at)
        return True

    def renew(self, at: float, token: str, keys: tuple[str, ...]) -> bool:
        held = [self.leases.get((i, k), {}) for i, k in enumerate(keys)]
        if not all(h.get(token, at) > at for h in held):
            return False
        for h in held:
            h[token] = at + LEASE_MS
        return True

    def release(self, token: str, keys: tuple[str, ...]) -> None:
        for i, k in enumerate(keys):
            self.leases.get((i, k), {}).pop(token, None)


def admissions(requests: DataFrame, limits: tuple[int, int], rates: tuple[int, int]) -> DataFrame:
    """``tenant, user, seq, at`` (ms) -> ``seq, admitted`` at the levels of users and tenants, at once.

    A tenant's requests are one sequence, as each depends on those admitted before; tenants
    are independent. A task holds what is open, never a tenant's rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, gate = None, None
        for frame in batches:
            out = []
            for r in frame.itertuples(index=False):
                if r.tenant != tenant:
                    tenant, gate = r.tenant, Gate(limits, rates)
                keys = (f"u{r.user}", f"t{r.tenant}")
                out.append(gate.acquire(r.at, str(r.seq), keys, keys))
            yield pd.DataFrame({"seq": frame["seq"], "admitted": out})

    return requests.select("tenant", "user", "seq", F.col("at").cast("double").alias("at")).repartition("tenant").sortWithinPartitions("tenant", "at", "seq").mapInPandas(run, "seq long, admitted boolean")
