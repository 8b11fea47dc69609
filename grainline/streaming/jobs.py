"""Job logs, leases and rate limits as folds over ordered events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fold(log: DataFrame, key: str, status: str, attempt: str) -> DataFrame:
    """Last status, number of events and of attempts of each job; partial before the shuffle."""
    return log.groupBy(key).agg(F.max_by(status, F.struct("ts", "event_id")).alias("status"), F.count("*").alias("n_events"), F.count_if(F.col(status) == attempt).alias("attempts"))


def expired(log: DataFrame, lease: str) -> DataFrame:
    """Whether a claim's lease ran out before the job's next event."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    after = F.lead("ts").over(order)
    return log.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), (after.isNull() | (after > F.col("ts") + F.expr(f"INTERVAL {lease}"))).alias("expired"))


def admit(times: list[float], limit: int, width: float, log: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Sliding log: a request passes while fewer than ``limit`` admitted ones are younger than ``width``."""
    log, out = list(log or []), []
    for t in times:
        log = [x for x in log if x > t - width]
        out.append(len(log) < limit)
        if out[-1]:
            log.append(t)
    return out, log


def rate_limit(requests: DataFrame, limit: int, width: float) -> DataFrame:
    """Admission depends on earlier admissions, so each user's requests are folded in order.

    Rows arrive sorted by user and time and are folded as a stream of batches: a
    task holds one user's log of at most ``limit`` entries, never a user's rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, log = None, []
        for frame in batches:
            out = []
            for u, t in zip(frame["user_id"], frame["t"], strict=True):
                if u != user:
                    user, log = u, []
                (ok,), log = admit([t], limit, width, log)
                out.append(ok)
            yield pd.DataFrame({"user_id": frame["user_id"], "event_id": frame["event_id"], "admitted": out})

    t = F.unix_micros("ts") / 1e6
    rows = requests.select("user_id", "event_id", t.alias("t")).repartition("user_id").sortWithinPartitions("user_id", "t", "event_id")
    return rows.mapInPandas(run, "user_id long, event_id long, admitted boolean")


def run_worker(spark: SparkSession, queue: DataFrame, handle: Callable[[DataFrame, int], None], state: str) -> None:
    """Poll, claim and run: batches of a stream of jobs go to ``handle``, one after another.

    A batch that fails is run again from the checkpoint in ``state`` with the same
    number, so a handler that writes by that number stays correct.
    """
    queue.writeStream.foreachBatch(handle).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
