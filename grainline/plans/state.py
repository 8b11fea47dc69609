"""Time-driven queries: job state, leases, rate limits, windows, caches; batch and streamed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import table
from ..streaming import events as E
from ..streaming import expiring, jobs
from .registry import query


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tumbling(E.read(spark, sf_dir), "1 hour")


@query("""SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total
    FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start, event_type, value FROM events) GROUP BY ALL""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tumbling(E.read(spark, sf_dir), "1 hour", "30 minutes")


@query("""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM g GROUP BY user_id, g""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(E.read(spark, sf_dir), "6 hours")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows by a stream with a watermark, run until its input is read."""
    return E.streamed(spark, sf_dir, "1 hour")


@query("SELECT user_id, arg_max(event_type, {'t': ts, 'i': event_id}) AS status, count(*) AS n_events, count(*) FILTER (event_type = 'purchase') AS attempts FROM events GROUP BY user_id")
def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's state is the fold of its log; users stand for jobs."""
    return jobs.fold(E.read(spark, sf_dir), "user_id", "event_type", "purchase")


@query("SELECT user_id AS job_id, event_id AS seq, lead(ts) OVER w IS NULL OR lead(ts) OVER w > ts + INTERVAL 120 MINUTE AS expired FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def expired_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.expired(E.read(spark, sf_dir), "120 minutes")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) / 1000.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, []::DOUBLE[] AS log, NULL::BOOLEAN AS admitted FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT f.user_id, e.n, e.event_id, CASE WHEN len(list_filter(f.log, lambda x: x > e.t - 7200)) < 2 THEN list_append(list_filter(f.log, lambda x: x > e.t - 7200), e.t) ELSE list_filter(f.log, lambda x: x > e.t - 7200) END,
        len(list_filter(f.log, lambda x: x > e.t - 7200)) < 2 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT user_id, event_id, admitted FROM f WHERE n > 0""")
def sliding_log_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two admitted requests in two hours; refused ones leave no trace."""
    return jobs.rate_limit(E.read(spark, sf_dir), 2, 7200.0)


@query("SELECT event_id, CASE WHEN n < 1 THEN 0.0 ELSE least(60.0, pow(2, n)) END::DOUBLE AS delay FROM (SELECT event_id, event_id % 9 AS n FROM events)")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.backoff_seconds(F.col("event_id") % 9).alias("delay"))


@query("SELECT event_type, min_by(event_id, {'t': ts, 'i': event_id}) AS event_id FROM events GROUP BY event_type")
def oldest_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""WITH c AS (SELECT event_id, user_id, ts, event_type FROM events), k AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS put FROM c)
    SELECT event_id, put IS NOT NULL AND put + INTERVAL 1 DAY > ts AS hit FROM k""")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup hits if the last one of the same key was less than the time to live before."""
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    put = F.lag("ts").over(order)
    return E.read(spark, sf_dir).select("event_id", (put.isNotNull() & (F.coalesce(put, F.col("ts")) + F.expr("INTERVAL 1 DAY") > F.col("ts"))).alias("hit"))


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, ts FROM events) GROUP BY ALL")
def deduplicated_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.read(spark, sf_dir).dropDuplicates(["user_id", "event_type", "ts"])
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id AS tenant, event_id AS seq, epoch_us(ts) / 1000.0 AS t, event_type AS entry, value * 3600000 AS ttl,
      CASE WHEN event_id % 50 = 0 THEN 'invalidate' WHEN event_id % 7 IN (0, 3) THEN 'put' ELSE 'get' END AS command FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY t, seq) AS n FROM e),
    l AS (SELECT *, max(CASE WHEN command = 'invalidate' THEN n END) OVER w AS cut, max(CASE WHEN command = 'put' THEN n END) OVER k AS put
          FROM n WINDOW w AS (PARTITION BY tenant ORDER BY n ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY tenant, entry ORDER BY n ROWS UNBOUNDED PRECEDING)),
    h AS (SELECT l.*, p.seq AS from_seq, l.command = 'get' AND p.n IS NOT NULL AND p.t + p.ttl > l.t AND coalesce(l.cut, 0) < p.n AS hit FROM l LEFT JOIN n p ON p.tenant = l.tenant AND p.n = l.put)
    SELECT tenant, seq, CASE WHEN hit THEN 'hit' WHEN command = 'get' THEN 'miss' WHEN command = 'put' THEN 'stored' ELSE 'invalidated' END AS outcome, CASE WHEN hit THEN from_seq::VARCHAR END AS value FROM h""")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as puts, look-ups and invalidations of cached answers that live as long as the event's value says."""
    n = F.col("event_id")
    command = F.when(n % 50 == 0, "invalidate").when((n % 7).isin(0, 3), "put").otherwise("get")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("tenant"), n.alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at"), command.alias("command"), F.col("event_type").alias("entry"), n.cast("string").alias("value"), (F.col("value") * 3600000).alias("ttl")
    )
    return expiring.folded(rows)
