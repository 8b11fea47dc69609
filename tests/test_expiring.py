"""Cached answers and leases that end by themselves: streams against plain folds, over restarts; deduplication of a stream."""

import random

from pyspark.sql import functions as F

from grainline.streaming import expiring as X


def cache_events(n=240):
    draw = random.Random(8)
    rows, at = [], 0.0
    for i in range(n):
        at += draw.choice((100.0, 4000.0, 30000.0))
        rows.append((draw.randrange(4), i, at, draw.choice(("put", "put", "get", "get", "get", "invalidate" if i % 9 == 0 else "get", "odd" if i % 50 == 0 else "put")), draw.choice("ab"), f"v{i}", draw.choice((500.0, 50_000.0, 400_000.0))))
    return rows


def plain_cache(rows):
    """By looking back over all earlier events of the tenant."""
    out = {}
    for k, (tenant, seq, at, command, entry, _, _) in enumerate(rows):
        before = [r for r in rows[:k] if r[0] == tenant]
        cut = max((r[1] for r in before if r[3] == "invalidate"), default=-1)
        puts = [r for r in before if r[3] == "put" and r[4] == entry and r[1] > cut]
        hit = command == "get" and puts and puts[-1][2] + puts[-1][6] > at
        out[seq] = ("hit", puts[-1][5]) if hit else ({"put": "stored", "get": "miss", "invalidate": "invalidated"}.get(command, "refused"), None)
    return out


def lease_events(n=200):
    draw = random.Random(4)
    rows, at = [], 0.0
    for i in range(n):
        at += draw.choice((50.0, 9000.0, 70000.0))
        rows.append((draw.randrange(3), i, at, draw.choice(("acquire", "acquire", "renew", "release")), f"{draw.randrange(3)}/{draw.choice('xyz')}", None, None))
    return rows


def run_stream(spark, rows, kind, folder, parts=4):
    """Rows in ``parts`` files; the stream is stopped and started anew after each of them."""
    X.use_timers(spark)
    size = -(-len(rows) // parts)
    for part in range(parts):
        spark.createDataFrame(rows[part * size : part * size + size], X.EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(X.EVENT).parquet(f"{folder}/in")
        run = X.streamed(source, kind).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return {r.seq: (r.outcome, r.value) for r in spark.read.parquet(f"{folder}/out").collect()}


def kept(spark, folder):
    """Tenants that the state store still holds."""
    return spark.read.format("statestore").option("stateVarName", "held").load(f"{folder}/state").count()


def test_cache_table_and_stream_are_plain(spark, tmp_path):
    rows = cache_events()
    want = plain_cache(rows)
    table = spark.createDataFrame(rows, X.EVENT).repartition(5)
    assert {r.seq: (r.outcome, r.value) for r in X.folded(table).collect()} == want
    assert run_stream(spark, rows, X.Cache, str(tmp_path)) == want


def test_leases_table_and_stream_agree(spark, tmp_path):
    rows = lease_events()
    table = {r.seq: (r.outcome, r.value) for r in X.folded(spark.createDataFrame(rows, X.EVENT), X.Admission).collect()}
    assert {"admitted", "full", "renewed", "over", "released"} == {o for o, _ in table.values()}
    assert run_stream(spark, rows, X.Admission, str(tmp_path)) == table


def test_state_of_quiet_tenants_is_gone(spark, tmp_path):
    rows = [(1, 1, 1e7, "put", "a", "v", 1000.0), (2, 2, 1e7 + 10, "put", "a", "v", 1e9), (3, 3, 1.1e7, "get", "a", None, None), (3, 4, 1.2e7, "get", "a", None, None)]
    found = run_stream(spark, rows, X.Cache, str(tmp_path), parts=4)
    assert [found[i][0] for i in (1, 2, 3, 4)] == ["stored", "stored", "miss", "miss"]
    assert kept(spark, str(tmp_path)) == 1


def test_a_stream_is_deduplicated_over_a_restart(spark, tmp_path):
    minute = lambda m: f"2024-01-01 00:{m:02d}:00"
    files = [[(1, minute(0), "a"), (1, minute(1), "again"), (2, minute(2), "b")], [(2, minute(3), "again, after the restart"), (3, minute(20), "c"), (1, minute(21), "far later")], [(4, minute(1), "too late"), (3, minute(22), "again")]]
    for rows in files:
        spark.createDataFrame(rows, "id long, t string, what string").select("id", F.to_timestamp("t").alias("ts"), "what").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema("id long, ts timestamp, what string").parquet(f"{tmp_path}/in")
        run = X.once(source, ["id"], "ts", "10 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    got = sorted((r.id, r.what) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert (1, "a") in got and (2, "b") in got and (3, "c") in got
    assert not [w for _, w in got if w.startswith(("again", "too late"))]
