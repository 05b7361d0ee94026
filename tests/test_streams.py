"""Keyed state of streams: what leaves while they run, what a restart keeps, and what the state forgets."""

import datetime as dt
import math
import random
import time

from pyspark.sql import functions as F

from txloom import scratch
from txloom.streaming import jobs


def runner(spark, schema, name, build):
    """Append rows to a stream's source and run it to the end, again and again from one checkpoint; gives (run, checkpoint)."""
    source, checkpoint, table = (scratch.folder(spark, f"{name}-{x}") for x in ("in", "checkpoint", "table"))

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        return jobs.run_to_end(build(spark.readStream.schema(schema).parquet(source)), "append", name, checkpoint, table)

    return run, checkpoint


def n_state(spark, checkpoint, variable):
    found = jobs.with_rocksdb(spark, lambda: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load().count())
    return found


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_silence_by_event_time(spark):
    """Alerts of every pause, in any order of arrival within the delay, over restarts, with a roster."""
    rng = random.Random(1)
    timeout, delay = 100, 300
    times = {e: sorted(rng.sample(range(5000), 12)) for e in "abc"}
    rows = sorted(((e, at(t)) for e, ts in times.items() for t in ts), key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(delay // 2)))
    roster = spark.createDataFrame([("a", at(-50)), ("late", at(200)), ("late", at(900))], "e string, since timestamp")
    run, _ = runner(spark, "e string, ts timestamp", "silence", lambda s: jobs.silent_alerts(s, "e", timeout, f"{delay} seconds", roster))
    for k in range(0, len(rows), 12):
        out = run(rows[k : k + 12])
    end = max(t for ts in times.values() for t in ts) - delay
    want = set()
    for e, ts in {**times, "late": []}.items():
        watched = {"a": -50, "late": 200}.get(e)
        marks = [(watched, False)] * (watched is not None) + [(t, True) for t in ts]
        for (start, reported), (stop, _) in zip(marks, [*marks[1:], (math.inf, True)], strict=True):
            k = 1
            while start + k * timeout < min(stop, end):
                want.add((e, start, reported, k))
                k += 1
    base = int(at(0).replace(tzinfo=dt.UTC).timestamp())
    got = {(r.e, r.from_s - base, r.reported, r.alert) for r in out.collect()}
    assert (got - want, want - got) == (set(), set())
    assert out.count() == len(want)


def test_silent_entities_share_the_rows_of_the_state(spark):
    """The state has a row for each bucket, not for each entity; null entities and whole numbers too long for doubles are entities like others."""
    base = 2**60
    roster = spark.createDataFrame([(base + k, at(0)) for k in range(300)], "e bigint, since timestamp")
    run, checkpoint = runner(spark, "e bigint, ts timestamp", "shared", lambda s: jobs.silent_alerts(s, "e", 100, "0 seconds", roster, buckets=8))
    out = run([(base + 1, at(50)), (None, at(60)), (base + 999, at(250))])
    end = 250
    since = {base + k: (0, False) for k in range(300)} | {base + 1: (50, True), None: (60, True)}
    want = sorted(str((e, a, reported, k)) for e, (a, reported) in since.items() for k in (1, 2) if a + k * 100 < end)
    zero = int(at(0).replace(tzinfo=dt.UTC).timestamp())
    assert sorted(str((r.e, r.from_s - zero, r.reported, r.alert)) for r in out.collect()) == want
    assert n_state(spark, checkpoint, "last") <= 8


def test_groups_leave_when_they_pass(spark):
    run, checkpoint = runner(spark, "g string, v int", "distinct", lambda s: jobs.distinct_values(s, ["g"], ["v"], 3))
    assert run([("a", 1), ("a", 2), ("a", 2), ("b", 1), (None, None)]).count() == 0
    assert n_state(spark, checkpoint, "values") == 4
    assert sorted((r.g, r.v, r.n_values) for r in run([("a", 1), ("a", 7)]).collect()) == [("a", "1", 3), ("a", "2", 3), ("a", "7", 3)]
    later = run([("a", 7), ("a", 8), ("b", 1), (None, 1), (None, 2)])
    assert sorted((r.g, r.v, r.n_values) for r in later.collect()) == [("", "", 3), ("", "1", 3), ("", "2", 3), ("a", "1", 3), ("a", "2", 3), ("a", "7", 3), ("a", "8", 4)]


def test_values_of_a_large_group_share_the_rows_of_the_state(spark):
    """Values are kept in few rows, which split as the group grows; each leaves once, over restarts, by two columns that could be taken for one."""
    run, checkpoint = runner(spark, "g string, v string, w int", "shares", lambda s: jobs.distinct_values(s, ["g"], ["v", "w"], 1200))
    value = lambda k: ("a" * (k % 3), k // 3)
    small = [("b", "x", k) for k in range(3)]
    assert run([*small, *(("a", *value(k)) for k in range(10))]).count() == 0 and n_state(spark, checkpoint, "values") == 13
    assert run([("a", *value(k)) for k in range(5, 900)]).count() == 0
    assert n_state(spark, checkpoint, "values") == 3 and n_state(spark, checkpoint, "shared") <= 16
    assert run([("a", *value(k)) for k in range(9000)] * 2).count() == 9000
    assert n_state(spark, checkpoint, "shared") <= 64
    out = run([*small, ("a", "", 1), *(("a", *value(k)) for k in range(8990, 9010)), ("a", None, None)]).collect()
    assert sorted((r.v, r.w) for r in out) == sorted([*((v, str(w)) for v, w in map(value, range(9010))), ("", "")])
    assert {r.g for r in out} == {"a"} and max(r.n_values for r in out) == 9011
    assert n_state(spark, checkpoint, "values") == 3


def test_nothing_leaves_before_the_means(spark):
    schema = "ts timestamp, account string, payment_format string, amount_paid int"
    early, late = F.col("ts") < F.lit("2024-01-02").cast("timestamp"), F.col("ts") >= F.lit("2024-01-02").cast("timestamp")
    run, checkpoint = runner(spark, schema, "means", lambda s: jobs.below_baseline(s, early, late, "2024-01-02", ["account"], delay="2 days", shards=3))
    day = 86400
    first = [(at(0), "e", "Wire", 100), (at(60), "e", "Wire", 300), (at(day), "x", "Wire", 1), (at(day), "y", "Wire", 2), (at(day + 5), None, "Wire", 0), (at(day), "z", "ACH", 0), (at(day), "n", None, 0)]
    assert run(first).count() == 0 and n_state(spark, checkpoint, "waiting") == 4
    assert run([(at(90), "e", "Wire", 200)]).count() == 0  # an early row that comes late still counts
    got = run([(at(4 * day), "w", "Wire", 1), (at(4 * day), "v", "Wire", 50)])
    assert sorted((r.account or "", r.payment_format, r.amount_paid) for r in got.collect()) == [("", "Wire", 0.0), ("w", "Wire", 1.0), ("x", "Wire", 1.0)]
    assert n_state(spark, checkpoint, "waiting") == 0
    assert {r.account for r in run([(at(5 * day), "u", "Wire", 1)]).collect()} == {None, "w", "x", "u"}


def test_discarded_parts_leave_the_state(spark):
    run, checkpoint = runner(spark, "client_id string, part string, stop boolean", "discard", lambda s: jobs.live_counts(s, "part", F.col("stop")))
    total = lambda out: {r.client_id: r.n for r in out.groupBy("client_id").agg(F.sum("change").alias("n")).collect()}
    assert total(run([("c", "p", False), ("c", "p", None), ("c", "q", False), ("c", None, True), ("d", "r", False)])) == {"c": 4, "d": 1}
    assert n_state(spark, checkpoint, "count") == 3
    assert total(run([("c", "p", True), ("c", "p", False)])) == {"c": 2, "d": 1}
    assert n_state(spark, checkpoint, "count") == 2
    assert total(run([("c", "p", False), ("d", "r", False)])) == {"c": 2, "d": 2}  # stragglers of a discarded part


def test_keys_are_remembered_for_a_time(spark):
    schema = "k string, ts timestamp"
    seen = lambda remember: runner(spark, schema, "once", lambda s: jobs.first_rows(s, ["k"], remember))
    run, checkpoint = seen("1 day")
    assert run([("a", at(0)), ("a", at(1)), (None, at(0)), (None, at(0))]).count() == 3
    # rows of long ago are new rows, replays stay out after a restart
    old = dt.datetime(2010, 1, 1)
    assert sorted(str(r.k) for r in run([("old", old), ("a", at(9))]).collect()) == ["None", "None", "a", "old"]
    assert n_state(spark, checkpoint, "seen") == 2
    run, checkpoint = seen("1 second")
    run([("a", at(0)), ("b", at(0))])
    time.sleep(4)
    run([("c", at(0))])
    time.sleep(4)
    run([("d", at(0))])
    assert n_state(spark, checkpoint, "seen") < 4


def test_waiting_rows_share_the_rows_of_the_state(spark):
    """Late rows that wait are kept in blocks, over restarts, and leave with their nulls; few rows of a batch are a row each."""
    schema = "ts timestamp, account string, payment_format string, amount_paid int"
    early, late = F.col("ts") < F.lit("2024-01-02").cast("timestamp"), F.col("ts") >= F.lit("2024-01-02").cast("timestamp")
    run, checkpoint = runner(spark, schema, "blocks", lambda s: jobs.below_baseline(s, early, late, "2024-01-02", ["account"], delay="2 days", shards=2))
    day = 86400
    rows = [(at(day + k), f"a{k}" if k % 7 else None, "Wire", k % 5) for k in range(5000)]
    assert run([(at(0), "e", "Wire", 300), *rows[:2500]]).count() == 0
    assert run(rows[2500:]).count() == 0
    assert n_state(spark, checkpoint, "waiting") == 0 and 4 <= n_state(spark, checkpoint, "blocks") <= 12
    got = run([(at(4 * day), "w", "Wire", 50)])
    assert sorted((r.account or "", r.amount_paid) for r in got.collect()) == sorted((a or "", float(n)) for _, a, _, n in rows if n < 3)
    assert n_state(spark, checkpoint, "blocks") == 0
