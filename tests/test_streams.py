"""Streams that stop after some batches, start again, and end where the batch form ends."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tenderloom.operators import health, state
from tenderloom.streaming import jobs

from .conftest import NOW, opportunities, record


def fed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


RUNS = "source_id string, run_no int, row_count long"


def test_source_monitor_goes_on_after_a_restart(spark, tmp_path):
    rows = [(s, n, (n * 7 + len(s)) % 5 * 10) for n in range(30) for s in ("a", "bb")]
    for part in (rows[:20], rows[20:22], rows[22:]):
        stream = fed(spark, tmp_path, part[::-1], RUNS)
        got = jobs.drain_to_table(jobs.monitor_sources(stream), f"{tmp_path}/out")
    batch = spark.createDataFrame(rows, RUNS).withColumn("status", F.lit("ok")).withColumn("note", F.lit(None).cast("string"))
    want = health.source_drops(batch, batch.select("run_no").distinct())
    key = ["source_id", "run_no", "row_count", "norm"]
    assert sorted(map(tuple, got.select(key).collect()), key=str) == sorted(map(tuple, want.select(key).collect()), key=str)


EVENTS = "kind string, key string, ts timestamp_ntz, cents long"


def test_weekly_load_counts_late_rows_within_bounds(spark, tmp_path):
    day = datetime(2024, 1, 1)
    first = [("k", "a", day + timedelta(days=d), 10) for d in range(10)]
    late = [("k", "a", day + timedelta(days=6), 5), ("k", "a", day + timedelta(days=30), 1)]
    too_late = [("k", "a", day, 100)]
    for part in (first, late, [("k", "a", day + timedelta(days=31), 1)], too_late):
        got = jobs.drain_updates(jobs.weekly_load(fed(spark, tmp_path, part, EVENTS), "ts", "cents"), f"{tmp_path}/out", ["week"])
    found = {str(r.week): (r["count"], r.value) for r in got.collect()}
    assert found == {"2024-01-01": (8, 75), "2024-01-08": (3, 30), "2024-01-29": (2, 2)}


def test_alarms_are_raised_once_across_restarts(spark, tmp_path):
    day = datetime(2024, 1, 1)
    for part in ([("k", "a", day, 0), ("k", "b", day, 0)], [("k", "a", day + timedelta(days=1), 0), ("k", "c", day, 0)]):
        alarms = jobs.unread_alarms(fed(spark, tmp_path, part, EVENTS), "ts", "60 days").select("kind", "key")
        got = jobs.drain_to_table(alarms, f"{tmp_path}/out")
    assert sorted(r.key for r in got.collect()) == ["a", "b", "c"]


def test_snapshot_versions_are_found_again(spark, tmp_path):
    base = opportunities(spark, [record(1), record(2), record(3)])
    tracked = spark.createDataFrame([("1",)], "opportunity_id string")
    fetches = [opportunities(spark, [record(2, title="Roof, second fetch"), record(4)]), opportunities(spark, [record(4), record(5)]), opportunities(spark, [record(6)])]
    want = start = base.withColumns({c: F.lit(str(NOW)).cast("timestamp_ntz") for c in ("first_seen_at", "last_seen_at")})
    for fetch in fetches:
        fetch.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        merger = jobs.SnapshotMerger(start, tracked, str(NOW), f"{tmp_path}/versions")  # a new process each time
        jobs.drain(spark.readStream.schema(fetch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/checkpoint", merger)
        want = state.merge_snapshot(want, fetch, tracked, str(NOW))
    key = ["opportunity_id", "title", "status"]
    assert sorted(map(tuple, merger.read().select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    assert merger.versions() == [1, 2]


def test_deadline_scan(spark):
    rows = [record(i, due_date=NOW + timedelta(days=d)) for i, d in enumerate((-1, 0, 1, 5, 6, 2, 2))]
    work = spark.createDataFrame([(str(i), "result" if i == 5 else "watching", i == 6) for i in range(7)], "opportunity_id string, stage string, archived boolean")
    got = {r.opportunity_id: (r.title, r.body) for r in state.deadline_scan(opportunities(spark, rows), work, str(NOW.date())).collect()}
    assert set(got) == {"1", "2", "3"}
    assert got["2"] == ("Due in 1 day: Roof Replacement at Fire Station 12", "Broward County · stage: watching")


def incremental(spark, folder, start, **how):
    return jobs.SnapshotMerger(start, spark.createDataFrame([], "opportunity_id string"), str(NOW), f"{folder}/versions", **how)


def files_under(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_small_fetch_rewrites_its_buckets_only(spark, tmp_path):
    rows = spark.range(2000).selectExpr("cast(id as string) as opportunity_id", "'old' as title", "'open' as status",
                                        "timestamp_ntz'2024-01-01 00:00:00' as first_seen_at", "timestamp_ntz'2024-01-01 00:00:00' as last_seen_at")
    merger = incremental(spark, tmp_path, rows, complete=False, buckets=32)
    before = files_under(tmp_path / "versions")
    assert len({f.rsplit("/", 2)[1] for f in before}) == 32
    fetch = spark.createDataFrame([("7", "new", "closed"), ("1999", "new", "open"), ("x1", "first", "open")], "opportunity_id string, title string, status string")
    touched = merger.table.touched(fetch)
    merger(fetch, 0)
    fresh = {f.rsplit("/", 2)[1] for f in files_under(tmp_path / "versions") if f not in before}
    assert fresh == {f"bucket={b}" for b in touched} and len(touched) <= 3
    got = {r.opportunity_id: r for r in merger.read().collect()}
    assert len(got) == 2001 and [got[k].title for k in ("7", "1999", "x1", "8")] == ["new", "new", "first", "old"]
    assert [(got[k].present, got[k].is_new) for k in ("7", "x1", "8")] == [(True, False), (True, True), (True, False)]
    assert str(got["7"].last_seen_at) == str(NOW) and str(got["7"].first_seen_at) == "2024-01-01 00:00:00" and str(got["x1"].first_seen_at) == str(NOW)
    assert merger.table.read(0).filter("title <> 'old'").count() == 0  # the version before still reads as it was


def test_a_batch_run_again_replaces_its_version(spark, tmp_path):
    kind = "opportunity_id string, title string, status string"
    start = spark.createDataFrame([(str(i), "a", "open") for i in range(50)], kind).withColumns({c: F.lit(str(NOW)).cast("timestamp_ntz") for c in ("first_seen_at", "last_seen_at")})
    merger = incremental(spark, tmp_path, start, complete=False, buckets=4)
    for number in (0, 1, 1, 2):
        incremental(spark, tmp_path, start, complete=False)(spark.createDataFrame([(str(number), f"t{number}", "open"), (f"n{number}", "t", "open")], kind), number)
    assert incremental(spark, tmp_path, start).table.buckets == 4  # fixed by the first manifest
    got = {r.opportunity_id: r.title for r in merger.read().collect()}
    assert len(got) == 53 and [got[str(i)] for i in range(4)] == ["t0", "t1", "t2", "a"]
    assert merger.versions() == [1, 2]
    used = {(v, b) for k in merger.table.versions() for b, v in merger.table.manifest(k)["at"].items()}
    left = {(int(p.parent.name[1:]), int(p.name.split("=")[1])) for p in (tmp_path / "versions" / "data").glob("v*/bucket=*")}
    assert left == used  # nothing that no version names


def test_buckets_that_empty_and_an_empty_table(spark, tmp_path):
    from tenderloom.operators.versions import BucketTable
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    table = BucketTable(spark, str(tmp_path / "t"), rows.schema, key="k", buckets=8)
    assert table.read().count() == 0
    table.commit(0, rows, table.touched(rows))
    table.commit(1, rows.limit(0), table.touched(rows.filter("k = 'a'")))
    assert [tuple(r) for r in table.read().collect()] == [("b", 2)]
    table.commit(2, rows.limit(0), [])
    assert table.read().count() == 1
    import pytest
    with pytest.raises(ValueError, match="not said to be touched"):
        table.commit(3, rows, table.touched(rows.filter("k = 'a'")))


MONITORED = "source_id string, run_no int, run_at timestamp, place long, done boolean, row_count long, status string, note string"


def monitored(runs, done):
    place = {n: sum(m in done for m in range(n)) for n in range(100)}
    return [(s, n, datetime(2024, 1, 1) + timedelta(days=n), place[n], n in done, c, "ok" if c else "empty", note) for s, n, c, note in runs]


def silences(runs, days, now):
    out = set()
    for source in {r[0] for r in runs}:
        seen = sorted(r[1] for r in runs if r[0] == source)
        out |= {(source, a) for a, b in zip(seen, [*seen[1:], now], strict=True) if b - a > days}
    return out


def test_monitor_equals_the_batch_verdicts_and_tells_silences_once(spark, tmp_path):
    from tenderloom.streaming import monitor
    done = {n for n in range(40) if n % 7 not in (3, 5)}
    runs = [("a", n, (n * 37) % 23 * 4, None if n % 3 else "slow") for n in range(40)]
    runs += [("b", n, 0 if n % 6 == 2 else 30, "") for n in range(40) if n % 12 < 5]
    runs += [("c", n, 12, None) for n in (0, 1, 2)] + [("d", 20, 9, None)]
    rows = monitored(runs, done)
    for lo, hi in ((0, 7), (7, 8), (8, 26), (26, 40)):  # a new process each time
        part = [r for r in rows if lo <= r[1] < hi]
        spark.createDataFrame(part[::-1], MONITORED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(MONITORED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        got = jobs.drain_to_table(monitor.watch_sources(stream, silence=timedelta(days=6), forget=timedelta(days=10)), f"{tmp_path}/out").collect()
    batch = spark.createDataFrame(rows, MONITORED)
    dones = spark.createDataFrame([(n,) for n in sorted(done)], "run_no int")
    want = health.source_drops(batch.select("source_id", "run_no", "row_count", "status", "note"), dones)
    key = ["source_id", "run_no", "row_count", "norm", "status", "note"]
    judged = sorted((tuple(r[c] for c in key) for r in got if not r.silent), key=str)
    assert judged == sorted(map(tuple, want.select(key).collect()), key=str)
    told = [(r.source_id, r.run_no) for r in got if r.silent]
    assert len(told) == len(set(told)) and set(told) == silences(runs, 6, 39)
    note = next(r for r in got if r.silent and r.source_id == "c")
    assert (note.status, note.note, str(note.run_at)) == ("degraded", "no run for 6 days; last heard of in run 2", "2024-01-09 00:00:00")
