"""Reports over runs that embed the health of their sources."""

from datetime import datetime

from tenderloom.operators import runs


def run(no, status="done", health=()):
    rows = [{"source_id": s, "name": f"Portal {s}", "status": st, "count": n, "error": None, "note": None, "elapsed_ms": 5} for s, st, n in health]
    return no, datetime(2024, 1, 1), status, sum(n for *_, n in health), no % 2, rows


ROWS = [run(1, health=[("a", "ok", 5)]), run(2, "error"), run(3, health=[("b", "degraded", 2), ("a", "ok", 9), (None, "error", 1), ("c", "ok", 9), ("d", "error", 0), ("", "error", 0)])]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, runs.RUN)


def test_latest_run_alone(spark):
    got = [(r.place, r.source_id, r["count"]) for r in runs.latest_health(table(spark), "count").collect()]
    assert got == [(0, "b", 2), (1, "a", 9), (3, "c", 9), (4, "d", 0)]
    assert [r.source_id for r in runs.productivity(table(spark), 3).collect()] == ["a", "c", "b"]
    assert [r.source_id for r in runs.problems(table(spark), 1).collect()] == ["b"]


def test_trend_takes_the_done_among_the_last(spark):
    assert [(r.run_no, r.opp_count) for r in runs.trend(table(spark), 2).collect()] == [(3, 21)]
    assert [r.run_no for r in runs.trend(table(spark)).collect()] == [1, 3]


def test_status_of_every_source(spark):
    sources = spark.createDataFrame([("a",), ("b",), ("z",)], "source_id string")
    got = {r.source_id: (r.status, r["count"], r.last_run, r.last_count) for r in runs.source_status(sources, table(spark)).collect()}
    assert got == {"a": ("ok", 9, 3, 21), "b": ("degraded", 2, 3, 21), "z": (None, None, 3, 21)}
    assert {r.status: r["count"] for r in runs.status_counts(sources, table(spark)).collect()} == {"ok": 1, "degraded": 1, "silent": 1}


def test_no_runs_and_a_run_without_health(spark):
    sources = spark.createDataFrame([("a",)], "source_id string")
    for rows in ([], [run(4)], [(5, None, "running", None, None, None)]):
        runs_ = table(spark, rows)
        assert runs.latest_health(runs_, "status").count() == 0 and runs.problems(runs_).count() == 0
        assert runs.source_status(sources, runs_).first().status is None
        assert [tuple(r) for r in runs.status_counts(sources, runs_).collect()] == [("silent", 1)]


def test_embedding_keeps_the_order(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (2, "c", 4)], "run_no int, source_id string, count long")
    log = spark.createDataFrame([(1, "done"), (2, "done"), (3, "done")], "run_no int, status string")
    got = {r.run_no: None if r.health is None else [tuple(h) for h in r.health] for r in runs.embed(rows, log, ["source_id", "count"]).collect()}
    assert got == {1: [("a", 3), ("b", 2)], 2: [("c", 4)], 3: None}


def test_the_scan_reads_only_the_fields_asked_for(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "runs"))
    stored = spark.read.parquet(str(tmp_path / "runs"))

    def schema(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan[plan.index("ReadSchema"):]

    assert "elapsed_ms" not in schema(runs.latest_health(stored, "count")) and "count" in schema(runs.latest_health(stored, "count"))
    assert "health" not in schema(runs.trend(stored))
