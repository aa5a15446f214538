"""Streaming forms of the recurring programs (family M), drained over the test tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.operators import watchlists
from tenderloom.plans.q_linkage import MATCHED, gazetteer, rules
from tenderloom.plans.q_ranking import JUDGED, RUN_LOG, RUN_ROWS, run_log, run_rows
from tenderloom.plans.q_state import MERGE_SQL, NOW, _new, _old
from tenderloom.plans.registry import query
from tenderloom.plans.sqltext import DAYS
from tenderloom.plans.tables import AS_OF, Tables
from tenderloom.session import scratch_path
from tenderloom.streaming import jobs, monitor


def event_stream(t: Tables) -> DataFrame:
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)


def as_stream(df: DataFrame, label: str, *slices: str) -> DataFrame:
    """Write rows to a table, as many files for each slice in turn, and read it as a stream of one slice a batch.

    A slice is written by many tasks; one with fewer files than the others gets empty ones, since a batch is a number of files.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    slices = slices or ("true",)
    width, files = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*.parquet")
    system = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k, part in enumerate(slices, 1):
        df.filter(part).repartition(width).write.mode("append").parquet(path)
        for _ in range(k * width - len(system.globStatus(files))):
            df.limit(0).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", width).parquet(path)


@query("deadline_load_stream", """SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS count, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value
    FROM events WHERE event_type <> 'error' GROUP BY 1""")
def deadline_load_stream(t: Tables) -> DataFrame:
    valued = event_stream(t).filter("event_type <> 'error'").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return jobs.drain_updates(jobs.weekly_load(valued, "ts", "cents"), scratch_path(t.spark, "weekly-load"), ["week"])


@query("notification_stream", "SELECT DISTINCT event_type AS kind, entity_id AS key FROM log", "log")
def notification_stream(t: Tables) -> DataFrame:
    alarms = event_stream(t).select(F.col("event_type").alias("kind"), F.expr("concat('ent', user_id)").alias("key"), "ts")
    return jobs.drain_to_table(jobs.unread_alarms(alarms, "ts", "60 days").select("kind", "key"), scratch_path(t.spark, "alarms"))


@query("stream_source_drops", f"""WITH {RUN_ROWS}, n AS (SELECT *, list_sort(list(row_count) OVER (PARTITION BY source_id ORDER BY run_no RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING)) AS past FROM runs_n)
    SELECT source_id, run_no, row_count, past[len(past) // 2 + 1] AS norm FROM n""", "runs")
def stream_source_drops(t: Tables) -> DataFrame:
    runs = as_stream(run_rows(t).select("source_id", "run_no", "row_count"), "runs", "run_no < 10", "run_no BETWEEN 10 AND 19", "run_no > 19")
    return jobs.drain_to_table(jobs.monitor_sources(runs), scratch_path(t.spark, "source-drops"))


@query("source_monitor_stream", f"""WITH {RUN_LOG}, {JUDGED},
    g AS (SELECT source_id, run_no, run_at, lead(run_at) OVER (PARTITION BY source_id ORDER BY run_no) AS after, (SELECT max(run_at) FROM runs_n) AS now FROM runs_n)
    SELECT source_id, run_no, row_count, norm, false AS silent, status, note FROM jd
    UNION ALL SELECT source_id, run_no, NULL, NULL, true, 'degraded', 'no run for 4 days; last heard of in run ' || run_no
    FROM g WHERE coalesce(after, now) > run_at + INTERVAL 4 DAY""", "runs")
def source_monitor_stream(t: Tables) -> DataFrame:
    """Verdicts of every run, and the times a source was not heard of for four days, over batches of runs."""
    rows = run_rows(t)
    log = run_log(t).select("run_no", (F.col("status") == "done").alias("done"))
    before = Window.orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = log.withColumn("place", F.coalesce(F.sum(F.col("done").cast("long")).over(before), F.lit(0)))  # one row a run
    told = rows.join(placed, "run_no").select("source_id", "run_no", F.col("run_at").cast("timestamp").alias("run_at"), "place", "done", "row_count", "status", "note")
    runs = as_stream(told, "monitored-runs", "run_no < 9", "run_no BETWEEN 9 AND 17", "run_no > 17")
    judged = monitor.watch_sources(runs, silence=timedelta(days=4))
    return jobs.drain_to_table(judged, scratch_path(t.spark, "source-monitor")).drop("run_at")


@query("snapshot_merge_stream", MERGE_SQL, "bids")
def snapshot_merge_stream(t: Tables) -> DataFrame:
    tracked = t.bids.filter("ordinal % 15 = 0").select("opportunity_id")
    merger = jobs.SnapshotMerger(_old(t), tracked, NOW, scratch_path(t.spark, "snapshots"))
    jobs.drain(as_stream(_new(t), "fetches"), scratch_path(t.spark, "snapshot-merge"), merger)
    return merger.read().drop("ordinal")


@query("snapshot_delta_stream", MERGE_SQL.replace("WHEN old.status IN ('open', 'upcoming') AND old.ordinal % 15 <> 0 THEN 'closed' ELSE old.status", "ELSE old.status")
       .replace("new.opportunity_id IS NOT NULL AS present", "true AS present"), "bids")
def snapshot_delta_stream(t: Tables) -> DataFrame:
    """Fetches of some sources' rows at a time: each rewrites the buckets of its ids, and what none mentions stays as it was."""
    merger = jobs.SnapshotMerger(_old(t), t.bids.select("opportunity_id").limit(0), NOW, scratch_path(t.spark, "snapshot-buckets"), complete=False)
    fetches = as_stream(_new(t), "partial-fetches", "ordinal % 5 = 1", "ordinal % 5 IN (2, 3)", "ordinal % 5 = 4")
    jobs.drain(fetches, scratch_path(t.spark, "snapshot-delta"), merger)
    return merger.read().drop("ordinal")


@query("match_alert_stream", f"""WITH {MATCHED}, fr AS (SELECT * FROM mt WHERE ordinal % 10 = 1) SELECT watchlist_id, arg_min(opportunity_id, coalesce({DAYS}, 9999) * 10000000000::HUGEINT
      + rnk) AS opportunity_id, count(*) AS found FROM (SELECT *, row_number() OVER (ORDER BY coalesce({DAYS}, 9999), lower(title), ordinal) AS rnk FROM fr) GROUP BY watchlist_id""", "bids")
def match_alert_stream(t: Tables) -> DataFrame:
    """Alerts for each fetch's new bids; a bid announced twice within a month alerts once."""
    out = scratch_path(t.spark, "alerts")
    fresh = as_stream(t.bids.filter("ordinal % 10 = 1"), "new-bids")
    once = fresh.withColumn("at", F.col("first_seen_at").cast("timestamp")).withWatermark("at", "30 days") \
        .dropDuplicatesWithinWatermark(["opportunity_id"])

    def alert(batch: DataFrame, number: int) -> None:
        named = watchlists.with_named_counties(batch.drop("at"), gazetteer(t), watchlists.needs_prose())
        found = watchlists.alerts(watchlists.matches(named, rules(t)), AS_OF)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    jobs.drain(once, f"{out}-checkpoint", alert)
    return t.spark.read.schema("watchlist_id string, opportunity_id string, found long, body string").parquet(out) \
        .select("watchlist_id", "opportunity_id", "found")
