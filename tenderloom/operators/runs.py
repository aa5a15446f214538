"""Reports on fetch runs whose rows embed the health of their sources.

A run is one row: run_no, finished_at, status, opp_count, new_count, and health,
an array of structs in the order the sources are configured. The array holds a
run's sources, so its length is theirs. Reports name the fields they read: the
scan takes those of the array alone, and a report that needs none leaves it out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.base import filled, with_scalars

RUN = """run_no int, finished_at timestamp_ntz, status string, opp_count long, new_count long,
    health array<struct<source_id:string,name:string,status:string,count:long,error:string,note:string,elapsed_ms:long>>"""
TREND_RUNS, TOP_SOURCES, PROBLEMS = 30, 10, 6  # fixed values
BAD = ("degraded", "error")                    # fixed values


def embed(rows: DataFrame, runs: DataFrame, fields: Sequence[str], order: str = "source_id") -> DataFrame:
    """Runs with the health rows (run_no, `fields`) of their sources as an array in the given order."""
    health = rows.groupBy("run_no").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__at"), *fields))).alias("health"))
    plain = F.transform("health", lambda h: F.struct(*[h[f].alias(f) for f in fields]))
    return runs.join(health.select("run_no", plain.alias("health")), "run_no", "left")


def newest(runs: DataFrame) -> DataFrame:
    """The latest run, whatever became of it."""
    return runs.orderBy(F.desc("run_no")).limit(1)


def latest_health(runs: DataFrame, *fields: str) -> DataFrame:
    """Health rows of the latest run with their place; rows that name no source are skipped."""
    wanted = dict.fromkeys(["source_id", *fields])
    # only the fields asked for are read from the array
    few = runs.select("run_no", F.arrays_zip(*[F.col(f"health.{f}").alias(f) for f in wanted]).alias("health"))
    rows = newest(few).select("run_no", F.posexplode("health").alias("place", "h")).select("run_no", "place", "h.*")
    return rows.filter(filled("source_id"))


def problems(runs: DataFrame, most: int = PROBLEMS) -> DataFrame:
    """The first sources of the latest run that need attention."""
    bad = latest_health(runs, "status", "count", "error").filter(F.col("status").isin(*BAD))
    return bad.orderBy("place").limit(most)


def productivity(runs: DataFrame, top: int = TOP_SOURCES) -> DataFrame:
    """The latest run's sources by how many rows they gave; on ties as configured."""
    return latest_health(runs, "status", "count").orderBy(F.desc("count"), "place").limit(top)


def trend(runs: DataFrame, last: int = TREND_RUNS) -> DataFrame:
    """Counts of the done ones among the last runs, oldest first."""
    recent = runs.select("run_no", "finished_at", "status", "opp_count", "new_count").orderBy(F.desc("run_no")).limit(last)
    return recent.filter(F.col("status") == "done").orderBy("run_no").select("run_no", "finished_at", "opp_count", "new_count")


def source_status(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Every configured source with its health in the latest run, null where silent, and that run's number and total."""
    health = latest_health(runs, "status", "count").select("source_id", "status", "count")
    summary = newest(runs.select("run_no", "opp_count")).select(F.col("run_no").alias("last_run"), F.col("opp_count").alias("last_count"))
    return with_scalars(sources.select("source_id").join(health, "source_id", "left"), summary.agg(F.max("last_run").alias("last_run"), F.max("last_count").alias("last_count")))


def status_counts(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """How many sources stand at each status; those the latest run does not speak of are silent."""
    health = latest_health(runs, "status").select("source_id", "status")
    return sources.select("source_id").join(health, "source_id", "left").groupBy(F.coalesce("status", F.lit("silent")).alias("status")).agg(F.count(F.lit(1)).alias("count"))
