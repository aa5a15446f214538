"""Source health: what a fetch's outcome means, judged against the source's own past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.functions.base import blank, filled, with_scalars

# Fixed values.
LOOKBACK_RUNS, MIN_NORM, SHARP_FLOOR = 8, 3, 10
UNVERIFIED_LOOKBACK, UNVERIFIED_MIN_RUNS, UNVERIFIED_MIN_DAYS = 120, 6, 7


def classify_result(rows: Column, degraded_reason: Column, allows_empty: Column, empty_note: Column,
                    blocked: Column, failed: Column) -> Column:
    """struct(status, note) of one source's fetch."""
    def outcome(status: str, note: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), note.cast("string").alias("note"))

    none = F.lit(None)
    return (F.when(blocked, outcome("degraded", F.lit("portal blocked this client")))
            .when(failed, outcome("error", none))
            .when(filled(degraded_reason), outcome("degraded", degraded_reason))
            .when(rows > 0, outcome("ok", none))
            .when(allows_empty, outcome("empty", F.when(filled(empty_note), empty_note)
                                        .otherwise(F.lit("portal listed no open solicitations"))))
            .otherwise(outcome("degraded", F.lit("fetched but parsed zero rows"))))


def upper_median(values: Column) -> Column:
    """The element at n//2 of the sorted values."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def drop_verdict(status: Column, note: Column, count: Column, norm: Column) -> Column:
    """struct(status, note) after comparing this run's count with the recent norm."""
    quiet = (count == 0) & status.isin("ok", "empty")
    sharp = (count < norm * 0.3) & (norm >= SHARP_FLOOR)
    normed = norm.cast("string")
    told = F.concat(F.lit("sharp drop: "), count.cast("string"), F.lit(" rows vs recent norm "), normed)
    return (F.when(norm.isNull() | (norm < MIN_NORM), F.struct(status.alias("status"), note.alias("note")))
            .when(quiet, F.struct(F.lit("degraded").alias("status"), F.concat(
                F.lit("returned 0 rows; this source's recent norm is "), normed).alias("note")))
            .when(sharp, F.struct(status.alias("status"), F.when(blank(note), told)
                                  .otherwise(F.concat(note, F.lit("; "), told)).alias("note")))
            .otherwise(F.struct(status.alias("status"), note.alias("note"))))


TREND_RUNS = 30  # fixed value: runs on the trend line


def source_drops(runs: DataFrame, done_runs: DataFrame) -> DataFrame:
    """Judge every (source, run) against that source's counts in the eight done runs before.

    `runs` has source_id, run_no, row_count, status and note; `done_runs` the
    run_no of each run that was done. A failed run neither counts nor shortens
    the window. A source has one row per run, so its window holds at most eight
    values.
    """
    # one row per run: how many done runs came before it
    ordered = runs.select("run_no").distinct().join(done_runs.select("run_no", F.lit(True).alias("done")), "run_no", "left")
    before = Window.orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.withColumn("done_before", F.coalesce(F.sum(F.col("done").cast("int")).over(before), F.lit(0)))
    past = Window.partitionBy("source_id").orderBy("done_before").rangeBetween(-LOOKBACK_RUNS, -1)
    judged = (runs.join(placed, "run_no")
              .withColumn("norm", upper_median(F.collect_list(F.when(F.col("done"), F.col("row_count"))).over(past)))
              .drop("done", "done_before"))
    verdict = drop_verdict(F.col("status"), F.col("note"), F.col("row_count"), F.col("norm"))
    return (judged.withColumn("verdict", verdict)
            .withColumn("status", F.col("verdict.status")).withColumn("note", F.col("verdict.note")).drop("verdict"))


def never_verified(history: DataFrame, current: DataFrame, now: str) -> DataFrame:
    """Mark empty sources that no recent run ever saw a row from.

    `history` (source_id, run_no, run_at, row_count) is cut to the last 120
    runs; a source needs six sightings, this run included, over seven days.
    """
    last = history.agg(F.max("run_no").alias("last_run"))
    recent = with_scalars(history, last).filter(F.col("run_no") > F.col("last_run") - UNVERIFIED_LOOKBACK)
    seen = recent.groupBy("source_id").agg(F.count(F.lit(1)).alias("seen"), F.max("row_count").alias("best"),
                                           F.min("run_at").alias("since"))
    moment = F.lit(now).cast("timestamp_ntz")
    days = F.floor((F.unix_seconds(moment.cast("timestamp")) - F.unix_seconds(F.col("since").cast("timestamp"))) / 86400)
    flagged = ((F.col("row_count") == 0) & (F.col("status") == "empty") & (F.coalesce("best", F.lit(0)) == 0)
               & (F.coalesce("seen", F.lit(0)) + 1 >= UNVERIFIED_MIN_RUNS)
               & F.coalesce(days >= UNVERIFIED_MIN_DAYS, F.lit(False)))
    told = F.concat(F.lit("no record in "), (F.col("seen") + 1).cast("string"), F.lit(" fetches over "),
                    days.cast("string"), F.lit(" days — never verified as a live board"))
    return (current.join(seen, "source_id", "left")
            .withColumn("note", F.when(flagged, F.concat_ws("; ", F.when(filled("note"), F.col("note")), told))
                        .otherwise(F.col("note")))
            .withColumn("status", F.when(flagged, F.lit("unverified")).otherwise(F.col("status")))
            .drop("seen", "best", "since"))


# Statuses this pair moves between as pages fill and empty; not a platform change.
FLICKER = ("selfhosted", "unknown")


def platform_moves(recorded: DataFrame, fresh: DataFrame) -> DataFrame:
    """Compare fresh platform findings with recorded ones: unchanged, moved or lost."""
    was = F.coalesce("was", F.lit("unknown"))
    joined = fresh.join(recorded.select("entity_id", F.col("platform").alias("was")), "entity_id", "left") \
        .withColumn("was", was)
    same = (F.col("was") == F.col("platform")) | (F.col("was").isin(*FLICKER) & F.col("platform").isin(*FLICKER))
    return joined.withColumn("verdict", F.when(same, "unchanged").when(F.col("platform") == "unknown", "lost")
                             .otherwise("moved"))


def lost_threshold(checked: Column) -> Column:
    return F.greatest(F.lit(5), F.floor(checked / 4))
