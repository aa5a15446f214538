"""The recurring programs as Structured Streaming jobs.

Event times are cast to TIMESTAMP, since watermarks do not take TIMESTAMP_NTZ.
Outputs and checkpoints are folders that the caller names: a job started again
with the same folders goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tenderloom.operators import health, state, versions


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a query over everything available now, handing each micro-batch to `each`."""
    query = (stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def drain_to_table(stream: DataFrame, out: str) -> DataFrame:
    """Append a stream's rows to the Parquet table `out` until nothing is left, and read it."""
    query = (stream.writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, out: str, by: list[str]) -> DataFrame:
    """Keep the newest row of every `by` from a query in update mode, and read them.

    Each micro-batch writes its changed rows under its own number, so a batch
    that is run again replaces itself.
    """
    drain(stream, f"{out}-checkpoint", lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), "update")
    values = [c for c in stream.columns if c not in by]
    rows = stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(out)
    return rows.groupBy(*by).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*by, "v.*")


def weekly_load(stream: DataFrame, ts: str, value: str, late: str = "7 days") -> DataFrame:
    """Count and value per Monday-based week of an event-time column.

    Run it in update mode: a week changes until the watermark is past it, then
    its state goes, and rows later than `late` are left out.
    """
    timed = stream.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    weeks = timed.groupBy(F.window("at", "7 days", "7 days", "4 days")).agg(
        F.count(F.lit(1)).alias("count"), F.sum(value).alias("value"))
    return weeks.select(F.col("window.start").cast("date").alias("week"), "count", "value")


def unread_alarms(stream: DataFrame, ts: str, keep: str) -> DataFrame:
    """One alarm per (kind, key) within the retention interval: the first one raised.

    An alarm has gone out before a later wording is known; the batch form,
    `state.unread_notifications`, lists the newest wording instead.
    """
    return (stream.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", keep)
            .dropDuplicatesWithinWatermark(["kind", "key"]))


def monitor_sources(stream: DataFrame) -> DataFrame:
    """Judge each source's runs against its previous eight, keeping those counts as state.

    `stream` has source_id, run_no and row_count; a source has one row per run
    and its runs arrive in order across batches.
    """
    lookback = health.LOOKBACK_RUNS

    def judge(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        past, rows = list(zip(*held.get)) if held.exists else [], []
        # A source's new runs may come in several Arrow batches; they are few, and sorted together.
        new = sorted((int(r), int(c)) for batch in batches for r, c in batch[["run_no", "row_count"]].itertuples(index=False))
        for run, count in new:
            window = sorted(c for r, c in past if run - lookback <= r < run)
            rows.append((key[0], run, count, window[len(window) // 2] if window else None))
            past = [p for p in past if p[0] > run - lookback] + [(run, count)]
        held.update(([r for r, _c in past], [c for _r, c in past]))
        yield pd.DataFrame(rows, columns=["source_id", "run_no", "row_count", "norm"]).astype({"norm": "Int64"})

    return stream.groupBy("source_id").applyInPandasWithState(
        judge, "source_id string, run_no int, row_count long, norm long", "runs array<int>, counts array<long>",
        "append", GroupStateTimeout.NoTimeout)


class SnapshotMerger:
    """Folds fetches into a versioned table of buckets: batch n makes version n + 1 of the one before it.

    A complete fetch flags what it does not mention as absent, which concerns
    every bucket. A fetch that is not complete (`complete=False`: one source's
    rows, a page of changes) reads and rewrites only the buckets of the ids it
    brings. Versions live under `root`; the newest is found there, so a new
    process goes on from it, and a batch that is run again replaces its own
    version from the same input. The last two versions stay.
    """

    def __init__(self, initial: DataFrame, tracked: DataFrame, now: str, root: str, complete: bool = True, buckets: int = versions.BUCKETS):
        flags = [F.lit(True).alias("present"), F.lit(False).alias("is_new")]
        first = initial.select("*", *[f for f, name in zip(flags, ("present", "is_new"), strict=True) if name not in initial.columns])
        self.table = versions.BucketTable(initial.sparkSession, root, first.schema, buckets=buckets)
        self.tracked, self.now, self.complete = tracked, now, complete
        if not self.versions():
            self.table.commit(0, first, list(range(self.table.buckets)))

    def versions(self) -> list[int]:
        """Numbers of the batches whose versions are there; -1 is the start."""
        return [v - 1 for v in self.table.versions()]

    def __call__(self, batch: DataFrame, number: int) -> None:
        before = max(v for v in self.versions() if v < number) + 1
        touched = list(range(self.table.buckets)) if self.complete else self.table.touched(batch)
        current = self.table.read(before, touched)
        merged = state.merge_snapshot(current, batch, self.tracked, self.now) if self.complete else state.merge_changes(current, batch, self.now)
        self.table.commit(number + 1, merged, touched, before)

    def read(self) -> DataFrame:
        return self.table.read()
