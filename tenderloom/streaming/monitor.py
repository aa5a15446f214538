"""A source monitor that remembers: recent counts as list state, the last sighting as value state, silence as a timer."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tenderloom.operators import health

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JUDGED = "source_id string, run_no int, run_at timestamp, row_count long, status string, note string, norm long, silent boolean"
_EPOCH = datetime(1970, 1, 1)


def _millis(at: datetime) -> int:
    return (at - _EPOCH) // timedelta(milliseconds=1)


class SourceMonitor(StatefulProcessor):
    """One row for each run of a source with the norm of its done runs before, and one for each time it fell silent.

    A silence is told when the watermark passes the source's last run by
    `silence`, or when its next run shows the gap, whichever comes first, and
    once only; so the rows do not hang on how runs fall into batches. A source
    not heard of for `forget` more is forgotten.
    """

    def __init__(self, silence: timedelta, forget: timedelta, lookback: int = health.LOOKBACK_RUNS):
        self.silence, self.forget, self.lookback = silence, forget, lookback

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getListState("past", "place long, row_count long")
        self.last = handle.getValueState("last", "at long, run_no int, told boolean")

    def _norm(self, past: list[tuple[int, int]], place: int) -> int | None:
        window = sorted(n for p, n in past if place - self.lookback <= p < place)
        return window[len(window) // 2] if window else None

    def _silent(self, source: str, last: tuple) -> tuple:
        return source, last[1], _EPOCH + timedelta(milliseconds=last[0]) + self.silence, None, None, None, None, True

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        past = [tuple(x) for x in self.past.get()] if self.past.exists() else []
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        new = [r for batch in rows for r in batch[["run_at", "place", "run_no", "done", "row_count", "status", "note"]].itertuples(index=False, name=None)]
        for run_at, place, run_no, done, count, status, note in sorted(new, key=lambda r: r[:3]):
            at = run_at.to_pydatetime().replace(tzinfo=None)
            if last and not last[2] and _millis(at) > last[0] + self.silence // timedelta(milliseconds=1):
                out.append(self._silent(key[0], last))
            norm = self._norm(past, place)
            out.append((key[0], run_no, at, count, status, note, norm, False))
            if done:
                past = [p for p in past if p[0] > place - self.lookback] + [(int(place), int(count))]
            last = (_millis(at), int(run_no), False)
        self.past.put(past) if past else self.past.clear()
        self.last.update(last)
        self._wait(last[0] + self.silence // timedelta(milliseconds=1) + 1)
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get()) if self.last.exists() else None
        if last is None or last[2]:
            self.past.clear()
            self.last.clear()
            yield self._frame([])
            return
        self.last.update((last[0], last[1], True))
        self._wait(expiredTimerInfo.getExpiryTimeInMs() + self.forget // timedelta(milliseconds=1))
        yield self._frame([self._silent(key[0], last)])

    def _wait(self, until: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(until)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in JUDGED.split(", ")]
        frame = pd.DataFrame(rows, columns=names).astype({"row_count": "Int64", "norm": "Int64", "run_no": "Int32", "silent": "bool"})
        frame["run_at"] = pd.to_datetime(frame["run_at"]).dt.tz_localize(timezone.utc)
        return frame

    def close(self) -> None:
        pass


def watch_sources(stream: DataFrame, silence: timedelta = timedelta(days=7), forget: timedelta = timedelta(days=90), late: str = "0 seconds") -> DataFrame:
    """Judge every run of every source as it comes, and flag sources that fell silent.

    `stream` has source_id, run_no, run_at (event time), place (how many runs
    were done before this one), done (whether this run was), row_count, status
    and note; a source's runs arrive in order across batches. Run and silence
    rows have the status and note that `health.source_drops` gives, and `silent`.
    The query keeps its state in RocksDB, which the session is set to here.
    """
    stream.sparkSession.conf.set(PROVIDER, ROCKSDB)
    timed = stream.withColumn("run_at", F.col("run_at").cast("timestamp")).withWatermark("run_at", late)
    judged = timed.groupBy("source_id").transformWithStateInPandas(SourceMonitor(silence, forget), JUDGED, "append", "EventTime")
    verdict = health.drop_verdict(F.col("status"), F.col("note"), F.col("row_count"), F.col("norm"))
    days = silence.total_seconds() / 86400
    quiet = F.concat(F.lit(f"no run for {days:g} days; last heard of in run "), F.col("run_no").cast("string"))
    named = judged.withColumn("verdict", verdict)
    return named.select("source_id", "run_no", "run_at", "row_count", "norm", "silent", F.when(F.col("silent"), F.lit("degraded")).otherwise(F.col("verdict.status")).alias("status"),
                        F.when(F.col("silent"), quiet).otherwise(F.col("verdict.note")).alias("note"))
