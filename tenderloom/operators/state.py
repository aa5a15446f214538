"""Table-version programs: each takes the current table and a batch and gives the next version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions import text
from tenderloom.functions.base import first_filled, first_rows, with_scalars


def merge_snapshot(current: DataFrame, incoming: DataFrame, tracked: DataFrame, now: str) -> DataFrame:
    """The next snapshot: incoming rows replace, vanished rows stay flagged absent.

    A vanished open or upcoming row is closed unless someone tracks it. Rows
    never seen before get first_seen_at = now. Also adds is_new. `incoming` must
    hold one row per opportunity_id.
    """
    stamp = F.lit(now).cast("timestamp_ntz")
    payload = [c for c in incoming.columns if c != "opportunity_id"]
    old = current.select("opportunity_id", F.lit(True).alias("__old"),
                         *[F.col(c).alias(f"old_{c}") for c in payload],
                         F.col("first_seen_at").alias("__first"), F.col("last_seen_at").alias("__last"))
    new = incoming.withColumn("__new", F.lit(True))
    marks = tracked.select("opportunity_id").distinct().withColumn("__tracked", F.lit(True))
    joined = old.join(new, "opportunity_id", "full").join(marks, "opportunity_id", "left")
    seen = F.col("__new").isNotNull()
    lapsed = ~seen & F.col("old_status").isin("open", "upcoming") & F.col("__tracked").isNull()
    columns = []
    for c in payload:
        kept = F.when(seen, F.col(c)).otherwise(F.col(f"old_{c}"))
        columns.append((F.when(lapsed, F.lit("closed")).otherwise(kept) if c == "status" else kept).alias(c))
    return joined.select(
        "opportunity_id", *columns,
        F.coalesce("__first", stamp).alias("first_seen_at"),
        F.when(seen, stamp).otherwise(F.col("__last")).alias("last_seen_at"),
        seen.alias("present"), F.col("__old").isNull().alias("is_new"))


def merge_changes(current: DataFrame, incoming: DataFrame, now: str) -> DataFrame:
    """The rows of `merge_snapshot` for a fetch that does not claim to be complete: what it does not mention stays as it is.

    `incoming` must hold one row per opportunity_id.
    """
    stamp = F.lit(now).cast("timestamp_ntz")
    payload = [c for c in incoming.columns if c != "opportunity_id"]
    told = F.lit(True).alias("__new")
    joined = (current.select("opportunity_id", F.struct(*current.columns).alias("__old"))
              .join(incoming.select("opportunity_id", F.struct(*payload).alias("__in"), told), "opportunity_id", "full"))
    seen, known = F.col("__new").isNotNull(), F.col("__old").isNotNull()
    kept = [F.when(seen, F.col("__in")[c]).otherwise(F.col("__old")[c]).alias(c) for c in payload]
    return joined.select("opportunity_id", *kept, F.when(known, F.col("__old.first_seen_at")).otherwise(stamp).alias("first_seen_at"),
                         F.when(seen, stamp).otherwise(F.col("__old.last_seen_at")).alias("last_seen_at"),
                         F.when(seen, True).otherwise(F.col("__old.present")).alias("present"),
                         F.when(known, F.col("__old.is_new") & ~seen).otherwise(F.lit(True)).alias("is_new"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "opportunity_id") -> DataFrame:
    """Keys that appeared or vanished between two snapshots."""
    appeared = after.select(key).join(before.select(key), key, "left_anti").withColumn("change", F.lit("new"))
    gone = before.select(key).join(after.select(key), key, "left_anti").withColumn("change", F.lit("gone"))
    return appeared.unionByName(gone)


def upsert(current: DataFrame, incoming: DataFrame, by: Sequence[str]) -> DataFrame:
    """Incoming rows replace rows with the same key; every other row stays."""
    kept = current.join(incoming.select(*by), list(by), "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def fill_blanks(current: DataFrame, incoming: DataFrame, key: str, fields: Sequence[str], merged_map: str | None = None) -> DataFrame:
    """Incoming values fill only blank fields; the map column is merged, incoming keys winning."""
    right = incoming.select(key, *[F.col(f).alias(f"in_{f}") for f in fields],
                            *([F.col(merged_map).alias("in_map")] if merged_map else []))
    joined = current.join(right, key, "full")
    out = [F.col(key), *[first_filled(f, F.trim(f"in_{f}")).alias(f) for f in fields]]
    if merged_map:
        empty = F.create_map().cast("map<string,string>")
        old, new = F.coalesce(merged_map, empty), F.coalesce("in_map", empty)
        out.append(F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new).alias(merged_map))
    return joined.select(*out)


def mint_missing(queue: DataFrame, leads: DataFrame, key: str = "opportunity_id") -> DataFrame:
    """Leads not already queued; queued letters are never rewritten."""
    return leads.join(queue.select(key), key, "left_anti")


def fold_workflow(events: DataFrame) -> DataFrame:
    """The state of each tracked bid after an ordered event log.

    Events carry opportunity_id, seq, at (date), and one of stage, decision,
    outcome or mail. A stage or outcome sets the stage (an outcome sets
    `result`); a later `go` turns `watching` into `preparing`. The first `sent`
    and `received` dates are kept. All of it folds map-side.
    """
    stage_set = F.coalesce(F.when(F.col("outcome").isNotNull(), F.lit("result")), F.col("stage"))
    set_at = F.when(stage_set.isNotNull(), F.col("seq"))
    go_at = F.when(F.col("decision") == "go", F.col("seq"))

    def latest(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq")))

    def first_date(kind: str) -> Column:
        return F.min_by("at", F.when(F.col("mail") == kind, F.col("seq")))

    folded = events.groupBy("opportunity_id").agg(
        F.coalesce(F.max_by(stage_set, set_at), F.lit("watching")).alias("set_stage"),
        F.coalesce(F.max(set_at), F.lit(-1)).alias("set_at"), F.max(go_at).alias("go_at"),
        latest("decision").alias("decision"), latest("outcome").alias("outcome"),
        first_date("sent").alias("sent_on"), first_date("received").alias("received_on"),
        F.count(F.lit(1)).alias("events"))
    moved = (F.col("set_stage") == "watching") & F.coalesce(F.col("go_at") >= F.col("set_at"), F.lit(False))
    return folded.withColumn("stage", F.when(moved, F.lit("preparing")).otherwise(F.col("set_stage"))) \
        .drop("set_stage", "set_at", "go_at")


def settle_runs(runs: DataFrame) -> DataFrame:
    """A run still `running` when a later one started has died.

    Runs are ordered by run_no; the newest run is found by one aggregate.
    """
    newest = runs.agg(F.max("run_no").alias("newest"))
    died = (F.col("status") == "running") & (F.col("run_no") < F.col("newest"))
    return (with_scalars(runs, newest)
            .withColumn("status", F.when(died, F.lit("died")).otherwise(F.col("status"))).drop("newest"))


def purge(table: DataFrame, marked: DataFrame, key: str = "opportunity_id") -> DataFrame:
    return table.join(marked.select(key).distinct(), key, "left_anti")


def prune_versions(cache: DataFrame, current: int, column: str = "version") -> DataFrame:
    return cache.filter(F.col(column) >= current)


def cache_misses(wanted: DataFrame, cache: DataFrame, by: Sequence[str]) -> DataFrame:
    return wanted.join(cache.select(*by).distinct(), list(by), "left_anti")


def carry_status(fresh: DataFrame, prior: DataFrame, by: Sequence[str], default: str = "suggested") -> DataFrame:
    """Matches found again keep the status they had."""
    old = prior.select(*by, F.col("status").alias("prior_status"))
    return fresh.join(old, list(by), "left").withColumn("status", F.coalesce("prior_status", F.lit(default))) \
        .drop("prior_status")


def unread_notifications(log: DataFrame) -> DataFrame:
    """One live notification per (kind, key): the newest wording, with how often it was raised."""
    raised = log.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("raised"))
    latest = first_rows(log, ["kind", "key"], [F.col("created_at").desc(), F.col("event_id").desc()])
    return latest.join(raised, ["kind", "key"])


def deadline_scan(bids: DataFrame, workflow: DataFrame, as_of: str, window: int = 5) -> DataFrame:
    """Alarms for tracked bids due within `window` days: opportunity_id, kind, title and body.

    Archived bids and those with a result raise none.
    """
    days = text.days_until_due("due_date", as_of)
    tracked = workflow.filter(~F.col("archived") & (F.col("stage") != "result")).select("opportunity_id", "stage")
    due = bids.withColumn("__days", days).filter(F.col("__days").between(0, window)).join(tracked, "opportunity_id")
    return due.select(
        "opportunity_id", F.lit("deadline_soon").alias("kind"),
        F.concat(F.lit("Due in "), F.col("__days").cast("string"), F.when(F.col("__days") == 1, " day: ").otherwise(" days: "), F.col("title")).alias("title"),
        F.concat(F.col("agency"), F.lit(" · stage: "), F.col("stage")).alias("body"))


def first_wins(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Union config tables in precedence order; the first definition of a key wins."""
    stacked = None
    for place, part in enumerate(parts):
        ranked = part.withColumn("__place", F.lit(place))
        stacked = ranked if stacked is None else stacked.unionByName(ranked, allowMissingColumns=True)
    return first_rows(stacked, [key], [F.col("__place").asc(), F.col("ordinal").asc()]).drop("__place")


def retain_newest(catalog: DataFrame, keep: int = 10) -> DataFrame:
    """Mark each snapshot kind's newest `keep` names; the rest may be removed."""
    newest = first_rows(catalog, ["kind"], [F.col("name").desc()], n=keep).withColumn("__kept", F.lit(True))
    return catalog.join(newest.select("kind", "name", "__kept"), ["kind", "name"], "left") \
        .withColumn("keep", F.col("__kept").isNotNull()).drop("__kept")


