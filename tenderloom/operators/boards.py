"""What a team's boards show: tracked bids, attention, directories, sweeps and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions import text
from tenderloom.functions.base import count_if, filled, numbered, or_blank, sum_if, with_scalars
from tenderloom.operators import filters, marts, ranking

# When a tracked bid needs attention, and how many are shown.
URGENT_DAYS, UNMET_DAYS, SHOWN = 7, 14, 8
RECENT_AWARDS, REASONS = 300, 10  # fixed values


def overlay(bids: DataFrame, workflow: DataFrame, results: DataFrame, briefs: DataFrame) -> DataFrame:
    """Bids with what the team knows of them: tracked, stage, archived, tracked_on, outcome (blank if none), has_summary.

    Each side has one row per opportunity_id; columns of `bids` are kept.
    """
    marks = workflow.select("opportunity_id", "stage", "archived", "tracked_on", F.lit(True).alias("tracked"))
    out = (bids.join(marks, "opportunity_id", "left").join(results.select("opportunity_id", "outcome"), "opportunity_id", "left")
           .join(briefs.select("opportunity_id", F.lit(True).alias("has_summary")), "opportunity_id", "left"))
    return out.withColumns({**{c: F.coalesce(c, F.lit(False)) for c in ("tracked", "archived", "has_summary")}, "outcome": F.coalesce("outcome", F.lit(""))})


def pipeline_board(bids: DataFrame, workflow: DataFrame, as_of: str, stages: Sequence[str] = marts.STAGES) -> DataFrame:
    """Every card of each stage with its place, soonest due first, and how many requirements are not ticked (`checks`)."""
    tracked = workflow.filter(F.col("stage").isin(*stages) & ~F.col("archived")).select("opportunity_id", "stage", "checks")
    order = [*filters.user_sort(text.days_until_due("due_date", as_of), False), F.col("ordinal").asc()]
    return numbered(tracked.join(bids, "opportunity_id"), order, "place", by=["stage"]).withColumn("unmet", ranking.unmet_requirements())


def attention(bids: DataFrame, workflow: DataFrame, as_of: str, shown: int = SHOWN) -> DataFrame:
    """Tracked bids due within a week, or within two with requirements open; the soonest of them."""
    active = workflow.filter(~F.col("archived") & (F.col("stage") != "result")).select("opportunity_id", "stage", "checks")
    due = bids.withColumn("days", text.days_until_due("due_date", as_of)).filter(F.col("days").between(0, UNMET_DAYS))
    judged = active.join(due, "opportunity_id").withColumn("unmet", ranking.unmet_requirements())
    return judged.filter((F.col("days") <= URGENT_DAYS) | (F.col("unmet") > 0)).orderBy("days", "ordinal").limit(shown)


def recent_awards(bids: DataFrame, most: int = RECENT_AWARDS) -> DataFrame:
    """Awards by the day they were decided, or else posted, newest first."""
    decided = bids.filter(F.col("status") == "award").withColumn("decided_on", F.coalesce("award_date", "posted_date"))
    return decided.orderBy(F.col("decided_on").desc_nulls_last(), "ordinal").limit(most)


def sweep_todo(roster: DataFrame, latest: DataFrame, mapped: DataFrame, tiers: Sequence[str]) -> DataFrame:
    """Roster entities of some tiers that no sweep has placed and no source covers."""
    placed = latest.filter(filled("platform") & (F.col("platform") != "unknown")).select("entity_id")
    return (roster.filter(F.col("tier").isin(*tiers)).join(placed, "entity_id", "left_anti").join(mapped.select("entity_id"), "entity_id", "left_anti"))


def sweep_report(latest: DataFrame, reason: Column, top: int = REASONS) -> DataFrame:
    """Platforms with their share of all entities, and the commonest reasons why one stayed unknown: section, key, count, pct."""
    total = latest.agg(F.count(F.lit(1)).alias("entities"))
    platforms = with_scalars(marts.tally(latest, "platform", "key"), total).select(
        F.lit("platform").alias("section"), "key", "count", F.bround(100 * F.col("count") / F.col("entities"), 1).alias("pct"))
    reasons = marts.tally(latest.filter(F.col("platform") == "unknown"), reason, "key").orderBy(F.desc("count"), "key").limit(top)
    return platforms.unionByName(reasons.select(F.lit("reason").alias("section"), "key", "count", F.lit(None).cast("double").alias("pct")))


def directory(entries: DataFrame, state: Column, active: Column, code: Column) -> DataFrame:
    """Active entries of a state that carry a tenant code, by name."""
    return entries.filter(state & active & code.isNotNull()).withColumn("code", code).orderBy(F.lower("name"))


def by_vendor(contracts: DataFrame) -> DataFrame:
    """Contracts of each named vendor: how many, worth how many cents, and when the last one ends."""
    held = contracts.filter(filled("vendor"))
    return held.groupBy("vendor").agg(F.count(F.lit(1)).alias("contracts"), F.sum(F.round(F.col("amount") * 100).cast("long")).alias("cents"), F.max("end_date").alias("last_end"))


def award_totals(bids: DataFrame, results: DataFrame) -> DataFrame:
    """One row: awards with an amount, all they come to, and the revenue of the bids the team won."""
    paid = bids.filter(F.col("status") == "award").agg(count_if(F.col("award_amount").isNotNull()).alias("with_amount"), F.sum("award_amount").alias("total_awarded"))
    won = results.agg(sum_if(F.col("outcome") == "won", F.coalesce("amount_cents", F.lit(0))).alias("pipeline_revenue"))
    return with_scalars(paid, won)


def expiry_summary(contracts: DataFrame, as_of: str, imminent_days: int = 90) -> DataFrame:
    """One row: contracts that end within a year, and those that end within `imminent_days`."""
    return filters.expiring(contracts, as_of).agg(F.count(F.lit(1)).alias("expiring"), count_if(F.col("days_left") <= imminent_days).alias("imminent"))


def ripe_summary(leads: DataFrame, new_days: int = 7) -> DataFrame:
    """One row: tabulations that can be asked for (rows of `records.ripe_for_request`), and those that became so within `new_days`."""
    return leads.agg(F.count(F.lit(1)).alias("ripe"), count_if(F.col("ripe_for_days") < new_days).alias("newly_ripe"))


def pricing_pool(current: DataFrame, archive: DataFrame) -> DataFrame:
    """Awards of the current records, and of archived ones that are not current."""
    older = archive.join(current.select("opportunity_id"), "opportunity_id", "left_anti")
    return current.unionByName(older, allowMissingColumns=True).filter(F.col("status") == "award")


def union_feeds(feeds: Sequence[DataFrame]) -> DataFrame:
    """All feeds' rows under one schema, missing columns null, with the feed's place as feed_no: the order that merges go by."""
    numbered_feeds = [f.withColumn("feed_no", F.lit(i)) for i, f in enumerate(feeds)]
    whole = numbered_feeds[0]
    for feed in numbered_feeds[1:]:
        whole = whole.unionByName(feed, allowMissingColumns=True)
    return whole


def status_order(status: Column, order: Sequence[str]) -> Column:
    """Sort key of a source's status: as listed, others after, silent ones last."""
    known = F.array_position(F.array(*[F.lit(s) for s in order]), or_blank(status))
    return F.when(status.isNull(), len(order) + 2).when(known > 0, known).otherwise(len(order) + 1)
