"""Row filters over opportunities, and the sort that goes with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions import text
from tenderloom.functions.base import all_of, or_blank

LIVE = ("open", "upcoming")
# Listing order of statuses; anything else ranks last.
STATUS_RANK = {"open": 0, "upcoming": 1, "catalog": 2, "closed": 3, "cancelled": 4}


def status_rank(status: str = "status") -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in STATUS_RANK.items() for x in pair])
    return F.coalesce(ranks[F.col(status)], F.lit(9))


def listing_order() -> list[Column]:
    """Open first, soonest due, undated last."""
    return [status_rank().asc(), F.col("due_date").asc_nulls_last(), F.col("county").asc(),
            F.col("agency").asc(), F.col("title").asc()]


def filter_opportunities(df: DataFrame, *, open_only: bool = False, county: str | None = None,
                         category: str | None = None, offer_type: str | None = None,
                         query: str | None = None) -> DataFrame:
    out = df
    if open_only:
        out = out.filter(F.col("status").isin(*LIVE))
    if county:
        out = out.filter(F.contains("county", F.lit(county.lower().replace(" ", "-"))))
    if category:
        wanted = category.lower()
        tagged = F.exists("categories", lambda c: F.lower(c) == wanted)
        out = out.filter(tagged | F.contains(F.lower(or_blank("offer_type")), F.lit(wanted)))
    if offer_type:
        out = out.filter(F.lower(or_blank("offer_type")) == offer_type.lower())
    if query:
        needle = F.lit(query.lower())
        fields = ("title", "brief", "description", "agency", "external_id")
        hit = F.lit(False)
        for name in fields:
            if name in df.columns:
                hit = hit | F.contains(F.lower(or_blank(name)), needle)
        out = out.filter(hit)
    return out


def status_among(statuses: Sequence[str]) -> Column:
    """`closed` also takes cancelled rows; no statuses means everything but catalog."""
    if not statuses:
        return F.col("status") != "catalog"
    wanted = set(statuses) | ({"cancelled"} if "closed" in statuses else set())
    return F.col("status").isin(*sorted(wanted))


def has_bond(requirements: str = "requirements") -> Column:
    return F.exists(requirements, lambda r: F.contains(F.lower(r), F.lit("bond")))


def panel_filter(df: DataFrame, as_of: str, *, statuses: Sequence[str] = (), counties: Sequence[str] = (),
                 offers: Sequence[str] = (), tiers: Sequence[str] = (), categories: Sequence[str] = (),
                 min_value: int | None = None, max_value: int | None = None, due_within: int | None = None,
                 rebids_only: bool = False, no_bond: bool = False, tracked_only: bool = False,
                 has_brief: bool = False) -> DataFrame:
    """The listing panel: unknown amounts fail a value bound, undated bids fail a due bound."""
    amount, days = text.budget_amount("budget"), text.days_until_due("due_date", as_of)
    tests = [F.col("status") != "catalog", status_among(statuses)]
    if counties:
        tests.append(F.col("county").isin(*counties))
    if offers:
        tests.append(F.col("offer_type").isin(*offers))
    if tiers:
        tests.append(F.coalesce("tier", F.lit("unknown")).isin(*tiers))
    if categories:
        tests.append(F.arrays_overlap("categories", F.array(*[F.lit(c) for c in categories])))
    if min_value is not None:
        tests.append(F.coalesce(amount >= min_value, F.lit(False)))
    if max_value is not None:
        tests.append(F.coalesce(amount <= max_value, F.lit(False)))
    if due_within is not None:
        tests.append(F.coalesce(days.between(0, due_within), F.lit(False)))
    if tracked_only:
        tests.append(F.col("tracked"))
    if rebids_only:
        tests.append(F.coalesce(F.col("prior_cycles"), F.lit(0)) > 0)
    if has_brief:
        tests.append(F.col("has_summary"))
    if no_bond:
        tests.append(~has_bond())
    return df.filter(all_of(tests))


def text_search(df: DataFrame, query: str, fields: Sequence[str]) -> DataFrame:
    """Rows whose joined fields contain every word of the query."""
    haystack = F.lower(F.concat_ws(" ", *[or_blank(f) for f in fields]))
    words = [w for w in query.lower().split() if w]
    return df.filter(all_of([F.contains(haystack, F.lit(w)) for w in words]))


def expiring(df: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """Contracts ending from today to `days` ahead, with days_left."""
    left = F.datediff(F.col("end_date"), F.lit(as_of).cast("date"))
    return df.withColumn("days_left", left).filter(F.col("days_left").between(0, days))


def decided_since(df: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Awards decided in the last `days`, with decided_on."""
    decided = F.coalesce("award_date", "posted_date")
    return (df.filter(F.col("status") == "award").withColumn("decided_on", decided)
            .filter(F.col("decided_on") >= F.date_sub(F.lit(as_of).cast("date"), days)))


def age_status(df: DataFrame, as_of: str, stale_days: int = 180) -> DataFrame:
    """Close open rows that are past due, or undated and posted long ago."""
    now = F.lit(as_of).cast("timestamp_ntz")
    stale = F.date_sub(now.cast("date"), stale_days)
    over = F.when(F.col("due_date").isNotNull(), F.col("due_date") < now) \
        .otherwise(F.coalesce(F.col("posted_date") < stale, F.lit(False)))
    return df.withColumn("status", F.when((F.col("status") == "open") & over, F.lit("closed"))
                         .otherwise(F.col("status")))


def user_sort(key: Column, descending: bool, title: str = "title") -> list[Column]:
    """A user's sort: missing values last either way, title always ascending on ties."""
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col(title).asc()]


def new_since(df: DataFrame, moment: str) -> DataFrame:
    return df.filter(F.col("status").isin(*LIVE) & (F.col("first_seen_at") > F.lit(moment).cast("timestamp_ntz")))


def enrichment_candidates(df: DataFrame, done_flag: str) -> DataFrame:
    """Rows still worth a second pass: live or award, and not fetched yet."""
    return df.filter(F.col("status").isin("open", "upcoming", "award") & ~F.col(done_flag))


def reasons_why(problems: Sequence[tuple[str, Column]]) -> Column:
    """The first failing reason, or null for a clean row."""
    out = F.lit(None).cast("string")
    for label, bad in reversed(problems):
        out = F.when(bad, F.lit(label)).otherwise(out)
    return out


