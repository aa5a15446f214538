"""Saved rules against live bids.

A rule pairs with bids through one equi-key: its counties if it names any, else
its offers, else its categories, else `*`. Rules are counted: up to 100,000 of
their keys are brought to the bids, which then are not shuffled at all; more
make an ordinary shuffled join whose hot keys AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions import geo, text
from tenderloom.functions.base import brought, filled_array, filled_number, first_rows, or_blank
from tenderloom.operators.filters import LIVE, has_bond

RULE_SCHEMA = ("watchlist_id string, counties array<string>, offers array<string>, categories array<string>, "
               "keywords array<string>, min_value long, max_value long, no_bond boolean, recurring_only boolean, "
               "include_statewide boolean")


def with_named_counties(df: DataFrame, gazetteer: geo.Gazetteer, only: Column | None = None) -> DataFrame:
    """Add named_counties: counties a bid names in its keywords or prose, besides its own field.

    Where `only` is given, prose is read for those rows alone; the others do
    not enter the search. Rows are told apart by `ordinal`.
    """
    slugs = F.array(*[F.lit(s) for s in geo.COUNTY_NAMES])
    prose = F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in ("title", "description", "department")])
    own = F.array_intersect("keywords", slugs)
    read = df if only is None else df.filter(only)
    guessed = geo.infer_counties(read.withColumn("__prose", prose), gazetteer, agency="__prose", out="__guess", key="ordinal")
    found = F.array_union(own, F.filter(F.array("__guess"), lambda c: F.array_contains(slugs, c)))
    told = guessed.withColumn("named_counties", found).drop("__prose", "__guess").select(*df.columns, "named_counties")
    if only is None:
        return told
    return told.unionByName(df.filter(~F.coalesce(only, F.lit(False))).withColumn("named_counties", own))


def needs_prose() -> Column:
    """Rows whose named counties can decide a match: live bids of statewide sources."""
    return (F.col("county") == "statewide") & F.col("status").isin(*LIVE)


def county_allows(wanted: Column, include_statewide: Column) -> Column:
    """Own county; else a statewide bid that names a wanted county; else the opt-in."""
    named = F.col("named_counties")
    return (~filled_array(wanted)
            | F.array_contains(wanted, F.col("county"))
            | ((F.col("county") == "statewide")
               & F.when(F.size(named) > 0, F.arrays_overlap(named, wanted))
               .otherwise(F.coalesce(include_statewide, F.lit(False)))))


def _prefixed(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(kind + ":"), v))


def matches(df: DataFrame, rules: DataFrame) -> DataFrame:
    """(watchlist_id, bid columns) for every live bid each rule accepts.

    `df` carries named_counties (see `with_named_counties`).
    """
    counties, offers, categories = F.col("rule.counties"), F.col("rule.offers"), F.col("rule.categories")
    route = (F.when(filled_array(counties),
                    _prefixed("county", F.array_union(counties, F.array(F.lit("statewide")))))
             .when(filled_array(offers), _prefixed("offer", F.array_distinct(offers)))
             .when(filled_array(categories), _prefixed("category", F.array_distinct(categories)))
             .otherwise(F.array(F.lit("*"))))
    keyed_rules = rules.select(F.struct(*rules.columns).alias("rule")).withColumn("key", F.explode(route))
    offer = F.coalesce("offer_type", F.lit("unknown"))
    doors = F.concat(F.array(F.concat(F.lit("county:"), F.col("county")), F.concat(F.lit("offer:"), offer), F.lit("*")),
                     _prefixed("category", F.array_distinct("categories")))
    live = df.filter(F.col("status").isin(*LIVE)).withColumn("key", F.explode(doors))
    amount = text.budget_amount("budget")
    words = F.lower(F.concat_ws(" ", F.col("title"), or_blank("scope"), or_blank("description"),
                                F.array_join("categories", " ")))
    low, high = F.col("rule.min_value"), F.col("rule.max_value")
    shared_tag = F.get(F.array_intersect(F.col("categories"), categories), F.lit(0))
    accepted = (
        county_allows(counties, F.col("rule.include_statewide"))
        & (~filled_array(offers) | F.array_contains(offers, offer))
        & (~filled_array(categories) | F.arrays_overlap(F.col("categories"), categories))
        # Zero bounds mean unset, and unknown amounts pass.
        & (~filled_number(low) | amount.isNull() | (amount >= low))
        & (~filled_number(high) | amount.isNull() | (amount <= high))
        & (~F.coalesce("rule.no_bond", F.lit(False)) | ~has_bond())
        & (~F.coalesce("rule.recurring_only", F.lit(False)) | (F.coalesce("prior_cycles", F.lit(0)) > 0))
        & (~filled_array("rule.keywords") | F.exists("rule.keywords", lambda w: F.contains(words, F.lower(w))))
        # A bid sharing several categories with a rule is kept at the first only.
        & (~F.startswith("key", F.lit("category:")) | (F.col("key") == F.concat(F.lit("category:"), shared_tag))))
    return (live.join(brought(keyed_rules), "key").filter(accepted)
            .withColumn("watchlist_id", F.col("rule.watchlist_id")).drop("key", "rule"))


def soonest_first(as_of: str) -> list[Column]:
    days = F.coalesce(text.days_until_due("due_date", as_of), F.lit(9_999))
    return [days.asc(), F.lower("title").asc(), F.col("ordinal").asc()]


def unseen(matched: DataFrame, seen: DataFrame) -> DataFrame:
    """Matches whose (watchlist_id, opportunity_id) has not been marked seen."""
    return matched.join(seen, ["watchlist_id", "opportunity_id"], "left_anti")


def marked(matched: DataFrame, seen: DataFrame) -> DataFrame:
    """Matches with was_seen: true where (watchlist_id, opportunity_id) has been marked seen, else null. What is new, what
    was seen and how much of each are then aggregates of one stream."""
    known = seen.select("watchlist_id", "opportunity_id").distinct().withColumn("was_seen", F.lit(True))
    return matched.join(known, ["watchlist_id", "opportunity_id"], "left")


def mark_seen(seen: DataFrame, shown: DataFrame) -> DataFrame:
    """The seen pairs after a list was shown: each once, whoever marked it."""
    pair = ["watchlist_id", "opportunity_id"]
    return seen.select(*pair).unionByName(shown.select(*pair)).distinct()


def counts(matched: DataFrame, seen: DataFrame, rules: DataFrame) -> DataFrame:
    """match_count and new_count per watchlist, zero for those with none."""
    sums = marked(matched.select("watchlist_id", "opportunity_id"), seen).groupBy("watchlist_id").agg(
        F.count(F.lit(1)).alias("match_count"), F.count(F.when(F.col("was_seen").isNull(), 1)).alias("new_count"))
    return rules.select("watchlist_id").join(sums, "watchlist_id", "left").select(
        "watchlist_id", F.coalesce("match_count", F.lit(0)).alias("match_count"),
        F.coalesce("new_count", F.lit(0)).alias("new_count"))


def alerts(fresh: DataFrame, as_of: str) -> DataFrame:
    """One alert per watchlist: its soonest-due new bid as lead, and how many more."""
    sizes = fresh.groupBy("watchlist_id").agg(F.count(F.lit(1)).alias("found"))
    lead = first_rows(fresh, ["watchlist_id"], soonest_first(as_of))
    return lead.join(sizes, "watchlist_id").select(
        "watchlist_id", "opportunity_id", "found",
        F.concat(F.col("title"), F.when(F.col("found") > 1, F.concat(
            F.lit(" (+"), (F.col("found") - 1).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))).alias("body"))
