"""Go / no-go meters for one bid: fit, capacity and margin, with written reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.functions import text
from tenderloom.functions.base import brought, filled, filled_number, first_rows, matches, with_scalars
from tenderloom.operators.filters import has_bond
from tenderloom.session import cut_lineage

COMPLIANCE = r"prevailing wage|davis[- ]bacon|sbe|mbe|dbe|local preference"  # fixed value
WINDOW_DAYS = 14


def clamp(score: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.bround(score).cast("int")))


def reasons(*steps: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*steps)), " · ")


def fit_scores(df: DataFrame, tracked: DataFrame, watch_hits: DataFrame, won_offers: DataFrame) -> DataFrame:
    """Add fit_score and fit_reasons.

    `tracked` (opportunity_id, ordinal, offer_type, county), `watch_hits`
    (opportunity_id, hits) and `won_offers` (offer_type) describe the user's
    work. A tracked bid is compared with the others only. Offers are an
    enumeration, so their counts fit one array.
    """
    ranked = first_rows(tracked, ["offer_type"], [F.col("ordinal").asc()], n=2, keep_rank="at")
    offers = tracked.groupBy("offer_type").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
    second = ranked.filter(F.col("at") == 2).select("offer_type", F.col("ordinal").alias("second"))
    table = offers.join(second, "offer_type", "left").agg(
        F.collect_list(F.struct("offer_type", "n", "first", "second")).alias("offers"))
    places = tracked.groupBy("county").agg(F.count(F.lit(1)).alias("county_n"))
    own = tracked.select("opportunity_id", F.lit(1).alias("is_tracked"))
    wins = won_offers.select("offer_type").distinct().withColumn("has_won", F.lit(True))
    joined = (df.join(own, "opportunity_id", "left").join(places, "county", "left")
              .join(watch_hits, "opportunity_id", "left").join(brought(wins), "offer_type", "left"))
    base = with_scalars(joined, table).withColumn("__self", F.coalesce("is_tracked", F.lit(0)))
    # Take the bid itself out of the counts before choosing the modal offer.
    def others(o: Column) -> Column:
        mine = (F.col("__self") == 1) & (o["offer_type"] == F.col("offer_type"))
        first = F.when(mine & (o["first"] == F.col("ordinal")), o["second"]).otherwise(o["first"])
        return F.struct((o["n"] - mine.cast("int")).alias("n"), (-first).alias("first"), o["offer_type"].alias("offer"))

    counted = base.withColumn("__others", F.filter(F.transform("offers", others), lambda o: o["n"] > 0))
    modal = F.array_max("__others")["offer"]
    spaced = F.replace("offer_type", F.lit("_"), F.lit(" "))
    hits = F.coalesce("hits", F.lit(0))
    bump = F.when(hits == 0, 0).when(hits == 1, 20).otherwise(30)
    same_kind = F.coalesce((modal != "unknown") & (modal == F.col("offer_type")), F.lit(False))
    same_place = F.coalesce(F.col("county_n") - F.col("__self") > 0, F.lit(False))
    won, vague = F.coalesce("has_won", F.lit(False)), F.col("offer_type") == "unknown"
    total = (40 + bump + F.when(same_kind, 15).otherwise(0) + F.when(same_place, 5).otherwise(0)
             + F.when(won, 10).otherwise(0) - F.when(vague, 10).otherwise(0))
    return (counted
            .withColumn("fit_score", clamp(total, 5, 95))
            .withColumn("fit_reasons", reasons(
                F.lit("baseline 40"),
                F.when(hits > 0, F.concat(F.lit("matches "), hits.cast("string"), F.lit(" of your watchlist"),
                                          F.when(hits == 1, "").otherwise("s"), F.lit(" (+"), bump.cast("string"), F.lit(")"))),
                F.when(same_kind, F.concat(F.lit("most of your pipeline is "), spaced, F.lit(" (+15)"))),
                F.when(same_place, F.lit("you already work this county (+5)")),
                F.when(won, F.concat(F.lit("you have won "), spaced, F.lit(" work (+10)"))),
                F.when(vague, F.lit("work type unclear from the listing (−10)"))))
            .drop("is_tracked", "county_n", "hits", "has_won", "offers", "__self", "__others"))


def nearby_committed(df: DataFrame, committed: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Add near: other committed bids due within `days` either side.

    No pairs are formed. Committed bids are counted per due moment; the counts
    at or before any moment come from a running sum inside its day plus the
    total of earlier days, and each bid subtracts two such counts.
    """
    span = F.expr(f"INTERVAL {days} DAYS")
    none = F.lit(None).cast("timestamp_ntz")
    load = committed.filter(F.col("due_date").isNotNull()).groupBy(F.col("due_date").alias("at")) \
        .agg(F.count(F.lit(1)).alias("n")).select("at", "n", none.alias("due_date"), F.lit("load").alias("end"))
    due = F.col("due_date")
    probes = (df.filter(due.isNotNull()).select("due_date").distinct()
              .select("due_date", F.explode(F.array(F.struct((due + span).alias("at"), F.lit("last").alias("end")),
                                                    F.struct((due - span).alias("at"), F.lit("first").alias("end")))).alias("p"))
              .select("p.at", F.lit(0).cast("long").alias("n"), "due_date", "p.end"))
    # Distinct moments only, so far smaller than the bids; read twice below.
    points = cut_lineage(load.unionByName(probes).withColumn("day", F.col("at").cast("date"))
                         .withColumn("micros", F.unix_micros(F.col("at").cast("timestamp"))))
    by_time = Window.partitionBy("day").orderBy("micros")
    inside = points.withColumn("through", F.sum("n").over(by_time.rangeBetween(Window.unboundedPreceding, 0))) \
        .withColumn("under", F.coalesce(F.sum("n").over(by_time.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # One row per calendar day, so one running sum over all of them is small.
    before = points.groupBy("day").agg(F.sum("n").alias("day_n")).withColumn("before", F.coalesce(F.sum("day_n").over(
        Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("day_n")
    ends = inside.filter("end <> 'load'").join(before, "day").groupBy("due_date").agg(
        F.max(F.when(F.col("end") == "last", F.col("before") + F.col("through"))).alias("through"),
        F.max(F.when(F.col("end") == "first", F.col("before") + F.col("under"))).alias("under"))
    own = committed.filter(F.col("due_date").isNotNull()).select("opportunity_id", F.lit(1).alias("__own"))
    return (df.join(ends, "due_date", "left").join(own, "opportunity_id", "left")
            .withColumn("near", F.coalesce(F.col("through") - F.col("under") - F.coalesce("__own", F.lit(0)), F.lit(0)))
            .drop("through", "under", "__own"))


def capacity_scores(df: DataFrame, committed: DataFrame) -> DataFrame:
    """Add capacity_score and capacity_reasons from the load around each due date."""
    loaded = nearby_committed(df, committed)
    near, dated = F.col("near"), F.col("due_date").isNotNull()
    return (loaded
            .withColumn("capacity_score", F.when(dated, clamp(90 - 20 * near, 10, 90)).otherwise(60))
            .withColumn("capacity_reasons",
                        F.when(~dated, F.lit("no due date — assuming moderate load"))
                        .when(near > 0, F.concat(near.cast("string"), F.lit(" other committed bid"),
                                                 F.when(near == 1, "").otherwise("s"), F.lit(" due within 14 days (−"),
                                                 (20 * near).cast("string"), F.lit(")")))
                        .otherwise(F.lit("no other committed bids due near this one"))))


def margin_scores(df: DataFrame) -> DataFrame:
    """Add margin_score and margin_reasons from risk signals on the bid itself."""
    per_day = F.when(filled("budget") & filled_number("duration_days"),
                     text.budget_amount("budget") / F.col("duration_days"))
    rebid, damages = filled_number("prior_cycles"), filled("liquidated_damages")
    overhead = F.exists("requirements", lambda r: matches(r, COMPLIANCE))
    roomy, tight = F.coalesce(per_day >= 3_000, F.lit(False)), F.coalesce(per_day < 1_000, F.lit(False))
    thin = text.detail_score() < 50
    rate = F.concat(F.lit("~$"), F.format_number(per_day, 0), F.lit("/day"))
    total = F.lit(60)
    for hit, points in ((rebid, -10), (damages, -10), (has_bond(), -5), (overhead, -5), (roomy, 10), (tight, -10), (thin, -5)):
        total = total + F.when(hit, points).otherwise(0)
    return (df.withColumn("margin_score", clamp(total, 15, 90))
            .withColumn("margin_reasons", reasons(
                F.lit("baseline 60"),
                F.when(rebid, F.lit("rebid — likely a priced incumbent (−10)")),
                F.when(damages, F.concat(F.lit("liquidated damages "), F.col("liquidated_damages"), F.lit(" (−10)"))),
                F.when(has_bond(), F.lit("bonding costs (−5)")),
                F.when(overhead, F.lit("compliance overhead — wage/participation terms (−5)")),
                F.when(roomy, F.concat(F.lit("roomy schedule at "), rate, F.lit(" (+10)"))),
                F.when(tight, F.concat(F.lit("tight at "), rate, F.lit(" (−10)"))),
                F.when(thin, F.lit("thin listing — unknowns cost margin (−5)")))))
