"""Dashboard totals, breakdowns and coverage reports: one aggregate per report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.functions import text
from tenderloom.functions.base import (any_of, col, count_if, filled, filled_array, sum_if)

STAGES = ("watching", "preparing", "submitted", "result")  # fixed values


def value() -> Column:
    return F.coalesce(text.budget_amount("budget"), F.lit(0))


def spine(spark: SparkSession, name: str, values: Sequence[str]) -> DataFrame:
    """A short fixed list as rows, to zero-fill reports."""
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} string, position int")


def monday(day: Column) -> Column:
    return F.date_sub(day, F.weekday(day))


def dashboard_totals(df: DataFrame, as_of: str) -> DataFrame:
    days = text.days_until_due("due_date", as_of)
    is_open, due_soon = F.col("status") == "open", F.coalesce(days.between(0, 7), F.lit(False))
    return df.agg(
        count_if(is_open).alias("open_count"),
        count_if(F.col("status") == "upcoming").alias("upcoming_count"),
        sum_if(is_open, value()).alias("open_value"),
        count_if(is_open & due_soon).alias("due_7d"),
        sum_if(is_open & due_soon, value()).alias("due_7d_value"))


def win_loss(results: DataFrame) -> DataFrame:
    won, lost = count_if(F.col("outcome") == "won"), count_if(F.col("outcome") != "won")
    return results.agg(won.alias("won"), lost.alias("lost"),
                       F.bround(won / F.nullif(won + lost, F.lit(0)), 3).alias("win_rate"),
                       sum_if(F.col("outcome") == "won", F.coalesce("amount_cents", F.lit(0))).alias("revenue_cents"))


def by_county(df: DataFrame) -> DataFrame:
    live = df.filter(F.col("status").isin("open", "upcoming"))
    return live.groupBy("county").agg(
        count_if(F.col("status") == "open").alias("open"),
        count_if(F.col("status") == "upcoming").alias("upcoming"),
        F.sum(value()).alias("value"))


def by_type(df: DataFrame) -> DataFrame:
    return (df.filter(F.col("status") == "open")
            .groupBy(F.coalesce("offer_type", F.lit("unknown")).alias("type"))
            .agg(F.count(F.lit(1)).alias("count"), F.sum(value()).alias("value")))


def deadline_load(df: DataFrame, as_of: str, weeks: int = 8) -> DataFrame:
    """Open bids due per Monday-based week, zero-filled for the next `weeks`."""
    start = monday(F.lit(as_of).cast("date"))
    slots = df.sparkSession.range(1).select(F.explode(F.sequence(
        start, F.date_add(start, 7 * (weeks - 1)), F.expr("INTERVAL 7 DAYS"))).alias("week"))
    load = (df.filter((F.col("status") == "open")
                      & F.col("due_date").cast("date").between(start, F.date_add(start, 7 * weeks - 1)))
            .groupBy(monday(F.col("due_date").cast("date")).alias("week"))
            .agg(F.count(F.lit(1)).alias("count"), F.sum(value()).alias("value")))
    return slots.join(load, "week", "left").select(
        "week", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("value", F.lit(0)).alias("value"))


def pipeline_stages(workflow: DataFrame, bids: DataFrame) -> DataFrame:
    """Count and value of tracked, unarchived bids per stage, zero-filled."""
    tracked = workflow.filter(~F.col("archived")).select("opportunity_id", "stage")
    valued = tracked.join(bids.select("opportunity_id", value().alias("value")), "opportunity_id", "left")
    sums = valued.groupBy("stage").agg(F.count(F.lit(1)).alias("count"),
                                       F.coalesce(F.sum("value"), F.lit(0)).alias("value"))
    return spine(bids.sparkSession, "stage", STAGES).join(sums, "stage", "left").select(
        "stage", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("value", F.lit(0)).alias("value"))


def results_by_month(results: DataFrame) -> DataFrame:
    is_won = F.col("outcome") == "won"
    return results.groupBy(F.date_format("decided_on", "yyyy-MM").alias("month")).agg(
        count_if(is_won).alias("won"), count_if(~is_won).alias("lost"),
        sum_if(is_won, F.coalesce("amount_cents", F.lit(0))).alias("revenue_cents"))


def has_category() -> Column:
    return filled("raw_category") | filled_array("commodity_codes") | F.exists("categories", lambda c: c != "general")


def coverage_counts(df: DataFrame, source: str = "source_id") -> DataFrame:
    """Per source, how many records carry each judged field."""
    award = F.col("status") == "award"
    return df.groupBy(source).agg(
        F.count(F.lit(1)).alias("records"),
        count_if(has_category()).alias("with_category"),
        count_if(filled_array("documents")).alias("with_documents"),
        count_if(F.col("due_date").isNotNull()).alias("with_due_date"),
        count_if(filled("budget")).alias("with_budget"),
        count_if(award).alias("awards"),
        count_if(award & F.col("award_amount").isNotNull()).alias("with_award_amount"),
        count_if(award & filled("awarded_vendor")).alias("with_award_vendor"))


def quality_tests() -> list[tuple[str, Column]]:
    return [
        ("due_date", F.col("due_date").isNotNull()),
        ("posted_date", F.col("posted_date").isNotNull()),
        ("description", filled("description") | filled("scope")),
        ("category", has_category()),
        ("commodity_codes", filled_array("commodity_codes")),
        ("documents", filled_array("documents")),
        ("budget", filled("budget")),
        ("contact", any_of([filled("contact"), filled("contact_email"), filled("contact_phone")])),
        ("external_id", filled("external_id")),
        ("tier", filled("tier") & (F.col("tier") != "unknown")),
    ]


def quality_report(df: DataFrame) -> DataFrame:
    """Count and percent of records carrying each field, per source and overall (source null).

    Twelve rows per source: ten fields over its records, two over its awards.
    """
    award = F.col("status") == "award"
    tests = quality_tests()
    award_tests = [("awarded_vendor", filled("awarded_vendor")), ("award_amount", F.col("award_amount").isNotNull())]
    rolled = (df.filter(F.col("status") != "catalog").rollup("source_id").agg(
        F.count(F.lit(1)).alias("records"), count_if(award).alias("awards"),
        *[count_if(t).alias(f"n_{name}") for name, t in tests],
        *[count_if(award & t).alias(f"n_{name}") for name, t in award_tests]))
    names = [n for n, _ in tests + award_tests]
    pairs = ", ".join(f"'{n}', n_{n}" for n in names)
    long = rolled.selectExpr("source_id", "records", "awards", f"stack({len(names)}, {pairs}) AS (field, filled)")
    base = F.when(F.col("field").isin(*[n for n, _ in award_tests]), F.col("awards")).otherwise(F.col("records"))
    return long.withColumn("pct", F.bround(100 * F.col("filled") / F.nullif(base, F.lit(0))).cast("long"))


def facet_counts(df: DataFrame, county_slugs: Sequence[str], offers: Sequence[str]) -> DataFrame:
    """(facet, key, count) over live bids: categories once per bid, all counties, all offers."""
    live = df.filter(F.col("status").isin("open", "upcoming"))
    tagged = live.select(
        F.explode(F.concat(
            F.transform(F.array_distinct("categories"), lambda c: F.struct(F.lit("category").alias("facet"), c.alias("key"))),
            F.array(F.struct(F.lit("county").alias("facet"), F.col("county").alias("key")),
                    F.struct(F.lit("offer").alias("facet"), F.coalesce("offer_type", F.lit("unknown")).alias("key"))))
                  ).alias("f")).select("f.*")
    counted = tagged.groupBy("facet", "key").agg(F.count(F.lit(1)).alias("count"))
    fixed = df.sparkSession.createDataFrame(
        [("county", c) for c in county_slugs] + [("offer", o) for o in offers], "facet string, key string")
    return fixed.join(counted, ["facet", "key"], "full").select(
        "facet", "key", F.coalesce("count", F.lit(0)).alias("count"))


def group_sizes(df: DataFrame) -> DataFrame:
    """(grouping, key, count) by county, offer, agency and category; no category means general."""
    pairs = F.concat(
        F.array(F.struct(F.lit("county").alias("grouping"), F.col("county").alias("key")),
                F.struct(F.lit("offer").alias("grouping"), F.coalesce("offer_type", F.lit("unknown")).alias("key")),
                F.struct(F.lit("agency").alias("grouping"), F.col("agency").alias("key"))),
        F.transform(F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(F.lit("general"))),
                    lambda c: F.struct(F.lit("category").alias("grouping"), c.alias("key"))))
    return (df.select(F.explode(pairs).alias("p")).select("p.*")
            .groupBy("grouping", "key").agg(F.count(F.lit(1)).alias("count")))


def tally(df: DataFrame, key: str | Column, out: str, values: Sequence[str] | None = None) -> DataFrame:
    """Rows per key; zero-filled over `values` when given."""
    counted = df.groupBy(col(key).alias(out)).agg(F.count(F.lit(1)).alias("count"))
    if values is None:
        return counted
    return spine(df.sparkSession, out, values).join(counted, out, "left").select(
        out, F.coalesce("count", F.lit(0)).alias("count"))


def funnel(df: DataFrame, reason: Column) -> DataFrame:
    """Rows per first failing reason; `candidate` counts the rows with none."""
    return df.groupBy(F.coalesce(reason, F.lit("candidate")).alias("outcome")).agg(F.count(F.lit(1)).alias("count"))
