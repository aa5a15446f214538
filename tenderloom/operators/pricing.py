"""What similar work has gone for, and who wins it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.functions import keys
from tenderloom.functions.base import filled, first_rows
from tenderloom.session import cut_lineage

MIN_SAMPLES = 3  # fixed value: thinner groups give no price
SLICE_DOLLARS = 4096
NOWHERE = ("statewide", "federal", "unknown")


def award_samples(df: DataFrame) -> DataFrame:
    """(slug, county, dollars) per award and category; `general` only when nothing else is tagged."""
    tags = F.filter("categories", lambda c: c != "general")
    return (df.filter((F.col("status") == "award") & (F.col("award_amount") > 0))
            .select(F.explode(F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("general")))).alias("slug"),
                    F.when(~F.col("county").isin(*NOWHERE), F.col("county")).alias("county"),
                    F.col("award_amount").cast("long").alias("dollars")))


def contract_samples(df: DataFrame, slug: Column) -> DataFrame:
    return df.filter(F.col("amount") > 0).select(
        slug.alias("slug"), F.lit(None).cast("string").alias("county"),
        F.bround("amount").cast("long").alias("dollars"))


def price_buckets(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, truncated interpolated median and index-picked quartiles of each group.

    The picks are order statistics at ranks n//4, (n-1)//2, n//2 and
    min(n-1, 3n//4). Samples are first counted per distinct dollar figure, so
    copies collapse map-side; a running count over range slices of the figures
    then locates each rank without putting a whole group in one task.
    """
    counted = samples.groupBy(*by, "dollars").agg(F.count(F.lit(1)).alias("n"))
    # Slices are fixed-width figure ranges, so one group spreads over many tasks.
    sliced = counted.withColumn("slice", F.floor(F.col("dollars") / SLICE_DOLLARS))
    per_slice = sliced.groupBy(*by, "slice").agg(F.sum("n").alias("slice_n"))
    # `slice` totals are at most (largest figure / SLICE_DOLLARS) rows per group.
    over = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slice.withColumn("before", F.coalesce(F.sum("slice_n").over(over), F.lit(0))).drop("slice_n")
    totals = per_slice.groupBy(*by).agg(F.sum("slice_n").alias("total")).filter(F.col("total") >= MIN_SAMPLES)
    inside = Window.partitionBy(*by, "slice").orderBy("dollars").rowsBetween(Window.unboundedPreceding, 0)
    placed = sliced.join(starts, [*by, "slice"])
    running = placed.withColumn("through", F.col("before") + F.sum("n").over(inside))
    joined = running.join(totals, list(by))
    first, last = F.col("through") - F.col("n"), F.col("through") - 1

    def pick(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= last), F.col("dollars")))

    n = F.col("total")
    stats = joined.groupBy(*by).agg(
        F.max("total").alias("count"),
        pick(F.floor((n - 1) / 2)).alias("mid_low"), pick(F.floor(n / 2)).alias("mid_high"),
        pick(F.floor(n / 4)).alias("low"), pick(F.least(n - 1, F.floor(3 * n / 4))).alias("high"))
    return stats.select(*by, "count", F.floor((F.col("mid_low") + F.col("mid_high")) / 2).cast("long").alias("median"),
                        "low", "high")



def price_hints(bids: DataFrame, overall: DataFrame, county: DataFrame) -> DataFrame:
    """For each bid, the first of its categories with a price; its county's if there is one."""
    asked = bids.select("ordinal", "county", F.posexplode("categories").alias("turn", "slug"))
    o = overall.select("slug", *[F.col(c).alias(f"all_{c}") for c in ("count", "median", "low", "high")])
    c = county.select("slug", "county", *[F.col(x).alias(f"here_{x}") for x in ("count", "median", "low", "high")])
    found = asked.join(o, "slug").join(c, ["slug", "county"], "left")
    local = F.col("here_count").isNotNull()
    answer = F.struct("turn", "slug", F.when(local, "county").otherwise("all").alias("scope"),
                      *[F.when(local, F.col(f"here_{x}")).otherwise(F.col(f"all_{x}")).alias(x)
                        for x in ("count", "median", "low", "high")])
    return (found.groupBy("ordinal").agg(F.min_by(answer, "turn").alias("hint"))
            .select("ordinal", "hint.slug", "hint.scope", "hint.count", "hint.median", "hint.low", "hint.high"))


def _most_common(counted: DataFrame, key: str, value: str, n: int, out: str) -> DataFrame:
    """Each key's `n` most frequent values, earliest first on ties, as one array.

    `counted` has uses and first_at per finer group.
    """
    summed = counted.groupBy(key, value).agg(F.sum("uses").alias("uses"), F.min("first_at").alias("first_at"))
    top = first_rows(summed, [key], [F.col("uses").desc(), F.col("first_at").asc()], n=n, keep_rank="rank")
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", value))),
                                            lambda s: s[value]).alias(out))


def vendor_profiles(awards: DataFrame, contracts: DataFrame) -> DataFrame:
    """One row per firm across awards and contract registers.

    `awards` has ordinal, awarded_vendor, award_amount, award_date, posted_date,
    agency and categories; `contracts` has ordinal, vendor and agency. Awards
    come before contracts wherever first-seen order decides. Rows are first
    added up per spelling and agency, and ids computed on those sums.
    """
    won = awards.filter((F.col("status") == "award") & filled("awarded_vendor"))
    held = contracts.filter(filled("vendor"))

    def seen(kind: int) -> Column:
        return F.min(F.struct(F.lit(kind).alias("kind"), F.col("ordinal").alias("o"))).alias("first_at")

    rows_won = won.groupBy(F.col("awarded_vendor").alias("name"), "agency").agg(
        seen(0), F.count(F.lit(1)).alias("awards"), F.lit(0).cast("long").alias("contracts"),
        F.sum(F.coalesce("award_amount", F.lit(0))).alias("dollars"), F.max(F.coalesce("award_date", "posted_date")).alias("last_award"))
    rows_held = held.groupBy(F.col("vendor").alias("name"), "agency").agg(
        seen(1), F.lit(0).cast("long").alias("awards"), F.count(F.lit(1)).alias("contracts"),
        F.lit(0).cast("long").alias("dollars"), F.lit(None).cast("date").alias("last_award"))
    sums = cut_lineage(rows_won.unionByName(rows_held).withColumn("vendor_id", keys.vendor_id("name"))
                       .withColumn("name", F.trim("name")).withColumn("uses", F.col("awards") + F.col("contracts")))
    totals = sums.groupBy("vendor_id").agg(
        F.sum("awards").alias("awards"), F.nullif(F.sum("dollars"), F.lit(0)).alias("awarded_total"),
        F.sum("contracts").alias("contracts"), F.max("last_award").alias("last_award"))
    names = _most_common(sums, "vendor_id", "name", 1, "names")
    agencies = _most_common(sums, "vendor_id", "agency", 3, "agencies")
    tagged = (won.select("awarded_vendor", "ordinal", F.posexplode(F.filter("categories", lambda c: c != "general")).alias("p", "tag"))
              .groupBy("awarded_vendor", "tag").agg(F.count(F.lit(1)).alias("uses"), F.min(F.struct("ordinal", "p")).alias("first_at"))
              .withColumn("vendor_id", keys.vendor_id("awarded_vendor")))
    tags = _most_common(tagged, "vendor_id", "tag", 3, "categories")
    return (totals.join(names, "vendor_id").join(agencies, "vendor_id").join(tags, "vendor_id", "left")
            .withColumn("name", F.get("names", F.lit(0))).drop("names")
            .withColumn("categories", F.coalesce("categories", F.array().cast("array<string>"))))


def vendor_order() -> list[Column]:
    return [F.col("awards").desc(), F.coalesce("awarded_total", F.lit(0)).desc(), F.col("contracts").desc()]
