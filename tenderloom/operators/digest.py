"""The counts and the subject line of a daily digest, each side read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions import text
from tenderloom.functions.base import with_scalars

DUE_SOON_DAYS = 7  # fixed value


def fresh_counts(marked: DataFrame) -> DataFrame:
    """One row from matches marked by `watchlists.marked`: new_matches that can be bid on, and bids that are only planned, each once."""
    fresh, planned = F.col("was_seen").isNull(), F.col("status") == "upcoming"
    counted = marked.agg(F.count(F.when(fresh, 1)).alias("total"), F.countDistinct(F.when(fresh & planned, F.col("opportunity_id"))).alias("planned"))
    return counted.select((F.col("total") - F.col("planned")).alias("new_matches"), "planned")


def due_soon(bids: DataFrame, tracked: DataFrame, as_of: str) -> DataFrame:
    """One row: tracked bids that are due within the week; `tracked` has opportunity_id, stage and archived."""
    active = tracked.filter(~F.col("archived") & (F.col("stage") != "result")).select("opportunity_id")
    soon = bids.filter(text.days_until_due("due_date", as_of).between(0, DUE_SOON_DAYS))
    return soon.join(active, "opportunity_id", "left_semi").agg(F.count(F.lit(1)).alias("deadlines"))


def _bit(n: str, one: str, many: str, after: str = "") -> Column:
    count = F.col(n)
    return F.when(count > 0, F.concat(count.cast("string"), F.lit(" "), F.when(count == 1, one).otherwise(many), F.lit(after)))


def subject(counts: DataFrame, *others: DataFrame, name: str = "Daily digest") -> DataFrame:
    """One row: the counts of all parts (protests, records, new_matches, planned, deadlines, decided) and the line that names those above 0."""
    row = counts
    for part in others:
        row = with_scalars(row, part)
    bits = F.concat_ws(", ", _bit("protests", "protest window", "protest windows", " open"), _bit("records", "tabulation", "tabulations", " requestable"),
                       _bit("new_matches", "new match", "new matches"), _bit("planned", "planned", "planned"), _bit("deadlines", "deadline", "deadlines", " this week"))
    return row.withColumn("subject", F.concat(F.lit(f"{name}: "), F.when(bits != "", bits).otherwise("source health")))
