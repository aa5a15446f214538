"""Bid tabulations that have become public, and the letters that ask for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.functions import render
from tenderloom.functions.calendar import records_ripe_on
from tenderloom.operators.similarity import without_similar

MAX_AGE_DAYS = 365  # fixed value


def ripe_for_request(df: DataFrame, as_of: str, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Closed, unawarded solicitations whose tabulation is requestable, with ripe_on and ripe_for_days."""
    today = F.lit(as_of).cast("date")
    due = (df.filter(F.col("status").isin("closed", "cancelled") & F.col("due_date").isNotNull())
           .withColumn("ripe_on", records_ripe_on(F.col("due_date")))
           .withColumn("ripe_for_days", F.datediff(today, F.col("ripe_on")))
           .filter(F.col("ripe_for_days").between(0, max_age_days)))
    return without_similar(due, df.filter(F.col("status") == "award"))


def with_letters(leads: DataFrame, as_of: str, requester: str = "") -> DataFrame:
    return leads.withColumn("letter", render.request_letter(as_of, requester))
