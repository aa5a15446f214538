"""Shape checks on candidate-match lists, and the network of firms they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.base import first_rows, none_if_blank, or_blank

MAX_MATCHES = 4                                   # fixed value
GOV_EXPERIENCE = ("strong", "some", "none", "unknown")  # fixed values


def normalise(raw: Column) -> Column:
    """The first four entries with a name: trimmed, enum clamped, web links distinct."""
    def clean(entry: Column) -> Column:
        gov = F.lower(F.trim(or_blank(entry["gov_experience"])))
        links = F.array_distinct(F.filter(F.transform(entry["sources"], lambda u: F.trim(u)), lambda u: u.startswith("http")))
        return F.struct(F.trim(or_blank(entry["name"])).alias("name"),
                        F.when(gov.isin(*GOV_EXPERIENCE), gov).otherwise("unknown").alias("gov_experience"),
                        links.alias("sources"))

    return F.filter(F.transform(F.slice(raw, 1, MAX_MATCHES), clean), lambda m: m["name"] != "")


def latest_status(changes: DataFrame, key: str, order: str, default: str = "prospect") -> DataFrame:
    """(key, status): the newest of each key's status rows; a blank status counts as `default`."""
    return changes.groupBy(key).agg(F.coalesce(none_if_blank(F.max_by("status", order)), F.lit(default)).alias("status"))


def firm_network(firms: DataFrame, matched: DataFrame, statuses: DataFrame, newest: int = 5, default: str = "prospect") -> DataFrame:
    """Every firm with its relationship status, how many bids it was matched to, and the newest of them, one row each.

    firms: firm and its own columns; matched: firm, opportunity_id, ordinal,
    matched_at, one row a match; statuses: firm, status. A firm without matches
    has one row with place 0. No firm's matches are held together: counts are a
    plain aggregate, and no more than `newest` rows of a firm leave a task.
    """
    counts = matched.groupBy("firm").agg(F.count(F.lit(1)).alias("matched"))
    top = first_rows(matched, ["firm"], [F.col("matched_at").desc(), F.col("ordinal").desc()], n=newest, keep_rank="place")
    return (standing(firms, statuses, default)
            .join(counts, "firm", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
            .join(top.select("firm", "place", "opportunity_id", "matched_at"), "firm", "left").withColumn("place", F.coalesce("place", F.lit(0))))


def standing(firms: DataFrame, statuses: DataFrame, default: str = "prospect") -> DataFrame:
    """Firms with their relationship status; a firm no row speaks of is at `default`."""
    return firms.join(statuses.select("firm", "status"), "firm", "left").withColumn("status", F.coalesce("status", F.lit(default)))
