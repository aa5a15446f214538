"""Joining award notices to the solicitations they decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.functions import keys
from tenderloom.functions.base import none_if_blank, shuffled
from tenderloom.operators.similarity import SET, best_match, with_tokens


def link_by_reference(awards: DataFrame, solicitations: DataFrame) -> DataFrame:
    """(award ordinal, solicitation ordinal) for awards that name their solicitation.

    An award offers up to four keys in order: its linked reference scoped by
    agency, the same bare, then its own reference scoped and bare. Each key
    belongs to the earliest solicitation carrying it, and the first key found
    wins. Keys are aggregated on both sides before they meet, so a reference
    shared by a third of the rows is one row.
    """
    own = solicitations.select("ordinal", F.lower("agency").alias("scope"), keys.bare_ref("external_id").alias("ref")) \
        .filter(F.col("ref").isNotNull())
    index = (own.select("ordinal", F.explode(F.array(F.concat_ws("|", "scope", "ref"), F.col("ref"))).alias("key"))
             .groupBy("key").agg(F.min("ordinal").alias("solicitation")))
    linked, named = keys.bare_ref("linked_ref"), keys.bare_ref("external_id")
    scope = F.lower("agency")
    offers = F.array(F.when(linked.isNotNull(), F.concat_ws("|", scope, linked)), linked,
                     F.when(named.isNotNull(), F.concat_ws("|", scope, named)), named)
    asked = awards.select("ordinal", F.posexplode(offers).alias("turn", "key")).filter(F.col("key").isNotNull())
    # Resolve each distinct key once, then bring the answers back to the awards.
    resolved = asked.select("key").distinct().join(index, "key")
    return (asked.join(resolved, "key")
            .groupBy("ordinal").agg(F.min(F.struct("turn", "solicitation")).alias("won"))
            .select("ordinal", F.col("won.solicitation").alias("solicitation")))


def link_by_title(awards: DataFrame, solicitations: DataFrame) -> DataFrame:
    """(award ordinal, solicitation ordinal, score) by title words within the agency."""
    left = with_tokens(awards)
    right = with_tokens(solicitations).withColumn("solicitation", F.col("ordinal"))
    best = best_match(left, right, "solicitation")
    return left.join(shuffled(best), SET).select("ordinal", "solicitation", "score")


def link_awards(df: DataFrame) -> DataFrame:
    """(ordinal, solicitation, linkage) for every award that finds its solicitation."""
    awards = df.filter(F.col("status") == "award")
    solicitations = df.filter(F.col("status") != "award")
    by_ref = link_by_reference(awards, solicitations)
    left_over = awards.join(by_ref, "ordinal", "left_anti")
    by_title = link_by_title(left_over, solicitations)
    return (by_ref.select("ordinal", "solicitation", F.lit("ref").alias("linkage"))
            .unionByName(by_title.select("ordinal", "solicitation", F.lit("fuzzy").alias("linkage"))))


def donate_award_facts(df: DataFrame, links: DataFrame) -> DataFrame:
    """Give each linked solicitation the award facts it lacks.

    The earliest linked award that has a fact supplies it; a vendor or date
    counts when it is filled, an amount when it is not null.
    """
    facts = (links.join(df.select("ordinal", "awarded_vendor", "award_amount", "award_date", "posted_date"), "ordinal")
             .withColumn("vendor", none_if_blank("awarded_vendor"))
             .withColumn("decided", F.coalesce("award_date", "posted_date"))
             .groupBy("solicitation")
             .agg(F.min_by("vendor", F.when(F.col("vendor").isNotNull(), F.col("ordinal"))).alias("got_vendor"),
                  F.min_by("award_amount", F.when(F.col("award_amount").isNotNull(), F.col("ordinal"))).alias("got_amount"),
                  F.min_by("decided", F.when(F.col("decided").isNotNull(), F.col("ordinal"))).alias("got_decided"))
             .withColumnRenamed("solicitation", "ordinal"))
    return (df.join(facts, "ordinal", "left")
            .withColumn("awarded_vendor", F.coalesce(none_if_blank("awarded_vendor"), "got_vendor", "awarded_vendor"))
            .withColumn("award_amount", F.coalesce("award_amount", "got_amount"))
            .withColumn("award_date", F.coalesce("award_date", "got_decided"))
            .drop("got_vendor", "got_amount", "got_decided"))
