"""The refresh run: one program over all fetched records, as steps in a fixed order.

Each step is a function of the records and the run's inputs. Two steps end in a
written table: the collapse, whose survivors all later steps read, and the
mining of prose, so that every pattern runs once for each record however many
joins read the result. The other steps stay lazy and fuse with what follows; the
narrow rows that details and packages bring are written, as several joins read them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tenderloom import schemas
from tenderloom.functions import package, render
from tenderloom.functions.base import first_filled, none_if_blank
from tenderloom.operators import dedupe, facts, filters, linkage, marts, ranking, similarity
from tenderloom.session import cut_lineage

DETAIL_BLANKS = ("description", "contact", "contact_email", "contact_phone", "submittal_info", "pre_bid_meeting")


@dataclass(frozen=True)
class Inputs:
    """What a run reads besides the fetched records.

    details: a second payload by opportunity_id (any of DETAIL_BLANKS, scope,
    documents, requirements). package_texts: (url, text) of bid packages.
    archive: past solicitations. cities: the gazetteer's city rows. A limit of
    None reads all that is worth reading; a number is a fetch budget.
    """

    as_of: str
    details: DataFrame | None = None
    package_texts: DataFrame | None = None
    archive: DataFrame | None = None
    cities: DataFrame | None = None
    detail_limit: int | None = None
    package_limit: int | None = None


class Step(NamedTuple):
    name: str
    run: Callable[[DataFrame, Inputs], DataFrame]
    written: bool = False


def age(df: DataFrame, given: Inputs) -> DataFrame:
    return filters.age_status(df, given.as_of)


def collapse(df: DataFrame, given: Inputs) -> DataFrame:
    return dedupe.collapse(df)


def read_details(df: DataFrame, given: Inputs) -> DataFrame:
    """Merge the second payload into live and awarded records that lack it, fairly over the sources if limited."""
    if given.details is None:
        return df
    chosen = filters.enrichment_candidates(df, "detail_fetched").select("ordinal", "opportunity_id", "source_id", "due_date")
    if given.detail_limit is not None:
        known = chosen.join(given.details.select("opportunity_id"), "opportunity_id", "left_semi")
        chosen = ranking.fair_share(known, given.detail_limit)
    # written: two joins read it, and every later reading of the records
    mine = cut_lineage(given.details.join(chosen.select("opportunity_id"), "opportunity_id", "left_semi").withColumn("read", F.lit(True)))
    merged = facts.merge_detail(df, mine.drop("read"), "opportunity_id", tuple(c for c in DETAIL_BLANKS if c in mine.columns))
    return (merged.join(mine.select("opportunity_id", "read"), "opportunity_id", "left")
            .withColumn("detail_fetched", F.coalesce("read", "detail_fetched")).drop("read"))


def package_rows(df: DataFrame, texts: DataFrame, limit: int | None = None) -> DataFrame:
    """(ordinal, package_url, facts) of the live and awarded records whose package says anything.

    A package is read once for each distinct address, however many records share
    it; soonest due first where a limit is given.
    """
    todo = ranking.primary_package(filters.enrichment_candidates(df, "package_parsed")).filter(F.col("package_url").isNotNull())
    todo = todo.select("ordinal", "package_url", "due_date")
    if limit is not None:
        todo = todo.orderBy(F.col("due_date").asc_nulls_last(), "ordinal").limit(limit)
    todo = cut_lineage(todo)  # all that comes before it would run for the addresses and for the rows
    wanted = todo.select("package_url").distinct()
    # written: a test of a fact would read the text again for each fact it names, and callers use the rows twice
    read = cut_lineage(texts.select(F.col("url").alias("package_url"), "text").dropDuplicates(["package_url"]).join(wanted, "package_url")
                       .select("package_url", package.package_facts("text").alias("facts")))
    said = [F.col(f"facts.{c}").isNotNull() for c in ("estimated_value", "project_location", "licenses", "duration_days", "liquidated_damages", "scope")]
    anything = F.size("facts.requirements") > 0
    for test in said:
        anything = anything | test
    return todo.select("ordinal", "package_url").join(read.filter(anything), "package_url")


def read_packages(df: DataFrame, given: Inputs) -> DataFrame:
    if given.package_texts is None:
        return df
    rows = cut_lineage(package_rows(df, given.package_texts, given.package_limit).select("ordinal", "facts.*", F.lit(True).alias("said")))
    merged = facts.apply_package_facts(df, rows.drop("said"), "ordinal")
    return (merged.join(rows.select("ordinal", "said"), "ordinal", "left")
            .withColumn("package_parsed", F.coalesce("said", "package_parsed")).drop("said"))


def derive(df: DataFrame, given: Inputs) -> DataFrame:
    return facts.derive_fields(df, given.cities)


def link(df: DataFrame, given: Inputs) -> DataFrame:
    """Awards learn what they decide, solicitations what was decided."""
    keys = ["ordinal", "status", "agency", "title", "external_id", "linked_ref"]
    links = cut_lineage(linkage.link_awards(df.select(*keys)))
    targets = df.select(F.col("ordinal").alias("solicitation"), F.col("external_id").alias("target_ref"))
    named = links.join(targets, "solicitation").select("ordinal", "linkage", "target_ref")
    fuzzy_ref = F.when(F.col("linkage") == "fuzzy", F.col("target_ref"))
    marked = (df.join(named, "ordinal", "left").withColumn("award_linkage", F.coalesce("linkage", "award_linkage"))
              .withColumn("linked_ref", F.coalesce(none_if_blank("linked_ref"), fuzzy_ref, "linked_ref")).drop("linkage", "target_ref"))
    return linkage.donate_award_facts(marked, links)


def recur(df: DataFrame, given: Inputs) -> DataFrame:
    return df if given.archive is None else similarity.recurrence(df, given.archive)


def write_briefs(df: DataFrame, given: Inputs) -> DataFrame:
    return df.withColumn("brief", first_filled("brief", render.brief(given.as_of)))


#: The order is part of the result: facts are mined after packages are read, links after facts, coverage of what a user sees.
STEPS = (Step("age", age), Step("collapse", collapse, written=True), Step("details", read_details), Step("packages", read_packages),
         Step("derive", derive, written=True), Step("link", link), Step("recurrence", recur), Step("briefs", write_briefs))


class Refreshed(NamedTuple):
    """The records, field coverage by source, and the steps in the order they ran: (place, step, written, rows where written)."""

    opportunities: DataFrame
    coverage: DataFrame
    steps: list[tuple[int, str, bool, int | None]]


def refresh(fetched: DataFrame, given: Inputs, steps: tuple[Step, ...] = STEPS) -> Refreshed:
    """Run `steps` over fetched records (columns of schemas.OPPORTUNITY; missing ones are added as nulls).

    Coverage is counted after linking, before any filter; filter the result
    with `filters.filter_opportunities`.
    """
    df = schemas.align(fetched, schemas.OPPORTUNITY)
    df = df.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("detail_fetched", "package_parsed")})
    log = []
    for place, step in enumerate(steps):
        df, rows = step.run(df, given), None
        if step.written:
            counted = Observation()
            df = cut_lineage(df.observe(counted, F.count(F.lit(1)).alias("rows")))
            rows = counted.get["rows"]
        log.append((place, step.name, step.written, rows))
    return Refreshed(df, marts.coverage_counts(df), log)
