"""Deciding which agency, source or portal two rows both mean."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.base import ColumnLike, blank, col, first_rows, lookup_map, or_blank

REQUIRED_KEYS = ("id", "name", "county", "agency", "portal_url", "adapter")  # fixed values
ADDRESS_FORMS = "^(?:cityof|townof|villageof|countyof)"                       # fixed value
MUNICIPAL_CLASSES = ("village", "town", "city")                              # fixed values


def agency_key(name: ColumnLike) -> Column:
    """An agency's name without punctuation or its leading form of address."""
    return F.regexp_replace(F.regexp_replace(F.lower(or_blank(name)), "[^a-z0-9]+", ""), ADDRESS_FORMS, "")


def superseded(sources: DataFrame, open_bid_adapters: Sequence[str]) -> DataFrame:
    """Catalog pointers whose agency some live adapter now reads."""
    live = sources.filter(F.col("adapter").isin(*[a for a in open_bid_adapters if a != "catalog"])
                          & F.coalesce("live_fetch", F.lit(True)) & ~blank("agency"))
    pointers = sources.filter((F.col("adapter") == "catalog") & ~blank("id"))
    keyed = live.select(agency_key("agency").alias("agency_key")).distinct()
    return pointers.withColumn("agency_key", agency_key("agency")).join(keyed, "agency_key", "left_semi")


def validate_sources(sources: DataFrame, adapters: Sequence[str]) -> DataFrame:
    """Add `reason`: missing keys, unknown adapter, or null for a usable row."""
    missing = F.array_compact(F.array(*[F.when(blank(k), F.lit(k)) for k in REQUIRED_KEYS]))
    return sources.withColumn("reason", F.when(
        F.size(missing) > 0, F.concat(F.lit("missing keys: "), F.array_join(missing, ", ")))
        .when(~F.col("adapter").isin(*adapters), F.concat(F.lit("unknown adapter "), F.col("adapter"))))


def name_variants(name: ColumnLike) -> Column:
    """Spellings worth trying against a roster, best first."""
    raw = F.lower(F.trim(col(name)))
    base = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "’", "'"), r",?\s+inc\.?$", ""), r"\s+", " "))
    flipped = [F.when(F.endswith(base, F.lit(f" {c}")),
                      F.concat(F.lit(f"{c} of "), F.regexp_replace(base, f" {c}$", ""))) for c in MUNICIPAL_CLASSES]
    authority = F.when(~base.rlike("(authority|district|county)$"), F.concat(base, F.lit(" authority")))
    return F.array_distinct(F.filter(F.array_compact(F.array(base, raw, *flipped, authority)), lambda v: v != ""))


def resolve_entities(catalog: DataFrame, roster: DataFrame, aliases: Mapping[str, str], key: str = "id") -> DataFrame:
    """Add entity_id: the roster entity of the first spelling that is an alias or a roster name."""
    spelled = catalog.select(key, F.posexplode(name_variants("agency")).alias("turn", "spelling"))
    first_named = first_rows(roster, [F.lower(F.trim("name"))], [F.col("ordinal").asc()]).select(
        F.lower(F.trim("name")).alias("spelling"), F.col("entity_id").alias("by_name"))
    alias = lookup_map(aliases, F.col("spelling")) if aliases else F.lit(None).cast("string")
    hits = spelled.join(first_named, "spelling", "left").withColumn("hit", F.coalesce(alias, "by_name")) \
        .filter(F.col("hit").isNotNull())
    found = hits.groupBy(key).agg(F.min_by("hit", "turn").alias("entity_id"))
    return catalog.join(found, key, "left")


def coverage_gap(resolved: DataFrame, covered_names: DataFrame, covered_identities: DataFrame) -> DataFrame:
    """Resolved catalog rows nobody reads live: first by agency name, then by tenant identity.

    `covered_names` has name; `covered_identities` has entity_id.
    """
    named = resolved.withColumn("__name", F.lower(F.trim("agency")))
    open_names = named.join(covered_names.select(F.col("name").alias("__name")).distinct(), "__name", "left_anti")
    return open_names.drop("__name").filter(F.col("entity_id").isNotNull()) \
        .join(covered_identities.select("entity_id").distinct(), "entity_id", "left_anti")


def recovery_outcome(platform: ColumnLike, unreadable: Sequence[str], buildable: Sequence[str]) -> Column:
    """What a re-read agency turned out to be."""
    p = col(platform)
    return (F.when(p == "unknown", "unread").when(p.isin(*unreadable), "stuck").when(p == "selfhosted", "lead")
            .when(p.isin(*buildable), "live").otherwise("lead"))


def host_of(url: ColumnLike) -> Column:
    return F.lower(F.regexp_extract(or_blank(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def registrable_domain(url: ColumnLike) -> Column:
    """The last two labels of a host; three under `.us`."""
    labels = F.split(host_of(url), r"\.")
    keep = F.when((F.element_at(labels, -1) == "us") & (F.size(labels) > 2), 3).otherwise(2)
    return F.array_join(F.slice(labels, -F.least(keep, F.size(labels)), keep), ".")


def source_identity(url: ColumnLike, tenant: ColumnLike) -> Column:
    """The host, and the tenant where the platform names one."""
    return F.concat(host_of(url), F.when(~blank(tenant), F.concat(F.lit("#"), F.lower(col(tenant)))).otherwise(F.lit("")))
