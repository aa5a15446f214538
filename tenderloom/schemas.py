"""Record schemas as DDL, written once. Reads are permissive and columns are only ever added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


DOCUMENT = "struct<name:string,url:string,kind:string>"

OPPORTUNITY = f"""
    ordinal long, opportunity_id string, source_id string, source_name string, external_id string, title string, url string,
    county string, agency string, department string, tier string,
    solicitation_type string, offer_type string, categories array<string>, keywords array<string>,
    raw_category string, commodity_codes array<string>,
    posted_date date, due_date timestamp_ntz, status string, protest_deadline timestamp_ntz,
    awarded_vendor string, award_amount long, award_date date, linked_ref string, award_linkage string,
    contract_term string, description string, brief string, contact string, budget string, scope string,
    requirements array<string>, documents array<{DOCUMENT}>, submittal_info string, pre_bid_meeting string,
    questions_due timestamp_ntz, contact_email string, contact_phone string, bid_opening string, detail_fetched boolean,
    project_location string, duration_days int, liquidated_damages string, licenses string, package_parsed boolean,
    prior_cycles int, last_cycle_closed date, personalized boolean, raw string, fetched_at timestamp_ntz"""

COVERAGE = ("struct<records:long,with_category:long,with_documents:long,with_due_date:long,with_budget:long,"
            "awards:long,with_award_amount:long,with_award_vendor:long>")

SOURCE_HEALTH = f"""source_id string, name string, ok boolean, count long, error string, elapsed_ms long,
    status string, note string, coverage {COVERAGE}"""


def snapshot() -> T.StructType:
    """One snapshot document: when, how many, health rows and opportunity rows."""
    def rows(ddl: str) -> T.ArrayType:
        return T.ArrayType(T.StructType.fromDDL(ddl))

    return T.StructType([
        T.StructField("fetched_at", T.StringType()), T.StructField("count", T.LongType()),
        T.StructField("health", rows(SOURCE_HEALTH)), T.StructField("opportunities", rows(OPPORTUNITY))])


CONTRACT = """contract_id string, agency string, name string, source_id string, vendor string, vendor_id string,
    status_id string, start_date date, end_date date, url string, amount double, method string, extendable boolean,
    commodity string, executed date, justification string, state_term_id string, agency_ref string"""

FINGERPRINT = """entity_id string, name string, website string, platform string, portal_url string,
    checked_url string, note string, also array<string>, confidence string"""

ROSTER = """entity_id string, name string, tier string, county string, website string, email string, phone string,
    notes string"""

# Enumerations.
SOLICITATION_TYPES = ("ITB", "IFB", "RFP", "RFQ", "RFI", "ITN", "RPQ", "ITQ", "RLI", "CCNA", "OTHER", "UNKNOWN")
OFFER_TYPES = ("goods", "services", "construction", "professional_services", "mixed", "unknown")
STATUSES = ("open", "closed", "cancelled", "upcoming", "catalog", "award")


def align(df: DataFrame, ddl: str) -> DataFrame:
    """Add columns the schema has and the data lacks; keep and never retype the rest."""
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(ddl).fields if f.name not in df.columns]
    return df.select("*", *missing)
