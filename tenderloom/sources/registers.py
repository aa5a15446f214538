"""Contract registers, rosters and finding logs as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom import schemas
from tenderloom.functions.base import filled, first_rows
from tenderloom.sources import lines

# The register export's header, in file order.
REGISTER_COLUMNS = ["Agency Name", "Vendor/Grantor Name", "Type", "Agency Contract ID", "PO Number", "Grant Award ID",
                    "Vendor/Grantor Name Line 2", "Original Contract Amount", "Total Amount", "Long Title/PO Title", "Status",
                    "Short Title", "Begin Date", "Original End Date", "New End Date", "Method of Procurement"]
MAPPED = {
    "Agency Name": "agency_name", "Vendor/Grantor Name": "vendor", "Vendor/Grantor Name Line 2": "vendor_line_2",
    "Agency Contract ID": "agency_contract_id", "Original Contract Amount": "original_amount", "Total Amount": "total_amount",
    "Long Title/PO Title": "long_title", "Short Title": "short_title", "Status": "status", "Begin Date": "begin_date",
    "Original End Date": "original_end_date", "New End Date": "new_end_date", "Method of Procurement": "method",
}


def read_register(spark: SparkSession, path: str, multi_line: bool = False, header: bool = True) -> DataFrame:
    """Register rows as text; rows with fields beyond the header are dropped, short ones kept.

    One spare column after the header catches what an over-long row spills, so
    length needs no second parse. `multi_line` lets quoted fields hold line
    breaks, at the price of unsplittable files.
    """
    spare = "__beyond"
    ddl = ", ".join(f"`{c}` string" for c in [*REGISTER_COLUMNS, spare])
    # A short row is padded with nulls; only what lies past the header marks a shifted one.
    rows = spark.read.schema(ddl).csv(path, header=header, enforceSchema=True, multiLine=multi_line, quote='"', escape='"', mode="PERMISSIVE")
    kept = rows.filter(F.col(spare).isNull())
    return kept.select(*[F.col(f"`{name}`").alias(short) for name, short in MAPPED.items()])


def finding_lines(spark: SparkSession, path: str, split_bytes: int = lines.SPLIT_BYTES) -> DataFrame:
    """All lines of a findings log, with their place in it; torn ones are flagged."""
    return lines.read_json_log(spark, path, schemas.FINGERPRINT, split_bytes)


def latest_findings(found: DataFrame) -> DataFrame:
    """The last whole line of every entity: the log is append-only, so a recheck is a later line."""
    whole = found.filter(~F.col("torn") & filled("entity_id"))
    return first_rows(whole, ["entity_id"], [F.col("file").desc(), F.col("place").desc()]).drop("torn")


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return latest_findings(finding_lines(spark, path))


def worth_rechecking(latest: DataFrame) -> DataFrame:
    """Entities that a platform was found for."""
    return latest.filter(filled("platform") & (F.col("platform") != "unknown")).select("entity_id")


def read_roster(spark: SparkSession, path: str, entities: DataFrame) -> DataFrame:
    """Roster rows of the given entities that have a website."""
    rows = spark.read.schema(schemas.ROSTER).csv(path, header=True, quote='"', escape='"', multiLine=True)
    return rows.filter(F.trim("website") != "").join(entities.select("entity_id"), "entity_id", "left_semi")
