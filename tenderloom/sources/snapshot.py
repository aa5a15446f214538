"""Reading and writing snapshot documents and their flat exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom import schemas
from tenderloom.functions import text
from tenderloom.functions.base import or_blank
from tenderloom.operators.filters import listing_order

SCOPE_CHARS, LISTED_DOCUMENTS = 2000, 10  # fixed values: the flat export's columns
PLAIN = ("county agency source_id source_name solicitation_type offer_type status url").split()
OPTIONAL = ("external_id brief contact contact_email contact_phone budget department pre_bid_meeting project_location "
            "liquidated_damages licenses tier raw_category awarded_vendor linked_ref award_linkage contract_term "
            "submittal_info").split()
NUMBERS = ("duration_days", "award_amount")
DATES = ("posted_date", "award_date", "last_cycle_closed")
MOMENTS = ("due_date", "questions_due")


def export_rows(df: DataFrame, as_of: str) -> DataFrame:
    """The flat 45-column export: arrays joined, documents counted, long scope cut."""
    def has(name: str) -> bool:
        return name in df.columns

    def text_of(name: str):
        return or_blank(name) if has(name) else F.lit("")

    out = [F.col("opportunity_id"), F.col("title"), *[F.col(c) for c in PLAIN]]
    out += [text_of(c).alias(c) for c in OPTIONAL]
    out += [(F.coalesce(F.col(c).cast("string"), F.lit("")) if has(c) else F.lit("")).alias(c) for c in NUMBERS]
    out += [(F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("")) if has(c) else F.lit("")).alias(c) for c in DATES]
    out += [(F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")) if has(c) else F.lit("")).alias(c) for c in MOMENTS]
    urls = F.transform(F.slice("documents", 1, LISTED_DOCUMENTS), lambda d: d["url"])
    out += [
        F.array_join("categories", ", ").alias("categories"),
        F.coalesce(text.days_until_due("due_date", as_of).cast("string"), F.lit("")).alias("days_until_due"),
        F.array_join("requirements", "; ").alias("requirements"),
        F.size("documents").alias("documents"),
        F.array_join(urls, " | ").alias("document_urls"),
        F.array_join("commodity_codes", "; ").alias("commodity_codes"),
        F.coalesce("prior_cycles", F.lit(0)).alias("prior_cycles"),
        F.coalesce("personalized", F.lit(False)).alias("personalized"),
        text.detail_score().alias("detail_score"),
        F.substring(F.replace(or_blank("scope"), F.lit("\n"), F.lit(" ")), 1, SCOPE_CHARS).alias("scope"),
    ]
    return df.select(*out)


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(opportunities, health) of one snapshot folder or of a single JSON document.

    A folder written by `write_snapshot` holds JSON lines and splits across
    tasks; a lone document is one JSON value and is read by one task.
    """
    if path.endswith(".json"):
        whole = spark.read.schema(schemas.snapshot()).json(path, multiLine=True)
        return (whole.select(F.explode("opportunities").alias("o")).select("o.*"),
                whole.select(F.explode("health").alias("h")).select("h.*"))
    return (spark.read.schema(schemas.OPPORTUNITY).json(f"{path}/opportunities"),
            spark.read.schema(schemas.SOURCE_HEALTH).json(f"{path}/health"))


def write_snapshot(df: DataFrame, health: DataFrame, path: str, as_of: str) -> None:
    """Full rows (compressed) and health as JSON lines, and the flat export as CSV in listing order."""
    df.write.mode("overwrite").json(f"{path}/opportunities", compression="gzip")
    health.write.mode("overwrite").json(f"{path}/health")
    ordered = df.orderBy(*listing_order())
    export_rows(ordered, as_of).write.mode("overwrite").csv(f"{path}/export", header=True, quote='"', escape='"')


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The flat export of a snapshot folder as text columns, as its readers see it."""
    return spark.read.csv(f"{path}/export", header=True, multiLine=True, quote='"', escape='"', nullValue="\\N")
