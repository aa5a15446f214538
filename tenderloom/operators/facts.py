"""Applying mined facts to records, and assembling bounded text bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions import geo, text
from tenderloom.functions.base import blank, first_filled, first_rows, none_if_blank, or_blank
from tenderloom.operators.dedupe import absorb_labels

BLANK_FILLED = ("project_location", "duration_days", "liquidated_damages", "licenses")


def longer_of(mine: str, theirs: str) -> Column:
    return F.when(F.length(theirs) > F.length(or_blank(mine)), F.col(theirs)).otherwise(F.col(mine))


def apply_package_facts(df: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """A package's value overrides, its other terms fill blanks, a longer scope wins, labels are appended."""
    other = facts.select(key, *[F.col(c).alias(f"pkg_{c}") for c in facts.columns if c != key])
    out = df.join(other, key, "left")
    if "estimated_value" in facts.columns:
        out = out.withColumn("budget", F.coalesce(none_if_blank("pkg_estimated_value"), "budget"))
    for name in BLANK_FILLED:
        if name in facts.columns:
            mine = F.col(name)
            kept = F.nullif(mine, F.lit(0)) if name == "duration_days" else none_if_blank(mine)
            out = out.withColumn(name, F.coalesce(kept, F.col(f"pkg_{name}"), mine))
    if "scope" in facts.columns:
        out = out.withColumn("scope", longer_of("scope", "pkg_scope"))
    if "requirements" in facts.columns:
        extra = F.coalesce("pkg_requirements", F.array().cast("array<string>"))
        out = out.withColumn("requirements", F.array_distinct(F.concat("requirements", extra)))
    return out.drop(*[f"pkg_{c}" for c in facts.columns if c != key])


PROSE = ("title", "description", "scope", "submittal_info", "contact")


def derive_fields(df: DataFrame, cities: DataFrame | None = None, prose: tuple[str, ...] = PROSE) -> DataFrame:
    """Fill blanks from whatever prose a record has; what it already states is kept.

    Value, pre-bid notice, question deadline, e-mail and phone fill blanks;
    requirement labels are appended and then absorb one another. With `cities`
    (a gazetteer's rows) a missing tier is read off the agency's name.
    """
    blob = F.col("__prose")
    labels = F.coalesce("requirements", F.array().cast("array<string>"))
    mined = {"budget": text.estimated_value, "pre_bid_meeting": text.pre_bid_meeting, "contact_email": text.contact_email, "contact_phone": text.contact_phone}
    # found in columns of their own: a test for blanks would search the text again
    found = {f"__{c}": F.when(blank(c), read(blob)) for c, read in mined.items()}
    out = (df.withColumn("__prose", text.joined_text(*[c for c in prose if c in df.columns]))
           .withColumns(found | {"__labels": F.array_distinct(F.concat(labels, text.requirement_labels(blob)))})
           .withColumn("requirements", absorb_labels("__labels"))
           .withColumn("questions_due", F.coalesce("questions_due", text.questions_due(blob)))
           .withColumns({c: first_filled(c, f"__{c}") for c in mined})
           .drop("__prose", "__labels", *found))
    if cities is None:
        return out
    guessed = geo.infer_tiers(out, cities, out="__guess")
    return guessed.withColumn("tier", F.when(blank("tier"), F.col("__guess")).otherwise(F.col("tier"))).drop("__guess")


def merge_detail(df: DataFrame, detail: DataFrame, key: str, blanks: tuple[str, ...]) -> DataFrame:
    """A second payload per record: fills blanks, replaces a shorter scope, adds documents and labels."""
    other = detail.select(key, *[F.col(c).alias(f"det_{c}") for c in detail.columns if c != key])
    out = df.join(other, key, "left")
    for name in blanks:
        out = out.withColumn(name, F.coalesce(none_if_blank(name), none_if_blank(f"det_{name}"), name))
    if "scope" in detail.columns:
        out = out.withColumn("scope", longer_of("scope", "det_scope"))
    if "documents" in detail.columns:
        from tenderloom.sources.payloads import distinct_documents
        added = F.coalesce("det_documents", F.slice("documents", 1, 0))
        out = out.withColumn("documents", distinct_documents(F.concat("documents", added)))
    if "requirements" in detail.columns:
        labels = F.coalesce("det_requirements", F.array().cast("array<string>"))
        out = out.withColumn("requirements", F.array_distinct(F.concat("requirements", labels)))
    return out.drop(*[f"det_{c}" for c in detail.columns if c != key])


def bundle(parts: DataFrame, key: str, head: Column, *, parts_kept: int, part_chars: int, total_chars: int) -> DataFrame:
    """One bounded text per key: a head and its first parts in place order, each cut, then the whole cut.

    `parts` carries key, place, name and text; only `parts_kept` rows per key
    reach the shuffle.
    """
    few = first_rows(parts, [key], [F.col("place").asc()], n=parts_kept, keep_rank="n")
    piece = F.concat(F.lit("\n== "), F.col("n").cast("string"), F.lit(": "), F.col("name"), F.lit("\n"),
                     F.substring("text", 1, part_chars))
    joined = few.withColumn("piece", piece).groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda s: s["piece"]), "").alias("body"))
    return joined.select(key, F.substring(F.concat(head, F.col("body")), 1, total_chars).alias("bundle"))
