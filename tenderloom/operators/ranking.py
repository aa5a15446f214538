"""Picks, caps and per-group top rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.functions import keys
from tenderloom.functions.base import first_rows, or_blank, with_scalars


def fair_share(df: DataFrame, limit: int, ordinal: str = "ordinal") -> DataFrame:
    """Up to `limit` rows taken round-robin across sources, each source soonest-due first.

    A source can never give more than `limit` rows, so rows beyond that rank are
    filtered before the shuffle and the final pick is a bounded top-n.
    """
    if limit <= 0:
        return df.limit(0)
    ranked = first_rows(df, ["source_id"], [F.col("due_date").asc_nulls_last(), F.col(ordinal).asc()],
                        n=limit, keep_rank="turn")
    return ranked.orderBy("turn", "source_id").limit(limit)


def primary_package(df: DataFrame) -> DataFrame:
    """Add package_url: the PDF most likely to be the solicitation itself.

    Addenda rank last and a file named after the reference ranks first; on ties
    the listed order holds. Works inside the row, so nothing is shuffled.
    """
    ref = keys.bare_ref("external_id")

    def rank(doc: Column, position: Column) -> Column:
        name = F.regexp_replace(F.lower(doc["name"]), "[^a-z0-9]", "")
        named = F.coalesce((F.length(ref) >= 5) & F.contains(name, ref), F.lit(False))
        return F.struct((doc["kind"] == "addendum").cast("int").alias("addendum"),
                        (~named).cast("int").alias("unnamed"), position.alias("position"), doc["url"].alias("url"))

    ranked = F.transform("documents", rank)
    pdfs = F.filter(ranked, lambda d: F.lower(F.substring_index(d["url"], "?", 1)).endswith(".pdf"))
    return df.withColumn("package_url", F.array_min(pdfs)["url"])


def capped(df: DataFrame, order: Sequence[Column], cap: int, by: Sequence[str] = ()) -> DataFrame:
    """The first `cap` rows (per group) with the group's size and how many were left out.

    The group size is a plain aggregate joined back, so no group is collected.
    """
    if by:
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("section_size"))
        top = first_rows(df, by, order, n=cap, keep_rank="position").join(sizes, list(by))
    else:
        sizes = df.agg(F.count(F.lit(1)).alias("section_size"))
        few = df.orderBy(*order).limit(cap)
        top = with_scalars(few.withColumn("position", F.row_number().over(Window.orderBy(*order))), sizes)
    return top.withColumn("more", F.greatest(F.col("section_size") - cap, F.lit(0)))


def scan_until(df: DataFrame, order: Sequence[Column], stop: Column, cap: int, bucket: str) -> DataFrame:
    """Rows of a sorted scan before the first one that meets `stop`, at most `cap` per bucket.

    The first stopping row is found by aggregate; rows at or past it are dropped
    by comparing sort positions, and the cap is a per-key top-n.
    """
    position = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    placed = df.withColumn("__at", position)
    limits = placed.filter(stop).groupBy(bucket).agg(F.min("__at").alias("__stop"))
    before = placed.join(limits, bucket, "left").filter(F.col("__stop").isNull() | (F.col("__at") < F.col("__stop")))
    return first_rows(before, [bucket], [F.col("__at").asc()], n=cap).drop("__at", "__stop")


def latest_by(df: DataFrame, by: Sequence[str], stamp: str, tiebreak: str) -> DataFrame:
    return first_rows(df, by, [F.col(stamp).desc_nulls_last(), F.col(tiebreak).desc()])


def unmet_requirements(requirements: str = "requirements", checks: str = "checks") -> Column:
    """Requirements whose position is not ticked in the checks map."""
    marked = F.transform(requirements, lambda r, i: F.struct(r.alias("label"), i.alias("at")))
    return F.size(F.filter(marked, lambda m: ~F.coalesce(F.col(checks)[m["at"].cast("string")], F.lit(False))))


def named_few(df: DataFrame, label: Column, order: Sequence[Column], n: int = 5, joiner: str = "; ") -> DataFrame:
    """One row: the first `n` labels joined, with `; and k more` when there are others."""
    sizes = df.agg(F.count(F.lit(1)).alias("total"))
    top = df.select(label.alias("label"), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]).alias("at")) \
        .orderBy("at").limit(n)
    body = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))),
                                            lambda s: s["label"]), joiner).alias("names"))
    return with_scalars(body, sizes).select(
        "total", F.concat(or_blank("names"),
                          F.when(F.col("total") > n, F.concat(F.lit(f"{joiner}and "), (F.col("total") - n).cast("string"),
                                                              F.lit(" more"))).otherwise(F.lit(""))).alias("body"))
