"""Collapsing records that describe the same solicitation.

The full two-key collapse is defined on an ordered list: records are taken from
the richest down, and each either joins the survivor its reference or title
already points at, or becomes a survivor. Here it runs without ever holding a
group in one task:

* For every reference and every title only its *first* record (in richness
  order) decides where the key points, so each key's decision is one `min`.
* A reference whose first record is not the first of its title defers to that
  title; the chain of such deferrals is followed by pointer doubling over one
  row per reference, written to a table per round.
* A chain that ends at a title first seen without a reference merges into that
  record; any other chain leaves each reference its own survivor.

Every aggregate combines map-side, so one reference or title holding a third of
all rows costs one row per task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions import keys
from tenderloom.functions.base import first_rows, or_blank
from tenderloom.session import cut_lineage


def richness_fields() -> list[Column]:
    """Seven tests of how complete a record is, most telling first."""
    return [
        (F.col("status") != "catalog").cast("int"),
        F.col("due_date").isNotNull().cast("int"),
        F.col("posted_date").isNotNull().cast("int"),
        F.length(or_blank("description")),
        F.coalesce(F.greatest(F.size("categories"), F.lit(0)), F.lit(0)),
        F.col("external_id").isNotNull().cast("int"),
        F.length(or_blank("title")),
    ]


def richness_order() -> list[Column]:
    """Sort columns: richest first, input order on ties."""
    return [c.desc() for c in richness_fields()] + [F.col("ordinal").asc()]


def richness_rank() -> Column:
    """The same order as one ascending struct, for `min` and `min_by`."""
    return F.struct(*[(-c).alias(f"r{i}") for i, c in enumerate(richness_fields())], F.col("ordinal"))


def keep_last_by(df: DataFrame, by: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    return first_rows(df, by, [F.col(ordinal).desc()])


def collapse_by_reference(df: DataFrame) -> DataFrame:
    """Keep the richest record of every county-scoped reference; rows without one stay."""
    # Rows without a reference get a key of their own, so one pass serves both.
    key = F.coalesce(keys.ref_key("county", "external_id"), F.concat(F.lit("#"), F.col("ordinal").cast("string")))
    return first_rows(df.withColumn("ref_key", key), ["ref_key"], richness_order()).drop("ref_key")


def collapse_by_title(df: DataFrame) -> DataFrame:
    """Drop records whose title was seen earlier with the same, or with no, reference.

    A record survives when it is the richest of its title, or when both it and
    that richest record carry references and they differ; one survivor is kept
    per distinct reference of a title.
    """
    keyed = (df.withColumn("ref_key", keys.ref_key("county", "external_id"))
             .withColumn("title_key", keys.title_key("county", "agency", "title"))
             .withColumn("rank", richness_rank()))
    heads = keyed.groupBy("title_key").agg(
        F.min(F.struct("rank", "ref_key")).alias("head"))
    per_ref = keyed.groupBy("title_key", "ref_key").agg(F.min("rank").alias("best"))
    survivors = (per_ref.join(heads, "title_key")
                 .filter((F.col("best") == F.col("head.rank"))
                         | (F.col("ref_key").isNotNull() & F.col("head.ref_key").isNotNull()))
                 .select(F.col("best.ordinal").alias("ordinal")))
    return df.join(survivors, "ordinal", "left_semi")


def _follow(links: DataFrame) -> DataFrame:
    """Replace every link by the end of its chain: one row (ref_key, absorber) each.

    `links` holds ref_key, parent (the reference deferred to, or null at a chain
    end) and absorber (the reference-less record ending the chain, or null).
    """
    current = cut_lineage(links)
    while True:  # pointer doubling: rounds grow with the logarithm of the longest chain
        if current.filter(F.col("parent").isNotNull()).limit(1).count() == 0:
            return current.select("ref_key", "absorber")
        ahead = current.select(F.col("ref_key").alias("parent"), F.col("parent").alias("next_parent"),
                               F.col("absorber").alias("next_absorber"))
        current = cut_lineage(
            current.join(ahead, "parent", "left")
            .select("ref_key", F.col("next_parent").alias("parent"),
                    F.coalesce("absorber", "next_absorber").alias("absorber")))


#: Fields that a survivor inherits where it lacks them.
INHERITED = ("due_date", "posted_date", "contact", "budget", "categories")


def _keyed(df: DataFrame) -> DataFrame:
    """A record's keys, rank and what it can give. Five branches read these columns, so they are written once."""
    return cut_lineage(df.select(
        "ordinal", keys.ref_key("county", "external_id").alias("ref_key"),
        keys.title_key("county", "agency", "title").alias("title_key"),
        richness_rank().alias("rank"), *INHERITED))


def survivor_map(df: DataFrame) -> DataFrame:
    """For every record, the ordinal of the record it merges into (itself if it survives)."""
    return _survivors(_keyed(df))


def _survivors(keyed: DataFrame) -> DataFrame:
    title_heads = keyed.groupBy("title_key").agg(F.min(F.struct("rank", "ref_key")).alias("head")).select(
        "title_key", F.col("head.rank.ordinal").alias("head_ordinal"), F.col("head.ref_key").alias("head_ref"))
    ref_heads = keyed.filter(F.col("ref_key").isNotNull()).groupBy("ref_key").agg(
        F.min(F.struct("rank", "title_key")).alias("head")).select(
        "ref_key", F.col("head.rank.ordinal").alias("own_ordinal"), F.col("head.title_key").alias("title_key"))
    # A title's head decides for its reference-less members and for deferring references.
    links = ref_heads.join(title_heads, "title_key").select(
        "ref_key",
        F.when(F.col("head_ordinal") != F.col("own_ordinal"), F.col("head_ref")).alias("parent"),
        F.when((F.col("head_ordinal") != F.col("own_ordinal")) & F.col("head_ref").isNull(),
               F.col("head_ordinal")).alias("absorber"))
    ends = _follow(links)
    by_ref = ref_heads.join(ends, "ref_key", "left").select(
        "ref_key", F.coalesce("absorber", "own_ordinal").alias("survivor"))
    by_title = (title_heads.join(by_ref.withColumnRenamed("ref_key", "head_ref"), "head_ref", "left")
                .select("title_key", F.coalesce("survivor", "head_ordinal").alias("survivor")))
    with_ref = keyed.filter(F.col("ref_key").isNotNull()).select("ordinal", "ref_key").join(by_ref, "ref_key")
    without = keyed.filter(F.col("ref_key").isNull()).select("ordinal", "title_key").join(by_title, "title_key")
    return with_ref.select("ordinal", "survivor").unionByName(without.select("ordinal", "survivor"))


def collapse(df: DataFrame) -> DataFrame:
    """The full two-key collapse; survivors inherit the few fields they lack.

    Missing due date, posted date, contact and budget come from the richest
    duplicate that has one; categories are unioned in merge order.
    """
    keyed = _keyed(df)
    members = cut_lineage(keyed.select("ordinal", *INHERITED, "rank").join(_survivors(keyed), "ordinal"))
    is_self = F.col("ordinal") == F.col("survivor")

    def donated(name: str, present: Column) -> Column:
        return F.min_by(F.when(present, F.col(name)), F.when(present, F.col("rank"))).alias(f"got_{name}")

    gifts = members.groupBy("survivor").agg(
        donated("due_date", F.col("due_date").isNotNull()),
        donated("posted_date", F.col("posted_date").isNotNull()),
        donated("contact", F.coalesce(F.col("contact") != "", F.lit(False))),
        donated("budget", F.coalesce(F.col("budget") != "", F.lit(False))),
        F.count(F.lit(1)).alias("merged_records"))
    tags = (members.select("survivor", "rank", is_self.alias("own"), F.posexplode("categories").alias("pos", "category"))
            .groupBy("survivor", "category")
            .agg(F.min(F.struct((~F.col("own")).alias("later"), "rank", "pos")).alias("at"))
            .groupBy("survivor")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "category"))),
                             lambda s: s["category"]).alias("got_categories")))
    kept = (df.join(gifts, df["ordinal"] == gifts["survivor"]).drop("survivor")
            .join(tags, df["ordinal"] == tags["survivor"], "left").drop("survivor"))
    return (kept
            .withColumn("due_date", F.coalesce("due_date", "got_due_date"))
            .withColumn("posted_date", F.coalesce("posted_date", "got_posted_date"))
            .withColumn("contact", F.when(F.coalesce(F.col("contact"), F.lit("")) != "", F.col("contact"))
                        .otherwise(F.coalesce("got_contact", "contact")))
            .withColumn("budget", F.when(F.coalesce(F.col("budget"), F.lit("")) != "", F.col("budget"))
                        .otherwise(F.coalesce("got_budget", "budget")))
            .withColumn("categories", F.coalesce("got_categories", "categories"))
            .drop("got_due_date", "got_posted_date", "got_contact", "got_budget", "got_categories"))


def better_register_rows(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Duplicate register rows: a named vendor beats none, then the later end date, then input order."""
    return first_rows(df, by, [F.coalesce(F.col("vendor") != "", F.lit(False)).desc(),
                               F.col("end_date").desc_nulls_last(), F.col("ordinal").asc()])


def announcement_groups(df: DataFrame) -> DataFrame:
    """One row per reference: longest title, newest announcement's url and contact, merged status.

    Status is `cancelled` when any announcement cancels, `award` when any is an
    award, otherwise `open`.
    """
    newest = F.struct(F.col("announced_on"), (-F.col("ordinal")).alias("o"))
    longest = F.struct(F.length("title"), (-F.col("ordinal")).alias("o"))
    return df.groupBy("ref").agg(
        F.max_by("title", longest).alias("title"),
        F.max_by("url", newest).alias("url"),
        F.max_by("contact", newest).alias("contact"),
        F.min("announced_on").alias("first_announced"),
        F.max("announced_on").alias("last_announced"),
        F.countDistinct("kind").alias("kinds"),
        F.array_join(F.array_sort(F.collect_set("kind")), "; ").alias("announcements"),
        F.when(F.max((F.col("kind") == "cancelled").cast("int")) == 1, F.lit("cancelled"))
        .when(F.max((F.col("kind") == "award").cast("int")) == 1, F.lit("award"))
        .otherwise(F.lit("open")).alias("status"))


REQUIREMENT_STOPWORDS = ["required", "a", "the", "of", "and", "to"]  # fixed values


def absorb_labels(labels: Column) -> Column:
    """Drop labels another label already says: a superset of words replaces the subset."""
    stop = F.array(*[F.lit(w) for w in REQUIREMENT_STOPWORDS])

    def words(label: Column) -> Column:
        return F.array_distinct(F.array_except(
            F.regexp_extract_all(F.lower(label), F.lit("[a-z0-9]+"), F.lit(0)), stop))

    def subset(a: Column, b: Column) -> Column:
        return F.size(F.array_except(a, b)) == 0

    def step(kept: Column, label: Column) -> Column:
        w = label["words"]
        # Index of the first kept label that covers this one, or that this one covers.
        hit = F.array_position(
            F.transform(kept, lambda k: subset(w, k["words"]) | subset(k["words"], w)), True)
        spot = hit.cast("int")
        at = F.get(kept, spot - 1)
        swapped = F.transform(kept, lambda k, i: F.when((i == spot - 1) & ~subset(w, at["words"]), label).otherwise(k))
        return F.when(F.size(w) == 0, kept).when(hit > 0, swapped) \
            .otherwise(F.concat(kept, F.array(label)))

    # the words stand beside their label: each pair that is compared would read them again
    told = F.transform(labels, lambda x: F.struct(x.alias("label"), words(x).alias("words")))
    kept = F.aggregate(told, F.array().cast("array<struct<label:string,words:array<string>>>"), step)
    return F.transform(kept, lambda k: k["label"])


def list_union(*arrays: Column) -> Column:
    """Union keeping first appearances in order."""
    return F.array_distinct(F.concat(*arrays))
