"""Identity: stable ids, content hashes, normal forms of references, titles and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom.functions.base import ColumnLike, col, none_if_blank, or_blank

# Title words that say nothing about what is bought.
NOISE_WORDS = (
    "the a an and or for of to in on at by with from services service "
    "project projects program city county town village district department "
    "request proposal proposals qualifications bid bids invitation notice "
    "rfp rfq rfi itb ifb itn rpq itq rli no number contract annual "
    "various citywide countywide phase re rebid new"
).split()

# Fixed value: legal forms dropped from a firm's name before it is hashed.
LEGAL_FORMS = r"\b(llc|l\.l\.c|inc|incorporated|corp|corporation|co|company|ltd|llp|pa|pllc)\b\.?"

# Smallest reference length that may join two records.
MIN_REF_LENGTH = 5


def short_digest(hexed: Column) -> Column:
    return F.substring(hexed, 1, 16)


def opportunity_id(source: ColumnLike, ref: ColumnLike, title: ColumnLike, url: ColumnLike) -> Column:
    joined = F.concat_ws("|", col(source), or_blank(ref), col(title), col(url))
    return short_digest(F.sha1(joined))


def content_hash(text: ColumnLike) -> Column:
    return short_digest(F.sha2(col(text), 256))


def vendor_id(name: ColumnLike) -> Column:
    """One id for every spelling of a firm's name that differs only in legal form."""
    without_form = F.regexp_replace(F.lower(col(name)), LEGAL_FORMS, "")
    return short_digest(F.sha1(F.regexp_replace(without_form, "[^a-z0-9]+", "")))


def bare_ref(ref: ColumnLike) -> Column:
    """A reference number as lower-case letters and digits; null when nothing is left."""
    return none_if_blank(F.regexp_replace(F.lower(col(ref)), "[^a-z0-9]+", ""))


def ref_key(county: ColumnLike, ref: ColumnLike) -> Column:
    bare = bare_ref(ref)
    return F.when(F.length(bare) >= MIN_REF_LENGTH, F.concat_ws("|", col(county), bare))


def title_key(county: ColumnLike, agency: ColumnLike, title: ColumnLike) -> Column:
    spaced = F.regexp_replace(F.lower(or_blank(title)), "[^a-z0-9 ]+", " ")
    tidy = F.trim(F.regexp_replace(spaced, r"\s+", " "))
    return F.concat_ws("|", col(county), F.lower(col(agency)), tidy)


def significant_tokens(title: ColumnLike) -> Column:
    """The distinct words that say what is bought, sorted so equal sets compare equal."""
    without_year = F.regexp_replace(F.lower(or_blank(title)), r"\b(?:19|20)\d{2}\b", " ")
    words = F.regexp_extract_all(without_year, F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*NOISE_WORDS) & ~w.rlike("^[0-9]+$"))
    return F.array_sort(F.array_distinct(kept))


def containment(a: ColumnLike, b: ColumnLike) -> Column:
    """Shared words over the smaller set's size; zero when either set is empty."""
    a, b = col(a), col(b)
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(F.lit(0.0))
