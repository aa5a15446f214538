"""Portal date strings to naive Eastern wall-clock timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom.functions.base import ColumnLike, all_of, col, let, none_if_blank

# Zone names and their hours from UTC. Eastern is taken as UTC-5 all year.
ZONE_HOURS = {
    "EST": -5, "EDT": -4, "ET": -5, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6,
    "PST": -8, "PDT": -7, "UTC": 0, "GMT": 0, "Z": 0,
}
EASTERN_HOURS = -5

# Layouts tried in order, after zone, weekday and filler words are removed.
LAYOUTS = [
    "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a", "M/d/yyyy HH:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy",
    "M-d-yyyy", "M/d/yy",
    "MMMM d yyyy h:mm a", "MMMM d yyyy H:mm", "MMMM d yyyy",
    "MMM d yyyy h:mm a", "MMM d yyyy H:mm", "MMM d yyyy",
    "d MMMM yyyy", "d MMM yyyy",
]
# Shapes from which nothing is removed and that one layout alone can read.
PLAIN_SHAPES = {r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z": "yyyy-MM-dd", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z": "M/d/yyyy",
                r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\z": "yyyy-MM-dd'T'HH:mm:ss"}
BARE_DATE = r"^\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\s*$"


def _strip(raw: Column) -> Column:
    """The string without zone, weekday and filler words, its meridiem as a spaced AM or PM."""
    out = F.regexp_replace(raw, r"(?i)\s*\(?\b(?:EST|EDT|ET|CST|CDT|MST|MDT|PST|PDT|UTC|GMT)\)?$", "")
    out = F.regexp_replace(out, r"(:\d{2}(?:\.\d+)?)(?:Z|[+-]\d{2}:?\d{2})$", "$1")
    out = F.regexp_replace(out, r"(?i)\b(?:mon|tues|wednes|thurs|fri|satur|sun)day,?\s*", "")
    out = F.regexp_replace(out, r"(?i)\s+at\s+", " ")
    out = F.regexp_replace(out, r"(?i)\s*\ba\.?m\.?$|(?i)(?<=\d)\s*a\.?m\.?$", " AM")
    out = F.regexp_replace(out, r"(?i)\s*\bp\.?m\.?$|(?i)(?<=\d)\s*p\.?m\.?$", " PM")
    out = F.regexp_replace(out, r"([A-Za-z])\.?\s+(\d{1,2}),\s*", "$1 $2 ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _minutes_east(raw: Column) -> Column:
    """The stated offset from UTC in minutes, or null for a bare local time."""
    zone = F.upper(none_if_blank(F.regexp_extract(raw, r"(?i)[\s\d]\(?(EST|EDT|ET|CST|CDT|MST|MDT|PST|PDT|UTC|GMT|Z)\)?$", 1)))
    named = F.create_map(*[F.lit(x) for pair in ZONE_HOURS.items() for x in pair])
    stated = none_if_blank(F.regexp_extract(raw, r":\d{2}(?:\.\d+)?([+-]\d{2}:?\d{2})$", 1))
    digits = F.replace(stated, F.lit(":"), F.lit(""))
    size = F.substring(digits, 2, 2).cast("int") * 60 + F.substring(digits, 4, 2).cast("int")
    return F.coalesce(named[zone] * 60, F.when(digits.startswith("-"), -size).otherwise(size))


def _can_be(bare: Column, layout: str) -> Column:
    """Whether every sign of a layout is there; a parse that fails costs an exception, many times this test."""
    return all_of([F.contains(bare, F.lit(sign)) for sign in "/-:" if sign in layout])


def parse_timestamp(text: ColumnLike) -> Column:
    """A date string as naive Eastern time, or null when it cannot be read."""
    def read(bare: Column) -> Column:
        return F.coalesce(*[F.when(_can_be(bare, layout), F.try_to_timestamp(bare, F.lit(layout))) for layout in LAYOUTS]).cast("timestamp_ntz")

    def local(raw: Column) -> Column:
        shift = F.coalesce(EASTERN_HOURS * 60 - _minutes_east(raw), F.lit(0))
        return let(_strip(raw), read) + F.make_dt_interval(F.lit(0), F.lit(0), shift.cast("int"))

    def known(raw: Column) -> Column:
        out = F
        for shape, layout in PLAIN_SHAPES.items():
            out = out.when(raw.rlike(shape), F.try_to_timestamp(raw, F.lit(layout)).cast("timestamp_ntz"))
        return out.when(raw.isNotNull(), local(raw))

    return let(none_if_blank(F.trim(col(text))), known)


def parse_day(text: ColumnLike) -> Column:
    return parse_timestamp(text).cast("date")


def looks_like_bare_date(text: ColumnLike) -> Column:
    return F.coalesce(col(text).rlike(BARE_DATE), F.lit(False))


def utc_to_new_york(ts: ColumnLike) -> Column:
    """A naive UTC timestamp as New York wall-clock time, with daylight saving."""
    return F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), col(ts).cast("timestamp_ntz"))


def us_day(text: ColumnLike) -> Column:
    """An m/d/yyyy day, null when malformed."""
    return F.try_to_timestamp(F.trim(col(text)), F.lit("M/d/yyyy")).cast("date")
