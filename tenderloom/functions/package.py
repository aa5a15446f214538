"""Commercial terms read from the text of a bid package."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom.functions.base import ColumnLike, col, let, none_if_blank, or_blank

# Labels, money, yes-answers, flags and the section banner.
LABEL = (r"(?<![A-Za-z0-9])(?!(?:YES|NO|N/A|TBD)\b)([A-Z][A-Za-z0-9]*"
         r"(?:(?:\s*[&/-]\s*|\s+)[A-Za-z0-9][A-Za-z0-9]*){0,6})\s*:")
MONEY = r"\$\s?[\d,]+(?:\.\d{1,2})?"
YES = r"(?i)^\s*(yes|y|required)\b"
FLAGS = [
    ("bid bond required", "Bid bond required"),
    ("performance bond required", "Performance bond required"),
    ("payment bond required", "Payment bond required"),
    ("performance & payment bond required", "Performance & payment bond required"),
    ("davis bacon", "Davis-Bacon wage rates"),
    ("additional insurance required", "Additional insurance"),
    ("maintenance wages", "Maintenance wage rates"),
    ("aipp", "Art in Public Places contribution"),
    ("dbe subcontractor forms required", "DBE subcontractor forms"),
    ("responsible wages", "Responsible wages"),
    ("living wage", "Living wage"),
]
SET_ASIDE = r"(?i)(SBE|DBE|MBE|WBE)[-\w]*\s+Requirements?\s*:?\s*YES[^%\n]{0,40}?(\d+(?:\.\d+)?)\s*%"
SCOPE_HEAD = r"(?i)scope\s+of\s+work\s*:?\s*"
BANNER = r"\n\s*(?:[A-Z][A-Z \d.&/-]{12,})\n"
VALUE_CHARS, SCOPE_CHARS, SCOPE_FLOOR = 400, 6000, 60
#: Labels that a fact is read from; a package states dozens of others.
USED = (*(label for label, _ in FLAGS), "estimated value", "project location", "license requirements", "per day", "liquidated damages",
        "calendar days for project completion")


def fields_of(text: str, wanted: frozenset[str] | None = None) -> dict[str, str]:
    """`Label: value` pairs line by line; a value ends where the next label starts, first label wins.

    A label with nothing before the next one takes the rest of its line.
    """
    found: dict[str, str] = {}
    for line in re.split(r"\r?\n", text):
        if ":" not in line:
            continue
        labels = list(_LABEL.finditer(line))
        for this, after in zip(labels, [*labels[1:], None], strict=True):
            label = _SPACES.sub(" ", _COLON.sub("", this.group(0))).strip(" ").lower()
            if not label or label in found or wanted is not None and label not in wanted:
                continue
            value = line[this.end(): after.start() if after else None].strip(" ")
            if not value and after:
                value = line[after.start():].strip(" ")
            if value:
                found[label] = value[:VALUE_CHARS]
    return found


# As Java reads them: white space is the six ASCII characters.
_LABEL, _SPACES, _COLON = re.compile(LABEL, re.A), re.compile(r"\s+", re.A), re.compile(r"\s*:$", re.A)


def labelled_fields(text: ColumnLike, wanted: Sequence[str] | None = None) -> Column:
    """The fields of `fields_of` as a map, those of `wanted` alone if given.

    Cutting lines at labels is a loop over matches, which column functions can
    only state by joining the rest of a line again for each label; in Arrow
    batches it is several times faster.
    """
    names = None if wanted is None else frozenset(wanted)

    @F.pandas_udf("map<string,string>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.fillna("").map(lambda t: fields_of(t, names))

    return read(or_blank(text))


def _tidy(value: Column) -> Column:
    """Collapsed and stripped of edge punctuation; null when nothing is left."""
    return none_if_blank(F.trim(F.regexp_replace(value, r"\s+", " "), F.lit(" .;:")))


def _money(value: Column) -> Column:
    return none_if_blank(F.regexp_replace(F.regexp_extract(or_blank(value), MONEY, 0), r"\s+", ""))


def scope_of_work(text: ColumnLike) -> Column:
    """The narrative after a scope heading, up to the next capital banner."""
    after = F.split(or_blank(text), SCOPE_HEAD, 2)

    def cut(body: Column) -> Column:
        head = F.split(body, BANNER, 2)[0]
        return F.trim(F.regexp_replace(F.when(F.length(head) > SCOPE_FLOOR, head).otherwise(body), r"[ \t]+", " "))

    return none_if_blank(let(F.trim(F.substring(F.get(after, F.lit(1)), 1, SCOPE_CHARS)), cut))


def _facts_from(fields: Column, text: Column) -> Column:
    def says_yes(label: str) -> Column:
        return F.coalesce(fields[label].rlike(YES), F.lit(False))

    damages = F.coalesce(_money(fields["per day"]), _money(fields["liquidated damages"]))
    share = F.regexp_extract(text, SET_ASIDE, 2)
    licence = _tidy(fields["license requirements"])
    flags = [F.when(says_yes(label), F.lit(phrase)) for label, phrase in FLAGS]
    flags.append(F.substring(F.concat(F.lit("Licence: "), licence), 1, 140))
    flags.append(F.when(share.try_cast("double") > 0, F.concat(
        F.upper(F.regexp_extract(text, SET_ASIDE, 1)), F.lit(" set-aside "), share, F.lit("%"))))
    days = F.regexp_extract(or_blank(fields["calendar days for project completion"]), r"\d{1,5}", 0)
    return F.struct(
        _money(fields["estimated value"]).alias("estimated_value"),
        _tidy(fields["project location"]).alias("project_location"), licence.alias("licenses"),
        none_if_blank(days).cast("int").alias("duration_days"),
        F.when(says_yes("liquidated damages"), F.coalesce(F.concat(damages, F.lit(" per day")), F.lit("Yes"))).alias("liquidated_damages"),
        F.array_compact(F.array(*flags)).alias("requirements"), scope_of_work(text).alias("scope"))


def package_facts(text: ColumnLike) -> Column:
    """struct of estimated value, location, licences, days, damages, requirement flags and scope."""
    # the text and its fields side by side, so that the batch pass stands once in the plan
    both = F.struct(col(text).alias("text"), labelled_fields(text, USED).alias("fields"))
    return let(both, lambda b: _facts_from(b["fields"], b["text"]))
