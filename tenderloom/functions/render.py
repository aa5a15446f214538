"""Display strings: money, one-line briefs and request letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom.functions import text
from tenderloom.functions.base import ColumnLike, blank, col, filled, let, or_blank


def _one_decimal(n: Column) -> Column:
    return F.regexp_replace(F.format_string("%.1f", n), r"\.0$", "")


def short_money(amount: ColumnLike) -> Column:
    """$1.4M, $250k or $900; null stays null."""
    n = col(amount).cast("double")
    return (F.when(n >= 1_000_000, F.concat(F.lit("$"), _one_decimal(F.bround(n / 1_000_000, 1)), F.lit("M")))
            .when(n >= 1_000, F.concat(F.lit("$"), F.bround(n / 1_000).cast("long").cast("string"), F.lit("k")))
            .when(n.isNotNull(), F.concat(F.lit("$"), n.cast("long").cast("string"))))


def brief(as_of: str) -> Column:
    """The one-line summary of a solicitation."""
    kind = F.upper(F.when(blank("solicitation_type"), F.lit("BID")).otherwise(F.col("solicitation_type")))
    kind = F.when(kind == "UNKNOWN", F.lit("BID")).otherwise(kind)
    head = F.concat(F.lit("["), kind, F.lit("] "), F.col("agency"), F.lit(": "), F.trim("title"))
    days = text.days_until_due("due_date", as_of)
    number = days.cast("string")
    timing = (F.when(days < 0, F.concat(F.lit("CLOSED "), F.abs(days).cast("string"), F.lit("d ago")))
              .when(days == 0, F.lit("DUE TODAY"))
              .when(days <= 7, F.concat(F.lit("due in "), number, F.lit("d (URGENT)")))
              .otherwise(F.concat(F.lit("due in "), number, F.lit("d"))))
    closes = F.concat(F.lit("Closes "), F.date_format("due_date", "MMM dd, yyyy HH:mm"),
                      F.lit(" ("), timing, F.lit(")."))
    undated = (F.when(F.col("status") == "upcoming", F.lit("Upcoming / planned solicitation."))
               .when(F.col("status") == "catalog", F.lit("Portal directory entry — register to see live bids."))
               .otherwise(F.lit("Due date not published on listing.")))
    offer = F.when(filled("offer_type") & (F.col("offer_type") != "unknown"),
                   F.replace("offer_type", F.lit("_"), F.lit(" ")))
    tags = F.when(F.size("categories") > 0, F.array_join(F.slice("categories", 1, 3), "/"))
    category = F.concat_ws("; ", offer, tags)
    tidy = F.trim(F.regexp_replace(or_blank("description"), r"\s+", " "))
    desc = let(tidy, lambda d: F.when(F.length(d) > 180, F.concat(F.substring(d, 1, 177), F.lit("..."))).otherwise(d))
    return F.concat_ws(
        " ", head,
        F.when(filled("external_id"), F.concat(F.lit("Ref "), F.col("external_id"), F.lit("."))),
        F.when(F.col("due_date").isNotNull(), closes).otherwise(undated),
        F.when(category != "", F.concat(F.lit("Category: "), category, F.lit("."))),
        F.when(filled("budget"), F.concat(F.lit("Budget: "), F.col("budget"), F.lit("."))),
        F.when(filled("department"), F.concat(F.lit("Dept: "), F.col("department"), F.lit("."))),
        F.when(filled("contact"), F.concat(F.lit("Contact: "), F.col("contact"), F.lit("."))),
        let(desc, lambda d: F.when((d != "") & ~F.contains(F.lower("title"), F.lower(d)), d)))


# Fixed value: the request letter. {agency} {ref} {title} {opened} {today} {who} are filled per lead.
LETTER = """\
Public records request — {agency}
Re: {ref}

To the custodian of public records:

Under Chapter 119, Florida Statutes, I request a copy of the following records
concerning solicitation {ref} ({title}), which was opened on {opened}:

  1. The bid tabulation for this solicitation.
  2. The plan-holder and addenda registry maintained for it under
     s. 255.0525(3), F.S., if one exists.

Pursuant to s. 119.01(2)(f), F.S., I request the copy in the medium in which
your office maintains the record — a native export from your procurement
system (CSV, XLSX, or your system's standard export output) is entirely
acceptable and is what I am asking for. I am not asking that any list be
compiled or that data be re-sorted or reformatted.

More than 30 days have passed since the opening of this solicitation and no
notice of intended decision appears to have been posted, so the exemption in
s. 119.071(1)(b)2, F.S. has lapsed by its own terms.

If any portion is withheld or redacted, please state the statutory basis for
each, as required by s. 119.07(1)(e), F.S. If you anticipate a special service
charge under s. 119.07(4)(d), F.S., please provide a written itemized estimate
before performing the work rather than after.

Requested {today} by {who}.
"""
NO_REQUESTER = "[your name, business, and contact details]"


def request_letter(as_of: str, requester: str = "") -> Column:
    """The records-request letter for a lead with agency, external_id, title and due_date."""
    import re

    long_day = "MMMM d, yyyy"
    slots = {
        "agency": F.col("agency"),
        "ref": F.when(filled("external_id"), F.col("external_id")).otherwise(F.col("title")),
        "title": F.col("title"),
        "opened": F.coalesce(F.date_format("due_date", long_day), F.lit("the date of opening")),
        "today": F.date_format(F.lit(as_of).cast("date"), long_day),
        "who": F.lit(requester.strip() or NO_REQUESTER),
    }
    parts = [slots[p[1:-1]] if p.startswith("{") else F.lit(p)
             for p in re.split(r"(\{\w+\})", LETTER) if p]
    return F.concat(*parts)
