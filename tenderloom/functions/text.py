"""Facts mined from solicitation prose, as native column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom.functions import dates
from tenderloom.functions.base import (ColumnLike, any_of, capture, captures, col, ladder, labels_where, let, matches,
                                       none_if_blank, or_blank)

# Solicitation-type patterns, tried in this order.
SOLICITATION_TYPES = [
    (r"\bITN\b", "ITN"),
    (r"\bCCNA\b", "CCNA"),
    (r"\bRPQ\b", "RPQ"),
    (r"\bITQ\b", "ITQ"),
    (r"\bRLI\b", "RLI"),
    (r"\bRFQ\b", "RFQ"),
    (r"\bRFI\b", "RFI"),
    (r"\bRFP\b", "RFP"),
    (r"\bIFB\b", "IFB"),
    (r"\bITB\b", "ITB"),
    (r"invitation\s+to\s+negotiate", "ITN"),
    (r"request\s+for\s+(?:price\s+)?quotations?", "RPQ"),
    (r"invitation\s+to\s+quote", "ITQ"),
    (r"request\s+for\s+letters?\s+of\s+interest", "RLI"),
    (r"request\s+for\s+qualifications?", "RFQ"),
    (r"request\s+for\s+information", "RFI"),
    (r"request\s+for\s+proposals?", "RFP"),
    (r"invitation\s+(?:to|for)\s+bid", "ITB"),
]

# Reference-number patterns, tried in this order.
EXTERNAL_ID_PATTERNS = [
    r"\b((?:ITB|IFB|RFP|RFQ|RFI|ITN|RPQ|ITQ|RLI)\s*(?:No\.?\s*)?[\d][\w./-]{2,})",
    r"\b((?:RFP|ITB|EVN|IFB)\d{5,})",
    r"\b([A-Z]{2,}\d{6,}[A-Z0-9]*)\b",
    r"\b(\d{2}C-\d{3}[A-Z]?)\b",
]

# Requirement labels and what in the text earns them.
REQUIREMENTS = [
    ("Bid bond", r"\bbid\s+bond\b|\bbid\s+security\b|\bproposal\s+bond\b"),
    ("Performance bond", r"\bperformance\s+bond\b"),
    ("Payment bond", r"\bpayment\s+bond\b"),
    ("Insurance certificate",
     r"\bcertificate\s+of\s+insurance\b|\binsurance\s+requirement|\bliability\s+insurance\b"),
    ("Licensed contractor",
     r"\blicensed\b|\bstate\s+certified\b|\bgeneral\s+contractor'?s?\s+licen[cs]e\b"),
    ("Prequalification required", r"\bpre[-\s]?qualif"),
    ("Mandatory pre-bid meeting",
     r"\bmandatory\b[^.]{0,60}\bpre[-\s]?(?:bid|proposal|submittal)\b|\bpre[-\s]?bid\b[^.]{0,40}\bmandatory\b"),
    ("Mandatory site visit", r"\bmandatory\b[^.]{0,40}\bsite\s+(?:visit|inspection)\b"),
    ("E-Verify", r"\be[-\s]?verify\b"),
    ("SBE/MBE/DBE participation",
     r"\b(?:SBE|MBE|DBE|WBE|M/?WBE)\b|\bsmall\s+business\s+enterprise\b|\bdisadvantaged\s+business\b"),
    ("Local preference", r"\blocal\s+(?:business\s+)?preference\b|\blocal\s+vendor\s+preference\b"),
    ("Living wage", r"\bliving\s+wage\b|\bprevailing\s+wage\b|\bDavis[-\s]?Bacon\b"),
    ("Drug-free workplace", r"\bdrug[-\s]?free\s+workplace\b"),
    ("Public entity crimes affidavit", r"\bpublic\s+entity\s+crimes?\b"),
    ("Background screening", r"\bbackground\s+(?:screening|check)\b|\blevel\s+2\s+screening\b"),
    ("Bonding capacity", r"\bbonding\s+capacity\b"),
    ("References required",
     r"\b(?:three|3|five|5)\s+(?:\(\d\)\s*)?(?:similar\s+)?references\b|\breference\s+requirement"),
]

# A money figure, and the phrasings that say it is the contract's value.
MONEY = r"\$\s?[\d,]+(?:\.\d{1,2})?(?:\s*(?:million|billion|M|K)\b)?"
VALUE_PATTERNS = [
    rf"(?:not\s+to\s+exceed|nte)\s+(?:of\s+)?({MONEY})",
    rf"(?:estimated|approximate|anticipated)\s+(?:construction\s+)?(?:budget|value|cost|amount)\s*(?:is|of|:)?\s*({MONEY})",
    rf"(?:budget|value|amount)\s+of\s+({MONEY})",
    rf"({MONEY})\s*(?:per\s+year|annually|per\s+annum)",
    rf"(?:total\s+)?(?:contract|project)\s+(?:value|amount|budget)\s*(?:is|of|:)?\s*({MONEY})",
]
MIN_BARE_VALUE = 25_000

# Dates inside prose, pre-bid notices, e-mail and phone shapes.
PROSE_DATE = (r"(?:[A-Z][a-z]+day,?\s+)?([A-Z][a-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}/\d{1,2}/\d{4})"
              r"(?:[^\n]{0,30}?(\d{1,2}:\d{2}\s*[AP]\.?M\.?))?")
QUESTIONS = (r"(?:questions?|additional\s+information|clarification|inquiries)[^\n]{0,60}?\s*" + PROSE_DATE)
PRE_BID = r"pre[-\s]?(?:bid|proposal|submittal)\s+(?:conference|meeting)[^.\n]{0,180}"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PHONE = r"\(?\b\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b"


def joined_text(*texts: ColumnLike) -> Column:
    """The non-blank texts, one per line."""
    return F.concat_ws("\n", *[none_if_blank(t) for t in texts])


def _met(text: Column, lowered: Column, pattern: str) -> Column:
    """`matches`, tried only where a literal that every match contains is in the lower-case text: a plain search costs far less."""
    from tenderloom.functions.classify import literals

    found = literals(pattern)
    return matches(text, pattern) if found is None else any_of([F.coalesce(F.contains(lowered, F.lit(x)), F.lit(False)) for x in sorted(found)]) & matches(text, pattern)


def _with_lower(text: ColumnLike, body) -> Column:
    return let(F.struct(col(text).alias("text"), F.lower(col(text)).alias("lowered")), lambda b: body(b["text"], b["lowered"]))


def _where_said(text: ColumnLike, pattern: str, found: Column) -> Column:
    """`found`, which only a match of `pattern` can fill, read only where a literal of the pattern stands."""
    from tenderloom.functions.classify import literals

    lowered = F.lower(col(text))
    return F.when(any_of([F.contains(lowered, F.lit(x)) for x in sorted(literals(pattern))]), found)


def solicitation_type(text: ColumnLike) -> Column:
    return _with_lower(text, lambda t, low: ladder([(_met(t, low, p), F.lit(kind)) for p, kind in SOLICITATION_TYPES], F.lit("UNKNOWN")))


def external_id(text: ColumnLike) -> Column:
    found = F.coalesce(*[capture(text, p) for p in EXTERNAL_ID_PATTERNS])
    return F.trim(F.regexp_replace(found, r"\s+", " "))


def requirement_labels(text: ColumnLike) -> Column:
    return _with_lower(text, lambda t, low: labels_where([(label, _met(t, low, p)) for label, p in REQUIREMENTS]))


def tidy_money(text: ColumnLike) -> Column:
    return F.regexp_replace(F.regexp_replace(col(text), r"\s+", ""), "(?i)(million|billion)$", " $1")


def money_number(text: ColumnLike) -> Column:
    """Dollars in one money figure, applying its magnitude word or letter."""
    text = col(text)
    number = F.coalesce(F.regexp_replace(text, r"[^\d.]", "").try_cast("double"), F.lit(0.0))
    lowered = F.lower(text)
    scale = F.when(lowered.contains("million") | text.rlike(r"\dM\b"), 1_000_000.0) \
        .when(lowered.contains("billion"), 1_000_000_000.0) \
        .when(text.rlike(r"\dK\b"), 1_000.0).otherwise(1.0)
    return number * scale


def _largest_bare(figures: Column) -> Column:
    numbers = F.transform(figures, money_number)
    ranked = F.arrays_zip(numbers.alias("n"), figures.alias("f"))
    # The first of the largest figures.
    return let(F.array_max(numbers), lambda top: F.when(top >= MIN_BARE_VALUE, F.get(
        F.filter(ranked, lambda p: p["n"] == top), F.lit(0))["f"]))


def estimated_value(text: ColumnLike) -> Column:
    """The figure phrased as the value, else the largest bare figure worth a contract."""
    bare = let(captures(text, MONEY), _largest_bare)
    return F.when(F.contains(col(text), F.lit("$")), tidy_money(F.coalesce(*[capture(text, p) for p in VALUE_PATTERNS], bare)))


def pre_bid_meeting(text: ColumnLike) -> Column:
    found = F.regexp_replace(capture(text, PRE_BID, 0), r"\s+", " ")
    return _where_said(text, PRE_BID, F.trim(found, F.lit(" .;:")))


def questions_due(text: ColumnLike) -> Column:
    day, clock = capture(text, QUESTIONS, 1), capture(text, QUESTIONS, 2)
    return _where_said(text, QUESTIONS, dates.parse_timestamp(F.concat_ws(" ", day, clock)))


def contact_email(text: ColumnLike) -> Column:
    return F.when(F.contains(col(text), F.lit("@")), F.rtrim(capture(text, EMAIL, 0), F.lit(".")))


def contact_phone(text: ColumnLike) -> Column:
    return F.trim(capture(text, PHONE, 0))


def budget_amount(budget: ColumnLike) -> Column:
    """Whole dollars of the low end of a budget: every digit before the first dash."""
    low = F.split(or_blank(budget), "[-–]", 2)[0]
    return none_if_blank(F.regexp_replace(low, r"[^\d]", "")).cast("long")


def days_until_due(due: ColumnLike, as_of: str) -> Column:
    return F.datediff(col(due).cast("date"), F.lit(as_of).cast("date"))


def detail_score() -> Column:
    """0-100: how much is known about a bid, from thirteen weighted presence tests."""
    from tenderloom.functions.base import filled, filled_array, filled_number
    weights = [  # fixed values
        (filled("scope"), 22),
        (filled_array("documents"), 16),
        (F.col("due_date").isNotNull(), 13),
        (filled_array("requirements"), 9),
        (filled("contact") | filled("contact_email"), 8),
        (filled("budget"), 8),
        (filled("description"), 4),
        (filled("external_id"), 3),
        (filled("submittal_info") | filled("pre_bid_meeting"), 2),
        (filled_number("duration_days"), 5),
        (filled("liquidated_damages"), 5),
        (filled("licenses"), 3),
        (filled("project_location"), 2),
    ]
    total = F.lit(0)
    for present, points in weights:
        total = total + F.when(present, points).otherwise(0)
    return total.cast("int")
