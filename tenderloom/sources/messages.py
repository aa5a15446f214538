"""Bid notices that arrive as mail, and which agency sent them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions import dates
from tenderloom.functions.base import ColumnLike, any_of, capture, captures, col, first_filled, first_rows, matches, none_if_blank, or_blank
from tenderloom.operators.resolve import host_of

# What a notice's subject, links, deadline and reference look like.
BID_SUBJECT = r"\b(bid|solicitation|rfp|rfq|itb|ifb|itn|rpq|procurement|invitation to)\b"
SUBJECT_PREFIX = r"^\s*(?:re:|fwd:)?\s*(?:notify\s*me|new\s+bid\s+posting|bid\s+posting|bids?)\s*[:\-–]\s*"
LINK = r"https?://[^\s<>\"')]+"
CLOSING = (r"(?:clos(?:es|ing)|due|deadline|submittal)\s*(?:date)?\s*[:\-]?\s*([A-Z][a-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}/\d{1,2}/\d{4})"
           r"(?:[^\n]{0,20}?(\d{1,2}:\d{2}\s*[AP]\.?M\.?))?")
REFERENCE = r"\b((?:ITB|IFB|RFP|RFQ|RFI|ITN|RPQ|ITQ|RLI)[\s\-]?[\w.\-/]{3,})"
FOOTER = r"\b(unsubscribe|you are receiving this|to stop receiving)\b"
SKIPPED_LINKS = ("unsubscribe", "list.aspx", "privacy", "mailto")
SUMMARY_CHARS = 600


def notice_title(subject: ColumnLike) -> Column:
    bare = F.trim(F.regexp_replace(col(subject), "(?i)" + SUBJECT_PREFIX, ""), F.lit(" -–:|"))
    return F.substring(F.regexp_replace(bare, r"\s+", " "), 1, 200)


def notice_link(body: ColumnLike) -> Column:
    """The first link that is not part of the mail's footer."""
    urls = F.transform(captures(or_blank(body), LINK), lambda u: F.rtrim(u, F.lit(".,);")))
    wanted = F.filter(urls, lambda u: ~any_of([F.contains(F.lower(u), F.lit(skip)) for skip in SKIPPED_LINKS]))
    return F.get(wanted, F.lit(0))


def closing_time(text: ColumnLike) -> Column:
    return dates.parse_timestamp(F.concat_ws(" ", capture(text, CLOSING, 1), capture(text, CLOSING, 2)))


def summary(body: ColumnLike) -> Column:
    flat = F.trim(F.regexp_replace(or_blank(body), r"\s+", " "))
    return none_if_blank(F.substring(F.trim(F.split(flat, "(?i)" + FOOTER, 2)[0]), 1, SUMMARY_CHARS))


def bid_notices(messages: DataFrame, portal_url: str) -> DataFrame:
    """Messages (message_id, subject, body, sender) to notices; the first message of a url wins."""
    kept = messages.filter(matches("subject", BID_SUBJECT)).select(
        "message_id", "sender", notice_title("subject").alias("title"),
        F.coalesce(notice_link("body"), F.lit(portal_url)).alias("url"),
        F.coalesce(closing_time("body"), closing_time("subject")).alias("due_date"),
        F.trim(first_filled(capture("subject", REFERENCE), capture("body", REFERENCE))).alias("external_id"),
        summary("body").alias("description")).filter(F.length("title") >= 5)
    return first_rows(kept, ["url"], [F.col("message_id").asc()])


def bare_host(url: ColumnLike) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def sender_domain(sender: ColumnLike) -> Column:
    found = F.lower(F.regexp_extract(or_blank(sender), r"@([\w.-]+)", 1))
    return F.regexp_replace(found, r"^www\.", "")


def _suffixes(host: ColumnLike) -> Column:
    """A host and every parent domain of it."""
    labels = F.split(col(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def attribute_senders(notices: DataFrame, sources: DataFrame) -> DataFrame:
    """Add agency and county of the source whose host matches the link, else the sender.

    Hosts match when equal or when either is a subdomain of the other, so each
    side's parent domains are equi-joined with the other side.
    """
    hosts = first_rows(sources.withColumn("host", bare_host("portal_url")).filter((F.col("host") != "") & (or_blank("agency") != "")),
                       ["host"], [F.col("ordinal").asc()]) \
        .select("host", F.col("ordinal").alias("place"), F.col("agency").alias("src_agency"), F.col("county").alias("src_county"))
    asked = notices.select("message_id", F.posexplode(F.array(bare_host("url"), sender_domain("sender"))).alias("turn", "candidate")) \
        .filter(F.col("candidate") != "")
    distinct = asked.select("candidate").distinct()
    below = distinct.withColumn("host", F.explode(_suffixes("candidate"))).join(hosts, "host")
    above = hosts.withColumn("candidate", F.explode(_suffixes("host"))).join(distinct, "candidate")
    columns = ["candidate", "place", "src_agency", "src_county"]
    answers = below.select(*columns).unionByName(above.select(*columns)).groupBy("candidate").agg(
        F.min(F.struct("place", "src_agency", "src_county")).alias("a"))
    best = asked.join(answers, "candidate").groupBy("message_id").agg(F.min_by("a", "turn").alias("a"))
    domain = sender_domain("sender")
    return notices.join(best, "message_id", "left").withColumn(
        "agency", F.coalesce("a.src_agency", F.when(domain != "", F.concat(F.lit("Email alert ("), domain, F.lit(")"))))) \
        .withColumn("county", F.coalesce("a.src_county", F.lit("unknown"))).drop("a")
