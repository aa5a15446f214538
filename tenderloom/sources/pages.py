"""Facts read off web pages: text, links, platforms, tables and labelled values.

Everything a regular expression can say is native. Nested tables and label/value
layouts need a parser, so `table_rows` and `label_values` parse in Arrow batches
with the standard library, one page at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.base import (ColumnLike, any_of, capture, captures, col, first_rows, ladder, let, lookup_map,
                                       matches, none_if_blank, or_blank)

#: Named references by the standard library's list, with their semicolon where they must have one; a hard blank is a blank
#: here, as every reader of these pages takes it.
NAMED = {name: char.replace("\u00a0", " ") for name, char in html5.items()}
#: Names that count without a semicolon, longest first: the rest of what follows stays text.
BARE = sorted((name for name in NAMED if not name.endswith(";")), key=lambda n: (-len(n), n))
#: References that nearly all pages use, tried before the list.
COMMON = {name: NAMED[name] for name in ("amp;", "nbsp;", "lt;", "gt;", "quot;", "apos;")}
#: Numbers that name what an old Windows page meant by them.
WINDOWS = {0: "\ufffd", 13: "\r", **{n: bytes([n]).decode("cp1252") if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(n) for n in range(0x80, 0xA0)}}
#: What a reference's name or number may look like.
REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _character(point: Column) -> Column:
    """The character of a number: old Windows numbers mean what browsers show, surrogates and numbers beyond are the
    replacement character, control characters are nothing."""
    shown = F.from_json(F.lit(json.dumps({str(n): c for n, c in WINDOWS.items()})), "map<string,string>")
    void = ((point < 9) | point.between(0xB, 0xB) | point.between(0xE, 0x1F) | point.between(0x7F, 0x9F) | point.between(0xFDD0, 0xFDEF)
            | (F.pmod(point, F.lit(0x10000)) >= 0xFFFE))
    plain = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    return (F.when(point == 160, " ").when(shown[point.cast("string")].isNotNull(), shown[point.cast("string")])
            .when(point.between(0xD800, 0xDFFF) | (point > 0x10FFFF), "\ufffd").when(void, "").otherwise(plain))


def unescape(text: ColumnLike) -> Column:
    """Character references decoded once, as the standard library's `html.unescape` does, but for hard blanks; others stay as they are."""
    # by first letter: a map is searched entry by entry
    by_letter: dict[str, dict[str, str]] = {}
    for name, char in NAMED.items():
        by_letter.setdefault(name[0], {})[name] = char
    listed = F.from_json(F.lit(json.dumps(by_letter)), "map<string,map<string,string>>")

    def named(name: Column) -> Column:
        return listed[F.substring(name, 1, 1)][name]

    bare = "^(" + "|".join(BARE) + ")"

    def number(name: Column) -> Column:
        digits = F.rtrim(F.substr(name, F.lit(2)), F.lit(";"))
        hexed = F.lower(F.substring(digits, 1, 1)) == "x"
        value = F.when(hexed, F.lower(F.ltrim(F.substr(digits, F.lit(2)), F.lit("0")))).otherwise(F.ltrim(digits, F.lit("0")))
        point = F.when(hexed, F.conv(F.when(value == "", "0").otherwise(value), 16, 10)).otherwise(F.when(value == "", "0").otherwise(value))
        # more digits than any character has
        return F.when(F.length(value) > 9, F.lit(0x110000).cast("bigint")).otherwise(point.try_cast("bigint"))

    def decoded(piece: Column) -> Column:
        def known(name: Column) -> Column:
            short = F.regexp_extract(name, bare, 1)
            whole = F.when(name.isin(*COMMON), lookup_map(COMMON, name)).otherwise(named(name))
            return (F.when(name == "", F.concat(F.lit("&"), piece))
                    .when(name.startswith("#"), F.concat(let(number(name), _character), F.substr(piece, F.length(name) + 1)))
                    .when(whole.isNotNull(), F.concat(whole, F.substr(piece, F.length(name) + 1)))
                    .when(short != "", F.concat(named(short), F.substr(piece, F.length(short) + 1)))
                    .otherwise(F.concat(F.lit("&"), piece)))

        return let(F.regexp_extract(piece, REFERENCE, 1), known)

    def whole(text: Column) -> Column:
        parts = let(F.split(text, "&"), lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(F.transform(F.slice(p, F.lit(2), F.size(p)), decoded), "")))
        return F.when(F.contains(text, F.lit("&")), parts).otherwise(text)

    return let(text, whole)


def html_to_text(html: ColumnLike, separator: str = " · ") -> Column:
    """Text as a person reads it: entities resolved twice, breaks as separators, tags gone."""
    out = unescape(unescape(or_blank(html)))
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", separator)
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "), F.lit(" ·"))


def rich_text(html: ColumnLike) -> Column:
    """The text pieces of an editor field joined by blanks; drawings are left out, references decoded once."""
    out = F.regexp_replace(or_blank(html), r"(?is)<svg\b.*?(?:</svg\s*>|$)", " ")
    out = unescape(F.regexp_replace(out, r"(?s)<!--.*?-->|<[^>]+>", " "))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


ANCHOR = r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""


def links(html: ColumnLike) -> Column:
    """Every anchor as struct(href, text), in page order."""
    hrefs = F.regexp_extract_all(col(html), F.lit(ANCHOR), F.lit(1))
    texts = F.regexp_extract_all(col(html), F.lit(ANCHOR), F.lit(2))
    return F.transform(F.arrays_zip(hrefs.alias("h"), texts.alias("t")), lambda p: F.struct(
        p["h"].alias("href"), F.trim(F.regexp_replace(F.regexp_replace(p["t"], "<[^>]+>", " "), r"\s+", " ")).alias("text")))


def page_links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.posexplode(links("html")).alias("position", "a")).select(
        "page_id", "url", "position", "a.href", "a.text")


def absolute(base: ColumnLike, href: ColumnLike) -> Column:
    """A link resolved against its page (schemes, roots and siblings)."""
    base, href = col(base), col(href)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
            .when(href.startswith("/"), F.concat(origin, href))
            .otherwise(F.concat(F.coalesce(none_if_blank(folder), F.concat(origin, F.lit("/"))), href)))


# Platform, what proves it is run here, what only names it; best first.
PLATFORM_SIGNATURES = [
    ("bonfire", ("bonfirehub.com",), ("bonfire portal",)),
    ("opengov", ("procurement.opengov.com/portal/", "api.procurement.opengov.com"), ("opengov procurement",)),
    ("civicplus", ("/Common/Modules/Bids/RWDBids.css",), ()),
    ("vendor_registry", ("vrapp.vendorregistry.com/Bids/View/", "vendorregistry.com/Bids/"), ("vendor registry",)),
    ("vendorlink", ("myvendorlink.com", "vendorlink."), ("vendorlink",)),
    ("ionwave", (".ionwave.net", "ctl00_mainContent_rgBidList"), ("ionwave",)),
    ("bidsync_periscope", ("BuyspeedBidDetail.xhtml", ".buyspeed.com/bso/", "bidsync.com"), ("bidsync", "periscope holdings")),
    ("peoplesoft", ("SCP_PUB_BID_CMP_FL.GBL", "SCP_PUBLIC_MENU_FL"), ()),
    ("oracle_ebs", ("OA_HTML/OA.jsp?OAFunc=PON_",), ()),
    ("infor_fsm", ("inforcloudsuite.com/fsm/SupplyManagementSupplier",), ()),
    ("jaggaer", ("bids.sciquest.com/apps/Router/PublicEvent", "sciquest.com"), ("jaggaer",)),
    ("workday_sourcing", ("public-portal.us.workdayspend.com", "workdayspend.com"), ("workday strategic sourcing",)),
    ("bids_and_tenders", (".bidsandtenders.net/Module/Tenders/",), ("bids&tenders",)),
    ("planetbids", ("planetbids.com",), ("planetbids",)),
    ("publicpurchase", ("publicpurchase.com/gems/", "publicpurchase.com"), ("public purchase",)),
    ("demandstar", ("demandstar.com",), ("demandstar",)),
    ("bidnet", ("bidnetdirect.com",), ("bidnet direct",)),
    ("bidexpress", ("bidexpress.com", "bidx.com"), ("bid express",)),
    ("questcdn", ("questcdn.com",), ("questcdn",)),
    ("openpurchase", ("openpurchase.io",), ()),
]
# Link wording worth following, best first, and the coarse test before it.
LINK_HINTS = ("bid opportunit", "bids", "solicitation", "invitation to bid", "procurement", "purchasing", "rfp", "vendor")
LINK_TEST = "bid|purchas|procure|solicitat|rfp|vendor"
KNOWN_PLATFORM_BONUS = 20


def _contains_any(lowered: Column, needles: Sequence[str]) -> Column:
    return any_of([F.contains(lowered, F.lit(n.lower())) for n in needles])


def identify_platforms(html: ColumnLike) -> Column:
    """struct(strong, weak): platforms proved by the page, and those only named on it."""
    lowered = F.lower(col(html))
    strong, weak = [], []
    for platform, proofs, names in PLATFORM_SIGNATURES:
        proved = _contains_any(lowered, proofs)
        strong.append(F.when(proved, F.lit(platform)))
        if names:
            weak.append(F.when(~proved & _contains_any(lowered, names), F.lit(platform)))
    return F.struct(F.array_compact(F.array(*strong)).alias("strong"), F.array_compact(F.array(*weak)).alias("weak"))


def link_score(href: ColumnLike, text: ColumnLike) -> Column:
    """How promising a link is: its best hint's rank, plus a bonus for a known platform's own host."""
    blob = F.lower(F.concat_ws(" ", col(href), col(text)))
    hint = ladder([(F.contains(blob, F.lit(h)), F.lit(len(LINK_HINTS) - i)) for i, h in enumerate(LINK_HINTS)], F.lit(0))
    strong = [n for _p, proofs, _n in PLATFORM_SIGNATURES for n in proofs]
    bonus = F.when(_contains_any(F.lower(col(href)), strong), KNOWN_PLATFORM_BONUS).otherwise(0)
    return F.when(matches(blob, LINK_TEST), hint + bonus).otherwise(0)


def best_links(pages: DataFrame, avoid: Sequence[str] = ()) -> DataFrame:
    """Each page's most promising procurement link; the earliest on ties."""
    banned = [n for p, proofs, _n in PLATFORM_SIGNATURES if p in avoid for n in proofs]
    scored = page_links(pages).withColumn("score", link_score("href", "text"))
    if banned:
        scored = scored.filter(~_contains_any(F.lower("href"), banned))
    best = scored.filter("score > 0").groupBy("page_id").agg(
        F.max(F.struct("score", (-F.col("position")).alias("at"), "href", "url")).alias("b"))
    return best.select("page_id", F.col("b.score").alias("score"), absolute("b.url", "b.href").alias("link"))


# A numbered solicitation and a date as agencies write them; two of each make a board.
BOARD_REF = r"\b(?:ITB|IFB|RFP|RFQ|RFI|ITN|BID|SOLICITATION)\b[\s.#:No-]{0,6}(?:\d{2,4}[-/]\d{1,4}|\d{4,})"
BOARD_DATE = (r"\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+20\d{2}\b")
BOARD_MIN = 2


def bid_board_counts(html: ColumnLike) -> Column:
    """struct(refs, dates): distinct numbered solicitations and dates on a page."""
    text = F.regexp_replace(col(html), "<[^>]+>", " ")
    refs = F.transform(captures(text, BOARD_REF), lambda r: F.regexp_replace(F.upper(r), "[^A-Z0-9]", ""))
    return F.struct(F.size(F.array_distinct(refs)).alias("refs"), F.size(F.array_distinct(captures(text, BOARD_DATE))).alias("dates"))


def is_bid_board(html: ColumnLike) -> Column:
    counts = bid_board_counts(html)
    return (counts["refs"] >= BOARD_MIN) & (counts["dates"] >= BOARD_MIN)


# Where each platform's address names its tenant.
TENANT_PATTERNS = {
    "bonfire": r"https?://([a-z0-9-]+\.bonfirehub\.com)",
    "opengov": r"/portal/(?:embed/)?([a-z0-9_-]+)",
    "ionwave": r"https?://([a-z0-9-]+\.ionwave\.net)",
    "jaggaer": r"[?&]CustomerOrg=([A-Za-z0-9_-]+)",
    "workday_sourcing": r"https?://([a-z0-9-]+)\.(?:public-portal\.)?us\.workdayspend\.com",
}


def tenant(url: ColumnLike, platform: ColumnLike) -> Column:
    p = col(platform)
    return ladder([(p == name, capture(url, pattern)) for name, pattern in TENANT_PATTERNS.items()], F.lit(None).cast("string"))


def points_offsite(html: ColumnLike, platform: ColumnLike) -> Column:
    """A bid page without rows of its own that links the other platform."""
    has_rows = col(html).contains('class="bidTitle"') | col(html).contains("listItemsRow")
    lowered = F.lower(col(html))
    linked = ladder([(col(platform) == p, _contains_any(lowered, proofs)) for p, proofs, _n in PLATFORM_SIGNATURES], F.lit(False))
    return linked & ~has_rows


POINTING = "civicplus"  # fixed value: boards of this platform may only point at another


def platform_of(html: ColumnLike) -> Column:
    """struct(platform, also, confidence) of a page: the first platform it proves, else the first it names; a board that
    lists nothing and links another platform counts as that one."""
    def decided(found: Column) -> Column:
        proved, named = found["strong"], found["weak"]
        every = F.array_distinct(F.concat(proved, named))
        head = F.get(every, F.lit(0))
        also = F.filter(every, lambda p: p != head)
        offsite = F.get(also, F.lit(0))
        pointer = F.coalesce((head == POINTING) & offsite.isNotNull() & points_offsite(html, offsite), F.lit(False))
        confidence = F.when(F.size(proved) > 0, "strong").when(F.size(named) > 0, "weak")
        return F.struct(F.when(pointer, offsite).otherwise(head).alias("platform"),
                        F.when(pointer, F.concat(F.array(head), F.slice(also, F.lit(2), F.greatest(F.size(also) - 1, F.lit(0))))).otherwise(also).alias("also"),
                        F.when(pointer, "pointer").otherwise(confidence).alias("confidence"))

    return let(identify_platforms(html), decided)


# Notice links and package files.
NOTICE_REF = (r"\b(ITB|IFB|RFP|RFQ|RFI|ITN|RPQ|ITQ|RLI)\s*(?:No\.?\s*)?[-–]?\s*"
              r"(\d{2,4}[-–]\d{2,4}(?:[-–]\d{1,4})?)")
NOTICE_NOT = r"\b(award|tabulation|intent to award|results|minutes|agenda|archive)\b"
NOTICE_HEAD = r"^[\s–:|-]*(?:(?:public\s+notice|notice|addendum|advertisement)[\s–:|-]*)+"
NOTICE_TAIL = r"(?:[\s–:|-]*\[?\s*(?:pdf|docx?|\d+(?:st|nd|rd|th)\s+revised|revised)\s*\]?)+[\s–:|-]*$"
DOCUMENT_LINK = r"(documentcenter|showdocument|\.pdf|\.docx?|\.xlsx?|\.zip)"
MAX_DOCUMENTS = 40


def peel(text: ColumnLike) -> Column:
    """A notice's text without wrappers such as `... Revised [PDF]`, however many are stacked."""
    inner = F.regexp_replace(F.regexp_replace(col(text), "(?i)" + NOTICE_HEAD, ""), "(?i)" + NOTICE_TAIL, "")
    return F.trim(inner, F.lit(" -–:|"))


def notice_links(pages: DataFrame) -> DataFrame:
    """Per page and reference, the longest-titled notice link; earliest on ties."""
    found = page_links(pages).filter(matches("text", NOTICE_REF) & ~matches("text", NOTICE_NOT))
    part = {i: F.regexp_extract("text", "(?is)^(.*?)" + NOTICE_REF + "(.*)$", i) for i in (1, 2, 3, 4)}
    tail, head = peel(part[4]), peel(part[1])
    title = F.substring(F.trim(F.regexp_replace(F.when(F.length(tail) >= 5, tail).otherwise(head), r"\s+", " ")), 1, 200)
    named = found.select("page_id", "position", F.concat(F.upper(part[2]), F.lit(" "), F.replace(part[3], F.lit("–"), F.lit("-"))).alias("ref"),
                         title.alias("title"), absolute("url", "href").alias("link")).filter(F.length("title") >= 5)
    return first_rows(named, ["page_id", "ref"], [F.length("title").desc(), F.col("position").asc()])


def page_documents(pages: DataFrame) -> DataFrame:
    """Package files of each page: kind from the name, one per address, forty at most."""
    files = page_links(pages).filter(matches("href", DOCUMENT_LINK) & (F.length("text") >= 3))
    lowered = F.lower("text")
    kind = (F.when(F.contains(lowered, F.lit("addend")), "addendum").when(matches(lowered, r"\b(plan|drawing|sketch)"), "drawing")
            .when(matches(lowered, r"\bspec"), "specification").otherwise("document"))
    shaped = files.select("page_id", "position", absolute("url", "href").alias("link"), F.substring("text", 1, 160).alias("name"), kind.alias("kind"))
    once = first_rows(shaped, ["page_id", "link"], [F.col("position").asc()])
    return first_rows(once, ["page_id"], [F.col("position").asc()], n=MAX_DOCUMENTS)


AWARDED_TO = r"awarded\s+to[:\s]+([^\n\r;]{3,120})"  # fixed value


def awarded_to(page_text: ColumnLike, document_text: ColumnLike) -> Column:
    """The winner named on the page, else in its award document."""
    found = F.coalesce(capture(page_text, AWARDED_TO), capture(document_text, AWARDED_TO))
    return F.rtrim(F.trim(found), F.lit("."))


ROW_DATE = r"^\d{1,2}/\d{1,2}/\d{4}$"  # fixed value


def content_cells(cells: ColumnLike, file_no: ColumnLike) -> Column:
    """struct(date, title) of a result row: the first date-like cell, and the longest other one."""
    cells = col(cells)
    dated = F.coalesce(F.get(F.filter(cells, lambda c: c.rlike(ROW_DATE)), F.lit(0)), F.lit(""))
    rest = F.filter(cells, lambda c: (c != "") & (c != col(file_no)) & (c != dated))
    ranked = F.transform(rest, lambda c, i: F.struct(F.length(c).alias("n"), (-i).alias("i"), c.alias("c")))
    return F.struct(dated.alias("date"), F.array_max(ranked)["c"].alias("title"))


# ---- pages that need a parser ----------------------------------------------

class _TableReader(HTMLParser):
    """Collects each table as rows of (is_header, text) cells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self._open: list[list[list[str]]] = []
        self._cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            table: list[list[str]] = []
            self.tables.append(table)
            self._open.append(table)
        elif tag == "tr" and self._open:
            self._open[-1].append([])
        elif tag in ("td", "th") and self._open and self._open[-1]:
            self._cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self._cell is not None and self._open and self._open[-1]:
            self._open[-1][-1].append(" ".join("".join(self._cell).split()))
            self._cell = None
        elif tag == "table" and self._open:
            self._open.pop()

    def handle_data(self, data):
        if self._cell is not None:
            self._cell.append(data)


def table_rows(pages: DataFrame, header_words: Sequence[str]) -> DataFrame:
    """(page_id, table_no, row_no, cells map) of tables whose header names one of the words."""
    words = [w.lower() for w in header_words]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, html in zip(batch["page_id"], batch["html"]):
                reader = _TableReader()
                reader.feed(html or "")
                for number, rows in enumerate(reader.tables):
                    header = [c.lower() for c in rows[0]] if rows else []
                    if not any(w in h for w in words for h in header):
                        continue
                    for place, cells in enumerate(rows[1:], start=1):
                        if any(cells):
                            out.append((page_id, number, place, dict(zip(header, cells))))
            yield pd.DataFrame(out, columns=["page_id", "table_no", "row_no", "cells"])

    return pages.select("page_id", "html").mapInPandas(read, "page_id long, table_no int, row_no int, cells map<string,string>")


class _LabelReader(HTMLParser):
    """Pairs short texts ending in a colon with the text that follows."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pairs: dict[str, str] = {}
        self._label: str | None = None
        self._skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self._skip += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self._skip:
            self._skip -= 1

    def handle_data(self, data):
        text = " ".join(data.split())
        if not text or self._skip:
            return
        if text.endswith(":") and len(text) <= 40:
            self._label = text.rstrip(":").strip().lower()
        elif self._label:
            self.pairs.setdefault(self._label, text)
            self._label = None


def label_values(pages: DataFrame) -> DataFrame:
    """(page_id, fields map) of `Label:` texts and the value after each."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, html in zip(batch["page_id"], batch["html"]):
                reader = _LabelReader()
                reader.feed(html or "")
                out.append((page_id, reader.pairs))
            yield pd.DataFrame(out, columns=["page_id", "fields"])

    return pages.select("page_id", "html").mapInPandas(read, "page_id long, fields map<string,string>")


def bid_tabs(rows: DataFrame) -> DataFrame:
    """Contracts with all bidders, the low bidder as winner.

    `rows` has contract_no, place, bidder and amount text, as read from result tables.
    """
    priced = rows.withColumn("amount", F.regexp_replace(F.regexp_extract("amount", r"\$?\s?([\d,]+(?:\.\d{1,2})?)", 1), ",", "").try_cast("double")) \
        .filter(F.col("amount").isNotNull() & (or_blank("bidder") != ""))
    return priced.groupBy("contract_no").agg(
        F.count(F.lit(1)).alias("bidders"), F.min_by("bidder", F.struct("amount", "place")).alias("low_bidder"),
        F.min("amount").alias("low_amount"), F.max("amount").alias("high_amount"))


def tabulation_facts(rows: DataFrame) -> DataFrame:
    """(sheet_id, vendor, amount): the first priced row under the header naming bidder and price.

    `rows` has sheet_id, row_no and cells (array of text).
    """
    upper = F.transform("cells", lambda c: F.upper(F.trim(or_blank(c))))

    def last_with(*words: str) -> Column:
        hit = F.transform(upper, lambda c, i: F.when(any_of([F.contains(c, F.lit(w)) for w in words]), i))
        return F.array_max(hit)

    headed = rows.select("sheet_id", "row_no", last_with("BIDDER", "VENDOR").alias("vendor_at"), last_with("PRICE", "TOTAL", "AMOUNT").alias("amount_at"))
    header = headed.filter(F.col("vendor_at").isNotNull()).groupBy("sheet_id").agg(F.min(F.struct("row_no", "vendor_at", "amount_at")).alias("h"))
    body = rows.join(header, "sheet_id").filter(F.col("row_no") > F.col("h.row_no"))
    vendor = F.trim(or_blank(F.get("cells", F.col("h.vendor_at"))))
    figure = F.regexp_replace(or_blank(F.get("cells", F.col("h.amount_at"))), r"[^\d.]", "").try_cast("double")
    found = body.withColumn("vendor", vendor).withColumn("amount", F.bround(figure).cast("long")) \
        .filter((F.col("vendor") != "") & F.col("amount").isNotNull())
    return found.groupBy("sheet_id").agg(F.min_by(F.struct("vendor", "amount"), "row_no").alias("f")).select("sheet_id", "f.vendor", "f.amount")
