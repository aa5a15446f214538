"""Result pages and result sheets: who bid what on which contract."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions import classify
from tenderloom.functions.base import ColumnLike, capture, captures, col, none_if_blank, or_blank

# The parts of a letting report, and how award documents name their firm and sums.
HEADER_ID, LABEL_CLASS, ROW_CLASS, NAME_CLASS, TOTAL_CLASS = "contractHeader", "ContractHeader", "textLeft", "vendorName", "bidTotal"
COLUMN_TITLE = "CONTRACTOR'S NAME"
BID_AMOUNT = re.compile(r"\$?\s?([\d,]+(?:\.\d{1,2})?)")
AWARD_FIRM = r"(?:intent\s+to\s+award|award(?:ed)?)\s+(?:\w+\s+){0,3}?to[:\s]+([A-Z][\w&.,'()\- ]{2,80}?)(?=[,;\n]|\s{2,}|$)"
ANY_AMOUNT = r"\$\s?([\d,]+(?:\.\d{2})?)"
DESCRIPTION_CHARS = 600
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class LettingReader(HTMLParser):
    """Contracts of a report in page order: their labels, and (bidder, amount text) of the rows up to the next contract."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.contracts: list[tuple[dict[str, str], list[tuple[str, str]]]] = []
        self._open: list[str] = []           # what each open element is to us
        self._text: dict[str, list[str]] = {}
        self._row: dict[str, str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        given = dict(attrs)
        classes = (given.get("class") or "").split()
        role = ""
        if tag == "div":
            if given.get("id") == HEADER_ID:
                self.contracts.append(({}, []))
            for name in (LABEL_CLASS, ROW_CLASS, NAME_CLASS, TOTAL_CLASS):
                if name in classes:
                    role = name
                    self._text[name] = []
            if role == ROW_CLASS:
                self._row = {}
            if role == LABEL_CLASS:
                self._text["label"] = []
        elif tag == "span" and LABEL_CLASS in self._open and not self._text["label"]:
            role = "label"
        self._open.append(role or tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not self._open:
            return
        role = self._open.pop()
        if role not in (LABEL_CLASS, ROW_CLASS, NAME_CLASS, TOTAL_CLASS) or not self.contracts:
            return
        text = " ".join(" ".join(self._text[role]).split())
        if role == LABEL_CLASS:
            label = " ".join(" ".join(self._text["label"]).split())
            if label:
                self.contracts[-1][0][label.rstrip(":").lower()] = text[len(label):].strip()
        elif role == ROW_CLASS:
            row, self._row = self._row or {}, None
            if NAME_CLASS in row and TOTAL_CLASS in row:
                self.contracts[-1][1].append((row[NAME_CLASS], row[TOTAL_CLASS]))
        elif self._row is not None:
            self._row.setdefault(role, text)

    def handle_data(self, data: str) -> None:
        for role in set(self._open):
            if role in self._text:
                self._text[role].append(data)


#: A tag that can be read in one way only, and elements whose text is no markup.
PLAIN_TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[A-Za-z][A-Za-z0-9-]*="[^"<>&]*")*)\s*(/?)>""", re.A)
PLAIN_ATTRIBUTE = re.compile(r"""([A-Za-z][A-Za-z0-9-]*)="([^"]*)\"""", re.A)
RAW = frozenset("script style textarea title iframe noembed noframes noscript plaintext svg math xmp".split())


def read_report(html: str) -> LettingReader:
    """The reader after a report. Where every `<` begins a plain tag the tags are found at once, which the standard parser
    does several times slower; any other page goes through that parser."""
    reader = LettingReader()
    tags = list(PLAIN_TAG.finditer(html))
    if len(tags) != html.count("<") or any(t.group(2).lower() in RAW or (t.group(1) and (t.group(3) or t.group(4))) for t in tags):
        reader.feed(html)
        return reader
    at = 0
    for tag in tags:
        if at < tag.start():
            reader.handle_data(unescape(html[at: tag.start()]))
        at = tag.end()
        name = tag.group(2).lower()
        if tag.group(1):
            reader.handle_endtag(name)
            continue
        reader.handle_starttag(name, [(k.lower(), v) for k, v in PLAIN_ATTRIBUTE.findall(tag.group(3))] if tag.group(3) else [])
        if tag.group(4):
            reader.handle_endtag(name)
    return reader


def letting_rows(html: str | None) -> Iterator[tuple]:
    """(contract_no, county, project, place, bidder, amount) of every priced bidder of a report."""
    for labels, rows in read_report(html or "").contracts:
        contract, place = labels.get("contract no") or "", 0
        for bidder, amount in rows:
            found = BID_AMOUNT.search(amount)
            digits = found.group(1).replace(",", "") if found else ""
            if not contract or not bidder or not digits or bidder.upper() == COLUMN_TITLE:
                continue
            place += 1
            yield contract, labels.get("county") or None, labels.get("fin prj no") or None, place, bidder, float(digits)


def letting_bids(pages: DataFrame) -> DataFrame:
    """Pages (with html) and, for each, the priced bidders of its contracts in page order.

    A page is read into one list and its html left behind before the list is laid out, so no bidder carries the page.
    """
    as_list = F.udf(lambda html: list(letting_rows(html)), "array<struct<contract_no:string,county:string,project:string,place:int,bidder:string,amount:double>>", useArrow=True)
    read = pages.withColumn("__bids", as_list("html")).drop("html")
    return read.select(*[c for c in read.columns if c != "__bids"], F.inline("__bids"))


def letting_awards(pages: DataFrame) -> DataFrame:
    """Award rows of letting reports (source_id, district, letting_date, url, html): the first bidder listed is the apparent low one."""
    bids = letting_bids(pages)
    line = F.concat("bidder", F.lit(" — $"), F.format_number("amount", 2))
    key = ["source_id", "district", "letting_date", "url", "contract_no"]
    each = bids.groupBy(*key).agg(
        F.count(F.lit(1)).alias("bidders"), F.min_by("bidder", "place").alias("awarded_vendor"), F.bround(F.min_by("amount", "place")).cast("long").alias("award_amount"),
        F.first("county", ignorenulls=True).alias("county_name"), F.first("project", ignorenulls=True).alias("linked_ref"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    title = F.concat(F.lit("FDOT letting "), F.date_format("letting_date", "MM/dd/yyyy"), F.lit(": contract "), "contract_no",
                     F.when(F.col("county_name").isNotNull(), F.concat(F.lit(" — "), F.initcap("county_name"), F.lit(" County"))).otherwise(""))
    told = F.concat(F.lit("Preliminary letting results (apparent low bid first; official Intent to Award posts on FDOT Contracts Administration). "),
                    F.col("bidders").cast("string"), F.lit(" bid(s): "), F.array_join("lines", " · "))
    department = F.when(F.col("district") == "99", "FDOT Central Office / Turnpike").otherwise(F.concat(F.lit("FDOT District "), "district"))
    shaped = each.select("source_id", title.alias("title"), "url", F.col("contract_no").alias("external_id"), department.alias("department"), "county_name", F.lit("award").alias("status"),
                         F.col("letting_date").alias("award_date"), F.col("letting_date").alias("posted_date"), "awarded_vendor", "award_amount", "linked_ref",
                         F.when(F.col("linked_ref").isNotNull(), "ref").alias("award_linkage"), F.substring(told, 1, DESCRIPTION_CHARS).alias("description"), "bidders", F.lit("").alias("about"))
    return classify.enrich(shaped, description="about").drop("about")


def text_award_facts(text: ColumnLike) -> Column:
    """struct(vendor, amount) of an award document's text: the firm it awards to, and the largest sum it names."""
    text = or_blank(col(text))
    firm = F.trim(F.regexp_replace(capture(text, AWARD_FIRM), r"\s+", " "), F.lit(" ,."))
    sums = F.transform(captures(text, ANY_AMOUNT, 1), lambda m: F.replace(m, F.lit(","), F.lit("")).try_cast("double"))
    return F.struct(none_if_blank(firm).alias("vendor"), F.bround(F.array_max(sums)).cast("long").alias("amount"))
