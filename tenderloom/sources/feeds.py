"""Whole feeds, payload in and opportunity rows out, for payloads without one fixed shape.

A payload is read as VARIANT: lists may stand at the top, at a path, or under
whatever name a portal gives them this year, and objects may be keyed by id. A
field is taken as text wherever it is there, whatever its JSON type. Payload
rows carry source_id, ordinal and payload; a payload that is no JSON gives no
rows. Every feed ends in the shared enrichment, so its rows have
solicitation_type, offer_type, categories and keywords.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.functions import classify, dates
from tenderloom.functions.base import filled, first_filled, none_if_blank, or_blank
from tenderloom.operators import ranking
from tenderloom.sources import payloads as p
from tenderloom.sources.pages import html_to_text

NO_TEXTS = "array<string>"
_ROWS = "array<struct<{}, is_vendor: boolean, place: int>>"


# ---- VARIANT helpers --------------------------------------------------------

def _list(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def listed(payloads: DataFrame, path: str | None = None) -> DataFrame:
    """source_id, ordinal, place and r (VARIANT) of each object in a payload's list: the one at `path`, or the payload
    itself, or the first list among its values."""
    parsed = payloads.select("source_id", "ordinal", "payload", F.try_parse_json("payload").alias("v"))
    if path:
        rows = _list(F.col("v"), path)
    else:
        fields = F.try_variant_get("v", "$", "map<string,variant>")
        # the object's names in the order the payload has them
        inside = F.filter(F.transform(F.json_object_keys("payload"), lambda k: _list(fields[k])), lambda x: x.isNotNull())
        rows = F.coalesce(_list(F.col("v")), F.get(inside, F.lit(0)))
    each = parsed.select("source_id", "ordinal", F.posexplode(rows).alias("place", "r"))
    return each.filter(F.try_variant_get("r", "$", "map<string,variant>").isNotNull())


def _values(v: Column, path: str) -> Column:
    """The values of an object keyed by id, or of a list, at `path`."""
    return F.coalesce(F.map_values(F.try_variant_get(v, path, "map<string,variant>")), _list(v, path))


def keyed(payloads: DataFrame, path: str) -> DataFrame:
    """source_id, ordinal, place and r of the values of an object keyed by id, or of a list, at `path`."""
    values = _values(F.try_parse_json("payload"), path)
    # a value of a VARIANT keeps the names of the whole payload, here every id; written and read again it has its own alone
    own = F.transform(values, lambda x: F.try_parse_json(F.to_json(x)))
    each = payloads.select("source_id", "ordinal", F.posexplode(own).alias("place", "r"))
    return each.filter(F.try_variant_get("r", "$", "map<string,variant>").isNotNull())


def said(name: str, r: str = "r") -> Column:
    """A field as trimmed text, blank where it is missing or null."""
    return F.trim(or_blank(F.try_variant_get(r, f"$.{name}", "string")))


def texts(name: str, r: str = "r") -> Column:
    """A list field's non-blank texts."""
    each = F.transform(F.coalesce(F.try_variant_get(r, f"$.{name}", "array<string>"), F.array().cast(NO_TEXTS)), lambda x: F.trim(or_blank(x)))
    return F.filter(each, lambda x: x != "")


def truth(name: str, r: str = "r") -> Column:
    """A yes-or-no field in any spelling; null where it is missing or blank."""
    return _truth(said(name, r))


def _truth(said: Column) -> Column:
    return F.when(said != "", F.lower(said).isin("1", "true", "yes"))


def _finished(rows: DataFrame, taxonomy: Sequence[classify.Category], more_keywords: str | None = None, about: str = "about") -> DataFrame:
    """Classified rows; `about` is the text read beside the title, and goes."""
    out = classify.enrich(rows, taxonomy, description=about).drop(about)
    return out.withColumn("keywords", F.array_distinct(F.concat("keywords", more_keywords))).drop(more_keywords) if more_keywords else out



# ---- sourcing events ---------------------------------------------------------

def _events(payloads: DataFrame) -> DataFrame:
    return listed(payloads, "$.data.events.nodes").withColumn("reason", p.skip_reason(said("requestType"), truth("restricted")))


def sourcing_skips(payloads: DataFrame) -> DataFrame:
    """How many titled events were left out, by reason."""
    skipped = _events(payloads).filter((said("title") != "") & F.col("reason").isNotNull())
    return skipped.groupBy("source_id", "reason").agg(F.count(F.lit(1)).alias("events"))


def sourcing_events(payloads: DataFrame, portal_url: str, taxonomy: Sequence[classify.Category] = classify.STARTER) -> DataFrame:
    """Events for everyone to bid on; tests and invitations are left out (`sourcing_skips` counts them)."""
    rows = _events(payloads).filter((said("title") != "") & F.col("reason").isNull())
    codes = texts("commodityCodes")
    shaped = rows.select(
        "source_id", "ordinal", "place", said("title").alias("title"), first_filled(said("projectId"), said("id")).alias("external_id"),
        F.coalesce(none_if_blank(said("bidUrl")), F.lit(portal_url)).alias("url"), none_if_blank(said("description")).alias("description"),
        codes.alias("commodity_codes"), none_if_blank(F.array_join(codes, "; ")).alias("raw_category"), dates.parse_day(said("publishedAt")).alias("posted_date"),
        dates.parse_timestamp(said("bidSubmissionDeadline")).alias("due_date"), p.event_status(said("state")).alias("status"), F.lit("").alias("about"))
    return _finished(shaped.withColumn("codes", F.col("commodity_codes")), taxonomy, "codes")


# ---- executed contracts ---------------------------------------------------------

#: What is read of a contract and of a vendor: their column, and their field's name in the payload.
CONTRACT_FIELDS = {"contract_id": "ContractID", "name": "Name", "vendor_id": "VendorID", "status_id": "ContractStatusID", "start": "StartDate", "end": "EndDate", "extendable": "IsExtendable"}
VENDOR_FIELDS = {"vendor_id": "VendorID", "vendor": "VendorContactOrganizationName"}


def portal_contracts(payloads: DataFrame, agency: str, portal_url: str) -> DataFrame:
    """Contracts from an object keyed by id, with their vendor's name from the payload's own vendor list.

    A payload is parsed once. Contracts and vendors leave it in one list of rows and meet in a window: there is no join,
    and where the payloads are dealt by their ordinal nothing is shuffled.
    """
    columns = [*CONTRACT_FIELDS, "vendor"]

    def read(path: str, fields: dict[str, str]) -> Column:
        # the fields are taken where the value stands: by itself it would carry the names of the whole payload
        return F.transform(_values(F.col("v"), path), lambda x, place: F.struct(
            *[(F.try_variant_get(x, f"$.{fields[c]}", "string") if c in fields else F.lit(None).cast("string")).alias(c) for c in columns], F.lit(path == "$.vendors").alias("is_vendor"), place.alias("place")))

    # a payload without source or ordinal shares them with no other
    alone = F.when(F.col("source_id").isNull() | F.col("ordinal").isNull(), F.monotonically_increasing_id())
    parsed = payloads.select("source_id", "ordinal", alone.alias("alone"), F.try_parse_json("payload").alias("v"))
    lists = [F.coalesce(read(*x), F.array().cast(_ROWS.format(", ".join(f"{c}: string" for c in columns)))) for x in (("$.publicContracts", CONTRACT_FIELDS), ("$.vendors", VENDOR_FIELDS))]
    found = parsed.select("source_id", "ordinal", "alone", F.inline(F.concat(*lists)))
    rows = found.select("source_id", "ordinal", "alone", "is_vendor", "place", *[F.trim(or_blank(c)).alias(c) for c in columns])
    told = F.when(F.col("is_vendor"), (F.col("vendor_id") != "") & (F.col("vendor") != "")).otherwise((F.col("contract_id") != "") & (F.col("name") != ""))
    same = Window.partitionBy("source_id", "ordinal", "alone", "vendor_id")
    named = rows.filter(told).withColumn("vendor", F.max_by("vendor", F.when(F.col("is_vendor"), F.col("place"))).over(same)).filter(~F.col("is_vendor"))
    return named.select(
        "contract_id", F.lit(agency).alias("agency"), "name", "source_id", F.when(F.col("alone").isNull(), F.col("vendor")).alias("vendor"),
        none_if_blank("vendor_id").alias("vendor_id"), none_if_blank("status_id").alias("status_id"), dates.parse_day("start").alias("start_date"),
        dates.parse_day("end").alias("end_date"), F.lit(portal_url).alias("url"), _truth(F.col("extendable")).alias("extendable"))


# ---- road-work advertisements -----------------------------------------------------

def road_advertisements(payloads: DataFrame, page_url: str, taxonomy: Sequence[classify.Category] = classify.STARTER) -> DataFrame:
    """Advertisements of a road department: display text inside JSON is read as a person would, districts name their counties."""
    def shown(name: str) -> Column:
        return html_to_text(said(name))

    rows = listed(payloads, "$.Model.AdList").select(
        "source_id", "ordinal", "place", shown("AdShortDescription").alias("heading"), none_if_blank(shown("AdNumber")).alias("external_id"),
        shown("DotAssignedDistrictCode").alias("district"), shown("AdStatusTypeName").alias("state"), shown("MajorWorkTypesText").alias("major"),
        F.replace(shown("MinorWorkTypesText"), F.lit("<br/>"), F.lit(" | ")).alias("minor"), shown("ProjectThresholdTypeName").alias("prequalified"),
        shown("BDI").alias("set_aside"), shown("SelectionMethodText").alias("selection"), dates.parse_day(shown("LastDateAdvertised")).alias("posted_date"),
        dates.parse_timestamp(shown("ResponseDeadlineDateTime")).alias("due_date"), p.display_amount(said("AdContractAmount")).alias("budget"))
    rows = rows.filter((F.col("heading") != "") | F.col("external_id").isNotNull())
    work = F.concat_ws(" | ", none_if_blank("major"), none_if_blank("minor"))
    asked = F.array_compact(F.array(F.concat(F.lit("FDOT prequalification: "), none_if_blank("prequalified")),
                                    F.when(F.lower("set_aside") == "yes", "Business Development Initiative set-aside"),
                                    F.concat(F.lit("Selection method: "), none_if_blank("selection"))))
    titled = F.coalesce(none_if_blank("heading"), F.concat(F.lit("FDOT advertisement "), F.col("external_id")))
    shaped = rows.select(
        "source_id", "ordinal", "place", titled.alias("title"), "external_id", F.lit(page_url).alias("url"), p.district_label("district").alias("department"),
        F.when(work != "", F.transform(F.split(work, r"\|"), lambda w: F.trim(w))).otherwise(F.array().cast(NO_TEXTS)).alias("commodity_codes"),
        none_if_blank(work).alias("raw_category"), asked.alias("requirements"), "posted_date", "due_date", "budget",
        F.coalesce(p.lookup_map(p.ROAD_STATUS, F.lower("state")), F.lit("closed")).alias("status"), p.district_counties("district").alias("counties"), F.lit("").alias("about"))
    return _finished(shaped, taxonomy, "counties")


# ---- county lists ------------------------------------------------------------------

def current_list(payloads: DataFrame, portal_url: str, detail_url: str, taxonomy: Sequence[classify.Category] = classify.STARTER) -> DataFrame:
    """Open solicitations of a county's list; a date filed as a title gives way to the number."""
    number = said("solicitationNumber")
    rows = listed(payloads).select("source_id", "ordinal", "place", p.usable_title(said("title"), number).alias("title"), none_if_blank(number).alias("external_id"),
                                   none_if_blank(said("solicitationType")).alias("description"), dates.parse_timestamp(said("openingDate")).alias("due_date"),
                                   dates.parse_day(said("postedDate")).alias("posted_date"))
    link = F.concat(F.lit(f"{detail_url}?solNumber="), F.replace(F.url_encode("external_id"), F.lit("+"), F.lit("%20")))
    shaped = rows.filter(filled("title")).withColumns({"url": F.coalesce(link, F.lit(portal_url)), "status": F.lit("open"), "about": or_blank("description")})
    return _finished(shaped, taxonomy)


def future_list(payloads: DataFrame, portal_url: str, taxonomy: Sequence[classify.Category] = classify.STARTER) -> DataFrame:
    """Advance notices: no number and no bid date yet, so the posting counter is the key."""
    rows = listed(payloads).select("source_id", "ordinal", "place", F.trim(F.rtrim(said("documentTitle"), F.lit(". "))).alias("title"), F.lit(None).cast("string").alias("external_id"),
                                   dates.parse_day(said("releaseDate")).alias("posted_date"), dates.parse_day(said("removalDate")).alias("removed"),
                                   none_if_blank(F.concat_ws(" — ", none_if_blank(said("sendFeedBack")), none_if_blank(said("emailAddress")))).alias("contact"),
                                   F.try_variant_get("r", "$.webPostingCounter", "long").alias("counter"), F.lit("").alias("about"))
    until = F.coalesce(F.concat(F.lit("; posted through "), F.col("removed").cast("string")), F.lit(""))
    shaped = rows.filter(filled("title")).withColumns({"url": F.lit(portal_url), "status": F.lit("upcoming"),
                                                       "description": F.concat(F.lit("Advance notice of an upcoming solicitation"), until)}).drop("removed")
    found = _finished(shaped, taxonomy)
    return found.withColumn("external_id", p.posting_id("external_id", "counter")).drop("counter")


def recommendation_list(payloads: DataFrame, page_url: str, host: str, taxonomy: Sequence[classify.Category] = classify.STARTER) -> DataFrame:
    """Award recommendations: the document names the vendor, the row only the purchase."""
    link = first_filled(said("url"), said("pdfUrl"))
    rows = listed(payloads).select("source_id", "ordinal", "place", first_filled(said("title"), said("documentTitle")).alias("full"), F.lit(None).cast("string").alias("external_id"),
                                   dates.parse_day(first_filled(said("datePosted"), said("postedDate"), said("releaseDate"))).alias("posted_date"),
                                   F.when(link.startswith("/"), F.concat(F.lit(host), link)).otherwise(link).alias("link"))
    rows = rows.filter(filled("full"))
    files = F.when(filled("link"), F.array(p.document(F.substring("full", 1, 160), F.col("link")))).otherwise(F.array().cast("array<struct<name:string,url:string,kind:string>>"))
    shaped = rows.withColumns({"title": F.col("full"), "url": F.lit(page_url), "status": F.lit("award"), "award_date": F.col("posted_date"), "documents": files, "about": F.lit("")}).drop("full", "link")
    return _finished(shaped, taxonomy).withColumn("title", F.substring("title", 1, 200))


# ---- decisions of boards --------------------------------------------------------------

def _decisions(rows: DataFrame, taxonomy: Sequence[classify.Category]) -> DataFrame:
    """Award rows from titles that speak of an award: source_id, matter_title, external_id, url, decided."""
    title = F.col("matter_title")
    told = rows.filter(p.is_award_title("matter_title")).withColumns({
        "title": F.substring(title, 1, 160), "about": title, "number": F.col("external_id"), "awarded_vendor": p.title_vendor("matter_title"),
        "award_amount": p.title_amount("matter_title"), "linked_ref": p.title_reference("matter_title"), "posted_date": F.col("decided"), "award_date": F.col("decided"),
        "status": F.lit("award"), "description": F.substring(title, 1, 600)})
    # the number of the matter is no reference of a solicitation: the title alone is read for its type
    out = classify.enrich(told.withColumn("external_id", F.lit("")), taxonomy, description="about")
    return (out.withColumns({"external_id": F.col("number"), "title": F.substring(title, 1, 200), "award_linkage": F.when(F.col("linked_ref").isNotNull(), "ref")})
            .drop("about", "number", "matter_title", "decided"))


def award_matters(payloads: DataFrame, portal_url: str, taxonomy: Sequence[classify.Category] = classify.STARTER) -> DataFrame:
    """Award matters of a council's agendas; the day it passed comes before the day it was listed."""
    matter = said("MatterId")
    rows = listed(payloads).select(
        "source_id", "ordinal", "place", said("MatterTitle").alias("matter_title"), first_filled(said("MatterFile"), F.when(matter != "0", matter)).alias("external_id"),
        F.coalesce(dates.parse_day(said("MatterPassedDate")), dates.parse_day(said("MatterAgendaDate"))).alias("decided"), F.lit(portal_url).alias("url"))
    return _decisions(rows, taxonomy)


def board_actions(rows: DataFrame, as_of: str, matter_url: str, lookback_days: int = 365, cap: int = 100,
                  taxonomy: Sequence[classify.Category] = classify.STARTER) -> DataFrame:
    """Award actions of a board's record: rows newest first (source_id, place, matter, file_number, date, title), read
    until the first one before the lookback, `cap` award rows of a source at most. An amount of 0 is none."""
    known = rows.withColumns({"decided": dates.parse_day("date"), "matter_title": or_blank("title")})
    before = F.coalesce(F.col("decided") < F.date_sub(F.lit(as_of).cast("date"), lookback_days), F.lit(False))
    limits = known.filter(before).groupBy("source_id").agg(F.min("place").alias("stop"))
    recent = known.join(limits, "source_id", "left").filter(F.col("stop").isNull() | (F.col("place") < F.col("stop"))).drop("stop")
    few = ranking.scan_until(recent.filter(p.is_award_title("matter_title")), [F.col("place")], F.lit(False), cap, "source_id")
    shaped = few.select("source_id", "place", "matter_title", F.coalesce(none_if_blank("file_number"), "matter").alias("external_id"), "decided",
                        F.replace(F.lit(matter_url), F.lit("{}"), F.col("matter")).alias("url"))
    return _decisions(shaped, taxonomy).withColumn("award_amount", F.nullif("award_amount", F.lit(0).cast("long")))
