"""Feed payloads to opportunity and contract rows, one function per payload shape.

Each takes a DataFrame of raw JSON payloads (or rows already split from them)
and gives opportunity columns; classification is added afterwards by
`tenderloom.functions.classify`, once for all feeds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions import calendar, dates, text
from tenderloom.functions.base import (ColumnLike, capture, col, filled, first_filled, first_rows, lookup_map,
                                       matches, none_if_blank, or_blank)
from tenderloom.sources.pages import html_to_text, rich_text

PAYLOAD_OPTIONS = {"mode": "PERMISSIVE"}


def exploded_rows(payloads: DataFrame, schema: str, field: str) -> DataFrame:
    """Rows of one array inside each JSON payload, with their place as page_ordinal and row_pos."""
    parsed = payloads.withColumn("p", F.from_json("payload", schema, PAYLOAD_OPTIONS))
    return parsed.select("source_id", F.col("ordinal").alias("page_ordinal"),
                         F.posexplode(f"p.{field}").alias("row_pos", "r"))


def exploded_map(payloads: DataFrame, schema: str, field: str, *others: str) -> DataFrame:
    """Values of one object-keyed-by-id inside each payload, as rows."""
    parsed = payloads.withColumn("p", F.from_json("payload", schema, PAYLOAD_OPTIONS))
    return parsed.select("source_id", F.col("ordinal").alias("page_ordinal"), *[F.col(f"p.{o}").alias(o) for o in others],
                         F.explode(f"p.{field}").alias("key", "r"))


def vendor_index(vendors: DataFrame) -> DataFrame:
    """vendor_id -> vendor; rows without an id or a name are not indexed."""
    vid, name = F.trim(F.col("VendorID").cast("string")), F.trim("VendorContactOrganizationName")
    return vendors.select(vid.alias("vendor_id"), name.alias("vendor")) \
        .filter((F.col("vendor_id") != "") & (F.col("vendor") != ""))


def distinct_documents(documents: ColumnLike) -> Column:
    """Documents in order, the first of every address (ignoring anything after `?`)."""
    documents = col(documents)

    def address(d: Column) -> Column:
        return F.substring_index(d["url"], "?", 1)

    urls = F.transform(documents, address)
    return F.filter(documents, lambda d, i: F.array_position(urls, address(d)) == i + 1)


def document(name: Column, url: Column, kind: str = "document") -> Column:
    return F.struct(name.alias("name"), url.alias("url"), F.lit(kind).alias("kind"))


# ---- project lists with an open/ended split --------------------------------

PROJECT_ROWS = """count long, rows array<struct<id:long,title:string,status:string,financialId:string,summary:string,
    closeOutReason:string,closedSubstatus:string,closedAt:string,solicitationClosedDate:string,
    releaseProjectDate:string,proposalDeadline:string,department:struct<name:string>>>"""
AWARD_WORDS = ("award",)                                            # fixed values
CANCEL_WORDS = ("cancel", "re-solicit", "resolicit", "rejected")    # fixed values


def _says(text_: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text_, F.lit(w))
    return out


def ended_status(reason: ColumnLike, substatus: ColumnLike, decided: ColumnLike) -> Column:
    """struct(status, award_date) of a project that is no longer open."""
    reason, sub = F.lower(or_blank(reason)), F.lower(or_blank(substatus))
    awarded = _says(reason, AWARD_WORDS)
    cancelled = sub.isin("canceled", "cancelled") | _says(reason, CANCEL_WORDS)
    return F.struct(
        F.when(awarded, "award").when(cancelled, "cancelled").otherwise("closed").alias("status"),
        F.when(awarded, dates.parse_day(decided)).alias("award_date"))


def normalise_projects(payloads: DataFrame, open_statuses: Sequence[str] = ("open",)) -> DataFrame:
    """Paged project lists: the last copy of an id wins, open and ended projects get their status."""
    rows = exploded_rows(payloads, PROJECT_ROWS, "rows").filter("r.id IS NOT NULL")
    newest = first_rows(rows, ["source_id", "r.id"], [F.col("page_ordinal").desc(), F.col("row_pos").desc()])
    ended = ended_status("r.closeOutReason", "r.closedSubstatus", first_filled("r.closedAt", "r.solicitationClosedDate"))
    is_open = F.trim(or_blank("r.status")).isin(*open_statuses)
    ref, title = none_if_blank(F.trim("r.financialId")), F.trim("r.title")
    return newest.filter(filled(title)).select(
        "source_id", F.col("r.id").alias("project_id"), title.alias("title"),
        F.coalesce(ref, text.external_id(title)).alias("external_id"),
        none_if_blank(F.trim("r.department.name")).alias("department"),
        dates.parse_day("r.releaseProjectDate").alias("posted_date"),
        dates.parse_timestamp("r.proposalDeadline").alias("due_date"),
        F.when(is_open, F.lit("open")).otherwise(ended["status"]).alias("status"),
        F.when(~is_open, ended["award_date"]).alias("award_date"),
        none_if_blank(F.substring(rich_text("r.summary"), 1, 600)).alias("description"))


PROJECT_DETAIL = """project_id long, summary string, description string, contactFullName string, contactTitle string,
    procurementContactFullName string, procurementContactTitle string, contact string, contactEmail string,
    procurementContactEmail string, qaDeadline string, questionDeadline string, preProposalDate string,
    preProposalText string, preProposalLocation string, categories array<struct<code:string,title:string>>,
    upfrontQuestions array<struct<title:string,value:string>>,
    documentAttachment struct<url:string,filename:string>,
    attachments array<struct<url:string,filename:string,name:string,title:string>>,
    proposalDocuments array<struct<url:string,filename:string,name:string,title:string>>,
    addendums array<struct<titleDisplay:string,title:string,attachments:array<struct<url:string,filename:string>>>>"""
DEFAULT_DOCUMENT = "Bid package"  # fixed value


def project_documents(p: str) -> Column:
    """Files from the compiled packet, the attachments and the proposal documents, once per address."""
    def packet(a: Column) -> Column:
        return document(F.coalesce(none_if_blank(F.trim(a["filename"])), F.lit(DEFAULT_DOCUMENT)), a["url"])

    def listed(a: Column) -> Column:
        name = first_filled(F.trim(a["filename"]), F.trim(a["name"]), F.trim(a["title"]))
        return document(F.coalesce(name, F.lit(DEFAULT_DOCUMENT)), a["url"])

    none = F.array().cast("array<struct<name:string,url:string,kind:string>>")
    both = F.concat(
        F.when(F.col(f"{p}.documentAttachment").isNotNull(), F.array(packet(F.col(f"{p}.documentAttachment")))).otherwise(none),
        F.coalesce(F.transform(f"{p}.attachments", listed), none),
        F.coalesce(F.transform(f"{p}.proposalDocuments", listed), none))
    return distinct_documents(F.filter(both, lambda d: F.coalesce(d["url"].startswith("http"), F.lit(False))))


def _named(name: Column, title: Column) -> Column:
    name, title = none_if_blank(F.trim(name)), none_if_blank(F.trim(title))
    return F.when(name.isNotNull(), F.concat_ws(" — ", name, title))


def normalise_project_details(payloads: DataFrame) -> DataFrame:
    """Second payload per project: scope, contacts, deadlines, codes, cost and files."""
    p = payloads.select("source_id", F.from_json("payload", PROJECT_DETAIL, PAYLOAD_OPTIONS).alias("p"))
    cost = F.filter("p.upfrontQuestions", lambda q: matches(q["title"], "cost|budget|value"))
    estimates = F.filter(F.transform(cost, lambda q: text.estimated_value(q["value"])), lambda v: v.isNotNull())
    met = F.coalesce(dates.parse_timestamp("p.preProposalDate").cast("string"), F.col("p.preProposalDate"))
    codes = F.filter("p.categories", lambda c: filled(c["code"]))
    return p.select(
        "source_id", F.col("p.project_id").alias("project_id"),
        first_filled(rich_text("p.summary"), rich_text("p.description")).alias("scope"),
        F.coalesce(_named(F.col("p.contactFullName"), F.col("p.contactTitle")),
                   _named(F.col("p.procurementContactFullName"), F.col("p.procurementContactTitle")),
                   none_if_blank(F.trim("p.contact"))).alias("contact"),
        first_filled(F.trim("p.contactEmail"), F.trim("p.procurementContactEmail")).alias("contact_email"),
        dates.parse_timestamp(first_filled("p.qaDeadline", "p.questionDeadline")).alias("questions_due"),
        F.when(filled("p.preProposalDate"), F.concat_ws(" · ", met, none_if_blank(F.trim("p.preProposalText")),
                                                        none_if_blank(F.trim("p.preProposalLocation")))).alias("pre_bid_meeting"),
        F.transform(codes, lambda c: F.trim(F.concat(F.lit("NIGP "), c["code"], F.lit(" "), or_blank(c["title"])))).alias("commodity_codes"),
        F.get(estimates, F.lit(0)).alias("budget"),
        project_documents("p").alias("documents"))


# ---- federal notices -------------------------------------------------------

NOTICES = """totalRecords long, opportunitiesData array<struct<noticeId:string,title:string,solicitationNumber:string,
    fullParentPathName:string,postedDate:string,type:string,active:string,responseDeadLine:string,naicsCode:string,
    classificationCode:string,typeOfSetAsideDescription:string,uiLink:string,description:string,
    placeOfPerformance:struct<city:struct<code:string,name:string>>,resourceLinks:array<string>,
    pointOfContact:array<struct<email:string,fullName:string,phone:string>>,
    award:struct<amount:string,date:string,awardee:struct<name:string>>>>"""


def _first_with(contacts: Column, field: str) -> Column:
    return F.get(F.filter(F.transform(contacts, lambda c: c[field]), filled), F.lit(0))


def dollars(value: ColumnLike) -> Column:
    plain = F.regexp_replace(col(value), "[,$]", "")
    return F.bround(none_if_blank(F.trim(plain)).try_cast("double")).cast("long")


def normalise_notices(payloads: DataFrame, status: str = "open") -> DataFrame:
    """Notices: leaf office, codes, first contact with each field, numbered attachments, award facts."""
    rows = exploded_rows(payloads, NOTICES, "opportunitiesData").filter(filled(F.trim("r.title")))
    if status == "open":
        rows = rows.filter(~F.coalesce(F.lower("r.active") == "no", F.lit(False)))
    award = F.lit(status == "award")
    office = none_if_blank(F.initcap(F.trim(F.element_at(F.split(or_blank("r.fullParentPathName"), r"\."), -1))))
    city = none_if_blank(F.initcap("r.placeOfPerformance.city.name"))
    set_aside = none_if_blank("r.typeOfSetAsideDescription")
    meta = F.concat_ws(" · ", F.concat(F.lit("Federal "), F.coalesce(none_if_blank("r.type"), F.lit("solicitation"))), office,
                       F.concat(F.lit("Place of performance: "), F.when(city.isNotNull(), F.concat(city, F.lit(", "))).otherwise(F.lit("")), F.lit("FL")),
                       F.concat(F.lit("Set-aside: "), set_aside))
    own_text = F.when(filled("r.description") & ~F.col("r.description").startswith("http"), F.col("r.description"))
    links = F.transform("r.resourceLinks", lambda u, i: document(F.concat(F.lit("Attachment "), (i + 1).cast("string")), u))
    codes = F.array_compact(F.array(F.concat(F.lit("NAICS "), none_if_blank("r.naicsCode")),
                                    F.concat(F.lit("PSC "), none_if_blank("r.classificationCode"))))
    return rows.select(
        "source_id", F.col("r.noticeId").alias("notice_id"), F.trim("r.title").alias("title"), office.alias("department"),
        F.coalesce(none_if_blank("r.solicitationNumber"), text.external_id("r.title")).alias("external_id"),
        dates.parse_day("r.postedDate").alias("posted_date"), dates.parse_timestamp("r.responseDeadLine").alias("due_date"),
        F.lit(status).alias("status"), F.coalesce(own_text, meta).alias("description"),
        _first_with(F.col("r.pointOfContact"), "fullName").alias("contact"),
        _first_with(F.col("r.pointOfContact"), "email").alias("contact_email"),
        _first_with(F.col("r.pointOfContact"), "phone").alias("contact_phone"),
        codes.alias("commodity_codes"), set_aside.alias("raw_category"),
        F.filter(links, lambda d: d["url"].startswith("http")).alias("documents"),
        F.when(award, none_if_blank(F.trim("r.award.awardee.name"))).alias("awarded_vendor"),
        F.when(award, dollars("r.award.amount")).alias("award_amount"),
        F.when(award, dates.parse_day("r.award.date")).alias("award_date"),
        F.when(award, none_if_blank("r.solicitationNumber")).alias("linked_ref"),
        F.concat(city, F.lit(", FL")).alias("project_location"))


# ---- state advertisements --------------------------------------------------

# Advertisement type codes.
AD_TYPES = {"2": "OTHER", "4": "ITB", "5": "ITN", "6": "RFP", "8": "RFI", "9": "RFQ", "10": "OTHER"}
AWARD_TYPES = ("1",)
ADS = """array<struct<advertisementId:long,title:string,agency:string,typeId:string,type:string,status:string,
    agencyAdNumber:string,uniqueName:string,publishDate:string,closeDate:string,
    organization:struct<name:string,shortName:string>>>"""


def normalise_advertisements(payloads: DataFrame) -> DataFrame:
    """Advertisements: stated type over inferred, decisions become awards with a protest clock."""
    rows = payloads.select("source_id", F.explode(F.from_json("payload", ADS, PAYLOAD_OPTIONS)).alias("r")) \
        .filter(filled(F.trim("r.title")))
    ref = none_if_blank(F.trim(first_filled("r.agencyAdNumber", "r.uniqueName")))
    is_award = F.col("r.typeId").isin(*AWARD_TYPES)
    shaped = rows.select(
        "source_id", F.col("r.advertisementId").alias("ad_id"), F.trim("r.title").alias("title"),
        F.coalesce(first_filled("r.agency", "r.organization.name", "r.organization.shortName"), F.lit("State of Florida")).alias("agency"),
        F.coalesce(ref, text.external_id("r.title")).alias("external_id"),
        F.coalesce(lookup_map(AD_TYPES, F.col("r.typeId")), text.solicitation_type("r.title")).alias("solicitation_type"),
        dates.parse_timestamp("r.publishDate").alias("published"), dates.parse_timestamp("r.closeDate").alias("due_date"),
        F.when(is_award, "award").when(F.upper("r.status") == "OPEN", "open").otherwise("closed").alias("status"))
    clocked = calendar.protest_deadline(shaped, "published", "deadline")
    return clocked.withColumn("protest_deadline", F.when(F.col("status") == "award", F.col("deadline"))) \
        .withColumn("posted_date", F.col("published").cast("date")).drop("deadline", "published")


# ---- sourcing events -------------------------------------------------------

EVENT_STATUS = {"published": "open", "closed": "closed", "awarded": "award", "cancelled": "cancelled",
                "canceled": "cancelled"}  # fixed values
TEST_TYPES = ("TEST",)                    # fixed values


def skip_reason(request_type: ColumnLike, restricted: ColumnLike) -> Column:
    """Why an event is not a public bid, or null."""
    return (F.when(F.upper(F.trim(or_blank(request_type))).isin(*TEST_TYPES), "test event")
            .when(F.coalesce(col(restricted), F.lit(False)), "invitation-only event"))


def event_status(state: ColumnLike) -> Column:
    return F.coalesce(lookup_map(EVENT_STATUS, F.lower(F.trim(or_blank(state)))), F.lit("closed"))


def with_codes(keywords: ColumnLike, codes: ColumnLike) -> Column:
    """Keywords followed by the non-blank commodity codes not already among them."""
    tidy = F.filter(F.transform(col(codes), lambda c: F.trim(c)), lambda c: c != "")
    return F.array_distinct(F.concat(col(keywords), F.coalesce(tidy, F.array().cast("array<string>"))))


# ---- portals keyed by id ---------------------------------------------------

PORTAL = """projects map<string,struct<ProjectID:string,ProjectName:string,ReferenceID:string,DepartmentID:string,
    DateClose:string,ProjectSubStatusID:string,IsPublicAward:boolean>>, departments map<string,struct<DepartmentName:string>>"""


def ended_portal_status(sub: ColumnLike, public_award: ColumnLike) -> Column:
    return (F.when(F.coalesce(col(public_award), F.lit(False)) | (or_blank(sub) == "3"), "award")
            .when(or_blank(sub) == "2", "cancelled").otherwise("closed"))


def normalise_portal(payloads: DataFrame, past: bool) -> DataFrame:
    """Projects keyed by id with a department lookup; close times arrive in UTC."""
    rows = exploded_map(payloads, PORTAL, "projects", "departments").filter(filled(F.trim("r.ProjectName")))
    status = ended_portal_status("r.ProjectSubStatusID", "r.IsPublicAward") if past else F.lit("open")
    return rows.select(
        "source_id", F.col("r.ProjectID").alias("project_id"), F.trim("r.ProjectName").alias("title"),
        F.coalesce(none_if_blank(F.trim("r.ReferenceID")), text.external_id("r.ProjectName")).alias("external_id"),
        F.col("departments")[F.col("r.DepartmentID")]["DepartmentName"].alias("department"),
        dates.utc_to_new_york(dates.parse_timestamp("r.DateClose")).alias("due_date"), status.alias("status"))


def overlay_mine(public: DataFrame, mine: DataFrame) -> DataFrame:
    """Fold a vendor's own listings into the public ones by url, flagged and tagged `invited` first."""
    marked = mine.select("url", F.lit(True).alias("__mine"), *[F.col(c).alias(f"mine_{c}") for c in mine.columns if c != "url"])
    joined = public.join(marked, "url", "full")
    is_mine = F.col("__mine").isNotNull()
    tags = F.coalesce("categories", "mine_categories")
    out = []
    for c in public.columns:
        if c == "categories":
            out.append(F.when(is_mine, F.array_union(F.array(F.lit("invited")), tags)).otherwise(tags).alias(c))
        elif c == "personalized":
            out.append((is_mine | F.coalesce(c, F.lit(False))).alias(c))
        elif c == "url":
            out.append(F.col(c))
        else:
            out.append(F.coalesce(c, f"mine_{c}").alias(c) if f"mine_{c}" in marked.columns else F.col(c))
    return joined.select(*out)


# ---- road-work advertisements ----------------------------------------------

ROAD_STATUS = {"current": "open", "planned": "upcoming", "ad closed": "closed", "not yet selected": "closed",
               "cancelled": "cancelled", "canceled": "cancelled"}  # fixed values
# District -> counties.
DISTRICT_COUNTIES = {
    "01": ["charlotte", "collier", "desoto", "glades", "hardee", "hendry", "highlands", "lee", "manatee", "okeechobee", "polk", "sarasota"],
    "02": ["alachua", "baker", "bradford", "clay", "columbia", "dixie", "duval", "gilchrist", "hamilton", "lafayette", "levy", "madison",
           "nassau", "putnam", "st-johns", "suwannee", "taylor", "union"],
    "03": ["bay", "calhoun", "escambia", "franklin", "gadsden", "gulf", "holmes", "jackson", "jefferson", "leon", "liberty", "okaloosa",
           "santa-rosa", "wakulla", "walton", "washington"],
    "04": ["broward", "indian-river", "martin", "okeechobee", "palm-beach", "st-lucie"],
    "05": ["brevard", "flagler", "lake", "marion", "orange", "osceola", "seminole", "sumter", "volusia"],
    "06": ["miami-dade", "monroe"],
    "07": ["citrus", "hernando", "hillsborough", "pasco", "pinellas"],
}
DISTRICT_NAMES = {"08": "Florida's Turnpike Enterprise", "99": "Central Office"}  # fixed values


def district_counties(district: ColumnLike) -> Column:
    flat = []
    for code, counties in DISTRICT_COUNTIES.items():
        flat += [F.lit(code), F.array(*[F.lit(c) for c in counties])]
    return F.coalesce(F.create_map(*flat)[col(district)], F.array().cast("array<string>"))


def district_label(code: ColumnLike) -> Column:
    code = F.trim(or_blank(code))
    bare = F.regexp_replace(code, "^0+", "")
    return (F.when(code == "", None).when(code.isin(*DISTRICT_NAMES), F.concat(F.lit("FDOT "), lookup_map(DISTRICT_NAMES, code)))
            .otherwise(F.concat(F.lit("FDOT District "), F.when(bare != "", bare).otherwise(code))))


def display_amount(value: ColumnLike) -> Column:
    """A contract limit as shown on a board: $2.9M or $950,000; null when unreadable or not positive."""
    n = none_if_blank(F.regexp_replace(html_to_text(value), "[,$]", "")).try_cast("double")
    return (F.when(n >= 1_000_000, F.concat(F.lit("$"), F.format_number(n / 1_000_000, 1), F.lit("M")))
            .when(n > 0, F.concat(F.lit("$"), F.format_number(n, 0))))


# ---- award titles ----------------------------------------------------------

# The phrasing of award titles.
TITLE_REF = (r"\b(?:(?:Bid|RFP|RFQ|ITB|RLI|ITN|IFB|Solicitation|Contract)\b\s*(?:No\.?|#|Number)?\s*[:.]?\s*)"
             r"([A-Z0-9][A-Z0-9./-]{2,24})")
VENDOR_LEAD = r"\b(?:to|with)\s+(?:the\s+)?(?:(?:[a-z]+\s+){0,3}bidder,?\s+)?"
VENDOR_CORPORATE = (VENDOR_LEAD + r"([A-Z][\w&.,'()\- ]{2,80}?(?:Inc|LLC|LLP|Corp|Corporation|Company|Ltd|P\.?A|Co)\.?)(?=[,;\s]|$)")
VENDOR_DESCRIPTIVE = (VENDOR_LEAD + r"([A-Z][\w&.,'()\- ]{2,80}?(?:Group|Services|Enterprises|Associates|Engineering|Construction|"
                      r"Contracting|Industries|Solutions|Systems)\.?)(?=[,;\s]|$)")
CONNECTORS = ("To", "With", "The", "And", "Of", "For", "In", "At", "A", "An")


def is_award_title(title: ColumnLike) -> Column:
    return matches(title, r"\baward")


def title_amount(title: ColumnLike) -> Column:
    digits = F.regexp_replace(F.regexp_extract(col(title), r"\$\s?([\d,]+(?:\.\d{2})?)", 1), ",", "")
    return F.bround(none_if_blank(digits).try_cast("double")).cast("long")


def title_reference(title: ColumnLike) -> Column:
    """A quoted reference; prose caught by the pattern has no digit and is dropped."""
    ref = F.trim(capture(title, TITLE_REF), F.lit(" .,-"))
    clean = F.regexp_replace(ref, "[^A-Za-z0-9]", "")
    return F.when((F.length(clean) >= 3) & clean.rlike("[0-9]"), ref)


def title_vendor(title: ColumnLike) -> Column:
    """The firm named in an award title: corporate forms first; all-capital titles are recased."""
    title = col(title)

    def named(t: Column) -> Column:
        found = F.coalesce(none_if_blank(F.regexp_extract(t, VENDOR_CORPORATE, 1)),
                           none_if_blank(F.regexp_extract(t, VENDOR_DESCRIPTIVE, 1)))
        return F.trim(F.regexp_replace(found, r"\s+", " "), F.lit(" ,."))

    recased = F.initcap(title)
    for word in CONNECTORS:
        recased = F.regexp_replace(recased, rf"\b{word}\b", word.lower())
    return F.coalesce(named(title), F.when(title == F.upper(title), named(recased)))


# ---- contract register -----------------------------------------------------

def merged_vendor(first: ColumnLike, second: ColumnLike) -> Column:
    """Two name lines as one: joined, unless one already contains the other."""
    a, b = F.trim(or_blank(first)), F.trim(or_blank(second))
    inside = F.contains(F.lower(b), F.lower(a)) | F.contains(F.lower(a), F.lower(b))
    longer = F.when(F.length(a) >= F.length(b), a).otherwise(b)
    return none_if_blank(F.when((a == "") | (b == ""), F.concat(a, b)).when(inside, longer).otherwise(F.concat(a, F.lit(" "), b)))


def positive_money(value: ColumnLike) -> Column:
    n = none_if_blank(F.regexp_replace(F.trim(col(value)), "[$,]", "")).try_cast("double")
    return F.when(n > 0, n)


def agency_slug(agency: ColumnLike) -> Column:
    return F.substring(F.regexp_replace(F.lower(col(agency)), r"[^\p{L}\p{N}]", ""), 1, 32)


def map_register(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Register rows to contracts: agency-qualified id, amended end date first, amount fallback.

    `codes` (agency, code) names agencies by number; matching ignores case.
    """
    named = codes.select(F.upper(F.trim("agency")).alias("__folded"), F.col("code").alias("__code"))
    cid, agency = F.trim(or_blank("agency_contract_id")), F.trim(or_blank("agency_name"))
    name = first_filled(F.trim("long_title"), F.trim("short_title"))
    kept = rows.withColumn("__folded", F.upper(agency)).filter((cid != "") & (agency != "") & name.isNotNull())
    return kept.join(named, "__folded", "left").select(
        *[c for c in rows.columns if c == "ordinal"],
        F.concat(F.coalesce("__code", agency_slug(agency)), F.lit(":"), cid).alias("contract_id"),
        agency.alias("agency"), name.alias("name"), merged_vendor("vendor", "vendor_line_2").alias("vendor"),
        F.coalesce(positive_money("total_amount"), positive_money("original_amount")).alias("amount"),
        dates.us_day("begin_date").alias("start_date"),
        F.coalesce(dates.us_day("new_end_date"), dates.us_day("original_end_date")).alias("end_date"))


# ---- checks and grids ------------------------------------------------------

def expected_against_read(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Sources whose reported total exceeds what was parsed, with a degraded note."""
    read = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("read_rows"))
    joined = expected.join(read, "source_id", "left").withColumn("read_rows", F.coalesce("read_rows", F.lit(0)))
    return joined.withColumn("note", F.when(F.col("read_rows") < F.col("expected"), F.concat(
        F.lit("read "), F.col("read_rows").cast("string"), F.lit(" of "), F.col("expected").cast("string"), F.lit(" rows"))))


def map_grid(rows: DataFrame, list_status: Mapping[str, str]) -> DataFrame:
    """Grid rows by list type: decision date stands in for posted, awards get a protest clock, last copy wins."""
    status = F.coalesce(lookup_map(list_status, F.col("list_type")), F.lit("closed"))
    decided = F.coalesce(dates.parse_timestamp("award_date"), dates.parse_timestamp("non_award_date"))
    title, ref = F.trim(or_blank("bid_title")), none_if_blank(F.trim("bid_number"))
    shaped = rows.filter(title != "").select(
        "ordinal", title.alias("title"), ref.alias("external_id"), status.alias("status"), decided.alias("decided"),
        F.coalesce(dates.parse_timestamp("issue_date"), decided).cast("date").alias("posted_date"),
        dates.parse_timestamp("close_date").alias("due_date"))
    last = first_rows(shaped, ["status", F.coalesce("external_id", F.lit("")), "title"], [F.col("ordinal").desc()])
    clocked = calendar.protest_deadline(last, "decided", "deadline")
    award = F.col("status") == "award"
    return clocked.withColumn("protest_deadline", F.when(award, F.col("deadline"))) \
        .withColumn("award_date", F.when(award, F.col("decided").cast("date"))).drop("deadline", "decided")


def usable_title(title: ColumnLike, number: ColumnLike) -> Column:
    """A list row's title; a bare date filed as a title gives way to the number."""
    title = F.trim(or_blank(title))
    return none_if_blank(F.when(dates.looks_like_bare_date(title), F.trim(or_blank(number))).otherwise(title))


def posting_id(found: ColumnLike, counter: ColumnLike) -> Column:
    """A reference, else `WP-n` from the posting counter."""
    n = col(counter)
    return F.coalesce(col(found), F.when(n != 0, F.concat(F.lit("WP-"), n.cast("string"))))


