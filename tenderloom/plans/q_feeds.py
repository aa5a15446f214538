"""Whole feeds: payloads made of the bids' and contracts' own texts, and the opportunity rows they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions import classify
from tenderloom.functions.base import ColumnLike, brought, numbered
from tenderloom.plans.q_scalars import _ID_CASES, _TYPE_CASES, CLASSIFIED, classify_sql
from tenderloom.plans.q_sources import _DISTRICT_CASE, AWARD_TITLE
from tenderloom.plans.registry import query
from tenderloom.plans.tables import AS_OF, Tables
from tenderloom.sources import feeds

PORTAL = "https://portal.example.gov"


def enriched_sql(source: str) -> str:
    """CTE `z`: the rows of `source` (ext, title, about) with solicitation_type, external_id and the columns of CLASSIFIED."""
    return f"""f AS (SELECT *, title || chr(10) || about AS b FROM {source}), {classify_sql(classify.STARTER, 'f', 'ordinal')},
    x AS (SELECT * EXCLUDE (b), coalesce(ext, '') || ' ' || title || ' ' || about AS b FROM g), y AS (SELECT *, CASE {_TYPE_CASES} ELSE 'UNKNOWN' END AS solicitation_type FROM x),
    y2 AS (SELECT * EXCLUDE (b), title || ' ' || about AS b FROM y),
    z AS (SELECT *, coalesce(NULLIF(ext, ''), trim(regexp_replace(coalesce({_ID_CASES}), '\\s+', ' ', 'g'))) AS external_id FROM y2)"""


def pages_of(df: DataFrame, row: Column, wrap=lambda rows: rows, size: int = 100, at: str = "ordinal") -> DataFrame:
    """Payloads of about `size` rows each: JSON of `wrap`(list of rows)."""
    return (df.groupBy(F.floor(F.col(at) / size).alias("ordinal")).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("k"), row.alias("r")))).alias("rows"))
            .select(F.lit("feed").alias("source_id"), "ordinal", F.to_json(wrap(F.col("rows.r"))).alias("payload")))


SHOWN = ["external_id", "title", "url", "status", "posted_date", "due_date", "solicitation_type", "offer_type"]
LISTS = ["categories", "keywords"]


def shown(df: DataFrame, *more: str, lists: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[c for c in SHOWN if c in df.columns], *[F.array_join(c, "," if c in LISTS else "; ").alias(c) for c in (*LISTS, *lists)], *more)


def iso(c: ColumnLike, layout: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(c, layout)


# ---- sourcing events

_EVENTS = f"""ev AS (SELECT ordinal, trim(CASE WHEN ordinal % 31 = 0 THEN '  ' ELSE title || CASE WHEN ordinal % 4 = 0 THEN ' software and HVAC' ELSE '' END END) AS title, '' AS about,
      CASE WHEN ordinal % 3 = 0 THEN 'E' || ordinal ELSE 'PRJ-' || ordinal END AS ext, CASE WHEN ordinal % 2 = 0 THEN url ELSE '{PORTAL}/opportunities' END AS link, description,
      CASE WHEN ordinal % 3 = 1 THEN ['NIGP - 005', 'NIGP - ' || ordinal] ELSE CAST([] AS VARCHAR[]) END AS codes, posted_date, date_trunc('second', due_date) AS due_date,
      CASE ordinal % 5 WHEN 1 THEN 'open' WHEN 2 THEN 'award' WHEN 3 THEN 'cancelled' ELSE 'closed' END AS status, ordinal % 7 = 0 AS test, ordinal % 11 = 0 AS invited FROM bids)"""


def _event_payloads(t: Tables) -> DataFrame:
    k = F.col("ordinal")
    title = F.when(k % 31 == 0, "  ").otherwise(F.concat(F.lit(" "), "title", F.when(k % 4 == 0, " software and HVAC").otherwise("")))
    row = F.struct(
        F.concat(F.lit("E"), k.cast("string")).alias("id"), F.when(k % 3 != 0, F.concat(F.lit("PRJ-"), k.cast("string"))).otherwise("").alias("projectId"), title.alias("title"),
        F.when(k % 7 == 0, " test ").otherwise("RFP").alias("requestType"), (k % 11 == 0).alias("restricted"), F.when(k % 2 == 0, F.col("url")).alias("bidUrl"), "description",
        F.when(k % 3 == 1, F.array(F.lit("NIGP - 005 "), F.lit(" "), F.concat(F.lit("NIGP - "), k.cast("string")))).alias("commodityCodes"),
        iso("posted_date", "yyyy-MM-dd").alias("publishedAt"), iso("due_date", "yyyy-MM-dd'T'HH:mm:ss").alias("bidSubmissionDeadline"),
        F.expr("CASE ordinal % 5 WHEN 1 THEN 'Published' WHEN 2 THEN 'awarded' WHEN 3 THEN ' canceled' WHEN 4 THEN 'closed' ELSE 'odd' END").alias("state"))
    return pages_of(t.bids, row, lambda rows: F.struct(F.struct(F.struct(rows.alias("nodes")).alias("events")).alias("data")))


@query("feed_sourcing_events", f"""WITH {_EVENTS}, k AS (SELECT * FROM ev WHERE title <> '' AND NOT test AND NOT invited), {enriched_sql('k')}
    SELECT external_id, title, link AS url, status, posted_date, due_date, solicitation_type, {CLASSIFIED.rsplit(',', 1)[0].rsplit('array_to_string(keywords', 1)[0].rstrip(', ')},
      array_to_string(keywords || list_filter(codes, lambda c: NOT list_contains(keywords, c)), ',') AS keywords, array_to_string(codes, '; ') AS commodity_codes,
      NULLIF(array_to_string(codes, '; '), '') AS raw_category, NULLIF(trim(description), '') AS description FROM z""", "bids")
def feed_sourcing_events(t: Tables) -> DataFrame:
    return shown(feeds.sourcing_events(_event_payloads(t), f"{PORTAL}/opportunities"), "raw_category", "description", lists=("commodity_codes",))


@query("feed_sourcing_skips", f"""WITH {_EVENTS} SELECT 'feed' AS source_id, CASE WHEN test THEN 'test event' ELSE 'invitation-only event' END AS reason, count(*) AS events
    FROM ev WHERE title <> '' AND (test OR invited) GROUP BY ALL""", "bids")
def feed_sourcing_skips(t: Tables) -> DataFrame:
    return feeds.sourcing_skips(_event_payloads(t))


# ---- executed contracts

def contracts_of(t: Tables) -> DataFrame:
    """The contracts; suppliers, of whom two numbers are read, are brought to the lines if they are at most a million."""
    return t.view("contracts", supplier=brought(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), 1_000_000))


@query("feed_portal_contracts", """SELECT 'C' || order_key || '-' || line || '-' || part_key || '-' || supplier_key AS contract_id, name, CASE WHEN supplier_key % 4 <> 0 THEN 'Vendor & Sons ' || supplier_key END AS vendor,
    CAST(supplier_key AS VARCHAR) AS vendor_id, start_date, end_date, CASE line % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS extendable FROM contracts WHERE line % 6 <> 5""", "contracts")
def feed_portal_contracts(t: Tables) -> DataFrame:
    """Contracts keyed by id, or in a list, with vendors in the same payload."""
    # the shuffle carries the columns alone; ids and texts are made of them once a payload's rows are together
    told = ["order_key", "line", "part_key", "supplier_key", "name", "start_date", "end_date"]
    dealt = contracts_of(t).select(F.floor(F.col("order_key") / 50).alias("ordinal"), *told).repartition("ordinal")
    gathered = dealt.groupBy("ordinal").agg(F.collect_list(F.struct(*told)).alias("c"))

    def contract(c: Column) -> Column:
        cid = F.concat_ws("-", F.concat(F.lit("C"), c["order_key"].cast("string")), c["line"], c["part_key"], c["supplier_key"])
        asked = c["line"] % 4
        row = F.struct(F.when(c["line"] % 6 != 5, cid).otherwise(" ").alias("ContractID"), F.concat(F.lit(" "), c["name"]).alias("Name"), c["supplier_key"].alias("VendorID"),
                       iso(c["start_date"], "yyyy-MM-dd").alias("StartDate"), iso(c["end_date"], "MM/dd/yyyy").alias("EndDate"),
                       F.when(asked == 0, "Yes").when(asked == 1, "0").when(asked == 2, "TRUE").otherwise("").alias("IsExtendable"))
        return F.struct(cid.alias("id"), row.alias("r"))

    def vendor(key: Column) -> Column:
        name = F.when(key % 4 != 0, F.concat(F.lit("Vendor & Sons "), key.cast("string"))).otherwise(" ")
        return F.struct(key.cast("string").alias("id"), F.struct(key.alias("VendorID"), name.alias("VendorContactOrganizationName")).alias("v"))

    grouped = gathered.select("ordinal", F.transform("c", contract).alias("rows"), F.transform(F.array_distinct("c.supplier_key"), vendor).alias("vendors"))
    by_id = F.to_json(F.struct(F.map_from_entries("rows").alias("publicContracts"), F.map_from_entries("vendors").alias("vendors")))
    in_list = F.to_json(F.struct(F.col("rows.r").alias("publicContracts"), F.col("vendors.v").alias("vendors")))
    raw = grouped.select(F.lit("feed").alias("source_id"), "ordinal", F.when(F.col("ordinal") % 2 == 0, by_id).otherwise(in_list).alias("payload"))
    return feeds.portal_contracts(raw, "County", PORTAL).select("contract_id", "name", "vendor", "vendor_id", "start_date", "end_date", "extendable")


# ---- road-work advertisements

_ROADS = f"""rd AS (SELECT ordinal, CASE WHEN ordinal % 6 = 0 THEN 'FDOT advertisement AD' || ordinal ELSE title || ' & bridge' END AS title, '' AS about, 'AD' || ordinal AS ext,
      CASE ordinal % 10 WHEN 0 THEN '' WHEN 9 THEN '99' ELSE '0' || (ordinal % 10) END AS d, 'Signing · ' || scope AS work, ordinal % 3 = 0 AS minor, posted_date, date_trunc('minute', due_date) AS due_date,
      CASE ordinal % 5 WHEN 1 THEN 'open' WHEN 2 THEN 'upcoming' WHEN 3 THEN 'cancelled' ELSE 'closed' END AS status, award_amount AS v FROM bids)"""


@query("feed_road_ads", f"""WITH {_ROADS}, {enriched_sql('rd')}, w AS (SELECT *, concat_ws(' | ', NULLIF(work, 'Signing · '), CASE WHEN minor THEN '7.1 - Paving · 7.2' END) AS whole FROM z),
    q AS (SELECT *, coalesce(CASE d {_DISTRICT_CASE} END, CAST([] AS VARCHAR[])) AS counties FROM w)
    SELECT external_id, title, '{PORTAL}/ads' AS url, status, posted_date, due_date, solicitation_type, {CLASSIFIED.rsplit('array_to_string(keywords', 1)[0].rstrip(', ')},
      array_to_string(keywords || list_filter(counties, lambda c: NOT list_contains(keywords, c)), ',') AS keywords, NULLIF(whole, '') AS raw_category,
      array_to_string(list_transform(string_split(whole, '|'), lambda x: trim(x)), '; ') AS commodity_codes,
      CASE WHEN d = '' THEN NULL WHEN d = '08' THEN 'FDOT Florida''s Turnpike Enterprise' WHEN d = '99' THEN 'FDOT Central Office' ELSE 'FDOT District ' || ltrim(d, '0') END AS department,
      concat_ws('; ', CASE WHEN ordinal % 2 = 0 THEN 'FDOT prequalification: Type ' || (ordinal % 4) END, CASE WHEN ordinal % 9 = 0 THEN 'Business Development Initiative set-aside' END,
        CASE WHEN ordinal % 3 = 1 THEN 'Selection method: Best value & price' END) AS requirements,
      CASE WHEN v >= 1000000 THEN '$' || format('{{:,.1f}}', v / 1000000.0) || 'M' WHEN v > 0 THEN '$' || format('{{:,}}', v) END AS budget FROM q""", "bids")
def feed_road_ads(t: Tables) -> DataFrame:
    """Advertisements whose fields hold doubly escaped display text."""
    k = F.col("ordinal")
    row = F.struct(
        F.when(k % 6 == 0, "").otherwise(F.concat("title", F.lit(" &amp;amp; bridge"))).alias("AdShortDescription"), F.concat(F.lit(" AD"), k.cast("string")).alias("AdNumber"),
        F.expr("CASE ordinal % 10 WHEN 0 THEN '' WHEN 9 THEN '99' ELSE '0' || CAST(ordinal % 10 AS STRING) END").alias("DotAssignedDistrictCode"),
        F.expr("CASE ordinal % 5 WHEN 1 THEN 'Current' WHEN 2 THEN 'PLANNED' WHEN 3 THEN 'canceled' WHEN 4 THEN 'Ad Closed' ELSE 'odd' END").alias("AdStatusTypeName"),
        F.concat(F.lit(" Signing &lt;br/&gt; "), F.col("scope")).alias("MajorWorkTypesText"), F.when(k % 3 == 0, "7.1 - Paving&lt;br/&gt;7.2").alias("MinorWorkTypesText"),
        F.when(k % 2 == 0, F.concat(F.lit("<b>Type</b> "), (k % 4).cast("string"))).alias("ProjectThresholdTypeName"), F.when(k % 9 == 0, "YES").otherwise("No").alias("BDI"),
        F.when(k % 3 == 1, "Best value &#38; price").alias("SelectionMethodText"), iso("posted_date", "M/d/yyyy").alias("LastDateAdvertised"),
        iso("due_date", "M/d/yyyy h:mm a").alias("ResponseDeadlineDateTime"), F.col("award_amount").alias("AdContractAmount"))
    raw = pages_of(t.bids, row, lambda rows: F.struct(F.struct(rows.alias("AdList")).alias("Model")))
    return shown(feeds.road_advertisements(raw, f"{PORTAL}/ads"), "raw_category", "department", "budget", lists=("commodity_codes", "requirements"))


# ---- county lists

_LISTED = f"""ls AS (SELECT ordinal, CASE ordinal % 3 WHEN 0 THEN CASE WHEN ordinal % 4 = 0 THEN 'SOL ' || ordinal || '/1' ELSE title END WHEN 1 THEN title || ' software' ELSE title || ' RFP No. 2024-' || (100 + ordinal) END AS title,
      CASE WHEN ordinal % 3 = 0 THEN 'Request for Proposals' ELSE '' END AS about, CASE WHEN ordinal % 3 = 0 THEN 'SOL ' || ordinal || '/1' END AS ext, posted_date, due_date FROM bids)"""


@query("feed_county_lists", f"""WITH {_LISTED}, {enriched_sql('ls')}
    SELECT CASE WHEN ordinal % 3 = 1 THEN 'WP-' || ordinal ELSE external_id END AS external_id, title, CASE ordinal % 3 WHEN 0 THEN '{PORTAL}/d?solNumber=SOL%20' || ordinal || '%2F1' ELSE '{PORTAL}' END AS url,
      CASE ordinal % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'upcoming' ELSE 'award' END AS status, posted_date, CASE WHEN ordinal % 3 = 0 THEN due_date END AS due_date, solicitation_type, {CLASSIFIED},
      CASE ordinal % 3 WHEN 0 THEN about WHEN 1 THEN 'Advance notice of an upcoming solicitation' || coalesce('; posted through ' || CAST(due_date AS DATE), '') END AS description,
      CASE WHEN ordinal % 3 = 1 AND ordinal % 2 = 0 THEN 'Clerk — c@x.gov' WHEN ordinal % 3 = 1 THEN 'c@x.gov' END AS contact,
      CASE WHEN ordinal % 3 = 2 AND ordinal % 2 = 0 THEN 'https://host.example.gov/docs/' || ordinal || '.pdf' WHEN ordinal % 3 = 2 THEN 'http://elsewhere/' || ordinal END AS document FROM z""", "bids")
def feed_county_lists(t: Tables) -> DataFrame:
    """Three lists of one county, wrapped each in its own way: open, advance notices, award recommendations."""
    k, n = F.col("ordinal"), F.col("ordinal").cast("string")
    number = F.concat(F.lit("SOL "), n, F.lit("/1"))
    current = pages_of(t.bids.filter("ordinal % 3 = 0"), F.struct(
        F.when(k % 4 == 0, "1/2/2024").otherwise(F.concat("title", F.lit("  "))).alias("title"), number.alias("solicitationNumber"), F.lit(" Request for Proposals").alias("solicitationType"),
        iso("due_date", "M/d/yyyy HH:mm:ss").alias("openingDate"), iso("posted_date", "yyyy-MM-dd").alias("postedDate")),
        lambda rows: F.struct(F.lit(3).alias("draw"), F.lit("x").alias("note"), rows.alias("data"), F.array(F.lit("later list")).alias("zz")))
    future = pages_of(t.bids.filter("ordinal % 3 = 1"), F.struct(
        F.concat(F.lit(" "), "title", F.lit(" software. . ")).alias("documentTitle"), iso("posted_date", "MMMM d, yyyy").alias("releaseDate"), iso("due_date", "yyyy-MM-dd").alias("removalDate"),
        F.when(k % 2 == 0, "Clerk ").otherwise(" ").alias("sendFeedBack"), F.lit("c@x.gov").alias("emailAddress"), k.alias("webPostingCounter")))
    awarded = pages_of(t.bids.filter("ordinal % 3 = 2"), F.struct(
        F.when(k % 2 == 0, F.concat("title", F.lit(" RFP No. 2024-"), (k + 100).cast("string"))).alias("title"), F.concat("title", F.lit(" RFP No. 2024-"), (k + 100).cast("string")).alias("documentTitle"),
        F.when(k % 4 == 0, iso("posted_date", "yyyy-MM-dd")).alias("datePosted"), iso("posted_date", "M/d/yyyy").alias("releaseDate"),
        F.when(k % 2 == 0, F.concat(F.lit("/docs/"), n, F.lit(".pdf"))).alias("url"), F.concat(F.lit("http://elsewhere/"), n).alias("pdfUrl")),
        lambda rows: F.struct(rows.alias("AwardRecommendations2024")))
    parts = [feeds.current_list(current, PORTAL, f"{PORTAL}/d"), feeds.future_list(future, PORTAL), feeds.recommendation_list(awarded, PORTAL, "https://host.example.gov")]
    whole = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return shown(whole.withColumn("document", F.get("documents.url", F.lit(0))), "description", "contact", "document")


# ---- decisions of boards

_TITLE = AWARD_TITLE.replace("o_orderkey", "ordinal")
_AWARDED = rf"""tl AS (SELECT *, {_TITLE} || ' (' || title || ')' AS said FROM bids), aw0 AS (SELECT *, trim(NULLIF(regexp_extract(said, '(?i)\b(?:(?:Bid|RFP|RFQ|ITB|RLI|ITN|IFB|Solicitation|Contract)\b\s*(?:No\.?|#|Number)?\s*[:.]?\s*)([A-Z0-9][A-Z0-9./-]{{2,24}})', 1), ''), ' .,-') AS r
      FROM tl WHERE regexp_matches(said, '(?i)\baward')),
    aw AS (SELECT ordinal, substr(said, 1, 160) AS title, said AS about, '' AS ext, posted_date, CAST(due_date AS DATE) AS passed, CASE WHEN length(regexp_replace(r, '[^A-Za-z0-9]', '', 'g')) >= 3 AND regexp_matches(r, '[0-9]') THEN r END AS ref,
      CAST(round_even(CAST(NULLIF(replace(regexp_extract(said, '\$\s?([0-9,]+(?:\.[0-9]{{2}})?)', 1), ',', ''), '') AS DOUBLE), 0) AS BIGINT) AS amount,
      CASE ordinal % 5 WHEN 0 THEN 'Crown USA, Inc' WHEN 1 THEN 'BCC Engineering, LLC' END AS vendor FROM aw0)"""


@query("feed_award_matters", f"""WITH {_AWARDED}, {enriched_sql('aw')}
    SELECT CASE WHEN ordinal % 4 = 0 THEN 'M' || ordinal ELSE CAST(ordinal AS VARCHAR) END AS external_id, substr(about, 1, 200) AS title, '{PORTAL}' AS url, 'award' AS status,
      coalesce(CASE WHEN ordinal % 2 = 0 THEN passed END, posted_date) AS posted_date, solicitation_type, {CLASSIFIED}, vendor AS awarded_vendor, amount AS award_amount, ref AS linked_ref,
      CASE WHEN ref IS NOT NULL THEN 'ref' END AS award_linkage FROM z""", "bids")
def feed_award_matters(t: Tables) -> DataFrame:
    """Agenda matters: only titles with the word award count, whatever the search let through."""
    k = F.col("ordinal")
    title = F.concat(F.expr(_TITLE.replace("VARCHAR", "STRING")), F.lit(" ("), "title", F.lit(")"))
    row = F.struct(k.alias("MatterId"), F.when(k % 4 == 0, F.concat(F.lit(" M"), k.cast("string"))).alias("MatterFile"), title.alias("MatterTitle"),
                   iso("posted_date", "yyyy-MM-dd'T'HH:mm:ss").alias("MatterAgendaDate"), F.when(k % 2 == 0, iso("due_date", "yyyy-MM-dd'T'HH:mm:ss")).alias("MatterPassedDate"))
    return shown(feeds.award_matters(pages_of(t.bids, row), PORTAL), "awarded_vendor", "award_amount", "linked_ref", "award_linkage")


@query("feed_board_actions", rf"""WITH {_AWARDED.replace('tl AS (SELECT *,', "tl AS (SELECT * REPLACE (CASE WHEN ordinal % 50 = 3 THEN NULL ELSE posted_date END AS posted_date), source_id AS board,", 1).replace('aw AS (SELECT ordinal,', 'aw AS (SELECT ordinal, board, place,', 1)
      .replace('FROM tl WHERE', "FROM pl WHERE", 1).replace('aw0 AS (SELECT *,', '''pl0 AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY ordinal DESC) AS place FROM tl),
    st AS (SELECT board, min(place) AS stop FROM pl0 WHERE posted_date < DATE '1995-06-17' - 365 GROUP BY board), pl AS (SELECT pl0.* FROM pl0 LEFT JOIN st USING (board) WHERE stop IS NULL OR place < stop), aw0 AS (SELECT *,''', 1)},
    cp AS (SELECT * FROM aw QUALIFY row_number() OVER (PARTITION BY board ORDER BY place) <= 100), {enriched_sql('cp')}
    SELECT CASE WHEN ordinal % 4 = 0 THEN 'F' || ordinal ELSE CAST(ordinal AS VARCHAR) END AS external_id, substr(about, 1, 200) AS title, '{PORTAL}/matter?m=' || ordinal AS url, 'award' AS status, posted_date,
      solicitation_type, {CLASSIFIED}, board AS source_id, NULLIF(amount, 0) AS award_amount, ref AS linked_ref FROM z""", "bids")
def feed_board_actions(t: Tables) -> DataFrame:
    """A record read newest first: up to the first row before the lookback, at most 100 awards of a board."""
    k = F.col("ordinal")
    title = F.concat(F.expr(_TITLE.replace("VARCHAR", "STRING")), F.lit(" ("), "title", F.lit(")"))
    rows = t.bids.select("ordinal", "source_id", k.cast("string").alias("matter"),
                         F.when(k % 4 == 0, F.concat(F.lit("F"), k.cast("string"))).alias("file_number"), F.when(k % 50 == 3, "").otherwise(iso("posted_date", "M/d/yyyy")).alias("date"), title.alias("title"))
    rows = numbered(rows, [k.desc()], "place", ["source_id"]).drop("ordinal")
    return shown(feeds.board_actions(rows, "1995-06-17", PORTAL + "/matter?m={}"), "source_id", "award_amount", "linked_ref")
