"""Feeds, pages and messages read into records (families A, B and C).

Payload queries build each feed's JSON from the test tables, so the reader's
whole path runs: parse, explode, collapse, map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions import package
from tenderloom.functions.base import with_scalars
from tenderloom.operators import facts
from tenderloom.plans.q_scalars import CALENDAR_SQL
from tenderloom.plans.registry import query
from tenderloom.plans.tables import AS_OF, Tables
from tenderloom.session import scratch_path
from tenderloom.sources import messages, pages, payloads, registers, reports, snapshot

def key() -> Column:
    return F.col("o_orderkey")


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def paged(rows: DataFrame, row: Column, page: Column, wrap: str, more: dict[str, Column] | None = None) -> DataFrame:
    """Group rows into JSON payload pages of about fifty, as an API would return them."""
    grouped = rows.groupBy(page.alias("ordinal")).agg(F.collect_list(row).alias(wrap))
    fields = [F.col(wrap), *[v.alias(k) for k, v in (more or {}).items()]]
    return grouped.select(F.lit("feed").alias("source_id"), "ordinal", F.to_json(F.struct(*fields)).alias("payload"))


# ---- feeds -----------------------------------------------------------------

@query("norm_opengov", """SELECT o_orderkey AS project_id, 'Project ' || o_custkey AS title, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'F-' || o_orderkey END AS external_id,
    CAST(o_orderdate AS DATE) AS posted_date, o_orderdate - INTERVAL 5 HOUR AS due_date,
    CASE WHEN o_orderstatus = 'O' THEN 'open' WHEN o_orderkey % 5 = 0 THEN 'award' WHEN o_orderkey % 5 = 1 THEN 'cancelled' WHEN o_orderkey % 5 = 2 THEN 'cancelled' ELSE 'closed' END AS status,
    CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) + 3 END AS award_date, 'Work to do & <more>' AS description FROM orders""")
def norm_opengov(t: Tables) -> DataFrame:
    """Project pages with repeated ids: the last copy wins, open and ended rows get their status."""
    d = F.col("o_orderdate")
    row = F.struct(
        key().alias("id"), F.concat(F.lit("Project "), F.col("o_custkey").cast("string")).alias("title"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"),
        F.when(key() % 4 == 0, F.lit(" ")).otherwise(F.concat(F.lit("F-"), key().cast("string"))).alias("financialId"),
        F.lit("<p>Work<br>to   <svg><text>drawn</text></svg>do &amp; &lt;more&gt;</p>").alias("summary"),
        F.when(key() % 5 == 0, "Contract Awarded").when(key() % 5 == 1, "to be re-solicited").otherwise("Complete").alias("closeOutReason"),
        F.when(key() % 5 == 2, "canceled").alias("closedSubstatus"), iso(d + F.expr("INTERVAL 3 DAYS")).alias("closedAt"),
        iso(d).alias("releaseProjectDate"), F.concat(iso(d), F.lit("Z")).alias("proposalDeadline"))
    stale = F.struct(key().alias("id"), F.lit("Stale copy").alias("title"))
    first, again = paged(t.orders.filter("o_orderkey % 9 = 0"), stale, F.floor(key() / 50) * 2, "rows"), paged(t.orders, row, F.floor(key() / 50) * 2 + 1, "rows")
    return payloads.normalise_projects(first.unionByName(again)).select(
        "project_id", "title", "external_id", "posted_date", "due_date", "status", "award_date", "description")


@query("ended_status", """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'award' WHEN 1 THEN 'award' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'cancelled' WHEN 4 THEN 'cancelled' ELSE 'closed' END AS status,
    CASE WHEN o_orderkey % 7 < 2 THEN CAST(o_orderdate AS DATE) END AS award_date FROM orders""")
def ended_status(t: Tables) -> DataFrame:
    reason = F.expr("""CASE o_orderkey % 7 WHEN 0 THEN 'awarded' WHEN 1 THEN 'Project Awarded (cancelled lots)' WHEN 2 THEN 'Project will be RE-SOLICITED'
        WHEN 3 THEN 'all bids rejected' WHEN 5 THEN 'Complete' END""")
    ended = payloads.ended_status(reason, F.expr("CASE WHEN o_orderkey % 7 = 4 THEN 'Cancelled' END"), iso(F.col("o_orderdate")))
    return t.orders.select("o_orderkey", ended["status"].alias("status"), ended["award_date"].alias("award_date"))


@query("document_dedupe", """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 3 WHEN o_orderkey % 3 = 1 THEN 2 ELSE 1 END AS INTEGER) AS files,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Bid package|a.pdf|Form' WHEN o_orderkey % 3 = 1 THEN 'a.pdf|Form' ELSE 'Form' END AS names FROM orders""")
def document_dedupe(t: Tables) -> DataFrame:
    """Files from three payload shapes, once per address whatever its signature."""
    root = F.concat(F.lit("https://f.example/"), key().cast("string"))
    attach = F.array(F.struct(F.concat(root, F.lit("/a?sig=2")).alias("url"), F.lit("a.pdf").alias("filename")),
                     F.struct(F.lit("ftp://x").alias("url"), F.lit("skipped").alias("filename")))
    form = F.array(F.struct(F.concat(root, F.lit("/form?x=1")).alias("url"), F.lit("Form").alias("title")),
                   F.struct(F.concat(root, F.lit("/form?x=2")).alias("url"), F.lit("Form copy").alias("title")))
    detail = F.struct(
        key().alias("project_id"),
        F.when(key() % 3 == 0, F.struct(F.concat(root, F.lit("/pkg?sig=1")).alias("url"), F.lit(" ").alias("filename"))).alias("documentAttachment"),
        F.when(key() % 3 < 2, attach).alias("attachments"), form.alias("proposalDocuments"))
    raw = t.orders.select(F.lit("feed").alias("source_id"), F.to_json(detail).alias("payload"))
    docs = payloads.normalise_project_details(raw)
    return docs.select(F.col("project_id").alias("o_orderkey"), F.size("documents").alias("files"),
                       F.array_join(F.transform("documents", lambda d: d["name"]), "|").alias("names"))


@query("norm_project_detail", """SELECT o_orderkey AS project_id, 'Scope for ' || o_custkey AS scope, CASE o_orderkey % 3 WHEN 0 THEN 'Ann Lee — Buyer' WHEN 1 THEN 'Bo Ray' ELSE 'desk' END AS contact,
    CASE WHEN o_orderkey % 2 = 0 THEN 'a@x.gov' ELSE 'p@x.gov' END AS contact_email, o_orderdate AS questions_due, 'NIGP 910 Roofs' AS codes,
    CASE WHEN o_orderkey % 2 = 0 THEN '$2.5 million' END AS budget, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate || ' · Hall B' END AS pre_bid_meeting FROM orders""")
def norm_project_detail(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    detail = F.struct(
        key().alias("project_id"), F.concat(F.lit("<p>Scope for "), F.col("o_custkey").cast("string"), F.lit("</p>")).alias("summary"),
        F.when(key() % 3 == 0, "Ann Lee").alias("contactFullName"), F.when(key() % 3 == 0, "Buyer").alias("contactTitle"),
        F.when(key() % 3 == 1, "Bo Ray").alias("procurementContactFullName"), F.when(key() % 3 == 2, "desk").alias("contact"),
        F.when(key() % 2 == 0, "a@x.gov").otherwise("").alias("contactEmail"), F.lit("p@x.gov").alias("procurementContactEmail"),
        F.when(key() % 2 == 0, iso(d)).alias("qaDeadline"), iso(d).alias("questionDeadline"),
        F.when(key() % 4 == 0, iso(d)).alias("preProposalDate"), F.lit("Hall B").alias("preProposalLocation"),
        F.array(F.struct(F.lit("910").alias("code"), F.lit("Roofs").alias("title"))).alias("categories"),
        F.array(F.struct(F.when(key() % 2 == 0, "Estimated Cost").otherwise("Name").alias("title"), F.lit("$2.5 million").alias("value"))).alias("upfrontQuestions"))
    raw = t.orders.select(F.lit("feed").alias("source_id"), F.to_json(detail).alias("payload"))
    return payloads.normalise_project_details(raw).select("project_id", "scope", "contact", "contact_email", "questions_due",
                                                          F.array_join("commodity_codes", ";").alias("codes"), "budget", "pre_bid_meeting")


_SAM = """SELECT 'n' || o_orderkey AS notice_id, 'Notice ' || o_custkey AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'Dept Of The Army' ELSE NULL END AS department,
    CASE WHEN o_orderkey % 2 = 0 THEN 'W91-' || o_orderkey END AS external_id, CAST(o_orderdate AS DATE) AS posted_date,
    'Federal ' || CASE WHEN o_orderkey % 5 = 0 THEN 'solicitation' ELSE 'Combined' END || CASE WHEN o_orderkey % 3 = 0 THEN ' · Dept Of The Army' ELSE '' END
      || ' · Place of performance: ' || CASE WHEN o_orderkey % 4 = 0 THEN 'Miami Beach, ' ELSE '' END || 'FL' || CASE WHEN o_orderkey % 7 = 0 THEN ' · Set-aside: SBA' ELSE '' END AS description,
    'b@x.gov' AS contact_email, CASE WHEN o_orderkey % 2 = 0 THEN 'NAICS 236220|PSC Z2AA' ELSE 'NAICS 236220' END AS codes, CAST(1 AS INTEGER) AS files,
    CAST(round_even(o_totalprice, 0) AS BIGINT) AS award_amount FROM orders WHERE o_orderkey % 6 <> 0"""


@query("norm_sam", _SAM)
def norm_sam(t: Tables) -> DataFrame:
    contact = "struct<email:string,fullName:string,phone:string>"
    row = F.struct(
        F.concat(F.lit("n"), key().cast("string")).alias("noticeId"),
        F.when(key() % 6 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Notice "), F.col("o_custkey").cast("string"))).alias("title"),
        F.when(key() % 2 == 0, F.concat(F.lit("W91-"), key().cast("string"))).alias("solicitationNumber"),
        F.when(key() % 3 == 0, "DEPT OF DEFENSE.DEPT OF THE ARMY").alias("fullParentPathName"), iso(F.col("o_orderdate")).alias("postedDate"),
        F.when(key() % 5 != 0, "Combined").alias("type"), F.lit("236220").alias("naicsCode"), F.when(key() % 2 == 0, "Z2AA").alias("classificationCode"),
        F.when(key() % 7 == 0, "SBA").alias("typeOfSetAsideDescription"), F.lit("https://api.example/desc").alias("description"),
        F.when(key() % 4 == 0, F.struct(F.struct(F.lit("MIAMI BEACH").alias("name")).alias("city"))).alias("placeOfPerformance"),
        F.array(F.lit("https://d.example/1"), F.lit("n/a")).alias("resourceLinks"),
        F.array(F.lit(None).cast(contact), F.struct(F.lit("").alias("email"), F.lit("Ann").alias("fullName"), F.lit(None).cast("string").alias("phone")),
                F.struct(F.lit("b@x.gov").alias("email"), F.lit("Bo").alias("fullName"), F.lit("1").alias("phone"))).alias("pointOfContact"),
        F.struct(F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("amount")).alias("award"))
    notices = payloads.normalise_notices(paged(t.orders, row, F.floor(key() / 100), "opportunitiesData"), status="award")
    return notices.select("notice_id", "title", "department", "external_id", "posted_date", "description", "contact_email",
                          F.array_join("commodity_codes", "|").alias("codes"), F.size("documents").alias("files"), "award_amount")


@query("norm_mfmp", f"""WITH {CALENDAR_SQL}, a AS (SELECT o_orderkey AS ad_id, o_orderdate + INTERVAL 9 HOUR AS published, CAST(o_orderkey % 11 AS INTEGER) AS ty, o_orderstatus AS st FROM orders)
    SELECT ad_id, CASE ty WHEN 2 THEN 'OTHER' WHEN 4 THEN 'ITB' WHEN 5 THEN 'ITN' WHEN 6 THEN 'RFP' WHEN 8 THEN 'RFI' WHEN 9 THEN 'RFQ' WHEN 10 THEN 'OTHER' ELSE 'RFP' END AS solicitation_type,
      CASE WHEN ty = 1 THEN 'award' WHEN st = 'O' THEN 'open' ELSE 'closed' END AS status, CASE WHEN ad_id % 2 = 0 THEN 'Agency X' ELSE 'State of Florida' END AS agency,
      CASE WHEN ty = 1 THEN e.day + (published - CAST(published AS DATE)) END AS protest_deadline
    FROM a JOIN ix s ON s.day = CAST(published AS DATE) JOIN ix e ON e.biz = 1 AND e.bi = s.bi + 1 - s.biz + 3""")
def norm_mfmp(t: Tables) -> DataFrame:
    row = F.struct(key().alias("advertisementId"), F.concat(F.lit("RFP for lot "), key().cast("string")).alias("title"),
                   F.when(key() % 2 == 0, "Agency X").alias("agency"), (key() % 11).cast("string").alias("typeId"),
                   F.when(F.col("o_orderstatus") == "O", "Open").otherwise("Closed").alias("status"),
                   iso(F.col("o_orderdate") + F.expr("INTERVAL 9 HOURS")).alias("publishDate"))
    raw = t.orders.groupBy(F.floor(key() / 100).alias("ordinal")).agg(F.to_json(F.collect_list(row)).alias("payload")).withColumn("source_id", F.lit("ads"))
    return payloads.normalise_advertisements(raw).select("ad_id", "solicitation_type", "status", "agency", "protest_deadline")


@query("skip_reasons", """SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'test event' WHEN o_orderkey % 5 = 0 THEN 'invitation-only event' ELSE 'kept' END AS outcome, count(*) AS events,
    count(*) FILTER (o_orderstatus = 'F') AS awards, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 2 END) AS BIGINT) AS keywords FROM orders GROUP BY 1""")
def skip_reasons(t: Tables) -> DataFrame:
    reason = payloads.skip_reason(F.when(key() % 7 == 0, F.lit(" test ")).otherwise(F.lit("RFP")), key() % 5 == 0)
    words = payloads.with_codes(F.array(F.lit("paving"), F.lit("NIGP - 1")), F.when(key() % 2 == 0, F.array(F.lit("NIGP - 2 "), F.lit(" "), F.lit("NIGP - 1"))))
    state = payloads.event_status(F.expr("CASE o_orderstatus WHEN 'F' THEN 'Awarded' WHEN 'O' THEN 'published' ELSE 'odd' END"))
    return t.orders.select(F.coalesce(reason, F.lit("kept")).alias("outcome"), state.alias("status"), words.alias("words")).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("status") == "award", 1)).alias("awards"), F.sum(F.size("words")).alias("keywords"))


@query("norm_bonfire", """SELECT CAST(o_orderkey AS VARCHAR) AS project_id, 'Job ' || o_custkey AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'Dept 0' WHEN o_orderkey % 3 = 1 THEN 'Dept 1' END AS department,
    timezone('America/New_York', timezone('UTC', o_orderdate + INTERVAL 18 HOUR)) AS due_date, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 4 = 3 THEN 'award' WHEN o_orderkey % 4 = 2 THEN 'cancelled' ELSE 'closed' END AS status FROM orders""")
def norm_bonfire(t: Tables) -> DataFrame:
    project = F.struct(key().cast("string").alias("ProjectID"), F.concat(F.lit("Job "), F.col("o_custkey").cast("string")).alias("ProjectName"),
                       (key() % 3).cast("string").alias("DepartmentID"),
                       F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 18 HOURS"), "yyyy-MM-dd HH:mm:ss").alias("DateClose"),
                       (key() % 4).cast("string").alias("ProjectSubStatusID"), (key() % 5 == 0).alias("IsPublicAward"))
    departments = F.create_map(F.lit("0"), F.struct(F.lit("Dept 0").alias("DepartmentName")), F.lit("1"), F.struct(F.lit("Dept 1").alias("DepartmentName")))
    raw = t.orders.groupBy(F.floor(key() / 100).alias("ordinal")).agg(F.map_from_entries(F.collect_list(F.struct(key().cast("string"), project))).alias("projects")) \
        .select(F.lit("portal").alias("source_id"), "ordinal", F.to_json(F.struct("projects", departments.alias("departments"))).alias("payload"))
    return payloads.normalise_portal(raw, past=True).select("project_id", "title", "department", "due_date", "status")


@query("overlay_merge", """WITH p AS (SELECT url, ordinal, categories FROM bids WHERE ordinal % 5 <> 0), m AS (SELECT url, ordinal, categories FROM bids WHERE ordinal % 3 = 0)
    SELECT coalesce(p.url, m.url) AS url, coalesce(p.ordinal, m.ordinal) AS ordinal, m.url IS NOT NULL AS personalized,
      array_to_string(CASE WHEN m.url IS NOT NULL THEN ['invited'] ELSE CAST([] AS VARCHAR[]) END || coalesce(p.categories, m.categories), ',') AS categories
    FROM p FULL JOIN m USING (url)""", "bids")
def overlay_merge(t: Tables) -> DataFrame:
    public = t.bids.filter("ordinal % 5 <> 0").select("url", "ordinal", "categories", F.lit(False).alias("personalized"))
    mine = t.bids.filter("ordinal % 3 = 0").select("url", "ordinal", "categories")
    return payloads.overlay_mine(public, mine).select("url", "ordinal", "personalized", F.array_join("categories", ",").alias("categories"))


_DISTRICT_CASE = " ".join(f"WHEN '{d}' THEN {c}" for d, c in payloads.DISTRICT_COUNTIES.items())


@query("district_expand", f"""WITH a AS (SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 9 THEN '99' ELSE '0' || (o_orderkey % 10) END AS d, o_totalprice AS v FROM orders)
    SELECT o_orderkey, CASE WHEN d = '' THEN NULL WHEN d = '08' THEN 'FDOT Florida''s Turnpike Enterprise' WHEN d = '99' THEN 'FDOT Central Office' ELSE 'FDOT District ' || ltrim(d, '0') END AS department,
      array_to_string(['roads'] || coalesce(CASE d {_DISTRICT_CASE} END, CAST([] AS VARCHAR[])), ',') AS keywords, 'Signing · Lighting' AS work,
      CASE o_orderkey % 3 WHEN 0 THEN '$3.0M' WHEN 1 THEN '$' || format('{{:,}}', CAST(round_even(v, 0) AS BIGINT)) END AS budget FROM a""")
def district_expand(t: Tables) -> DataFrame:
    code = F.expr("CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 9 THEN '99' ELSE concat('0', o_orderkey % 10) END")
    amount = F.when(key() % 3 == 0, F.lit("2950000.0")).when(key() % 3 == 1, F.col("o_totalprice").cast("decimal(18,2)").cast("string")).otherwise(F.lit("0"))
    return t.orders.select(
        "o_orderkey", payloads.district_label(code).alias("department"),
        F.array_join(F.array_union(F.array(F.lit("roads")), payloads.district_counties(code)), ",").alias("keywords"),
        pages.html_to_text(F.lit(" Signing &amp;lt;br/&amp;gt; Lighting&amp;nbsp;")).alias("work"), payloads.display_amount(amount).alias("budget"))


@query("norm_lists", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'SOL-' || o_orderkey WHEN 1 THEN NULL ELSE 'Lot ' || o_orderkey END AS title,
    CASE o_orderkey % 3 WHEN 0 THEN 'RFP 2024-01' WHEN 1 THEN 'WP-' || o_orderkey END AS external_id FROM orders""")
def norm_lists(t: Tables) -> DataFrame:
    """List rows whose title may be a mis-filed date, keyed by reference or posting counter."""
    raw = F.expr("CASE o_orderkey % 4 WHEN 0 THEN ' 1/2/2024 ' WHEN 1 THEN '  ' ELSE concat('Lot ', o_orderkey) END")
    found = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'RFP 2024-01' END")
    counter = F.expr("CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey END")
    return t.orders.select(
        "o_orderkey", payloads.usable_title(raw, F.concat(F.lit("SOL-"), key().cast("string"))).alias("title"),
        payloads.posting_id(found, counter).alias("external_id"))


AWARD_TITLE = """CASE o_orderkey % 5 WHEN 0 THEN 'Approve AWARD of Bid No. OPN' || o_orderkey || 'B1 to low bidder, Crown USA, Inc., for $' || CAST(o_orderkey AS VARCHAR) || ',500 and $9'
    WHEN 1 THEN 'Resolution approving award of RFP No. 449, with BCC Engineering, LLC in the amount of $1,234,567.89'
    WHEN 2 THEN 'Forward look at Broward' WHEN 3 THEN 'AWARD CONTRACT FOR PAVING TO ACME SERVICES FOR ROADS' ELSE 'Award of Bid For Services' END"""


def award_titles_of(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.expr(AWARD_TITLE.replace("VARCHAR", "STRING")).alias("title"))


@query("award_titles", rf"""WITH a AS (SELECT o_orderkey, {AWARD_TITLE} AS title FROM orders),
    b AS (SELECT *, trim(NULLIF(regexp_extract(title, '(?i)\b(?:(?:Bid|RFP|RFQ|ITB|RLI|ITN|IFB|Solicitation|Contract)\b\s*(?:No\.?|#|Number)?\s*[:.]?\s*)([A-Z0-9][A-Z0-9./-]{{2,24}})', 1), ''), ' .,-') AS r FROM a)
    SELECT o_orderkey, CAST(round_even(CAST(NULLIF(replace(regexp_extract(title, '\$\s?([0-9,]+(?:\.[0-9]{{2}})?)', 1), ',', ''), '') AS DOUBLE), 0) AS BIGINT) AS amount,
      CASE WHEN length(regexp_replace(r, '[^A-Za-z0-9]', '', 'g')) >= 3 AND regexp_matches(r, '[0-9]') THEN r END AS ref
    FROM b WHERE regexp_matches(title, '(?i)\baward')""")
def award_titles(t: Tables) -> DataFrame:
    rows = award_titles_of(t).filter(payloads.is_award_title("title"))
    return rows.select("o_orderkey", payloads.title_amount("title").alias("amount"), payloads.title_reference("title").alias("ref"))


@query("vendor_phrase", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Crown USA, Inc' WHEN 1 THEN 'BCC Engineering, LLC' WHEN 3 THEN 'Acme Services' END AS vendor FROM orders""")
def vendor_phrase(t: Tables) -> DataFrame:
    return award_titles_of(t).select("o_orderkey", payloads.title_vendor("title").alias("vendor"))


_REGISTER = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ' ' || n_name || ' ' AS agency_name, ' C' || l_orderkey || '-' || l_linenumber AS agency_contract_id,
    CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE 'Long ' || l_partkey END AS long_title, 'Short ' || l_partkey AS short_title,
    CASE l_linenumber % 3 WHEN 0 THEN s_name || '  ' WHEN 1 THEN '' ELSE 'The ' || s_name END AS vendor, CASE l_linenumber % 2 WHEN 0 THEN s_name ELSE 'Unit B' END AS vendor_line_2,
    CASE WHEN l_quantity < 10 THEN 'n/a' ELSE '$' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS {str}) END AS total_amount, '1,000.50' AS original_amount,
    {fmt} AS original_end_date, CASE WHEN l_linenumber = 4 THEN '1/2/2030' ELSE '' END AS new_end_date, 'bad' AS begin_date
    FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey"""


@query("register_map", f"""WITH r AS ({_REGISTER.format(str='VARCHAR', fmt="strftime(l_shipdate, '%m/%d/%Y')", lineitem='lineitem', supplier='supplier', nation='nation')}),
    j AS (SELECT r.*, trim(agency_name) AS ag, trim(vendor) AS a, trim(vendor_line_2) AS b, CASE WHEN n_nationkey % 2 = 0 THEN 'A' || n_nationkey END AS code FROM r JOIN nation ON upper(n_name) = upper(trim(agency_name)))
    SELECT l_orderkey * 100000000000 + l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS ordinal, coalesce(code, regexp_replace(lower(ag), '[^a-z0-9]', '', 'g')) || ':' || trim(agency_contract_id) AS contract_id, ag AS agency,
      coalesce(NULLIF(long_title, ''), short_title) AS name,
      CASE WHEN a = '' OR b = '' THEN NULLIF(a || b, '') WHEN contains(lower(b), lower(a)) OR contains(lower(a), lower(b)) THEN CASE WHEN length(a) >= length(b) THEN a ELSE b END ELSE a || ' ' || b END AS vendor,
      coalesce(TRY_CAST(replace(replace(total_amount, '$', ''), ',', '') AS DOUBLE), 1000.5) AS amount, CAST(NULL AS DATE) AS start_date,
      CASE WHEN new_end_date <> '' THEN DATE '2030-01-02' ELSE strptime(original_end_date, '%m/%d/%Y')::DATE END AS end_date FROM j""")
def register_map(t: Tables) -> DataFrame:
    rows = t.spark.sql(_REGISTER.format(str="STRING", fmt="date_format(l_shipdate, 'MM/dd/yyyy')", lineitem="{lineitem}", supplier="{supplier}", nation="{nation}"),
                       lineitem=t.lineitem, supplier=t.supplier, nation=t.nation)
    rows = rows.withColumn("ordinal", F.expr("l_orderkey * 100000000000 + l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey"))
    codes = t.nation.filter("n_nationkey % 2 = 0").select(F.lower("n_name").alias("agency"), F.concat(F.lit("A"), F.col("n_nationkey").cast("string")).alias("code"))
    return payloads.map_register(rows, codes)


@query("detail_merge", """WITH d AS (SELECT ordinal, CASE WHEN ordinal % 2 = 0 THEN 'desk' END AS contact, CASE WHEN ordinal % 3 = 0 THEN repeat('scope ', 20) ELSE 'x' END AS scope FROM bids WHERE ordinal % 4 <> 0)
    SELECT b.ordinal, coalesce(NULLIF(b.contact, ''), d.contact, b.contact) AS contact, CASE WHEN length(d.scope) > length(coalesce(b.scope, '')) THEN d.scope ELSE b.scope END AS scope,
      CAST(len(b.documents) + CASE WHEN d.ordinal IS NOT NULL THEN CASE WHEN b.ordinal % 4 = 2 THEN 1 ELSE 2 END ELSE 0 END AS INTEGER) AS files,
      CAST(len(b.requirements) + CASE WHEN d.ordinal IS NOT NULL AND NOT list_contains(b.requirements, 'Bid bond') THEN 1 ELSE 0 END AS INTEGER) AS labels
    FROM bids b LEFT JOIN d USING (ordinal)""", "bids")
def detail_merge(t: Tables) -> DataFrame:
    package_ = payloads.document(F.lit("Bid package"), F.concat(F.col("url"), F.lit("/package.pdf?again")))
    extra = payloads.document(F.lit("Plan"), F.concat(F.col("url"), F.lit("/plan.pdf")), "drawing")
    detail = t.bids.filter("ordinal % 4 <> 0").select(
        "ordinal", F.expr("CASE WHEN ordinal % 2 = 0 THEN 'desk' END").alias("contact"),
        F.expr("CASE WHEN ordinal % 3 = 0 THEN repeat('scope ', 20) ELSE 'x' END").alias("scope"),
        F.array(package_, extra).alias("documents"), F.array(F.lit("Bid bond")).alias("requirements"))
    return facts.merge_detail(t.bids, detail, "ordinal", ("contact",)).select(
        "ordinal", "contact", "scope", F.size("documents").alias("files"), F.size("requirements").alias("labels"))


@query("expected_vs_read", """WITH r AS (SELECT source_id, count(*) AS n FROM bids WHERE ordinal % 9 <> 0 OR source_id IN ('2-HIGH', '5-LOW') GROUP BY source_id), e AS (SELECT source_id, count(*) AS expected FROM bids GROUP BY source_id)
    SELECT e.source_id, expected, coalesce(n, 0) AS read_rows, CASE WHEN coalesce(n, 0) < expected THEN 'read ' || coalesce(n, 0) || ' of ' || expected || ' rows' END AS note FROM e LEFT JOIN r USING (source_id)""", "bids")
def expected_vs_read(t: Tables) -> DataFrame:
    reported = t.bids.groupBy("source_id").agg(F.count(F.lit(1)).alias("expected"))
    return payloads.expected_against_read(t.bids.filter("ordinal % 9 <> 0 OR source_id IN ('2-HIGH', '5-LOW')"), reported) \
        .select("source_id", "expected", "read_rows", "note")


@query("grid_rows_map", f"""WITH {CALENDAR_SQL}, g AS (SELECT o_orderkey AS ordinal, 'Lot ' || (o_custkey % 300) AS title, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 'B' || (o_custkey % 50) END AS external_id,
      CASE o_orderstatus WHEN 'F' THEN 'award' WHEN 'O' THEN 'open' ELSE 'closed' END AS status, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 10 HOUR END AS decided, CAST(o_orderdate AS DATE) AS od FROM orders),
    l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY status, coalesce(external_id, ''), title ORDER BY ordinal DESC) = 1)
    SELECT ordinal, title, external_id, status, CASE WHEN status = 'award' THEN od ELSE od - 7 END AS posted_date, CASE WHEN status = 'award' THEN e.day + (decided - CAST(decided AS DATE)) END AS protest_deadline,
      CASE WHEN status = 'award' THEN CAST(decided AS DATE) END AS award_date
    FROM l LEFT JOIN ix s ON s.day = CAST(decided AS DATE) LEFT JOIN ix e ON e.biz = 1 AND e.bi = s.bi + 1 - s.biz + 3""")
def grid_rows_map(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    award = F.col("o_orderstatus") == "F"
    rows = t.orders.select(
        key().alias("ordinal"), F.expr("concat(' Lot ', o_custkey % 300)").alias("bid_title"), F.expr("CASE WHEN o_custkey % 4 = 0 THEN ' ' ELSE concat('B', o_custkey % 50) END").alias("bid_number"),
        F.col("o_orderstatus").alias("list_type"), F.when(award, iso(d + F.expr("INTERVAL 10 HOURS"))).alias("award_date"), F.lit(None).cast("string").alias("non_award_date"),
        F.when(~award, F.date_format(F.date_sub(d.cast("date"), 7), "M/d/yyyy")).alias("issue_date"), F.lit(None).cast("string").alias("close_date"))
    return payloads.map_grid(rows, {"F": "award", "O": "open"}).select("ordinal", "title", "external_id", "status", "posted_date", "protest_deadline", "award_date")


# ---- pages -----------------------------------------------------------------

_UNESC = "html"
# The references that the test pages hold, spelled out apart from the operator's own list.
_QUOTED = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&#58;", ":"), ("&copy;", "©"),
           ("&middot;", "·"), ("&amp;", "&")]
for _entity, _char in _QUOTED:
    _UNESC = f"replace({_UNESC}, '{_entity}', '{_char}')"
_TWICE = _UNESC
for _entity, _char in _QUOTED:
    _TWICE = f"replace({_TWICE}, '{_entity}', '{_char}')"


@query("html_to_text", rf"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace({_TWICE}, '(?i)<br\s*/?>', ' · ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' ·') AS body FROM pg""", "pg")
def html_to_text(t: Tables) -> DataFrame:
    return t.pg.select("page_id", pages.html_to_text("html").alias("body"))


_ANCHOR = r"""(?is)<a\b[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>"""
LINKS_SQL = rf"""lk AS (SELECT page_id, url, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS position, unnest(h) AS href,
    trim(regexp_replace(regexp_replace(unnest(x), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM (SELECT page_id, url, regexp_extract_all(html, '{_ANCHOR}', 1) AS h, regexp_extract_all(html, '{_ANCHOR}', 2) AS x FROM pg))"""
_ABS = r"""CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href
    ELSE coalesce(NULLIF(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)', 1), ''), regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/') || href END"""


@query("page_links", f"WITH {LINKS_SQL} SELECT page_id, position, href, text FROM lk", "pg")
def page_links(t: Tables) -> DataFrame:
    return pages.page_links(t.pg).select("page_id", "position", "href", "text")


_HINT = " ".join(f"WHEN contains(blob, '{h}') THEN {len(pages.LINK_HINTS) - i}" for i, h in enumerate(pages.LINK_HINTS))
_STRONG = " OR ".join(f"contains(lower(href), '{n.lower()}')" for _p, proofs, _w in pages.PLATFORM_SIGNATURES for n in proofs)


@query("best_link", f"""WITH {LINKS_SQL}, s AS (SELECT *, lower(href || ' ' || text) AS blob FROM lk),
    c AS (SELECT *, CAST(CASE WHEN regexp_matches(blob, '{pages.LINK_TEST}') THEN CASE {_HINT} ELSE 0 END + CASE WHEN {_STRONG} THEN 20 ELSE 0 END ELSE 0 END AS INTEGER) AS score FROM s
      WHERE NOT contains(lower(href), 'bonfirehub.com'))
    SELECT page_id, score, {_ABS} AS link FROM c WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, position) = 1""", "pg")
def best_link(t: Tables) -> DataFrame:
    return pages.best_links(t.pg, avoid=["bonfire"])


def _any(needles) -> str:
    return "(" + " OR ".join(f"contains(l, '{n.lower()}')" for n in needles) + ")" if needles else "false"


_STRONG_LIST = ", ".join(f"CASE WHEN {_any(s)} THEN '{p}' END" for p, s, _w in pages.PLATFORM_SIGNATURES)
_WEAK_LIST = ", ".join(f"CASE WHEN NOT {_any(s)} AND {_any(w)} THEN '{p}' END" for p, s, w in pages.PLATFORM_SIGNATURES)


@query("platform_signatures", f"""SELECT page_id, array_to_string(list_filter([{_STRONG_LIST}], lambda x: x IS NOT NULL), ',') AS strong,
    array_to_string(list_filter([{_WEAK_LIST}], lambda x: x IS NOT NULL), ',') AS weak FROM (SELECT page_id, lower(html) AS l FROM pg)""", "pg")
def platform_signatures(t: Tables) -> DataFrame:
    found = pages.identify_platforms("html")
    return t.pg.select("page_id", F.array_join(found["strong"], ",").alias("strong"), F.array_join(found["weak"], ",").alias("weak"))


_POINTED = " ".join(f"WHEN '{p}' THEN {' OR '.join(f'contains(l, $q${n.lower()}$q$)' for n in proofs)}" for p, proofs, _n in pages.PLATFORM_SIGNATURES)


@query("platform_verdict", f"""WITH s AS (SELECT page_id, lower(html) AS l, list_filter([{_STRONG_LIST}], lambda x: x IS NOT NULL) AS st, list_filter([{_WEAK_LIST}], lambda x: x IS NOT NULL) AS wk,
      contains(html, 'class="bidTitle"') OR contains(html, 'listItemsRow') AS has_rows FROM (SELECT page_id, html, lower(html) AS l FROM ({{page}}))),
    e AS (SELECT *, st || list_filter(wk, lambda x: NOT list_contains(st, x)) AS every FROM s),
    o AS (SELECT *, every[1] = 'civicplus' AND len(every) > 1 AND NOT has_rows AND coalesce(CASE every[2] {_POINTED} END, false) AS pointer FROM e)
    SELECT page_id, CASE WHEN pointer THEN every[2] ELSE every[1] END AS platform, array_to_string(CASE WHEN pointer THEN [every[1]] || every[3:] ELSE every[2:] END, ',') AS also,
      CASE WHEN pointer THEN 'pointer' WHEN len(st) > 0 THEN 'strong' WHEN len(wk) > 0 THEN 'weak' END AS confidence FROM o""".replace("{page}", "SELECT page_id, html || CASE page_id % 3 WHEN 0 THEN ' /Bids.aspx /Common/Modules/Bids/RWDBids.css https://www.myvendorlink.com/t' WHEN 1 THEN ' /Common/Modules/Bids/RWDBids.css <div class=\"bidTitle\"> https://www.myvendorlink.com/' ELSE '' END AS html FROM pg"), "pg")
def platform_verdict(t: Tables) -> DataFrame:
    """One platform for each page; boards that only point at another one count as that."""
    page = t.pg.withColumn("html", F.concat("html", F.expr("""CASE page_id % 3 WHEN 0 THEN ' /Bids.aspx /Common/Modules/Bids/RWDBids.css https://www.myvendorlink.com/t'
        WHEN 1 THEN ' /Common/Modules/Bids/RWDBids.css <div class="bidTitle"> https://www.myvendorlink.com/' ELSE '' END""")))
    return page.select("page_id", pages.platform_of("html").alias("v")).select("page_id", "v.platform", F.array_join("v.also", ",").alias("also"), "v.confidence")


@query("letting_pages", """WITH b AS (SELECT l_orderkey AS k, 'Firm & Sons ' || l_suppkey || '/' || l_partkey AS bidder, l_extendedprice AS amount, l_orderkey % 7 AS kind,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem),
    g AS (SELECT k, count(*) AS bidders, CAST(round_even(min(amount), 0) AS BIGINT) AS award_amount, arg_min(bidder, place) AS awarded_vendor,
      string_agg(bidder || ' — $' || format('{:,.2f}', amount), ' · ' ORDER BY place) AS lines FROM b WHERE kind <> 6 GROUP BY k)
    SELECT 'E' || k AS external_id, 'FDOT letting 03/04/2024: contract E' || k || CASE WHEN k % 7 <> 5 THEN ' — Palm Beach County' ELSE '' END AS title, CASE WHEN k // 20 % 5 = 0 THEN 'FDOT Central Office / Turnpike' ELSE 'FDOT District 4' END AS department,
      bidders, awarded_vendor, award_amount, CASE WHEN k % 3 = 0 THEN '4' || k END AS linked_ref, left('Preliminary letting results (apparent low bid first; official Intent to Award posts on FDOT Contracts Administration). '
      || bidders || ' bid(s): ' || lines, 600) AS description FROM g""")
def letting_pages(t: Tables) -> DataFrame:
    """Whole letting reports, twenty contracts a page, read as tables joined to their pages."""
    k = F.col("l_orderkey")
    place = F.struct("l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey")
    row = F.concat(F.lit('<div class="textLeft"><div class="vendorName">Firm &amp; Sons<br> '), F.col("l_suppkey").cast("string"), F.lit("/"), F.col("l_partkey").cast("string"),
                   F.lit('</div><div class="bidTotal x"> $ '), F.format_number("l_extendedprice", 2), F.lit("</div></div>"))
    each = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("at"), row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"))
    label = lambda name, value: F.concat(F.lit(f'<div class="ContractHeader"><span>{name}:</span> '), value, F.lit("</div>"))
    head = F.concat(F.lit('<div id="contractHeader">'), label("Contract No", F.when(k % 7 == 6, "").otherwise(F.concat(F.lit("E"), k.cast("string")))),
                    label("County", F.when(k % 7 == 5, "").otherwise("PALM BEACH")), label("Fin Prj No", F.when(k % 3 == 0, F.concat(F.lit("4"), k.cast("string"))).otherwise("")),
                    F.lit('</div><div class="textLeft"><div class="vendorName">Contractor\'s Name</div><div class="bidTotal">$0</div></div><div class="textLeft"><div class="vendorName">No price</div></div>'))
    page = F.floor(k / 20)
    htmls = (each.select(page.alias("page"), F.struct(k.alias("k"), F.concat(head, "rows").alias("h")).alias("c")).groupBy("page")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["h"]), "<hr>").alias("html")))
    raw = htmls.select(F.lit("lettings").alias("source_id"), F.when(F.col("page") % 5 == 0, "99").otherwise("4").alias("district"), F.lit("2024-03-04").cast("date").alias("letting_date"),
                       F.concat(F.lit("https://l/"), F.col("page").cast("string")).alias("url"), F.concat(F.lit("<html><body>"), "html", F.lit("</body></html>")).alias("html"))
    return reports.letting_awards(raw).select("external_id", "title", "department", "bidders", "awarded_vendor", "award_amount", "linked_ref", "description")


@query("award_documents", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Firm No ' || o_custkey END AS vendor, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE greatest(CAST(round_even(o_totalprice, 0) AS BIGINT), 1500) END AS amount FROM orders""")
def award_documents(t: Tables) -> DataFrame:
    """Award documents as text: the firm awarded to, and the largest sum named."""
    price = F.format_number("o_totalprice", 2)
    said = F.concat(F.lit("Committee memo\nThe staff recommends an "), F.when(key() % 4 == 0, "award.").otherwise(F.concat(F.lit("INTENT TO AWARD this contract to: Firm No "), F.col("o_custkey").cast("string"), F.lit(", low bidder"))),
                    F.when(key() % 5 == 0, "\nno sums").otherwise(F.concat(F.lit("\nDeposit $1,500 and total $ "), price, F.lit(" (was $12)"))))
    return t.orders.select("o_orderkey", reports.text_award_facts(said).alias("f")).select("o_orderkey", "f.vendor", "f.amount")


@query("bid_board_pages", rf"""WITH x AS (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[^\x00-\x7F]', 'x', 'g') AS b FROM pg),
    c AS (SELECT page_id, len(list_distinct(list_transform(regexp_extract_all(b, '(?i){pages.BOARD_REF}'), lambda r: regexp_replace(upper(r), '[^A-Z0-9]', '', 'g')))) AS refs,
      len(list_distinct(regexp_extract_all(b, '(?i){pages.BOARD_DATE}'))) AS dates FROM x)
    SELECT page_id, CAST(refs AS INTEGER) AS refs, CAST(dates AS INTEGER) AS dates, refs >= 2 AND dates >= 2 AS is_board FROM c""", "pg")
def bid_board_pages(t: Tables) -> DataFrame:
    counts = pages.bid_board_counts("html")
    return t.pg.select("page_id", counts["refs"].alias("refs"), counts["dates"].alias("dates"), pages.is_bid_board("html").alias("is_board"))


@query("tenant_extract", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'acme' || o_orderkey || '.bonfirehub.com' WHEN 1 THEN 't' || o_orderkey WHEN 2 THEN 'x.ionwave.net' WHEN 3 THEN 'UF' || o_orderkey END AS tenant FROM orders""")
def tenant_extract(t: Tables) -> DataFrame:
    platform = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'bonfire' WHEN 1 THEN 'opengov' WHEN 2 THEN 'ionwave' WHEN 3 THEN 'jaggaer' ELSE 'civicplus' END")
    url = F.expr("""CASE o_orderkey % 5 WHEN 0 THEN concat('https://acme', o_orderkey, '.bonfirehub.com/portal') WHEN 1 THEN concat('https://procurement.opengov.com/portal/embed/t', o_orderkey, '/project-list')
        WHEN 2 THEN 'https://x.ionwave.net/v' WHEN 3 THEN concat('https://bids.sciquest.com/apps/Router/PublicEvent?CustomerOrg=UF', o_orderkey) ELSE 'https://a.gov' END""")
    return t.orders.select("o_orderkey", pages.tenant(url, platform).alias("tenant"))


@query("notice_links", rf"""WITH {LINKS_SQL} SELECT page_id, 'RFP 2026-023' AS ref, 'Roof repairs at City Hall' AS title, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/docs/b.pdf' AS link
    FROM pg WHERE page_id % 10 = 3""", "pg")
def notice_links(t: Tables) -> DataFrame:
    return pages.notice_links(t.pg).select("page_id", "ref", "title", "link")


@query("page_documents", f"""WITH {LINKS_SQL}, d AS (SELECT page_id, position, {_ABS} AS link, text AS name, CASE WHEN contains(lower(text), 'addend') THEN 'addendum' WHEN regexp_matches(lower(text), '\\b(plan|drawing|sketch)') THEN 'drawing'
      WHEN regexp_matches(lower(text), '\\bspec') THEN 'specification' ELSE 'document' END AS kind FROM lk WHERE regexp_matches(href, '(?i){pages.DOCUMENT_LINK}') AND length(text) >= 3)
    SELECT page_id, link, name, kind FROM d QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY position) = 1""", "pg")
def page_documents(t: Tables) -> DataFrame:
    return pages.page_documents(t.pg).select("page_id", "link", "name", "kind")


@query("awarded_to", """SELECT page_id, CASE WHEN page_id % 10 = 5 THEN 'Crown USA, Inc' WHEN page_id % 10 = 6 THEN 'Doc Firm' END AS vendor FROM pg""", "pg")
def awarded_to(t: Tables) -> DataFrame:
    docs = t.pg.filter("page_id % 10 = 6 OR page_id % 10 = 5").select("page_id", F.lit("Committee file\nAwarded to: Doc Firm.\nEnd").alias("document_text"))
    joined = t.pg.join(docs, "page_id", "left")
    return joined.select("page_id", pages.awarded_to(pages.html_to_text("html"), F.col("document_text")).alias("vendor"))


@query("page_tables", """SELECT page_id, CAST(i AS INTEGER) AS row_no, CASE i WHEN 1 THEN 'RFP 1 Paving' ELSE 'ITB 2 Roof' END AS title, CASE i WHEN 1 THEN '1/2/2026' ELSE '2/3/2026' END AS posted FROM pg, range(1, 3) r(i) WHERE page_id % 10 = 7""", "pg")
def page_tables(t: Tables) -> DataFrame:
    rows = pages.table_rows(t.pg, ["bid", "solicitation"])
    return rows.select("page_id", "row_no", F.col("cells")["bid/solicitation"].alias("title"), F.col("cells")["posted"].alias("posted"))


@query("page_labels", """SELECT page_id, 'Open' AS status, '3/4/2026' AS closes FROM pg WHERE page_id % 10 = 8""", "pg")
def page_labels(t: Tables) -> DataFrame:
    fields = pages.label_values(t.pg).filter(F.col("fields")["status"].isNotNull())
    return fields.select("page_id", F.col("fields")["status"].alias("status"), F.col("fields")["closing date"].alias("closes"))


@query("content_cells", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS introduced, 'AWARD OF LOT ' || o_custkey AS title FROM orders""")
def content_cells(t: Tables) -> DataFrame:
    dated = F.when(key() % 3 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    cells = F.array(F.lit(""), key().cast("string"), dated, F.concat(F.lit("AWARD OF LOT "), F.col("o_custkey").cast("string")), F.lit("x"))
    rows = t.orders.select("o_orderkey", cells.alias("cells"), key().cast("string").alias("file_no"))
    found = pages.content_cells("cells", "file_no")
    return rows.select("o_orderkey", found["date"].alias("introduced"), found["title"].alias("title"))


@query("bid_tabs", """SELECT l_orderkey AS contract_no, count(*) AS bidders, min(l_extendedprice) AS low_amount, max(l_extendedprice) AS high_amount,
    first('Firm ' || l_suppkey || '/' || l_partkey ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey) AS low_bidder FROM lineitem GROUP BY l_orderkey""")
def bid_tabs(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("contract_no"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"), F.expr("concat('Firm ', l_suppkey, '/', l_partkey)").alias("bidder"),
        F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("amount"))
    return pages.bid_tabs(rows)


@query("tabulation_facts", """SELECT o_orderkey AS sheet_id, 'Firm ' || o_custkey AS vendor, CAST(round_even(o_totalprice, 0) AS BIGINT) AS amount FROM orders WHERE o_orderkey % 4 <> 0""")
def tabulation_facts(t: Tables) -> DataFrame:
    price = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    sheet = F.array(
        F.array(F.lit("City tabulation"), F.lit(""), F.lit("")),
        F.when(key() % 4 == 0, F.array(F.lit("No"), F.lit("Item"), F.lit("Bid"))).otherwise(F.array(F.lit("No"), F.lit("Bidder Name"), F.lit("Total Price"))),
        F.array(F.lit("1"), F.lit(""), F.lit("$5")),
        F.array(F.lit("2"), F.concat(F.lit("Firm "), F.col("o_custkey").cast("string")), price),
        F.array(F.lit("3"), F.lit("Later Firm"), F.lit("$9")))
    return pages.tabulation_facts(t.orders.select(key().alias("sheet_id"), F.posexplode(sheet).alias("row_no", "cells")))


PACKAGE_TEXT = """concat('BID PACKAGE\\nProject Location: ', n_name, ' depot  Estimated Value: $ ', CAST(CAST(o_totalprice AS BIGINT) AS STRING), '\\nPerformance & Payment Bond Required:YES Bid Bond Required:',
    CASE WHEN o_orderkey % 2 = 0 THEN 'YES' ELSE 'NO' END, '\\nLicense Requirements:Primary: General Building Contractor\\nCalendar Days for Project Completion: ', CAST(30 + o_orderkey % 90 AS STRING),
    ' days\\nLiquidated Damages: YES $$ Per Day:$333.71\\nSBE-S Requirements YES Percentage: 10%\\nScope of Work: Replace the roof at ', n_name, ' depot, including flashing, drains and all incidental work.\\nGENERAL CONDITIONS OF BID\\nboilerplate')"""


@query("package_facts", """SELECT o_orderkey, '$' || CAST(trunc(o_totalprice) AS BIGINT) AS estimated_value, n_name || ' depot' AS project_location, 'Primary: General Building Contractor' AS licenses, CAST(30 + o_orderkey % 90 AS INTEGER) AS duration_days,
    '$333.71 per day' AS liquidated_damages, CASE WHEN o_orderkey % 2 = 0 THEN 'Bid bond required;' ELSE '' END || 'Performance & payment bond required;Licence: Primary: General Building Contractor;SBE set-aside 10%' AS requirements,
    'Replace the roof at ' || n_name || ' depot, including flashing, drains and all incidental work.' AS scope
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def package_facts(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    read = rows.select("o_orderkey", package.package_facts(F.expr(PACKAGE_TEXT)).alias("f")).select("o_orderkey", "f.*")
    return read.withColumn("requirements", F.array_join("requirements", ";"))


# ---- messages --------------------------------------------------------------

_SUBJECT = """CASE n % 4 WHEN 0 THEN 'Fwd: Notify Me: Bid for lot ' || n WHEN 1 THEN 'RFP-24-' || (100 + n) || ' Paving' WHEN 2 THEN 'Lunch?' ELSE 'Bids: ' || n END"""
_BODY = """opening || chr(10) || CASE WHEN n % 4 = 0 THEN 'See https://www.city' || (n % 157) || '.gov/bids/' || (n % 40) || '. Closing date: March 14, 2024 at 3:30 PM' ELSE 'Details http://x.gov/unsubscribe https://sub.city' || (n % 157) || '.gov/b?i=' || n END
    || chr(10) || 'You are receiving this mail'"""


def mail(t: Tables) -> DataFrame:
    return t.messages.filter("opening IS NOT NULL").select(
        "message_id", F.expr(_SUBJECT).alias("subject"), F.expr(_BODY).alias("body"),
        F.expr("concat('Clerk <bids@mail.city', n % 211, '.gov>')").alias("sender"))


NOTICES = rf"""nt AS (SELECT message_id, n, CASE n % 4 WHEN 0 THEN 'Bid for lot ' || n ELSE 'RFP-24-' || (100 + n) || ' Paving' END AS title,
    CASE WHEN n % 4 = 0 THEN 'https://www.city' || (n % 157) || '.gov/bids/' || (n % 40) ELSE 'https://sub.city' || (n % 157) || '.gov/b?i=' || n END AS url,
    CASE WHEN n % 4 = 0 THEN TIMESTAMP '2024-03-14 15:30:00' END AS due_date, CASE WHEN n % 4 = 1 THEN 'RFP-24-' || (100 + n) END AS external_id
    FROM messages WHERE opening IS NOT NULL AND n % 4 IN (0, 1)),
    nf AS (SELECT * FROM nt QUALIFY row_number() OVER (PARTITION BY url ORDER BY message_id) = 1)"""


@query("bid_notices", f"WITH {NOTICES} SELECT message_id, title, url, due_date, external_id FROM nf", "messages")
def bid_notices(t: Tables) -> DataFrame:
    return messages.bid_notices(mail(t), "https://portal.example.gov").select("message_id", "title", "url", "due_date", "external_id")


@query("host_suffix_join", f"""WITH {NOTICES}, src AS (SELECT s_suppkey AS ordinal, 'city' || s_suppkey || '.gov' AS host, s_name AS agency FROM supplier),
    c AS (SELECT message_id, 0 AS turn, 'city' || (n % 157) || '.gov' AS h FROM nf UNION ALL SELECT message_id, 1, 'city' || (n % 211) || '.gov' FROM nf),
    m AS (SELECT message_id, arg_min(agency, turn) AS agency FROM c JOIN src ON src.host = c.h GROUP BY message_id)
    SELECT message_id, coalesce(m.agency, 'Email alert (mail.city' || (n % 211) || '.gov)') AS agency, CASE WHEN m.agency IS NOT NULL THEN 'broward' ELSE 'unknown' END AS county FROM nf LEFT JOIN m USING (message_id)""", "messages")
def host_suffix_join(t: Tables) -> DataFrame:
    sources = t.supplier.select(
        F.col("s_suppkey").alias("ordinal"), F.expr("concat('https://www.city', s_suppkey, '.gov/')").alias("portal_url"), F.col("s_name").alias("agency"), F.lit("broward").alias("county"))
    notices = messages.bid_notices(mail(t), "https://portal.example.gov")
    return messages.attribute_senders(notices, sources).select("message_id", "agency", "county")


# ---- files: written to the shared folder, then read back --------------------

@query("snapshot_scan", """SELECT opportunity_id, title, status, CAST(len(documents) AS INTEGER) AS files, due_date FROM bids""", "bids")
def snapshot_scan(t: Tables) -> DataFrame:
    """Write a snapshot, read it back, and list its rows."""
    path = scratch_path(t.spark, "snapshot")
    health = t.bids.groupBy("source_id").agg(F.count(F.lit(1)).alias("count")).withColumn("ok", F.lit(True))
    snapshot.write_snapshot(t.bids.drop("first_seen_at"), health, path, AS_OF)
    rows, _health = snapshot.read_snapshot(t.spark, path)
    return rows.select("opportunity_id", "title", "status", F.size("documents").alias("files"), "due_date")


@query("register_scan", """SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS contract_id, CASE WHEN l_linenumber % 3 = 1 THEN NULL ELSE 'Active' END AS status FROM lineitem WHERE l_linenumber % 3 <> 2""")
def register_scan(t: Tables) -> DataFrame:
    """A register export with short rows (kept) and over-long rows (dropped)."""
    path = scratch_path(t.spark, "register")
    full = F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)")
    line = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("Agency,V,T,"), full, F.lit(",,,,1,2,Long,Active,Short,1/1/2020,1/1/2021,,ITB"))) \
        .when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("Agency,V,T,"), full)) \
        .otherwise(F.concat(F.lit("Agency,V,T,"), full, F.lit(",,,,1,2,Long,Active,Short,1/1/2020,1/1/2021,,ITB,spilled,more")))
    t.lineitem.select(line.alias("value")).write.text(f"{path}/part")
    rows = registers.read_register(t.spark, f"{path}/part", header=False)
    return rows.select(F.col("agency_contract_id").alias("contract_id"), "status")


@query("findings_log", """WITH w AS (SELECT * FROM log WHERE event_id % 17 <> 0 AND event_id % 23 <> 1),
    l AS (SELECT entity_id, platform, event_id FROM w QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_id DESC) = 1)
    SELECT entity_id, platform, 'note, of ' || event_id AS note, platform <> 'unknown' AS recheck, (SELECT count(*) FROM log WHERE event_id % 17 = 0) AS torn_lines FROM l""", "log")
def findings_log(t: Tables) -> DataFrame:
    """An append-only log in several files with torn lines and lines of no entity: the last whole line of every entity."""
    path = scratch_path(t.spark, "findings")
    row = F.struct(F.expr("CASE WHEN event_id % 23 = 1 THEN '' ELSE entity_id END").alias("entity_id"), "platform", F.concat(F.lit("note, of "), F.col("event_id").cast("string")).alias("note"),
                   F.array("platform").alias("also"))
    line = F.to_json(row)
    written = t.log.select("event_id", line.alias("line")).select(
        "event_id", F.when(F.col("event_id") % 17 == 0, F.substring("line", 1, 25)).otherwise(F.col("line")).alias("value"))
    written.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    found = registers.finding_lines(t.spark, path, split_bytes=1 << 18)
    latest = registers.latest_findings(found)
    marked = latest.join(registers.worth_rechecking(latest).withColumn("recheck", F.lit(True)), "entity_id", "left")
    return with_scalars(marked, found.agg(F.count_if("torn").alias("torn_lines"))).select(
        "entity_id", "platform", "note", F.coalesce("recheck", F.lit(False)).alias("recheck"), "torn_lines")
