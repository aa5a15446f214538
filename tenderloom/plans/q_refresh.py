"""The refresh run over all bids, its coverage report, and packages read once for every bid that shares them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.functions import geo, text
from tenderloom.operators import dedupe, refresh
from tenderloom.plans.q_linkage import _SURVIVORS, LINKS
from tenderloom.plans.q_scalars import (_CITY_LONGEST, _DUE_FORMATS, _MARK, _MONEY_NUMBER, _NORM, _Q, _REQ_LIST,
                                        _VALUE_CASES, brief_sql, gazetteer)
from tenderloom.plans.registry import query
from tenderloom.plans.sqltext import BARE_REF, HAS_CATEGORY, absorbed, similar, tokens
from tenderloom.plans.tables import AS_OF_TS, DuckDialect, Tables, doc_columns

# ---- stand-in inputs: bids whose blurbs say something, frameworks that share a package, packages as text ------------

LEAD = doc_columns(DuckDialect)["lead"].replace("doc_id", "ordinal")
FRAMEWORK = "'https://portal.example.gov/frameworks/' || CAST(ordinal % 97 AS STRING) || '/package.pdf'"
RAW = f"""raw AS (SELECT * REPLACE (concat_ws(' ', description, {LEAD}) AS description,
    list_transform(documents, lambda d: struct_pack(name := d.name, url := CASE WHEN d.name = 'Bid package' THEN {FRAMEWORK} ELSE d.url END, kind := d.kind)) AS documents) FROM bids)"""
PACKAGE_SCOPE = "'Replace the roof at Lot ' || CAST({id} AS STRING) || ', including flashing, drains and all incidental work of the site.'"
PACKAGE_TEXT = """concat('BID PACKAGE\\nProject Location: Lot ', id, ' depot\\nEstimated Value: $ ', id * 10 + 500,
    '\\nPerformance & Payment Bond Required:YES Bid Bond Required:', CASE WHEN id % 2 = 0 THEN 'YES' ELSE 'NO' END,
    '\\nCalendar Days for Project Completion: ', 30 + id % 90, ' days\\nLiquidated Damages: YES $$ Per Day:$333.71\\nScope of Work: ',
    """ + PACKAGE_SCOPE.format(id="id") + """, '\\nGENERAL CONDITIONS OF BID\\nboilerplate')"""
DETAIL_LINE = "A bid bond is required; inquiries by April 2, 2024 at 10:15 AM."


def raw_bids(t: Tables) -> DataFrame:
    documents = F.expr(f"""transform(documents, d -> named_struct('name', d.name, 'url', CASE WHEN d.name = 'Bid package' THEN {FRAMEWORK} ELSE d.url END,
        'kind', d.kind))""")
    return t.bids.withColumn("description", F.concat_ws(" ", "description", F.expr(LEAD))).withColumn("documents", documents)


def package_texts(bids: DataFrame) -> DataFrame:
    urls = bids.select(F.explode("documents.url").alias("url")).distinct().withColumn("id", F.regexp_extract("url", r"/(\d+)/", 1).cast("long"))
    return urls.filter("id % 3 <> 0").select("url", F.expr(PACKAGE_TEXT).alias("text"))


def details(bids: DataFrame) -> DataFrame:
    return bids.filter("ordinal % 5 = 1").select(
        "opportunity_id", F.expr("'desk' || CAST(ordinal % 7 AS STRING) || '@example.gov'").alias("contact_email"),
        F.expr("'Clerk ' || CAST(ordinal % 3 AS STRING)").alias("contact"), F.lit(DETAIL_LINE).alias("submittal_info"),
        F.expr("'Work order ' || CAST(ordinal AS STRING)").alias("scope"), F.array(F.lit("Licensed contractor")).alias("requirements"))


ARCHIVED = "status IN ('closed', 'cancelled', 'award') OR ordinal % 7 = 0"


def run(t: Tables) -> refresh.Refreshed:
    fetched = raw_bids(t)
    archive = t.bids.filter(ARCHIVED).select("opportunity_id", "agency", "title", "due_date")
    return refresh.refresh(fetched, refresh.Inputs(AS_OF_TS, details=details(fetched), package_texts=package_texts(fetched),
                                                   archive=archive, cities=gazetteer(t).cities))


# ---- the same run in SQL, step by step -----------------------------------------------------------------------------

WORTH = "status IN ('open', 'upcoming', 'award')"
AGED = f"""{RAW}, aged AS (SELECT * REPLACE (CASE WHEN status = 'open' AND (CASE WHEN due_date IS NOT NULL THEN due_date < TIMESTAMP '{AS_OF_TS}'
    ELSE coalesce(posted_date < CAST(TIMESTAMP '{AS_OF_TS}' AS DATE) - 180, false) END) THEN 'closed' ELSE status END AS status) FROM raw)"""
COLLAPSED = f"""{AGED}, {_SURVIVORS.replace('FROM bids', 'FROM aged')},
    gifts AS (SELECT sv.surv, count(*) AS merged, arg_min(k.due_date, k.pos) FILTER (k.due_date IS NOT NULL) AS due,
      arg_min(k.posted_date, k.pos) FILTER (k.posted_date IS NOT NULL) AS posted,
      arg_min(k.contact, k.pos) FILTER (coalesce(k.contact, '') <> '') AS contact, arg_min(k.budget, k.pos) FILTER (coalesce(k.budget, '') <> '') AS budget
      FROM sv JOIN k USING (pos) GROUP BY sv.surv),
    tag1 AS (SELECT surv, tag, min((CASE WHEN pos = surv THEN 0 ELSE pos END) * 100 + i) AS seq FROM (SELECT sv.surv, k.pos, unnest(k.categories) AS tag,
      generate_subscripts(k.categories, 1) AS i FROM sv JOIN k USING (pos)) GROUP BY surv, tag),
    tag2 AS (SELECT surv, list(tag ORDER BY seq) AS tags FROM tag1 GROUP BY surv),
    ded AS (SELECT k.* EXCLUDE (rk, tk, pos) REPLACE (coalesce(k.due_date, gifts.due) AS due_date, coalesce(k.posted_date, gifts.posted) AS posted_date,
        coalesce(NULLIF(k.contact, ''), gifts.contact, k.contact) AS contact, coalesce(NULLIF(k.budget, ''), gifts.budget, k.budget) AS budget,
        coalesce(tag2.tags, k.categories) AS categories), gifts.merged AS merged_records
      FROM gifts JOIN k ON k.pos = gifts.surv LEFT JOIN tag2 ON tag2.surv = gifts.surv)"""
DETAILED = f"""dt AS (SELECT * REPLACE (
      CASE WHEN got THEN coalesce(NULLIF(contact, ''), 'Clerk ' || (ordinal % 3)) ELSE contact END AS contact,
      CASE WHEN got THEN coalesce(NULLIF(contact_email, ''), 'desk' || (ordinal % 7) || '@example.gov') ELSE contact_email END AS contact_email,
      CASE WHEN got THEN coalesce(NULLIF(submittal_info, ''), '{DETAIL_LINE}') ELSE submittal_info END AS submittal_info,
      CASE WHEN got AND length('Work order ' || ordinal) > length(coalesce(scope, '')) THEN 'Work order ' || ordinal ELSE scope END AS scope,
      CASE WHEN got AND NOT list_contains(requirements, 'Licensed contractor') THEN requirements || ['Licensed contractor'] ELSE requirements END AS requirements)
    FROM (SELECT *, {WORTH} AND ordinal % 5 = 1 AS got FROM ded))"""
PRIMARY = f"""pd AS (SELECT ordinal, {BARE_REF} AS ref, unnest(documents) AS doc, generate_subscripts(documents, 1) AS place FROM {{rows}} WHERE {WORTH}),
    pk AS (SELECT ordinal, arg_min(doc.url, place + CASE WHEN doc.kind = 'addendum' THEN 2000 ELSE 0 END
      + CASE WHEN coalesce(length(ref) >= 5 AND contains(regexp_replace(lower(doc.name), '[^a-z0-9]', '', 'g'), ref), false) THEN 0 ELSE 1000 END) AS url
      FROM pd WHERE ends_with(split_part(lower(doc.url), '?', 1), '.pdf') GROUP BY ordinal),
    pf AS (SELECT ordinal, url, id FROM (SELECT *, CAST(regexp_extract(url, '/([0-9]+)/', 1) AS BIGINT) AS id FROM pk) WHERE id % 3 <> 0)"""
_PSCOPE = PACKAGE_SCOPE.format(id="pf.id")
PACKAGED = f"""{PRIMARY.format(rows='dt')},
    pa AS (SELECT dt.* REPLACE (coalesce('$' || (pf.id * 10 + 500), budget) AS budget, coalesce(NULLIF(project_location, ''), 'Lot ' || pf.id || ' depot', project_location) AS project_location,
        CAST(coalesce(NULLIF(duration_days, 0), 30 + pf.id % 90, duration_days) AS INTEGER) AS duration_days,
        CASE WHEN pf.id IS NULL THEN liquidated_damages ELSE coalesce(NULLIF(liquidated_damages, ''), '$333.71 per day') END AS liquidated_damages,
        CASE WHEN length({_PSCOPE}) > length(coalesce(scope, '')) THEN {_PSCOPE} ELSE scope END AS scope,
        CASE WHEN pf.id IS NULL THEN requirements ELSE requirements || CASE WHEN pf.id % 2 = 0 THEN ['Bid bond required'] ELSE CAST([] AS VARCHAR[]) END
          || ['Performance & payment bond required'] END AS requirements), pf.id IS NOT NULL AS parsed
      FROM dt LEFT JOIN pf USING (ordinal))"""
DERIVED = rf"""dv0 AS (SELECT *, concat_ws(chr(10), NULLIF(title, ''), NULLIF(description, ''), NULLIF(scope, ''), NULLIF(submittal_info, ''), NULLIF(contact, '')) AS b FROM pa),
    dv1 AS (SELECT *, requirements || list_filter([{_REQ_LIST}], lambda x: x IS NOT NULL) AS said, regexp_extract_all(b, '(?i){text.MONEY}') AS bare FROM dv0),
    dv2 AS (SELECT *, list_filter(said, lambda x, i: list_position(said, x) = i) AS once, list_transform(bare, lambda m: {_MONEY_NUMBER}) AS figures, {_NORM.replace('name', 'agency')} AS n FROM dv1),
    drv AS (SELECT * REPLACE ({absorbed('once')} AS requirements,
      coalesce(NULLIF(budget, ''), regexp_replace(regexp_replace(coalesce({_VALUE_CASES},
        CASE WHEN list_max(figures) >= 25000 THEN bare[list_position(figures, list_max(figures))] END), '\s+', '', 'g'), '(?i)(million|billion)$', ' \1')) AS budget,
      coalesce(NULLIF(pre_bid_meeting, ''), trim(regexp_replace(NULLIF(regexp_extract(b, '(?i){text.PRE_BID}'), ''), '\s+', ' ', 'g'), ' .;:')) AS pre_bid_meeting,
      coalesce(NULLIF(contact_email, ''), rtrim(NULLIF(regexp_extract(b, '(?i){text.EMAIL}'), ''), '.')) AS contact_email,
      coalesce(NULLIF(contact_phone, ''), trim(NULLIF(regexp_extract(b, '(?i){text.PHONE}'), ''))) AS contact_phone,
      CASE WHEN coalesce(tier, '') <> '' THEN tier WHEN n = '' THEN 'unknown' WHEN regexp_matches(n, '{geo.TIER_SCHOOL}') THEN 'school_district'
        WHEN regexp_matches(n, '{geo.TIER_HIGHER_ED}') THEN 'higher_ed' WHEN {_MARK} OR regexp_matches(n, '{geo.STATE_BODY}') THEN 'state'
        WHEN regexp_matches(n, '{geo.TIER_SPECIAL.replace("'", "''")}') THEN 'special_district' WHEN regexp_matches(n, '{geo.TIER_MUNICIPAL}') THEN 'municipal'
        WHEN regexp_matches(n, '\bcounty\b') THEN 'county' WHEN (CASE {_CITY_LONGEST} END) IS NOT NULL THEN 'municipal' ELSE 'unknown' END AS tier),
      try_strptime(trim(regexp_extract(b, '(?i){_Q}', 1) || ' ' || rtrim(regexp_extract(b, '(?i){_Q}', 2), '.')), {_DUE_FORMATS}) AS questions_due FROM dv2)"""
LINKED = f"""{LINKS.replace('FROM bids', 'FROM drv')},
    named AS (SELECT lk.ordinal, lk.linkage, t.external_id AS target_ref FROM lk JOIN drv t ON t.ordinal = lk.solicitation),
    won AS (SELECT lk.solicitation, arg_min(NULLIF(b.awarded_vendor, ''), b.ordinal) FILTER (NULLIF(b.awarded_vendor, '') IS NOT NULL) AS v,
      arg_min(b.award_amount, b.ordinal) FILTER (b.award_amount IS NOT NULL) AS a,
      arg_min(coalesce(b.award_date, b.posted_date), b.ordinal) FILTER (coalesce(b.award_date, b.posted_date) IS NOT NULL) AS d
      FROM lk JOIN drv b USING (ordinal) GROUP BY lk.solicitation),
    lkd AS (SELECT drv.* REPLACE (coalesce(NULLIF(drv.linked_ref, ''), CASE WHEN linkage = 'fuzzy' THEN target_ref END, drv.linked_ref) AS linked_ref,
        coalesce(NULLIF(drv.awarded_vendor, ''), won.v) AS awarded_vendor, coalesce(drv.award_amount, won.a) AS award_amount,
        coalesce(drv.award_date, won.d) AS award_date), linkage AS award_linkage
      FROM drv LEFT JOIN named USING (ordinal) LEFT JOIN won ON won.solicitation = drv.ordinal)"""
REFRESHED = f"{COLLAPSED}, {DETAILED}, {PACKAGED}, {DERIVED}, {LINKED}"


@query("refresh_run", f"""WITH RECURSIVE {REFRESHED},
    ar AS (SELECT opportunity_id, agency, due_date, {tokens('title')} AS toks FROM bids WHERE {ARCHIVED}),
    rc AS (SELECT o.ordinal, CAST(count(ar.opportunity_id) AS INTEGER) AS cycles, CAST(max(ar.due_date) AS DATE) AS last_closed
      FROM (SELECT *, {tokens('title')} AS toks FROM lkd) o LEFT JOIN ar ON lower(o.agency) = lower(ar.agency) AND ar.opportunity_id <> o.opportunity_id
        AND {similar('o.toks', 'ar.toks')} GROUP BY o.ordinal),
    br0 AS ({brief_sql('lkd')})
    SELECT ordinal, status, merged_records, budget, contact, contact_email, contact_phone, pre_bid_meeting, questions_due, tier,
      array_to_string(requirements, '; ') AS requirements, scope, project_location, duration_days, liquidated_damages, got AS detail_fetched, parsed AS package_parsed,
      awarded_vendor, award_amount, award_date, award_linkage, linked_ref, cycles AS prior_cycles, last_closed AS last_cycle_closed, brief
    FROM lkd JOIN rc USING (ordinal) JOIN br0 USING (ordinal)""", "bids")
def refresh_run(t: Tables) -> DataFrame:
    return run(t).opportunities.select(
        "ordinal", "status", "merged_records", "budget", "contact", "contact_email", "contact_phone", "pre_bid_meeting", "questions_due", "tier",
        F.array_join("requirements", "; ").alias("requirements"), "scope", "project_location", "duration_days", "liquidated_damages", "detail_fetched",
        "package_parsed", "awarded_vendor", "award_amount", "award_date", "award_linkage", "linked_ref", "prior_cycles", "last_cycle_closed", "brief")


@query("refresh_coverage", f"""WITH RECURSIVE {REFRESHED} SELECT source_id, count(*) AS records, count(*) FILTER ({HAS_CATEGORY}) AS with_category,
    count(*) FILTER (len(documents) > 0) AS with_documents, count(*) FILTER (due_date IS NOT NULL) AS with_due_date,
    count(*) FILTER (coalesce(budget, '') <> '') AS with_budget, count(*) FILTER (status = 'award') AS awards,
    count(*) FILTER (status = 'award' AND award_amount IS NOT NULL) AS with_award_amount,
    count(*) FILTER (status = 'award' AND coalesce(awarded_vendor, '') <> '') AS with_award_vendor FROM lkd GROUP BY source_id""", "bids")
def refresh_coverage(t: Tables) -> DataFrame:
    """Field coverage by source as the run stamps it: after mining and linking, before any filter."""
    return run(t).coverage


@query("package_fanout", f"""WITH {RAW}, {PRIMARY.format(rows='raw')}, u AS (SELECT url, count(*) AS shared FROM pf GROUP BY url)
    SELECT ordinal, url AS package_url, '$' || (id * 10 + 500) AS estimated_value, 'Lot ' || id || ' depot' AS project_location,
      CAST(30 + id % 90 AS INTEGER) AS duration_days, CASE WHEN id % 2 = 0 THEN 'Bid bond required; ' ELSE '' END || 'Performance & payment bond required' AS requirements, shared
    FROM pf JOIN u USING (url)""", "bids")
def package_fanout(t: Tables) -> DataFrame:
    """A package is read once and its terms go to every bid that shares it."""
    fetched = raw_bids(t).withColumn("package_parsed", F.lit(False))
    rows = refresh.package_rows(fetched, package_texts(fetched))
    shared = rows.groupBy("package_url").agg(F.count(F.lit(1)).alias("shared"))
    return rows.join(shared, "package_url").select("ordinal", "package_url", "facts.estimated_value", "facts.project_location", "facts.duration_days",
                                                   F.array_join("facts.requirements", "; ").alias("requirements"), "shared")


@query("derive_fields", rf"""WITH {RAW}, pa AS (SELECT * REPLACE (CASE WHEN ordinal % 4 = 1 THEN '' WHEN ordinal % 4 = 2 THEN NULL ELSE budget END AS budget) FROM raw), {DERIVED}
    SELECT ordinal, budget, pre_bid_meeting, questions_due, contact_email, contact_phone, tier, array_to_string(requirements, '; ') AS requirements FROM drv""", "bids")
def derive_fields(t: Tables) -> DataFrame:
    """Every field that prose can fill, over bids of which half state no budget."""
    from tenderloom.operators import facts
    bids = raw_bids(t).withColumn("budget", F.expr("CASE WHEN ordinal % 4 = 1 THEN '' WHEN ordinal % 4 = 2 THEN NULL ELSE budget END"))
    bids = bids.withColumn("questions_due", F.lit(None).cast("timestamp_ntz"))
    return facts.derive_fields(bids, gazetteer(t).cities).select("ordinal", "budget", "pre_bid_meeting", "questions_due", "contact_email", "contact_phone", "tier",
                                                                 F.array_join("requirements", "; ").alias("requirements"))


@query("requirement_absorb", f"""WITH r AS (SELECT ordinal, requirements || ['Bid bond required', 'Insurance', 'Living wage for the site', 'of the'] AS more FROM bids)
    SELECT ordinal, array_to_string({absorbed('more')}, '; ') AS labels FROM r""", "bids")
def requirement_absorb(t: Tables) -> DataFrame:
    more = F.concat("requirements", F.array(*[F.lit(x) for x in ("Bid bond required", "Insurance", "Living wage for the site", "of the")]))
    return t.bids.select("ordinal", F.array_join(dedupe.absorb_labels(more), "; ").alias("labels"))
