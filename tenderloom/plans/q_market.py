"""Filters and market reports over opportunities (families F and G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.functions import geo, text
from tenderloom.functions.base import count_if, sum_if
from tenderloom.operators import boards, filters, marts, ranking
from tenderloom.plans.registry import query
from tenderloom.plans.sqltext import BUDGET, DAYS, HAS_CATEGORY, LIVE, RANK, VALUE
from tenderloom.plans.tables import AS_OF, AS_OF_TS, Tables


def workflow(bids: DataFrame) -> DataFrame:
    """Tracked bids with stage and archive flag, derived from bid keys."""
    return bids.filter("ordinal % 6 = 2").select(
        "opportunity_id", "ordinal",
        F.expr("CASE ordinal % 5 WHEN 0 THEN 'watching' WHEN 1 THEN 'preparing' WHEN 2 THEN 'submitted' "
               "WHEN 3 THEN 'result' ELSE 'lost track' END").alias("stage"),
        F.expr("ordinal % 10 = 4").alias("archived"),
        F.expr("CASE WHEN ordinal % 4 = 0 THEN map('0', true) WHEN ordinal % 4 = 2 THEN map('0', false, '1', true) "
               "ELSE map() END").cast("map<string,boolean>").alias("checks"),
        F.expr("CAST(first_seen_at AS DATE)").alias("tracked_on"))


WORKFLOW = """wf AS (SELECT opportunity_id, ordinal,
    CASE ordinal % 5 WHEN 0 THEN 'watching' WHEN 1 THEN 'preparing' WHEN 2 THEN 'submitted'
      WHEN 3 THEN 'result' ELSE 'lost track' END AS stage, ordinal % 10 = 4 AS archived,
    CASE WHEN ordinal % 4 = 0 THEN ['0'] WHEN ordinal % 4 = 2 THEN ['1'] ELSE CAST([] AS VARCHAR[]) END AS ticked,
    CAST(first_seen_at AS DATE) AS tracked_on FROM bids WHERE ordinal % 6 = 2)"""


def results(bids: DataFrame) -> DataFrame:
    return bids.filter("ordinal % 6 = 2 AND ordinal % 5 = 3").select(
        "opportunity_id", F.expr("CASE WHEN ordinal % 4 = 0 THEN 'won' ELSE 'lost' END").alias("outcome"),
        F.expr("CASE WHEN ordinal % 8 = 0 THEN CAST(NULL AS BIGINT) ELSE ordinal * 100 END").alias("amount_cents"),
        F.expr("CAST(first_seen_at AS DATE)").alias("decided_on"))


RESULTS = """res AS (SELECT opportunity_id, CASE WHEN ordinal % 4 = 0 THEN 'won' ELSE 'lost' END AS outcome,
    CASE WHEN ordinal % 8 = 0 THEN NULL ELSE ordinal * 100 END AS amount_cents,
    CAST(first_seen_at AS DATE) AS decided_on FROM bids WHERE ordinal % 6 = 2 AND ordinal % 5 = 3)"""


@query("status_aging", f"""SELECT ordinal, CASE WHEN status = 'open' AND (CASE WHEN due_date IS NOT NULL
      THEN due_date < TIMESTAMP '{AS_OF_TS}' ELSE coalesce(posted_date < DATE '{AS_OF}' - 180, false) END)
    THEN 'closed' ELSE status END AS status FROM bids""", "bids")
def status_aging(t: Tables) -> DataFrame:
    return filters.age_status(t.bids, AS_OF_TS).select("ordinal", "status")


@query("filter_opportunities", f"""SELECT ordinal, status, title, {RANK} AS status_rank FROM bids
    WHERE {LIVE} AND contains(county, 'palm-beach') AND (list_contains(list_transform(categories, lambda c: lower(c)), 'building')
      OR contains(lower(offer_type), 'building')) AND lower(offer_type) = 'construction'
      AND (contains(lower(title), 'gear') OR contains(lower(coalesce(description, '')), 'gear')
        OR contains(lower(agency), 'gear') OR contains(lower(coalesce(external_id, '')), 'gear'))""", "bids")
def filter_opportunities(t: Tables) -> DataFrame:
    rows = filters.filter_opportunities(t.bids, open_only=True, county="Palm Beach", category="Building",
                                        offer_type="Construction", query="gear")
    return rows.orderBy(*filters.listing_order(), "ordinal").select(
        "ordinal", "status", "title", filters.status_rank().alias("status_rank"))


@query("panel_filter", f"""SELECT ordinal, {BUDGET} AS amount FROM bids WHERE status IN ('open', 'closed', 'cancelled')
    AND county IN ('broward', 'orange') AND offer_type IN ('goods', 'services') AND coalesce(tier, 'unknown') IN ('unknown', 'county')
    AND list_has_any(categories, ['automobile', 'small']) AND {BUDGET} >= 1000 AND {BUDGET} <= 400000
    AND NOT list_has_any(requirements, ['Bid bond'])""", "bids")
def panel_filter(t: Tables) -> DataFrame:
    rows = filters.panel_filter(t.bids, AS_OF, statuses=["open", "closed"], counties=["broward", "orange"],
                                offers=["goods", "services"], tiers=["unknown", "county"],
                                categories=["automobile", "small"], min_value=1000, max_value=400_000, no_bond=True)
    return rows.select("ordinal", text.budget_amount("budget").alias("amount"))


@query("panel_due_within", f"""SELECT ordinal, {DAYS} AS days FROM bids WHERE {LIVE} AND {DAYS} BETWEEN 0 AND 60
    AND prior_cycles > 0""", "bids")
def panel_due_within(t: Tables) -> DataFrame:
    rows = filters.panel_filter(t.bids, AS_OF, statuses=["open", "upcoming"], due_within=60, rebids_only=True)
    return rows.select("ordinal", text.days_until_due("due_date", AS_OF).alias("days"))


@query("text_search", """SELECT ordinal, title FROM bids WHERE contains(lower(concat_ws(' ', title, agency,
      coalesce(external_id, ''), coalesce(scope, ''), coalesce(description, ''))), 'gear')
    AND contains(lower(concat_ws(' ', title, agency, coalesce(external_id, ''), coalesce(scope, ''),
      coalesce(description, ''))), 'nation_1')""", "bids")
def text_search(t: Tables) -> DataFrame:
    return filters.text_search(t.bids, "Gear NATION_1", ["title", "agency", "external_id", "scope", "description"]) \
        .select("ordinal", "title")


@query("expiring_contracts", f"""SELECT order_key, line, part_key, supplier_key, name, end_date,
      CAST(date_diff('day', DATE '{AS_OF}', end_date) AS INTEGER) AS days_left
    FROM contracts WHERE date_diff('day', DATE '{AS_OF}', end_date) BETWEEN 0 AND 365""", "contracts")
def expiring_contracts(t: Tables) -> DataFrame:
    return filters.expiring(t.contracts, AS_OF).orderBy("end_date", "name").select(
        "order_key", "line", "part_key", "supplier_key", "name", "end_date", "days_left")


@query("expiry_summary", f"""SELECT CAST(count(CASE WHEN d BETWEEN 0 AND 365 THEN 1 END) AS BIGINT) AS expiring,
      CAST(count(CASE WHEN d BETWEEN 0 AND 90 THEN 1 END) AS BIGINT) AS imminent
    FROM (SELECT date_diff('day', DATE '{AS_OF}', end_date) AS d FROM contracts)""", "contracts")
def expiry_summary(t: Tables) -> DataFrame:
    return boards.expiry_summary(t.contracts, AS_OF)


@query("contracts_by_vendor", """SELECT vendor, count(*) AS contracts, CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS BIGINT) AS cents,
      max(end_date) AS last_end FROM contracts WHERE coalesce(vendor, '') <> '' GROUP BY vendor""", "contracts")
def contracts_by_vendor(t: Tables) -> DataFrame:
    return boards.by_vendor(t.contracts)


@query("contract_rank", f"""SELECT order_key, line, part_key, supplier_key, amount, end_date FROM contracts
    WHERE date_diff('day', DATE '{AS_OF}', end_date) BETWEEN 0 AND 180
    ORDER BY coalesce(amount, 0) DESC, end_date, order_key, line, part_key, supplier_key LIMIT 10""", "contracts")
def contract_rank(t: Tables) -> DataFrame:
    soon = filters.expiring(t.contracts, AS_OF, days=180)
    return soon.orderBy(F.coalesce("amount", F.lit(0.0)).desc(), "end_date", "order_key", "line", "part_key",
                        "supplier_key").limit(10).select("order_key", "line", "part_key", "supplier_key", "amount", "end_date")


@query("decided_recently", f"""SELECT ordinal, coalesce(award_date, posted_date) AS decided_on, award_amount,
      CAST(count(*) OVER () AS BIGINT) AS section_size, greatest(count(*) OVER () - 10, 0) AS more
    FROM bids WHERE status = 'award' AND coalesce(award_date, posted_date) >= DATE '{AS_OF}' - 7
    ORDER BY coalesce(award_amount, 0) DESC, coalesce(award_date, posted_date) DESC, ordinal LIMIT 10""", "bids")
def decided_recently(t: Tables) -> DataFrame:
    fresh = filters.decided_since(t.bids, AS_OF)
    order = [F.coalesce("award_amount", F.lit(0)).desc(), F.col("decided_on").desc(), F.col("ordinal").asc()]
    return ranking.capped(fresh, order, cap=10).select("ordinal", "decided_on", "award_amount", "section_size", "more")


@query("new_since", """SELECT ordinal, first_seen_at FROM bids WHERE status IN ('open', 'upcoming')
    AND first_seen_at > TIMESTAMP '2000-01-01 00:00:00'""", "bids")
def new_since(t: Tables) -> DataFrame:
    return filters.new_since(t.bids, "2000-01-01 00:00:00").orderBy(F.desc("first_seen_at"), "ordinal") \
        .select("ordinal", "first_seen_at")


@query("dashboard_totals", f"""WITH {WORKFLOW}, {RESULTS} SELECT
    (SELECT count(*) FROM bids WHERE status = 'open') AS open_count,
    (SELECT count(*) FROM bids WHERE status = 'upcoming') AS upcoming_count,
    (SELECT CAST(sum({VALUE}) AS BIGINT) FROM bids WHERE status = 'open') AS open_value,
    (SELECT count(*) FROM bids WHERE status = 'open' AND {DAYS} BETWEEN 0 AND 7) AS due_7d,
    (SELECT CAST(coalesce(sum({VALUE}), 0) AS BIGINT) FROM bids WHERE status = 'open' AND {DAYS} BETWEEN 0 AND 7) AS due_7d_value,
    (SELECT count(*) FROM wf WHERE NOT archived) AS tracked,
    (SELECT count(*) FROM res WHERE outcome = 'won') AS won, (SELECT count(*) FROM res WHERE outcome <> 'won') AS lost,
    (SELECT round_even(count(*) FILTER (outcome = 'won') / count(*), 3) FROM res) AS win_rate,
    (SELECT CAST(coalesce(sum(amount_cents), 0) AS BIGINT) FROM res WHERE outcome = 'won') AS revenue_cents""", "bids")
def dashboard_totals(t: Tables) -> DataFrame:
    from tenderloom.functions.base import with_scalars
    tracked = workflow(t.bids).agg(count_if(~F.col("archived")).alias("tracked"))
    return with_scalars(with_scalars(marts.dashboard_totals(t.bids, AS_OF), tracked), marts.win_loss(results(t.bids)))


@query("by_county", f"""SELECT county, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'upcoming') AS upcoming,
      CAST(sum({VALUE}) AS BIGINT) AS value FROM bids WHERE {LIVE} GROUP BY county""", "bids")
def by_county(t: Tables) -> DataFrame:
    return marts.by_county(t.bids).orderBy("county")


@query("by_type", f"""SELECT offer_type AS type, count(*) AS count, CAST(sum({VALUE}) AS BIGINT) AS value
    FROM bids WHERE status = 'open' GROUP BY offer_type""", "bids")
def by_type(t: Tables) -> DataFrame:
    return marts.by_type(t.bids).orderBy(F.desc("count"), "type")


@query("deadline_load", f"""WITH w AS (SELECT CAST(date_trunc('week', DATE '{AS_OF}') AS DATE) + 7 * CAST(i AS INTEGER) AS week
      FROM range(8) r(i)), b AS (SELECT CAST(date_trunc('week', due_date) AS DATE) AS week, {VALUE} AS value
      FROM bids WHERE status = 'open' AND due_date IS NOT NULL)
    SELECT w.week, count(b.week) AS count, CAST(coalesce(sum(b.value), 0) AS BIGINT) AS value
    FROM w LEFT JOIN b USING (week) GROUP BY w.week""", "bids")
def deadline_load(t: Tables) -> DataFrame:
    return marts.deadline_load(t.bids, AS_OF).orderBy("week")


@query("pipeline_stages", f"""WITH {WORKFLOW}, s(stage) AS (VALUES ('watching'), ('preparing'), ('submitted'), ('result'))
    SELECT s.stage, count(wf.opportunity_id) AS count, CAST(coalesce(sum({VALUE}), 0) AS BIGINT) AS value
    FROM s LEFT JOIN (SELECT * FROM wf WHERE NOT archived) wf USING (stage)
    LEFT JOIN (SELECT opportunity_id, budget FROM bids) b USING (opportunity_id) GROUP BY s.stage""", "bids")
def pipeline_stages(t: Tables) -> DataFrame:
    return marts.pipeline_stages(workflow(t.bids), t.bids)


@query("results_by_month", f"""WITH {RESULTS} SELECT strftime(decided_on, '%Y-%m') AS month,
    count(*) FILTER (outcome = 'won') AS won, count(*) FILTER (outcome <> 'won') AS lost,
    CAST(coalesce(sum(amount_cents) FILTER (outcome = 'won'), 0) AS BIGINT) AS revenue_cents FROM res GROUP BY 1""", "bids")
def results_by_month(t: Tables) -> DataFrame:
    return marts.results_by_month(results(t.bids)).orderBy("month")


COVERAGE = f"""count(*) AS records, count(*) FILTER ({HAS_CATEGORY}) AS with_category,
    count(*) FILTER (len(documents) > 0) AS with_documents, count(*) FILTER (due_date IS NOT NULL) AS with_due_date,
    count(*) FILTER (coalesce(budget, '') <> '') AS with_budget, count(*) FILTER (status = 'award') AS awards,
    count(*) FILTER (status = 'award' AND award_amount IS NOT NULL) AS with_award_amount,
    count(*) FILTER (status = 'award' AND coalesce(awarded_vendor, '') <> '') AS with_award_vendor"""


@query("coverage_counts", f"SELECT source_id, {COVERAGE} FROM bids GROUP BY source_id", "bids")
def coverage_counts(t: Tables) -> DataFrame:
    return marts.coverage_counts(t.bids)


_QUALITY = {
    "due_date": "due_date IS NOT NULL", "posted_date": "posted_date IS NOT NULL",
    "description": "coalesce(description, '') <> '' OR coalesce(scope, '') <> ''", "category": HAS_CATEGORY,
    "commodity_codes": "len(commodity_codes) > 0", "documents": "len(documents) > 0",
    "budget": "coalesce(budget, '') <> ''",
    "contact": "coalesce(contact, '') <> '' OR coalesce(contact_email, '') <> '' OR coalesce(contact_phone, '') <> ''",
    "external_id": "coalesce(external_id, '') <> ''", "tier": "coalesce(tier, '') NOT IN ('', 'unknown')",
    "awarded_vendor": "status = 'award' AND coalesce(awarded_vendor, '') <> ''",
    "award_amount": "status = 'award' AND award_amount IS NOT NULL",
}
_QUALITY_SQL = "\nUNION ALL ".join(
    f"SELECT source_id, count(*) AS records, count(*) FILTER (status = 'award') AS awards, '{name}' AS field, "
    f"count(*) FILTER ({test}) AS filled FROM bids WHERE status <> 'catalog' GROUP BY ROLLUP (source_id)"
    for name, test in _QUALITY.items())


@query("quality_report", f"""WITH q AS ({_QUALITY_SQL})
    SELECT source_id, records, awards, field, filled, CAST(round_even(100 * filled / NULLIF(CASE WHEN field IN
      ('awarded_vendor', 'award_amount') THEN awards ELSE records END, 0), 0) AS BIGINT) AS pct FROM q""", "bids")
def quality_report(t: Tables) -> DataFrame:
    return marts.quality_report(t.bids)


OFFERS = ("construction", "services", "goods", "professional_services", "mixed", "unknown")
_COUNTIES = [*geo.COUNTY_NAMES, *geo.PSEUDO_COUNTIES]


@query("facets", f"""WITH live AS (SELECT * FROM bids WHERE {LIVE}),
    c AS (SELECT 'category' AS facet, c AS key, count(*) AS count FROM (SELECT unnest(list_distinct(categories)) AS c FROM live) GROUP BY c
      UNION ALL SELECT 'county', county, count(*) FROM live GROUP BY county
      UNION ALL SELECT 'offer', offer_type, count(*) FROM live GROUP BY offer_type),
    f(facet, key) AS (VALUES {', '.join(f"('county', '{c}')" for c in _COUNTIES)}, {', '.join(f"('offer', '{o}')" for o in OFFERS)})
    SELECT facet, key, coalesce(count, 0) AS count,
      CASE WHEN facet = 'county' THEN {"CASE key " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**geo.COUNTY_NAMES, **geo.PSEUDO_COUNTIES}.items()) + " END"} END AS label,
      CASE WHEN facet = 'county' THEN {"CASE key " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**geo.COUNTY_REGION, **{p: p for p in geo.PSEUDO_COUNTIES}}.items()) + " END"} END AS region
    FROM f FULL JOIN c USING (facet, key)""", "bids")
def facets(t: Tables) -> DataFrame:
    is_county = F.col("facet") == "county"
    return marts.facet_counts(t.bids, _COUNTIES, OFFERS) \
        .withColumn("label", F.when(is_county, geo.county_label("key"))) \
        .withColumn("region", F.when(is_county, geo.region_of("key")))


@query("organize_groups", """SELECT 'county' AS grouping, county AS key, count(*) AS count FROM bids GROUP BY county
    UNION ALL SELECT 'offer', offer_type, count(*) FROM bids GROUP BY offer_type
    UNION ALL SELECT 'agency', agency, count(*) FROM bids GROUP BY agency
    UNION ALL SELECT 'category', c, count(*) FROM (SELECT unnest(CASE WHEN len(categories) > 0 THEN categories
      ELSE ['general'] END) AS c FROM bids) GROUP BY c""", "bids")
def organize_groups(t: Tables) -> DataFrame:
    return marts.group_sizes(t.bids)


@query("county_coverage", f"""SELECT count(DISTINCT county) FILTER (county IN ({', '.join(f"'{c}'" for c in geo.COUNTY_NAMES)})) AS covered,
    CAST({len(geo.COUNTY_NAMES)} AS INTEGER) AS counties FROM bids""", "bids")
def county_coverage(t: Tables) -> DataFrame:
    return t.bids.filter(F.col("county").isin(*geo.COUNTY_NAMES)).agg(
        F.countDistinct("county").alias("covered"), F.lit(len(geo.COUNTY_NAMES)).alias("counties"))


@query("award_totals", f"""WITH {WORKFLOW}, {RESULTS} SELECT (SELECT count(*) FROM bids WHERE status = 'award' AND award_amount IS NOT NULL) AS with_amount,
    (SELECT CAST(sum(award_amount) AS BIGINT) FROM bids WHERE status = 'award') AS total_awarded,
    (SELECT CAST(coalesce(sum(amount_cents), 0) AS BIGINT) FROM res WHERE outcome = 'won') AS pipeline_revenue""", "bids")
def award_totals(t: Tables) -> DataFrame:
    return boards.award_totals(t.bids, results(t.bids))


@query("union_sources", """WITH u AS (SELECT 0 AS feed_no, source_id, opportunity_id AS id, title, agency, award_amount AS dollars, due_date, awarded_vendor AS vendor FROM bids
    UNION ALL SELECT 1, source_id, contract_id, name, agency, NULL, NULL, vendor FROM contracts
    UNION ALL SELECT 2, 'archive', opportunity_id, title, agency, NULL, due_date, NULL FROM bids WHERE ordinal % 7 = 0)
    SELECT feed_no, source_id, count(*) AS records, count(due_date) AS dated, count(vendor) AS with_vendor, CAST(sum(dollars) AS BIGINT) AS dollars, min(title) AS first_title FROM u GROUP BY feed_no, source_id""",
       ("bids", "contracts"))
def union_sources(t: Tables) -> DataFrame:
    """Three feeds of different columns under one schema."""
    live = t.bids.select("source_id", F.col("opportunity_id").alias("id"), "title", "agency", F.col("award_amount").alias("dollars"), "due_date", F.col("awarded_vendor").alias("vendor"))
    held = t.contracts.select("source_id", F.col("contract_id").alias("id"), F.col("name").alias("title"), "agency", "vendor")
    old = t.bids.filter("ordinal % 7 = 0").select(F.lit("archive").alias("source_id"), F.col("opportunity_id").alias("id"), "title", "agency", "due_date")
    return boards.union_feeds([live, held, old]).groupBy("feed_no", "source_id").agg(
        F.count(F.lit(1)).alias("records"), F.count("due_date").alias("dated"), F.count("vendor").alias("with_vendor"), F.sum("dollars").alias("dollars"), F.min("title").alias("first_title"))