"""Scalar functions, prose mining and the two legal clocks (families J and K)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.functions import calendar, classify, dates, geo, keys, render, text
from tenderloom.operators import dedupe, scoring
from tenderloom.plans.q_market import WORKFLOW, workflow
from tenderloom.plans.registry import query
from tenderloom.plans.sqltext import BUDGET, DAYS, tokens
from tenderloom.plans.tables import AS_OF, DuckDialect, Tables, bid_columns
from tenderloom.session import scratch_path
from tenderloom.sources import snapshot


@query("stable_ids", """SELECT ordinal, substr(sha1(source_id || '|' || coalesce(external_id, '') || '|' || title || '|' || url), 1, 16)
    AS stable_id FROM bids""", "bids")
def stable_ids(t: Tables) -> DataFrame:
    return t.bids.select("ordinal", keys.opportunity_id("source_id", "external_id", "title", "url").alias("stable_id"))


@query("content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS digest FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", keys.content_hash("text").alias("digest"))


@query("vendor_ids", f"""SELECT vendor, count(*) AS rows, substr(sha1(regexp_replace(regexp_replace(lower(vendor), '{keys.LEGAL_FORMS}', '', 'g'),
    '[^a-z0-9]+', '', 'g')), 1, 16) AS vendor_id FROM contracts WHERE vendor IS NOT NULL GROUP BY vendor""", "contracts")
def vendor_ids(t: Tables) -> DataFrame:
    names = t.contracts.filter(F.col("vendor").isNotNull()).groupBy("vendor").agg(F.count(F.lit(1)).alias("rows"))
    return names.withColumn("vendor_id", keys.vendor_id("vendor"))


@query("budget_amount", f"SELECT ordinal, budget, {BUDGET} AS amount FROM bids", "bids")
def budget_amount(t: Tables) -> DataFrame:
    return t.bids.select("ordinal", "budget", text.budget_amount("budget").alias("amount"))


@query("days_until_due", f"SELECT ordinal, {DAYS} AS days FROM bids", "bids")
def days_until_due(t: Tables) -> DataFrame:
    return t.bids.select("ordinal", text.days_until_due("due_date", AS_OF).alias("days"))


DETAIL = """CAST(CASE WHEN coalesce(scope, '') <> '' THEN 22 ELSE 0 END + CASE WHEN len(documents) > 0 THEN 16 ELSE 0 END
    + CASE WHEN due_date IS NOT NULL THEN 13 ELSE 0 END + CASE WHEN len(requirements) > 0 THEN 9 ELSE 0 END
    + CASE WHEN coalesce(contact, '') <> '' OR coalesce(contact_email, '') <> '' THEN 8 ELSE 0 END
    + CASE WHEN coalesce(budget, '') <> '' THEN 8 ELSE 0 END + CASE WHEN coalesce(description, '') <> '' THEN 4 ELSE 0 END
    + CASE WHEN coalesce(external_id, '') <> '' THEN 3 ELSE 0 END
    + CASE WHEN coalesce(submittal_info, '') <> '' OR coalesce(pre_bid_meeting, '') <> '' THEN 2 ELSE 0 END
    + CASE WHEN coalesce(duration_days, 0) <> 0 THEN 5 ELSE 0 END + CASE WHEN coalesce(liquidated_damages, '') <> '' THEN 5 ELSE 0 END
    + CASE WHEN coalesce(licenses, '') <> '' THEN 3 ELSE 0 END + CASE WHEN coalesce(project_location, '') <> '' THEN 2 ELSE 0 END AS INTEGER)"""


@query("detail_score", f"SELECT ordinal, {DETAIL} AS score FROM bids", "bids")
def detail_score(t: Tables) -> DataFrame:
    return t.bids.select("ordinal", text.detail_score().alias("score"))


@query("normal_keys", """SELECT ordinal, CASE WHEN length(regexp_replace(lower(external_id), '[^a-z0-9]+', '', 'g')) >= 5
      THEN county || '|' || regexp_replace(lower(external_id), '[^a-z0-9]+', '', 'g') END AS ref_key,
    county || '|' || lower(agency) || '|' || trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))
      AS title_key FROM bids""", "bids")
def normal_keys(t: Tables) -> DataFrame:
    return t.bids.select("ordinal", keys.ref_key("county", "external_id").alias("ref_key"),
                         keys.title_key("county", "agency", "title").alias("title_key"))


@query("significant_tokens", f"SELECT ordinal, array_to_string({tokens('title')}, ' ') AS words FROM bids", "bids")
def significant_tokens(t: Tables) -> DataFrame:
    return t.bids.select("ordinal", F.array_join(keys.significant_tokens("title"), " ").alias("words"))


# Accented letters count as letters on both sides; the twin's engine has ASCII word boundaries only.
FOLDED = r"regexp_replace(lead || chr(10) || scope, '[^\x00-\x7F]', 'x', 'g')"
LEAD_AND_SCOPE = ("lead", "scope")


def _sql_quote(pattern: str) -> str:
    return pattern.replace("'", "''")


def _found(pattern: str, source: str) -> str:
    return f"regexp_matches({source}, '(?i){_sql_quote(pattern)}')"


_TYPE_CASES = " ".join(f"WHEN {_found(p, 'b')} THEN '{k}'" for p, k in text.SOLICITATION_TYPES)


@query("solicitation_type", f"""SELECT doc_id, CASE {_TYPE_CASES} ELSE 'UNKNOWN' END AS solicitation_type
    FROM (SELECT doc_id, {FOLDED} AS b FROM docs)""", "docs")
def solicitation_type(t: Tables) -> DataFrame:
    return t.docs.select("doc_id", text.solicitation_type(text.joined_text(*LEAD_AND_SCOPE)).alias("solicitation_type"))


_ID_CASES = ", ".join(f"NULLIF(regexp_extract(b, '(?i){_sql_quote(p)}', 1), '')" for p in text.EXTERNAL_ID_PATTERNS)


@query("external_id", rf"""SELECT doc_id, trim(regexp_replace(coalesce({_ID_CASES}), '\s+', ' ', 'g')) AS external_id
    FROM (SELECT doc_id, {FOLDED} AS b FROM docs)""", "docs")
def external_id(t: Tables) -> DataFrame:
    return t.docs.select("doc_id", text.external_id(text.joined_text(*LEAD_AND_SCOPE)).alias("external_id"))


_REQ_LIST = ", ".join(f"CASE WHEN {_found(p, 'b')} THEN '{k}' END" for k, p in text.REQUIREMENTS)


@query("requirements", f"""SELECT doc_id, array_to_string(list_filter([{_REQ_LIST}], lambda x: x IS NOT NULL), '; ') AS labels
    FROM (SELECT doc_id, {FOLDED} AS b FROM docs)""", "docs")
def requirements(t: Tables) -> DataFrame:
    return t.docs.select("doc_id", F.array_join(text.requirement_labels(text.joined_text(*LEAD_AND_SCOPE)), "; ").alias("labels"))


_MONEY_NUMBER = r"""CASE WHEN contains(lower(m), 'million') OR regexp_matches(m, '\dM\b') THEN 1000000.0
    WHEN contains(lower(m), 'billion') THEN 1000000000.0 WHEN regexp_matches(m, '\dK\b') THEN 1000.0 ELSE 1.0 END
    * coalesce(TRY_CAST(regexp_replace(m, '[^0-9.]', '', 'g') AS DOUBLE), 0.0)"""
_VALUE_CASES = ", ".join(f"NULLIF(regexp_extract(b, '(?i){p}', 1), '')" for p in text.VALUE_PATTERNS)


@query("estimated_value", rf"""WITH f AS (SELECT doc_id, {FOLDED} AS b FROM docs),
    m AS (SELECT doc_id, b, regexp_extract_all(b, '(?i){text.MONEY}') AS bare FROM f),
    n AS (SELECT *, list_transform(bare, lambda m: {_MONEY_NUMBER}) AS figures FROM m)
    SELECT doc_id, regexp_replace(regexp_replace(coalesce({_VALUE_CASES},
      CASE WHEN list_max(figures) >= 25000 THEN bare[list_position(figures, list_max(figures))] END), '\s+', '', 'g'),
      '(?i)(million|billion)$', ' \1') AS value FROM n""", "docs")
def estimated_value(t: Tables) -> DataFrame:
    return t.docs.select("doc_id", text.estimated_value(text.joined_text(*LEAD_AND_SCOPE)).alias("value"))


_Q = _sql_quote(text.QUESTIONS)
_DUE_FORMATS = "['%B %d, %Y %I:%M %p', '%B %d, %Y', '%m/%d/%Y %I:%M %p', '%m/%d/%Y']"


@query("contact_fields", rf"""WITH f AS (SELECT doc_id, {FOLDED} AS b FROM docs)
    SELECT doc_id, trim(regexp_replace(NULLIF(regexp_extract(b, '(?i){text.PRE_BID}'), ''), '\s+', ' ', 'g'), ' .;:') AS pre_bid,
      try_strptime(trim(regexp_extract(b, '(?i){_Q}', 1) || ' ' || rtrim(regexp_extract(b, '(?i){_Q}', 2), '.')), {_DUE_FORMATS}) AS questions_due,
      rtrim(NULLIF(regexp_extract(b, '(?i){text.EMAIL}'), ''), '.') AS email, trim(NULLIF(regexp_extract(b, '(?i){text.PHONE}'), '')) AS phone
    FROM f""", "docs")
def contact_fields(t: Tables) -> DataFrame:
    blob = text.joined_text(*LEAD_AND_SCOPE)
    return t.docs.select("doc_id", text.pre_bid_meeting(blob).alias("pre_bid"), text.questions_due(blob).alias("questions_due"),
                         text.contact_email(blob).alias("email"), text.contact_phone(blob).alias("phone"))


def _category_case(c: classify.Category, offers: dict[str, str]) -> str:
    up = f"'{c.umbrella}'" if c.umbrella else "NULL"
    vote = f"'{offers[c.umbrella]}'" if c.umbrella else "NULL"
    return "CASE " + " ".join(f"WHEN {_found(p, 'b')} THEN {{'slug': '{c.slug}', 'offer': '{c.offer}', 'umbrella': {up}, 'vote': {vote}, "
                              f"'kw': lower(regexp_extract(b, '(?i){_sql_quote(p)}'))}}" for p in c.patterns) + " END"


def _distinct(names: str) -> str:
    return f"list_filter({names}, lambda x, i: x IS NOT NULL AND list_position({names}, x) = i)"


def classify_sql(taxonomy: tuple[classify.Category, ...], source: str, key: str) -> str:
    """CTE `g`: key, b, tags, votes and keywords by trying every pattern of every category."""
    offers = {c.slug: c.offer for c in taxonomy}
    cases = ", ".join(_category_case(c, offers) for c in taxonomy if c.patterns)
    return f"""h AS (SELECT *, list_filter([{cases}], lambda x: x IS NOT NULL)[1:8] AS hits FROM {source}),
    d AS (SELECT *, list_transform(hits, lambda x: x.slug) || list_transform(hits, lambda x: x.umbrella) AS named,
      list_transform(hits, lambda x: x.offer) || list_transform(hits, lambda x: x.vote) AS voted, list_transform(hits, lambda x: trim(x.kw)) AS kws FROM h),
    g AS (SELECT *, {_distinct('named')} AS tags, {_distinct('voted')} AS votes, {_distinct('kws')} AS keywords FROM d)"""


CLASSIFIED = """CASE WHEN len(tags) = 0 THEN 'general' ELSE array_to_string(tags, ',') END AS categories,
      CASE WHEN len(votes) = 0 THEN 'unknown' WHEN list_contains(votes, 'construction') THEN 'construction'
        WHEN list_contains(votes, 'professional_services') AND NOT list_contains(votes, 'goods') THEN 'professional_services'
        WHEN list_contains(votes, 'goods') AND NOT list_contains(votes, 'services') THEN 'goods'
        WHEN list_contains(votes, 'services') THEN 'services' ELSE votes[1] END AS offer_type, array_to_string(keywords, ',') AS keywords"""


@query("classify", f"""WITH f AS (SELECT doc_id, {FOLDED} AS b FROM docs), {classify_sql(classify.STARTER, 'f', 'doc_id')}
    SELECT doc_id, {CLASSIFIED} FROM g""", "docs")
def classify_docs(t: Tables) -> DataFrame:
    return classify.classify(t.docs, text.joined_text(*LEAD_AND_SCOPE)).select(
        "doc_id", F.array_join("categories", ",").alias("categories"), "offer_type", F.array_join("keywords", ",").alias("keywords"))


# A taxonomy of more than two hundred categories by rule, over sounds of the invented prose: each sound pair is a category,
# every third one below a pair of its first sound with itself.
SOUNDS = ("than", "here", "ting", "nth", "onti", "erch", "ich", "sch", "ung", "ein", "eau", "que", "reo", "tion", "ment")
WIDE = classify.STARTER[:-1] + tuple(
    classify.Category(f"{a}_{b}", f"Kind {a.upper()}/{b}", a, ("goods", "services", "construction", "professional_services", "mixed")[(i * 4 + j) % 5],
                      (rf"\b{a}{b}\s+{a}", rf"\b{a}{b}(?:s|en)?\b", rf"{b}{b}{a}|{a}{a}{b}"), f"{a}_{a}" if (i + j) % 3 == 0 and i != j else None)
    for i, a in enumerate(SOUNDS) for j, b in enumerate(SOUNDS)) + classify.STARTER[-1:]


def wide_taxonomy(t: Tables) -> tuple[classify.Category, ...]:
    """The generated taxonomy, written as JSON rows to the shared folder and loaded as a deployment loads its own."""
    path = scratch_path(t.spark, "taxonomy")
    rows = [(i, c.slug, c.label, c.group, c.offer, list(c.patterns), c.umbrella) for i, c in enumerate(WIDE)]
    kind = "position int, slug string, label string, group string, offer string, patterns array<string>, umbrella string"
    t.spark.createDataFrame(rows, kind).write.json(path)
    return classify.read_taxonomy(t.spark, path)


_LABELS = "map {" + ", ".join(f"'{c.slug}': '{c.label}'" for c in WIDE) + "}"


@query("enrich", f"""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Ref-' || doc_id WHEN doc_id % 3 = 1 THEN '' END AS ext,
      regexp_replace(lead, '[^\\x00-\\x7F]', 'x', 'g') AS title, regexp_replace(scope, '[^\\x00-\\x7F]', 'x', 'g') AS description FROM docs),
    f AS (SELECT *, coalesce(title, '') || chr(10) || coalesce(description, '') AS b, coalesce(title, '') || ' ' || coalesce(description, '') AS w FROM e),
    {classify_sql(WIDE, 'f', 'doc_id')}, x AS (SELECT * EXCLUDE (b), coalesce(ext, '') || ' ' || w AS b FROM g),
    y AS (SELECT *, CASE {_TYPE_CASES} ELSE 'UNKNOWN' END AS solicitation_type FROM x), z AS (SELECT * EXCLUDE (b), w AS b FROM y)
    SELECT doc_id, solicitation_type, coalesce(NULLIF(ext, ''), trim(regexp_replace(coalesce({_ID_CASES}), '\\s+', ' ', 'g'))) AS external_id, {CLASSIFIED},
      coalesce(({_LABELS})[coalesce(tags[1], 'general')], '?') AS label,
      array_to_string(list_transform(tags, lambda s: upper(left(replace(s, '_', ' '), 1)) || substr(replace(s, '_', ' '), 2)), '; ') AS plain_labels FROM z""", "docs")
def enrich_docs(t: Tables) -> DataFrame:
    """Type, reference, work categories and their labels, under a taxonomy of more than two hundred categories."""
    ext = F.expr("CASE WHEN doc_id % 3 = 0 THEN 'Ref-' || CAST(doc_id AS STRING) WHEN doc_id % 3 = 1 THEN '' END")
    given = t.docs.select("doc_id", F.col("lead").alias("title"), F.col("scope").alias("description"), ext.alias("external_id"))
    taxonomy = wide_taxonomy(t)
    rich = classify.enrich(given, taxonomy)
    tags = F.filter("categories", lambda c: c != "general")
    return rich.select("doc_id", "solicitation_type", "external_id", F.array_join("categories", ",").alias("categories"), "offer_type",
                       F.array_join("keywords", ",").alias("keywords"), classify.category_label(F.get("categories", F.lit(0)), taxonomy).alias("label"),
                       F.array_join(F.transform(tags, lambda c: classify.category_label(c, ())), "; ").alias("plain_labels"))


@query("umbrella_expand", """SELECT ordinal, array_to_string(CASE WHEN list_contains(categories, 'building') THEN
      list_filter(['roofing', 'construction'] || categories, lambda x: true) ELSE ['software'] || categories END, ',') AS expanded FROM bids""", "bids")
def umbrella_expand(t: Tables) -> DataFrame:
    tagged = F.when(F.array_contains("categories", "building"), F.concat(F.array(F.lit("roofing")), "categories")) \
        .otherwise(F.concat(F.array(F.lit("software")), "categories"))
    return t.bids.select("ordinal", F.array_join(classify.expand_umbrellas(tagged, classify.STARTER), ",").alias("expanded"))


@query("default_categories", """SELECT ordinal, array_to_string(['paving', 'medium'] || list_filter(categories, lambda c: c NOT IN ('general', 'medium')), ',') AS categories FROM bids""", "bids")
def default_categories(t: Tables) -> DataFrame:
    return t.bids.select("ordinal", F.array_join(classify.default_categories(F.col("categories"), ["paving", "medium"]), ",").alias("categories"))


AGENCY_SQL = """CASE ordinal % 16 WHEN 0 THEN 'City of Miami Beach Purchasing' WHEN 1 THEN 'Sarasota Schools' WHEN 2 THEN 'Miami-Dade County'
    WHEN 3 THEN 'Florida Department of Health' WHEN 4 THEN 'St. Johns County Board' WHEN 5 THEN 'Town of Davie' WHEN 6 THEN 'Leon Sheriff'
    WHEN 7 THEN 'Broward College' WHEN 8 THEN 'Agency for Persons' WHEN 9 THEN 'Port of Palm Beach' WHEN 10 THEN 'Hialeah' WHEN 11 THEN ''
    WHEN 12 THEN 'Pasco County Public Schools' WHEN 13 THEN 'North Miami Beach Utilities' ELSE agency END"""
CITIES = [("miami beach", "miami-dade"), ("north miami beach", "miami-dade"), ("miami", "miami-dade"), ("davie", "broward"),
          ("hialeah", "miami-dade"), ("naples", "collier")]
INSTITUTIONS = {"broward college": "broward", "port of palm beach": "palm-beach"}
_NORM = "regexp_replace(replace(trim(lower(name)), '.', ''), '\\s+', ' ', 'g')"
_MARK = " OR ".join(f"contains(n, '{m}')" for m in geo.STATEWIDE_MARKERS)
_SPELL = geo.county_spellings()
_SPELL_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SPELL.items())
_CITY_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CITIES)
_CITY_LONGEST = " ".join(f"WHEN regexp_matches(n, '\\b{k}\\b') THEN '{v}'" for k, v in sorted(CITIES, key=lambda c: -len(c[0])))
_COUNTY_LONGEST = " ".join(f"WHEN regexp_matches(n, '\\b{k}\\b') THEN '{v}'" for k, v in sorted(_SPELL.items(), key=lambda c: -len(c[0])))
_TAIL = geo.CITY_TAIL


def gazetteer(t: Tables) -> geo.Gazetteer:
    return geo.Gazetteer(t.spark.createDataFrame([(*c, i) for i, c in enumerate(CITIES)], "needle string, slug string, position int"), INSTITUTIONS)


@query("infer_county", rf"""WITH a AS (SELECT ordinal, {AGENCY_SQL} AS name, CASE ordinal % 40 WHEN 14 THEN 'St. Lucie' WHEN 15 THEN 'federal' END AS hint FROM bids),
    b AS (SELECT *, {_NORM} AS n, replace(trim(lower(hint)), '.', '') AS h FROM a)
    SELECT ordinal, coalesce(CASE h {_SPELL_CASE} END, CASE WHEN hint = 'federal' THEN 'federal' END,
      CASE WHEN n = '' THEN 'unknown' END, CASE trim(regexp_extract(n, '\b([a-z][a-z'' -]+?)\s+county\b', 1)) {_SPELL_CASE} END,
      CASE WHEN {_MARK} OR regexp_matches(n, '{geo.STATE_BODY}') THEN 'statewide' END,
      CASE WHEN contains(n, 'broward college') THEN 'broward' WHEN contains(n, 'port of palm beach') THEN 'palm-beach' END,
      CASE trim(regexp_replace(regexp_extract(n, '\b(?:city|town|village) of ([a-z'' .-]+)', 1), '{_TAIL}', '')) {_CITY_CASE} END,
      CASE {_CITY_LONGEST} END, CASE {_COUNTY_LONGEST} END, 'unknown') AS slug FROM b""", "bids")
def infer_county(t: Tables) -> DataFrame:
    named = t.bids.select("ordinal", F.expr(AGENCY_SQL).alias("name"),
                          F.expr("CASE ordinal % 40 WHEN 14 THEN 'St. Lucie' WHEN 15 THEN 'federal' END").alias("hint"))
    return geo.infer_counties(named, gazetteer(t), agency="name", hint="hint", out="slug").select("ordinal", "slug")


@query("infer_tier", rf"""WITH a AS (SELECT ordinal, county, {AGENCY_SQL} AS name FROM bids), b AS (SELECT *, {_NORM} AS n FROM a)
    SELECT ordinal, CASE WHEN county = 'orange' AND ordinal % 5 = 0 THEN 'federal' WHEN n = '' THEN 'unknown'
      WHEN regexp_matches(n, '{geo.TIER_SCHOOL}') THEN 'school_district' WHEN regexp_matches(n, '{geo.TIER_HIGHER_ED}') THEN 'higher_ed'
      WHEN {_MARK} OR regexp_matches(n, '{geo.STATE_BODY}') THEN 'state' WHEN regexp_matches(n, '{geo.TIER_SPECIAL.replace("'", "''")}') THEN 'special_district'
      WHEN regexp_matches(n, '{geo.TIER_MUNICIPAL}') THEN 'municipal' WHEN regexp_matches(n, '\bcounty\b') THEN 'county'
      WHEN (CASE {_CITY_LONGEST} END) IS NOT NULL THEN 'municipal' ELSE 'unknown' END AS tier FROM b""", "bids")
def infer_tier(t: Tables) -> DataFrame:
    named = t.bids.select("ordinal", F.expr(AGENCY_SQL).alias("name"),
                          F.expr("CASE WHEN county = 'orange' AND ordinal % 5 = 0 THEN 'federal' ELSE county END").alias("county"))
    return geo.infer_tiers(named, gazetteer(t).cities, agency="name", out="tier").select("ordinal", "tier")


@query("parse_dates", """WITH d AS (SELECT o_orderkey, o_orderdate AS d, CAST(o_orderkey % 9 AS INTEGER) AS k FROM orders)
    SELECT o_orderkey, CASE k WHEN 0 THEN d - INTERVAL 5 HOUR WHEN 1 THEN d + INTERVAL 930 MINUTE WHEN 2 THEN d + INTERVAL 795 MINUTE
      WHEN 3 THEN d WHEN 6 THEN d + INTERVAL 9 HOUR WHEN 7 THEN d - INTERVAL 7 HOUR WHEN 8 THEN d END AS parsed, k = 8 AS bare FROM d""")
def parse_dates(t: Tables) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 9

    def day(fmt: str):
        return F.date_format(d, fmt)

    written = (F.when(k == 0, F.concat(day("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
               .when(k == 1, F.concat(day("MM/dd/yyyy"), F.lit(" 3:30 PM")))
               .when(k == 2, F.concat(day("MMMM dd, yyyy"), F.lit(" 2:15PM EDT")))
               .when(k == 3, day("yyyy-MM-dd")).when(k == 4, F.lit("TBD")).when(k == 5, F.lit(""))
               .when(k == 6, F.concat(day("MMM dd, yyyy"), F.lit(" at 9:00 a.m.")))
               .when(k == 7, F.concat(day("yyyy-MM-dd HH:mm:ss"), F.lit("+02:00"))).otherwise(day("MM/dd/yyyy")))
    return t.orders.select("o_orderkey", written.alias("w")).select(
        "o_orderkey", dates.parse_timestamp("w").alias("parsed"), dates.looks_like_bare_date("w").alias("bare"))


@query("utc_to_local", """SELECT event_id, timezone('America/New_York', timezone('UTC', ts + to_days(CAST(event_id % 365 AS INTEGER)))) AS local_ts FROM events""")
def utc_to_local(t: Tables) -> DataFrame:
    moved = F.col("ts") + F.make_dt_interval((F.col("event_id") % 365).cast("int"))
    return t.events.select("event_id", dates.utc_to_new_york(moved).alias("local_ts"))


@query("money_display", f"""WITH v AS (SELECT ordinal, {BUDGET} * (CASE WHEN ordinal % 3 = 0 THEN 17 WHEN ordinal % 3 = 1 THEN 1 ELSE 0 END)
      + CASE WHEN ordinal % 3 = 2 THEN ordinal % 1000 ELSE 0 END AS n FROM bids)
    SELECT ordinal, CASE WHEN n >= 1000000 THEN '$' || regexp_replace(format('{{:.1f}}', round_even(n / 1000000, 1)), '\\.0$', '') || 'M'
      WHEN n >= 1000 THEN '$' || CAST(round_even(n / 1000, 0) AS BIGINT) || 'k' WHEN n IS NOT NULL THEN '$' || n END AS shown FROM v""", "bids")
def money_display(t: Tables) -> DataFrame:
    n = F.expr("CASE WHEN ordinal % 3 = 0 THEN 17 WHEN ordinal % 3 = 1 THEN 1 ELSE 0 END") * text.budget_amount("budget") \
        + F.expr("CASE WHEN ordinal % 3 = 2 THEN ordinal % 1000 ELSE 0 END")
    return t.bids.select("ordinal", render.short_money(n).alias("shown"))


def brief_sql(rows: str) -> str:
    return f"""WITH b AS (SELECT *, {DAYS} AS days, trim(regexp_replace(coalesce(description, ''), '\\s+', ' ', 'g')) AS d0,
      CASE WHEN length(d0) > 180 THEN substr(d0, 1, 177) || '...' ELSE d0 END AS d,
      concat_ws('; ', CASE WHEN offer_type <> 'unknown' THEN replace(offer_type, '_', ' ') END,
        CASE WHEN len(categories) > 0 THEN array_to_string(categories[1:3], '/') END) AS cat FROM {rows})
    SELECT ordinal, concat_ws(' ', '[' || CASE WHEN solicitation_type = 'UNKNOWN' THEN 'BID' ELSE upper(solicitation_type) END || '] ' || agency || ': ' || trim(title),
      'Ref ' || NULLIF(external_id, '') || '.',
      CASE WHEN due_date IS NOT NULL THEN 'Closes ' || strftime(due_date, '%b %d, %Y %H:%M') || ' (' || CASE WHEN days < 0 THEN 'CLOSED ' || abs(days) || 'd ago'
        WHEN days = 0 THEN 'DUE TODAY' WHEN days <= 7 THEN 'due in ' || days || 'd (URGENT)' ELSE 'due in ' || days || 'd' END || ').'
        WHEN status = 'upcoming' THEN 'Upcoming / planned solicitation.' WHEN status = 'catalog' THEN 'Portal directory entry — register to see live bids.'
        ELSE 'Due date not published on listing.' END,
      CASE WHEN cat <> '' THEN 'Category: ' || cat || '.' END, 'Budget: ' || NULLIF(budget, '') || '.', 'Dept: ' || NULLIF(department, '') || '.',
      'Contact: ' || NULLIF(contact, '') || '.', CASE WHEN d <> '' AND NOT contains(lower(title), lower(d)) THEN d END) AS brief FROM b"""


@query("brief_text", brief_sql("bids"), "bids")
def brief_text(t: Tables) -> DataFrame:
    return t.bids.select("ordinal", render.brief(AS_OF).alias("brief"))


@query("margin_score", f"""WITH m AS (SELECT *, CASE WHEN coalesce(budget, '') <> '' AND coalesce(duration_days, 0) <> 0 THEN {BUDGET} / duration_days END AS pd,
      {DETAIL} AS ds FROM bids),
    r AS (SELECT *, list_has_any(requirements, ['Bid bond']) AS bond, list_has_any(requirements, ['SBE/MBE/DBE participation']) AS comp FROM m)
    SELECT ordinal, CAST(greatest(15, least(90, 60 - CASE WHEN prior_cycles > 0 THEN 10 ELSE 0 END - CASE WHEN coalesce(liquidated_damages, '') <> '' THEN 10 ELSE 0 END
      - CASE WHEN bond THEN 5 ELSE 0 END - CASE WHEN comp THEN 5 ELSE 0 END + CASE WHEN pd >= 3000 THEN 10 WHEN pd < 1000 THEN -10 ELSE 0 END
      - CASE WHEN ds < 50 THEN 5 ELSE 0 END)) AS INTEGER) AS score,
      concat_ws(' · ', 'baseline 60', CASE WHEN prior_cycles > 0 THEN 'rebid — likely a priced incumbent (−10)' END,
        'liquidated damages ' || NULLIF(liquidated_damages, '') || ' (−10)', CASE WHEN bond THEN 'bonding costs (−5)' END,
        CASE WHEN comp THEN 'compliance overhead — wage/participation terms (−5)' END,
        CASE WHEN pd >= 3000 THEN 'roomy schedule at ~$' || format('{{:,}}', CAST(round_even(pd, 0) AS BIGINT)) || '/day (+10)'
          WHEN pd < 1000 THEN 'tight at ~$' || format('{{:,}}', CAST(round_even(pd, 0) AS BIGINT)) || '/day (−10)' END,
        CASE WHEN ds < 50 THEN 'thin listing — unknowns cost margin (−5)' END) AS reasons FROM r""", "bids")
def margin_score(t: Tables) -> DataFrame:
    return scoring.margin_scores(t.bids).select("ordinal", F.col("margin_score").alias("score"), F.col("margin_reasons").alias("reasons"))


@query("capacity_band", f"""WITH {WORKFLOW}, c AS (SELECT opportunity_id, due_date FROM bids JOIN (SELECT opportunity_id FROM wf WHERE NOT archived
      AND stage IN ('preparing', 'submitted')) USING (opportunity_id) WHERE due_date IS NOT NULL),
    n AS (SELECT b.ordinal, b.due_date, CAST(count(c.opportunity_id) AS BIGINT) AS near FROM bids b LEFT JOIN c ON c.opportunity_id <> b.opportunity_id
      AND c.due_date BETWEEN b.due_date - INTERVAL 14 DAY AND b.due_date + INTERVAL 14 DAY GROUP BY ALL)
    SELECT ordinal, near, CAST(CASE WHEN due_date IS NULL THEN 60 ELSE greatest(10, least(90, 90 - 20 * near)) END AS INTEGER) AS score FROM n""", "bids")
def capacity_band(t: Tables) -> DataFrame:
    active = workflow(t.bids).filter(~F.col("archived") & F.col("stage").isin("preparing", "submitted"))
    committed = active.select("opportunity_id").join(t.bids.select("opportunity_id", "due_date"), "opportunity_id")
    return scoring.capacity_scores(t.bids.select("ordinal", "opportunity_id", "due_date"), committed) \
        .select("ordinal", "near", F.col("capacity_score").alias("score"))


@query("fit_score", f"""WITH {WORKFLOW}, tr AS (SELECT b.opportunity_id, b.ordinal, b.offer_type, b.county FROM bids b JOIN wf USING (opportunity_id) WHERE NOT wf.archived),
    won AS (SELECT DISTINCT offer_type FROM bids WHERE ordinal % 6 = 2 AND ordinal % 5 = 3 AND ordinal % 4 = 0 AND offer_type <> 'goods'),
    o AS (SELECT offer_type, count(*) AS n, min(ordinal) AS f1, list_sort(list(ordinal))[2] AS f2 FROM tr GROUP BY offer_type),
    x AS (SELECT b.ordinal, b.offer_type, b.county, tr.ordinal IS NOT NULL AS mine, CASE b.ordinal % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 0 END AS hits
      FROM bids b LEFT JOIN tr USING (opportunity_id)),
    md AS (SELECT x.ordinal, arg_max(o.offer_type, (o.n - CASE WHEN x.mine AND o.offer_type = x.offer_type THEN 1 ELSE 0 END) * 100000000000
        - CASE WHEN x.mine AND o.f1 = x.ordinal THEN o.f2 ELSE o.f1 END) AS modal FROM x CROSS JOIN o GROUP BY x.ordinal),
    cc AS (SELECT county, count(*) AS cn FROM tr GROUP BY county),
    s AS (SELECT x.*, modal <> 'unknown' AND modal = x.offer_type AS same, coalesce(cn, 0) - CAST(mine AS INT) > 0 AS place, x.offer_type IN (SELECT offer_type FROM won) AS w
      FROM x JOIN md USING (ordinal) LEFT JOIN cc USING (county))
    SELECT ordinal, CAST(greatest(5, least(95, 40 + CASE hits WHEN 0 THEN 0 WHEN 1 THEN 20 ELSE 30 END + CASE WHEN same THEN 15 ELSE 0 END
      + CASE WHEN place THEN 5 ELSE 0 END + CASE WHEN w THEN 10 ELSE 0 END - CASE WHEN offer_type = 'unknown' THEN 10 ELSE 0 END)) AS INTEGER) AS score,
      concat_ws(' · ', 'baseline 40', CASE hits WHEN 0 THEN NULL WHEN 1 THEN 'matches 1 of your watchlist (+20)' ELSE 'matches ' || hits || ' of your watchlists (+30)' END,
        CASE WHEN same THEN 'most of your pipeline is ' || replace(offer_type, '_', ' ') || ' (+15)' END, CASE WHEN place THEN 'you already work this county (+5)' END,
        CASE WHEN w THEN 'you have won ' || replace(offer_type, '_', ' ') || ' work (+10)' END,
        CASE WHEN offer_type = 'unknown' THEN 'work type unclear from the listing (−10)' END) AS reasons FROM s""", "bids")
def fit_score(t: Tables) -> DataFrame:
    bids = t.bids.select("opportunity_id", "ordinal", "offer_type", "county")
    tracked = bids.join(workflow(t.bids).filter("NOT archived").select("opportunity_id"), "opportunity_id", "left_semi")
    hits = bids.filter("ordinal % 4 < 2").select("opportunity_id", F.expr("CASE ordinal % 4 WHEN 0 THEN 1 ELSE 3 END").alias("hits"))
    won = bids.filter("ordinal % 6 = 2 AND ordinal % 5 = 3 AND ordinal % 4 = 0 AND offer_type <> 'goods'")
    return scoring.fit_scores(bids, tracked, hits, won).select("ordinal", F.col("fit_score").alias("score"), F.col("fit_reasons").alias("reasons"))


CALENDAR_SQL = """cal AS (SELECT day, CAST(isodow < 6 AND NOT (
      (m = 1 AND dm = 1) OR (m = 7 AND dm = 4) OR (m = 11 AND dm = 11) OR (m = 12 AND dm = 25)
      OR (isodow = 1 AND ((m = 1 AND dm = 2) OR (m = 7 AND dm = 5) OR (m = 11 AND dm = 12) OR (m = 12 AND dm = 26)))
      OR (isodow = 5 AND ((m = 7 AND dm = 3) OR (m = 11 AND dm = 10) OR (m = 12 AND dm = 24)))
      OR (m = 1 AND isodow = 1 AND dm BETWEEN 15 AND 21) OR (m = 5 AND isodow = 1 AND dm > 24) OR (m = 9 AND isodow = 1 AND dm < 8)
      OR (m = 11 AND isodow = 4 AND dm BETWEEN 22 AND 28) OR (m = 11 AND isodow = 5 AND dm BETWEEN 23 AND 29)) AS INT) AS biz
    FROM (SELECT CAST(d AS DATE) AS day, isodow(d) AS isodow, month(d) AS m, day(d) AS dm FROM generate_series(TIMESTAMP '1993-01-01', TIMESTAMP '2003-12-31', INTERVAL 1 DAY) g(d))),
    ix AS (SELECT day, biz, sum(biz) OVER (ORDER BY day) AS bi, sum(1 - biz) OVER (ORDER BY day) AS idle FROM cal)"""
_POSTED = "o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT))"
_DEADLINE = f"""p AS (SELECT o_orderkey, {_POSTED} AS posted FROM orders),
    dl AS (SELECT p.o_orderkey, posted, e.day + (posted - CAST(posted AS DATE)) AS deadline FROM p JOIN ix s ON s.day = CAST(posted AS DATE)
      JOIN ix e ON e.biz = 1 AND e.bi = s.bi + 1 - s.biz + 3)"""


def _deadlines(t: Tables) -> DataFrame:
    posted = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    return calendar.protest_deadline(t.orders.select("o_orderkey", posted.alias("posted")), "posted", "deadline")


@query("protest_deadline", f"WITH {CALENDAR_SQL}, {_DEADLINE} SELECT o_orderkey, deadline FROM dl")
def protest_deadline(t: Tables) -> DataFrame:
    return _deadlines(t).select("o_orderkey", "deadline")


_HOURS = f"""hr AS (SELECT o_orderkey, deadline, CASE WHEN TIMESTAMP '{AS_OF} 10:30:00' >= deadline THEN -1 ELSE 1 END
      * (date_diff('microsecond', least(deadline, TIMESTAMP '{AS_OF} 10:30:00'), greatest(deadline, TIMESTAMP '{AS_OF} 10:30:00')) / 1000000 / 3600
        - 24 * CASE WHEN b.day > a.day THEN b.idle - a.idle ELSE 0 END) AS hours
    FROM dl JOIN ix a ON a.day = CAST(least(deadline, TIMESTAMP '{AS_OF} 10:30:00') AS DATE)
    JOIN ix b ON b.day = CAST(greatest(deadline, TIMESTAMP '{AS_OF} 10:30:00') AS DATE) - 1)"""


@query("business_hours_left", f"WITH {CALENDAR_SQL}, {_DEADLINE}, {_HOURS} SELECT o_orderkey, CAST(hours AS DOUBLE) AS hours FROM hr")
def business_hours_left(t: Tables) -> DataFrame:
    return calendar.business_hours_left(_deadlines(t), "deadline", f"{AS_OF} 10:30:00", "hours").select("o_orderkey", "hours")


@query("protest_windows", f"""WITH {CALENDAR_SQL}, {_DEADLINE}, {_HOURS} SELECT b.ordinal, hr.deadline, round_even(CAST(hours AS DOUBLE), 1) AS hours_left
    FROM hr JOIN bids b ON b.ordinal = hr.o_orderkey WHERE b.status = 'award' AND hours > 0 ORDER BY hours, b.ordinal LIMIT 8""", "bids")
def protest_windows(t: Tables) -> DataFrame:
    awards = t.bids.filter("status = 'award'").select("ordinal")
    clocked = calendar.business_hours_left(_deadlines(t), "deadline", f"{AS_OF} 10:30:00", "hours").filter("hours > 0")
    return (awards.join(clocked, awards["ordinal"] == clocked["o_orderkey"]).orderBy("hours", "ordinal").limit(8)
            .select("ordinal", "deadline", F.bround("hours", 1).alias("hours_left")))


@query("list_union", """SELECT ordinal, array_to_string(categories || list_filter(keywords, lambda k: NOT list_contains(categories, k)), ',') AS merged FROM bids""", "bids")
def list_union(t: Tables) -> DataFrame:
    return t.bids.select("ordinal", F.array_join(dedupe.list_union("categories", "keywords"), ",").alias("merged"))


def _export_sql() -> str:
    """Every column of the flat export, from the lists that name them."""
    have = bid_columns(DuckDialect)
    blank = "''"
    text_ = [f"coalesce({c}, '') AS {c}" if c in have else f"'' AS {c}" for c in snapshot.OPTIONAL]
    numbers = [f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" if c in have else f"{blank} AS {c}" for c in snapshot.NUMBERS]
    days = [f"coalesce(strftime({c}, '%Y-%m-%d'), '') AS {c}" if c in have else f"{blank} AS {c}" for c in snapshot.DATES]
    moments = [f"coalesce(strftime({c}, '%Y-%m-%dT%H:%M:%S'), '') AS {c}" if c in have else f"{blank} AS {c}" for c in snapshot.MOMENTS]
    return f"""SELECT opportunity_id, title, {', '.join([*snapshot.PLAIN, *text_, *numbers, *days, *moments])}, array_to_string(categories, ', ') AS categories,
      coalesce(CAST({DAYS} AS VARCHAR), '') AS days_until_due, array_to_string(requirements, '; ') AS requirements, CAST(len(documents) AS INTEGER) AS documents,
      array_to_string(list_transform(documents[1:10], lambda d: d.url), ' | ') AS document_urls, array_to_string(commodity_codes, '; ') AS commodity_codes,
      coalesce(prior_cycles, 0) AS prior_cycles, coalesce(personalized, false) AS personalized, {DETAIL} AS detail_score,
      substr(replace(coalesce(scope, ''), chr(10), ' '), 1, 2000) AS scope FROM bids"""


@query("export_rows", _export_sql(), "bids")
def export_rows(t: Tables) -> DataFrame:
    """The whole flat export."""
    return snapshot.export_rows(t.bids, AS_OF)


@query("export_csv", f"SELECT * REPLACE (CAST(documents AS VARCHAR) AS documents, CAST(prior_cycles AS VARCHAR) AS prior_cycles, CAST(personalized AS VARCHAR) AS personalized, CAST(detail_score AS VARCHAR) AS detail_score) FROM ({_export_sql()})", "bids")
def export_csv(t: Tables) -> DataFrame:
    """The CSV half of a snapshot, written in listing order and read back as text."""
    path = scratch_path(t.spark, "snapshot-export")
    snapshot.write_snapshot(t.bids.drop("first_seen_at"), t.bids.groupBy("source_id").agg(F.count(F.lit(1)).alias("count")), path, AS_OF)
    return snapshot.read_export(t.spark, path)


@query("health_status", """SELECT source_id, run_day, CASE WHEN events % 7 = 0 THEN 'degraded' WHEN had_error = 1 AND events % 2 = 0 THEN 'error'
      WHEN events % 5 = 0 THEN 'degraded' WHEN row_count > 0 THEN 'ok' WHEN events % 3 = 0 THEN 'empty' ELSE 'degraded' END AS status,
    CASE WHEN events % 7 = 0 THEN 'portal blocked this client' WHEN had_error = 1 AND events % 2 = 0 THEN NULL WHEN events % 5 = 0 THEN 'login page returned'
      WHEN row_count > 0 THEN NULL WHEN events % 3 = 0 THEN 'portal listed no open solicitations' ELSE 'fetched but parsed zero rows' END AS note FROM runs""", "runs")
def health_status(t: Tables) -> DataFrame:
    from tenderloom.operators.health import classify_result
    e = F.col("events")
    verdict = classify_result(F.col("row_count"), F.when(e % 5 == 0, F.lit("login page returned")), e % 3 == 0, F.lit(""),
                              e % 7 == 0, (F.col("had_error") == 1) & (e % 2 == 0))
    return t.runs.withColumn("v", verdict).select("source_id", "run_day", "v.status", "v.note")
