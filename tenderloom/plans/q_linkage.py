"""Joins, deduplication, watchlists and price reports (families D, E and the join-heavy part of G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tenderloom import schemas
from tenderloom.functions import calendar, classify, text
from tenderloom.functions.base import count_if
from tenderloom.operators import (boards, dedupe, digest, filters, health, linkage, marts, matches, pricing, records, resolve, similarity,
                                  state, watchlists)
from tenderloom.plans.q_market import RESULTS, WORKFLOW, results, workflow
from tenderloom.plans.q_scalars import _DEADLINE, _HOURS, CALENDAR_SQL, _deadlines, classify_sql, gazetteer
from tenderloom.plans.registry import query
from tenderloom.plans.sqltext import (BUDGET, DAYS, LIVE, REF_KEY, RICH, TITLE_KEY, VALUE, similar, tokens)
from tenderloom.plans.tables import AS_OF, AS_OF_TS, Tables
from tenderloom.session import scratch_path
from tenderloom.sources import registers

# ---- deduplication ---------------------------------------------------------

BY_REF = f"""k AS (SELECT *, {REF_KEY} AS rk FROM bids), byref AS (SELECT * EXCLUDE (rk) FROM k WHERE rk IS NULL
    UNION ALL SELECT * EXCLUDE (rk, rn) FROM (SELECT *, row_number() OVER (PARTITION BY rk ORDER BY {RICH}) AS rn FROM k WHERE rk IS NOT NULL) WHERE rn = 1)"""


@query("open_by_county", f"""WITH aged AS (SELECT * REPLACE (CASE WHEN status = 'open' AND (CASE WHEN due_date IS NOT NULL
      THEN due_date < TIMESTAMP '{AS_OF_TS}' ELSE coalesce(posted_date < DATE '{AS_OF}' - 180, false) END) THEN 'closed' ELSE status END AS status) FROM bids),
    k AS (SELECT *, {REF_KEY} AS rk FROM aged), d AS (SELECT * EXCLUDE (rk) FROM k WHERE rk IS NULL
    UNION ALL SELECT * EXCLUDE (rk, rn) FROM (SELECT *, row_number() OVER (PARTITION BY rk ORDER BY {RICH}) AS rn FROM k WHERE rk IS NOT NULL) WHERE rn = 1)
    SELECT county, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'upcoming') AS upcoming,
      CAST(sum({VALUE}) AS BIGINT) AS value FROM d WHERE {LIVE} GROUP BY county""", "bids")
def open_by_county(t: Tables) -> DataFrame:
    """Flagship: age, collapse by reference, then total what is live per county."""
    return marts.by_county(dedupe.collapse_by_reference(filters.age_status(t.bids, AS_OF_TS)))


@query("dedupe_by_ref", f"WITH {BY_REF} SELECT ordinal FROM byref", "bids")
def dedupe_by_ref(t: Tables) -> DataFrame:
    return dedupe.collapse_by_reference(t.bids).select("ordinal")


@query("dedupe_by_title", f"""WITH k AS (SELECT *, {REF_KEY} AS rk, {TITLE_KEY} AS tk FROM bids),
    o AS (SELECT ordinal, rk, tk, row_number() OVER (PARTITION BY tk ORDER BY {RICH}) AS rn,
      row_number() OVER (PARTITION BY tk, rk ORDER BY {RICH}) AS rr FROM k),
    h AS (SELECT tk, rk AS head_ref FROM o WHERE rn = 1)
    SELECT o.ordinal FROM o JOIN h USING (tk) WHERE o.rn = 1 OR (o.rr = 1 AND o.rk IS NOT NULL AND h.head_ref IS NOT NULL)""", "bids")
def dedupe_by_title(t: Tables) -> DataFrame:
    return dedupe.collapse_by_title(t.bids).select("ordinal")


_SURVIVORS = f"""k AS (SELECT *, {REF_KEY} AS rk, {TITLE_KEY} AS tk, row_number() OVER (ORDER BY {RICH}) AS pos FROM bids),
    th AS (SELECT tk, min(pos) AS tpos, arg_min(rk, pos) FILTER (rk IS NOT NULL) AS any_ref FROM k GROUP BY tk),
    tt AS (SELECT th.tk, th.tpos, k.rk AS tref FROM th JOIN k ON k.pos = th.tpos),
    rh AS (SELECT rk, min(pos) AS rpos, arg_min(tk, pos) AS tk FROM k WHERE rk IS NOT NULL GROUP BY rk),
    ln AS (SELECT rh.rk, CASE WHEN tt.tpos <> rh.rpos THEN tt.tref END AS parent, CASE WHEN tt.tpos <> rh.rpos AND tt.tref IS NULL THEN tt.tpos END AS absorber
      FROM rh JOIN tt USING (tk)),
    ch AS (SELECT rk, parent, absorber FROM ln UNION ALL SELECT ch.rk, ln.parent, ln.absorber FROM ch JOIN ln ON ln.rk = ch.parent),
    fin AS (SELECT rk, max(absorber) AS absorber FROM ch GROUP BY rk),
    br AS (SELECT rh.rk, coalesce(fin.absorber, rh.rpos) AS surv FROM rh JOIN fin USING (rk)),
    bt AS (SELECT tt.tk, coalesce(br.surv, tt.tpos) AS surv FROM tt LEFT JOIN br ON br.rk = tt.tref),
    sv AS (SELECT k.pos, k.ordinal, coalesce(br.surv, bt.surv) AS surv FROM k LEFT JOIN br ON br.rk = k.rk LEFT JOIN bt ON k.rk IS NULL AND bt.tk = k.tk)"""


@query("dedupe_full", f"""WITH RECURSIVE {_SURVIVORS},
    g AS (SELECT sv.surv, count(*) AS merged, arg_min(k.due_date, k.pos) FILTER (k.due_date IS NOT NULL) AS due,
      arg_min(k.contact, k.pos) FILTER (coalesce(k.contact, '') <> '') AS contact, arg_min(k.budget, k.pos) FILTER (coalesce(k.budget, '') <> '') AS budget
      FROM sv JOIN k USING (pos) GROUP BY sv.surv),
    c AS (SELECT surv, tag, min((CASE WHEN pos = surv THEN 0 ELSE pos END) * 100 + i) AS seq FROM (SELECT sv.surv, k.pos, unnest(k.categories) AS tag,
      generate_subscripts(k.categories, 1) AS i FROM sv JOIN k USING (pos)) GROUP BY surv, tag),
    cc AS (SELECT surv, string_agg(tag, ',' ORDER BY seq) AS categories FROM c GROUP BY surv)
    SELECT k.ordinal, g.merged AS merged_records, coalesce(k.due_date, g.due) AS due_date,
      CASE WHEN coalesce(k.contact, '') <> '' THEN k.contact ELSE coalesce(g.contact, k.contact) END AS contact,
      CASE WHEN coalesce(k.budget, '') <> '' THEN k.budget ELSE coalesce(g.budget, k.budget) END AS budget, coalesce(cc.categories, '') AS categories
    FROM g JOIN k ON k.pos = g.surv LEFT JOIN cc ON cc.surv = g.surv""", "bids")
def dedupe_full(t: Tables) -> DataFrame:
    return dedupe.collapse(t.bids).select("ordinal", "merged_records", "due_date", "contact", "budget",
                                          F.array_join("categories", ",").alias("categories"))


@query("register_dedupe", """SELECT contract_id, vendor, end_date, part_key, supplier_key FROM (SELECT *, row_number() OVER (PARTITION BY source_id, contract_id
    ORDER BY coalesce(vendor, '') <> '' DESC, end_date DESC NULLS LAST, supplier_key * 100000000 + part_key, amount) AS rn FROM contracts) WHERE rn = 1""", "contracts")
def register_dedupe(t: Tables) -> DataFrame:
    rows = t.contracts.withColumn("ordinal", F.col("supplier_key") * 100_000_000 + F.col("part_key"))
    return dedupe.better_register_rows(rows, ["source_id", "contract_id"]) \
        .select("contract_id", "vendor", "end_date", "part_key", "supplier_key")


@query("announcement_groups", """WITH a AS (SELECT event_id AS ordinal, entity_id AS ref, entity_id || ' notice ' || repeat('x', CAST(event_id % 5 AS INTEGER)) AS title,
      'https://x.example/' || event_id AS url, 'c' || event_id AS contact, CAST(ts AS DATE) AS announced_on,
      CASE WHEN event_id % 41 = 0 THEN 'cancelled' WHEN event_id % 29 = 0 THEN 'award' WHEN event_id % 3 = 0 THEN 'addendum' ELSE 'open' END AS kind FROM log)
    SELECT ref, arg_max(title, length(title) * 1000000000 - ordinal) AS title, arg_max(url, epoch_us(CAST(announced_on AS TIMESTAMP)) // 86400000000 * 1000000000 - ordinal) AS url,
      arg_max(contact, epoch_us(CAST(announced_on AS TIMESTAMP)) // 86400000000 * 1000000000 - ordinal) AS contact, min(announced_on) AS first_announced, max(announced_on) AS last_announced, count(DISTINCT kind) AS kinds,
      array_to_string(list_sort(list(DISTINCT kind)), '; ') AS announcements,
      CASE WHEN bool_or(kind = 'cancelled') THEN 'cancelled' WHEN bool_or(kind = 'award') THEN 'award' ELSE 'open' END AS status FROM a GROUP BY ref""", "log")
def announcement_groups(t: Tables) -> DataFrame:
    rows = t.log.select(
        F.col("event_id").alias("ordinal"), F.col("entity_id").alias("ref"),
        F.concat(F.col("entity_id"), F.lit(" notice "), F.expr("repeat('x', CAST(event_id % 5 AS INT))")).alias("title"),
        F.concat(F.lit("https://x.example/"), F.col("event_id").cast("string")).alias("url"),
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("contact"), F.col("ts").cast("date").alias("announced_on"),
        F.expr("CASE WHEN event_id % 41 = 0 THEN 'cancelled' WHEN event_id % 29 = 0 THEN 'award' WHEN event_id % 3 = 0 THEN 'addendum' ELSE 'open' END").alias("kind"))
    return dedupe.announcement_groups(rows)


@query("notification_dedupe", """SELECT kind, key, event_id, raised FROM (SELECT event_type AS kind, entity_id AS key, event_id,
    count(*) OVER (PARTITION BY event_type, entity_id) AS raised, row_number() OVER (PARTITION BY event_type, entity_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM log WHERE event_id % 9 <> 0) WHERE rn = 1""", "log")
def notification_dedupe(t: Tables) -> DataFrame:
    unread = t.log.filter("event_id % 9 <> 0").select(F.col("event_type").alias("kind"), F.col("entity_id").alias("key"),
                                                      F.col("ts").alias("created_at"), "event_id")
    return state.unread_notifications(unread).select("kind", "key", "event_id", "raised")


# A day inside the test data, so that bids are due in the days after it.
SCAN_DAY = "1998-06-01"
SCAN_DAYS = DAYS.replace(AS_OF, SCAN_DAY)


@query("deadline_scan", f"""WITH {WORKFLOW} SELECT b.opportunity_id, 'deadline_soon' AS kind, 'Due in ' || {SCAN_DAYS} || CASE {SCAN_DAYS} WHEN 1 THEN ' day: ' ELSE ' days: ' END || b.title AS title,
    b.agency || ' · stage: ' || wf.stage AS body FROM wf JOIN bids b USING (opportunity_id)
    WHERE NOT wf.archived AND wf.stage <> 'result' AND {SCAN_DAYS} BETWEEN 0 AND 5""", "bids")
def deadline_scan(t: Tables) -> DataFrame:
    return state.deadline_scan(t.bids, workflow(t.bids), SCAN_DAY)


# ---- award linkage and recurrence -----------------------------------------

TOKENED = f"tk AS (SELECT *, {tokens('title')} AS toks FROM bids)"
NORM_LINK = "NULLIF(regexp_replace(lower(linked_ref), '[^a-z0-9]+', '', 'g'), '')"
NORM_EXT = "NULLIF(regexp_replace(lower(external_id), '[^a-z0-9]+', '', 'g'), '')"
REF_LINK = f"""sol AS (SELECT ordinal, lower(agency) AS ag, {NORM_EXT} AS ref FROM bids WHERE status <> 'award'),
    ix AS (SELECT key, min(ordinal) AS sol FROM (SELECT ordinal, ag || '|' || ref AS key FROM sol WHERE ref IS NOT NULL UNION ALL
      SELECT ordinal, ref FROM sol WHERE ref IS NOT NULL) GROUP BY key),
    aw AS (SELECT ordinal, unnest([lower(agency) || '|' || {NORM_LINK}, {NORM_LINK}, lower(agency) || '|' || {NORM_EXT}, {NORM_EXT}]) AS key,
      unnest([0, 1, 2, 3]) AS turn FROM bids WHERE status = 'award'),
    rl AS (SELECT aw.ordinal, arg_min(ix.sol, aw.turn) AS solicitation FROM aw JOIN ix USING (key) GROUP BY aw.ordinal)"""


@query("award_ref_link", f"WITH {REF_LINK} SELECT ordinal, solicitation FROM rl", "bids")
def award_ref_link(t: Tables) -> DataFrame:
    return linkage.link_by_reference(t.bids.filter("status = 'award'"), t.bids.filter("status <> 'award'"))


FUZZY = f"""{TOKENED}, fz AS (SELECT a.ordinal, s.ordinal AS solicitation, len(list_intersect(a.toks, s.toks)) / least(len(a.toks), len(s.toks)) AS score,
      row_number() OVER (PARTITION BY a.ordinal ORDER BY len(list_intersect(a.toks, s.toks)) / least(len(a.toks), len(s.toks)) DESC, s.ordinal) AS rn
      FROM tk a JOIN tk s ON a.status = 'award' AND s.status <> 'award' AND lower(a.agency) = lower(s.agency) AND {similar('a.toks', 's.toks')})"""


@query("award_fuzzy_link", f"WITH {FUZZY} SELECT ordinal, solicitation, score FROM fz WHERE rn = 1", "bids")
def award_fuzzy_link(t: Tables) -> DataFrame:
    return linkage.link_by_title(t.bids.filter("status = 'award'"), t.bids.filter("status <> 'award'"))


LINKS = f"""{REF_LINK}, {FUZZY}, lk AS (SELECT ordinal, solicitation, 'ref' AS linkage FROM rl UNION ALL
    SELECT ordinal, solicitation, 'fuzzy' FROM fz WHERE rn = 1 AND ordinal NOT IN (SELECT ordinal FROM rl))"""


@query("award_link", f"WITH {LINKS} SELECT * FROM lk", "bids")
def award_link(t: Tables) -> DataFrame:
    return linkage.link_awards(t.bids)


@query("award_donate", f"""WITH {LINKS}, f AS (SELECT lk.solicitation, arg_min(NULLIF(b.awarded_vendor, ''), b.ordinal) FILTER (NULLIF(b.awarded_vendor, '') IS NOT NULL) AS v,
      arg_min(b.award_amount, b.ordinal) FILTER (b.award_amount IS NOT NULL) AS a,
      arg_min(coalesce(b.award_date, b.posted_date), b.ordinal) FILTER (coalesce(b.award_date, b.posted_date) IS NOT NULL) AS d
      FROM lk JOIN bids b USING (ordinal) GROUP BY lk.solicitation)
    SELECT b.ordinal, coalesce(NULLIF(b.awarded_vendor, ''), f.v) AS awarded_vendor, coalesce(b.award_amount, f.a) AS award_amount,
      coalesce(b.award_date, f.d) AS award_date FROM bids b LEFT JOIN f ON f.solicitation = b.ordinal""", "bids")
def award_donate(t: Tables) -> DataFrame:
    return linkage.donate_award_facts(t.bids, linkage.link_awards(t.bids)) \
        .select("ordinal", "awarded_vendor", "award_amount", "award_date")


@query("recurrence", f"""WITH {TOKENED}, ar AS (SELECT opportunity_id, agency, due_date, toks FROM tk WHERE status IN ('closed', 'cancelled', 'award') OR ordinal % 7 = 0)
    SELECT o.ordinal, CAST(count(ar.opportunity_id) AS INTEGER) AS prior_cycles, CAST(max(ar.due_date) AS DATE) AS last_cycle_closed
    FROM tk o LEFT JOIN ar ON lower(o.agency) = lower(ar.agency) AND ar.opportunity_id <> o.opportunity_id AND {similar('o.toks', 'ar.toks')}
    WHERE o.status IN ('open', 'upcoming') GROUP BY o.ordinal""", "bids")
def recurrence(t: Tables) -> DataFrame:
    archive = t.bids.filter("status IN ('closed', 'cancelled', 'award') OR ordinal % 7 = 0")
    live = t.bids.filter(F.col("status").isin("open", "upcoming"))
    return similarity.recurrence(live, archive.select("opportunity_id", "agency", "title", "due_date")) \
        .select("ordinal", "prior_cycles", "last_cycle_closed")


@query("unawarded", f"""WITH {TOKENED} SELECT ordinal FROM tk o WHERE status IN ('closed', 'cancelled') AND NOT EXISTS (SELECT 1 FROM tk a
    WHERE a.status = 'award' AND lower(a.agency) = lower(o.agency) AND {similar('o.toks', 'a.toks')})""", "bids")
def unawarded(t: Tables) -> DataFrame:
    return similarity.without_similar(t.bids.filter(F.col("status").isin("closed", "cancelled")), t.bids.filter("status = 'award'")) \
        .select("ordinal")


RIPE = f"""{TOKENED}, ripe AS (SELECT *, CAST(due_date AS DATE) + 31 AS ripe_on, CAST(date_diff('day', CAST(due_date AS DATE) + 31, DATE '{AS_OF}') AS INTEGER) AS ripe_for_days
    FROM tk o WHERE status IN ('closed', 'cancelled') AND due_date IS NOT NULL AND date_diff('day', CAST(due_date AS DATE) + 31, DATE '{AS_OF}') BETWEEN 0 AND 365
      AND NOT EXISTS (SELECT 1 FROM tk a WHERE a.status = 'award' AND lower(a.agency) = lower(o.agency) AND {similar('o.toks', 'a.toks')}))"""


def _ripe(t: Tables) -> DataFrame:
    return records.ripe_for_request(t.bids, AS_OF)


@query("ripe_records", f"WITH {RIPE} SELECT ordinal, ripe_on, ripe_for_days FROM ripe", "bids")
def ripe_records(t: Tables) -> DataFrame:
    return _ripe(t).orderBy("ripe_for_days", "ordinal").select("ordinal", "ripe_on", "ripe_for_days")


def _letter_sql() -> str:
    from tenderloom.functions import render
    import re
    day = "strftime({0}, '%B ') || day({0}) || strftime({0}, ', %Y')"
    slots = {"agency": "agency", "ref": "CASE WHEN coalesce(external_id, '') <> '' THEN external_id ELSE title END", "title": "title",
             "opened": day.format("due_date"), "today": day.format(f"DATE '{AS_OF}'"), "who": f"'{render.NO_REQUESTER}'"}
    return " || ".join(f"({slots[p[1:-1]]})" if p.startswith("{") else "'" + p.replace("'", "''") + "'"
                       for p in re.split(r"(\{\w+\})", render.LETTER) if p)


@query("ripe_summary", f"""WITH {RIPE} SELECT count(*) AS ripe, count(*) FILTER (ripe_for_days < 7) AS newly_ripe FROM ripe""", "bids")
def ripe_summary(t: Tables) -> DataFrame:
    return boards.ripe_summary(_ripe(t))


@query("request_letters", f"WITH {RIPE} SELECT ordinal, {_letter_sql()} AS letter FROM ripe", "bids")
def request_letters(t: Tables) -> DataFrame:
    return records.with_letters(_ripe(t), AS_OF).select("ordinal", "letter")


@query("records_mint", f"""WITH {RIPE} SELECT opportunity_id, ripe_on FROM ripe WHERE ordinal % 3 <> 0""", "bids")
def records_mint(t: Tables) -> DataFrame:
    queue = t.bids.filter("ordinal % 3 = 0").select("opportunity_id")
    return state.mint_missing(queue, _ripe(t)).orderBy(F.desc("ripe_on"), "ordinal").select("opportunity_id", "ripe_on")


# ---- lookups and overlays --------------------------------------------------

@query("workflow_overlay", f"""WITH {WORKFLOW}, {RESULTS} SELECT b.ordinal, wf.opportunity_id IS NOT NULL AS tracked, wf.stage, coalesce(wf.archived, false) AS archived,
    wf.tracked_on, coalesce(res.outcome, '') AS outcome, b.ordinal % 4 = 1 AS has_summary
    FROM bids b LEFT JOIN wf USING (opportunity_id) LEFT JOIN res USING (opportunity_id)""", "bids")
def workflow_overlay(t: Tables) -> DataFrame:
    briefs = t.bids.filter("ordinal % 4 = 1").select("opportunity_id")
    known = boards.overlay(t.bids.select("ordinal", "opportunity_id"), workflow(t.bids), results(t.bids), briefs)
    return known.select("ordinal", "tracked", "stage", "archived", "tracked_on", "outcome", "has_summary")


@query("contract_vendor_join", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS vendor
    FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def contract_vendor_join(t: Tables) -> DataFrame:
    """Contracts with their vendor's name; vendors without an id or a name are not indexed."""
    from tenderloom.sources.payloads import vendor_index
    raw = t.supplier.select(F.col("s_suppkey").alias("VendorID"), F.expr("CASE WHEN s_suppkey % 4 <> 0 THEN s_name ELSE ' ' END").alias("VendorContactOrganizationName"))
    vendors = vendor_index(raw)
    return (t.lineitem.withColumn("vendor_id", F.col("l_suppkey").cast("string")).join(vendors, "vendor_id", "left")
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "vendor"))


@query("agency_code_join", """SELECT c_custkey, n_nationkey AS agency_code FROM customer LEFT JOIN nation ON upper(n_name) = upper(trim(CASE WHEN c_custkey % 3 = 0
    THEN ' Nation_' || (c_custkey % 25) || ' ' ELSE 'Bureau ' || c_custkey END))""")
def agency_code_join(t: Tables) -> DataFrame:
    asked = t.customer.select("c_custkey", F.expr("CASE WHEN c_custkey % 3 = 0 THEN concat(' Nation_', c_custkey % 25, ' ') ELSE concat('Bureau ', c_custkey) END").alias("agency"))
    codes = t.nation.select(F.upper("n_name").alias("folded"), F.col("n_nationkey").alias("agency_code"))
    return asked.withColumn("folded", F.upper(F.trim("agency"))).join(codes, "folded", "left").select("c_custkey", "agency_code")


_MOVES = """old AS (SELECT entity_id, platform FROM log WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_id DESC) = 1),
    new AS (SELECT entity_id, platform FROM log QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_id DESC) = 1),
    mv AS (SELECT entity_id, coalesce(old.platform, 'unknown') AS was, new.platform, CASE WHEN coalesce(old.platform, 'unknown') = new.platform
      OR (coalesce(old.platform, 'unknown') IN ('selfhosted', 'unknown') AND new.platform IN ('selfhosted', 'unknown')) THEN 'unchanged'
      WHEN new.platform = 'unknown' THEN 'lost' ELSE 'moved' END AS verdict FROM new LEFT JOIN old USING (entity_id))"""


@query("platform_moves", f"""WITH {_MOVES} SELECT entity_id, was, platform, verdict, (SELECT count(*) FILTER (verdict = 'lost') >= greatest(5, count(*) // 4) FROM mv) AS many_lost FROM mv""", "log")
def platform_moves(t: Tables) -> DataFrame:
    from tenderloom.functions.base import with_scalars
    recorded = dedupe.keep_last_by(t.log.filter("event_id % 2 = 0"), ["entity_id"], "event_id")
    fresh = dedupe.keep_last_by(t.log, ["entity_id"], "event_id").select("entity_id", "platform")
    moves = health.platform_moves(recorded, fresh)
    alarm = moves.agg((count_if(F.col("verdict") == "lost") >= health.lost_threshold(F.count(F.lit(1)))).alias("many_lost"))
    return with_scalars(moves, alarm).select("entity_id", "was", "platform", "verdict", "many_lost")


SOURCES = """src AS (SELECT c_custkey AS ordinal, CASE WHEN c_custkey % 31 = 0 THEN '' ELSE 'og_' || (c_custkey % 700) END AS id,
    CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE c_name END AS name, 'county' AS county,
    CASE WHEN c_custkey % 2 = 0 THEN 'City of Agency ' || (c_custkey % 89) ELSE 'agency-' || (c_custkey % 89) END AS agency, 'https://p.example/' || c_custkey AS portal_url,
    CASE c_custkey % 4 WHEN 0 THEN 'catalog' WHEN 1 THEN 'opengov' WHEN 2 THEN 'bonfire' ELSE 'typo' END AS adapter, c_custkey % 5 <> 0 AS live_fetch FROM customer)"""
ADAPTERS = ("catalog", "opengov", "bonfire")


def sources(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("ordinal"), F.expr("CASE WHEN c_custkey % 31 = 0 THEN '' ELSE concat('og_', c_custkey % 700) END").alias("id"),
        F.expr("CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE c_name END").alias("name"), F.lit("county").alias("county"),
        F.expr("CASE WHEN c_custkey % 2 = 0 THEN concat('City of Agency ', c_custkey % 89) ELSE concat('agency-', c_custkey % 89) END").alias("agency"),
        F.concat(F.lit("https://p.example/"), k.cast("string")).alias("portal_url"),
        F.expr("CASE c_custkey % 4 WHEN 0 THEN 'catalog' WHEN 1 THEN 'opengov' WHEN 2 THEN 'bonfire' ELSE 'typo' END").alias("adapter"),
        (k % 5 != 0).alias("live_fetch"))


_AGENCY_KEY = "regexp_replace(regexp_replace(lower(agency), '[^a-z0-9]+', '', 'g'), '^(?:cityof|townof|villageof|countyof)', '')"


@query("superseded", f"""WITH {SOURCES} SELECT ordinal, id FROM src WHERE adapter = 'catalog' AND id <> '' AND {_AGENCY_KEY} IN
    (SELECT {_AGENCY_KEY} FROM src WHERE adapter IN ('opengov') AND live_fetch)""")
def superseded(t: Tables) -> DataFrame:
    return resolve.superseded(sources(t), ["opengov"]).select("ordinal", "id")


@query("source_validation", f"""WITH {SOURCES} SELECT ordinal, CASE WHEN coalesce(id, '') = '' OR coalesce(name, '') = '' THEN 'missing keys: ' ||
    concat_ws(', ', CASE WHEN id = '' THEN 'id' END, CASE WHEN name IS NULL THEN 'name' END) WHEN adapter = 'typo' THEN 'unknown adapter typo' END AS reason FROM src""")
def source_validation(t: Tables) -> DataFrame:
    return resolve.validate_sources(sources(t), ADAPTERS).select("ordinal", "reason")


@query("first_wins_merge", f"""WITH {SOURCES}, p AS (SELECT *, 0 AS place FROM src WHERE ordinal % 3 = 0 UNION ALL SELECT *, 1 FROM src WHERE ordinal % 3 <> 0)
    SELECT id, ordinal, adapter FROM p WHERE id <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY place, ordinal) = 1""")
def first_wins_merge(t: Tables) -> DataFrame:
    rows = sources(t).filter("id <> ''")
    return state.first_wins([rows.filter("ordinal % 3 = 0"), rows.filter("ordinal % 3 <> 0")], "id").select("id", "ordinal", "adapter")


ROSTER = """ro AS (SELECT s_suppkey AS ordinal, 'ent-' || s_suppkey AS entity_id, CASE s_suppkey % 3 WHEN 0 THEN 'Village of Place ' || (s_suppkey % 40)
    WHEN 1 THEN 'Route ' || (s_suppkey % 40) || ' Authority' ELSE 'Unit ' || (s_suppkey % 40) END AS name FROM supplier)"""
CATALOG = """ca AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'Place ' || (c_custkey % 40) || ' Village' WHEN 1 THEN 'Route ' || (c_custkey % 40) || ', Inc.'
    WHEN 2 THEN '  UNIT ' || (c_custkey % 40) WHEN 3 THEN 'Harbor Board' ELSE 'Cooperative ' || c_custkey END AS agency FROM customer)"""
_BASE = "trim(regexp_replace(regexp_replace(lower(trim(agency)), ',?\\s+inc\\.?$', ''), '\\s+', ' ', 'g'))"
RESOLVED = f"""{ROSTER}, {CATALOG}, sp AS (SELECT id, agency, unnest([b, lower(trim(agency)), CASE WHEN ends_with(b, ' village') THEN 'village of ' || regexp_replace(b, ' village$', '') END,
      CASE WHEN NOT regexp_matches(b, '(authority|district|county)$') THEN b || ' authority' END]) AS spelling, unnest([0, 1, 2, 3]) AS turn
      FROM (SELECT *, {_BASE} AS b FROM ca)),
    nm AS (SELECT lower(trim(name)) AS spelling, arg_min(entity_id, ordinal) AS ent FROM ro GROUP BY 1),
    hit AS (SELECT sp.id, arg_min(coalesce(CASE WHEN spelling = 'harbor board' THEN 'ent-7' END, nm.ent), sp.turn) AS entity_id FROM sp LEFT JOIN nm USING (spelling)
      WHERE coalesce(CASE WHEN spelling = 'harbor board' THEN 'ent-7' END, nm.ent) IS NOT NULL GROUP BY sp.id),
    rs AS (SELECT ca.id, ca.agency, hit.entity_id FROM ca LEFT JOIN hit USING (id))"""


def _resolved(t: Tables) -> DataFrame:
    roster = t.supplier.select(
        F.col("s_suppkey").alias("ordinal"), F.concat(F.lit("ent-"), F.col("s_suppkey").cast("string")).alias("entity_id"),
        F.expr("CASE s_suppkey % 3 WHEN 0 THEN concat('Village of Place ', s_suppkey % 40) WHEN 1 THEN concat('Route ', s_suppkey % 40, ' Authority') "
               "ELSE concat('Unit ', s_suppkey % 40) END").alias("name"))
    catalog = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.expr("CASE c_custkey % 5 WHEN 0 THEN concat('Place ', c_custkey % 40, ' Village') WHEN 1 THEN concat('Route ', c_custkey % 40, ', Inc.') "
               "WHEN 2 THEN concat('  UNIT ', c_custkey % 40) WHEN 3 THEN 'Harbor Board' ELSE concat('Cooperative ', c_custkey) END").alias("agency"))
    return resolve.resolve_entities(catalog, roster, {"harbor board": "ent-7"})


@query("entity_resolution", f"WITH {RESOLVED} SELECT id, agency, entity_id FROM rs")
def entity_resolution(t: Tables) -> DataFrame:
    return _resolved(t).select("id", "agency", "entity_id")


@query("coverage_gap", f"""WITH {RESOLVED} SELECT id, entity_id FROM rs WHERE entity_id IS NOT NULL AND lower(trim(agency)) NOT IN
    (SELECT 'place ' || (s_suppkey % 40) || ' village' FROM supplier WHERE s_suppkey % 4 = 0) AND entity_id NOT IN
    (SELECT 'ent-' || s_suppkey FROM supplier WHERE s_suppkey % 5 = 0)""")
def coverage_gap(t: Tables) -> DataFrame:
    names = t.supplier.filter("s_suppkey % 4 = 0").select(F.expr("concat('place ', s_suppkey % 40, ' village')").alias("name"))
    tenants = t.supplier.filter("s_suppkey % 5 = 0").select(F.expr("concat('ent-', s_suppkey)").alias("entity_id"))
    return resolve.coverage_gap(_resolved(t), names, tenants).select("id", "entity_id")


@query("roster_semi", f"""WITH {ROSTER} SELECT entity_id, name FROM ro WHERE ordinal % 6 <> 0 AND entity_id IN (SELECT 'ent-' || user_id FROM events)""")
def roster_semi(t: Tables) -> DataFrame:
    """A roster written as CSV and read back: rows of the recorded entities that have a website."""
    path = scratch_path(t.spark, "roster")
    given = {"entity_id": F.concat(F.lit("ent-"), F.col("s_suppkey").cast("string")),
             "name": F.expr("CASE s_suppkey % 3 WHEN 0 THEN concat('Village of Place ', s_suppkey % 40) WHEN 1 THEN concat('Route ', s_suppkey % 40, ' Authority') "
                            "ELSE concat('Unit ', s_suppkey % 40) END"),
             "website": F.expr("CASE WHEN s_suppkey % 6 = 0 THEN ' ' ELSE 'https://w.example' END"),
             "notes": F.expr("'Said \"call first\", then' || chr(10) || 'closed, ' || CAST(s_suppkey AS STRING)")}
    columns = StructType.fromDDL(schemas.ROSTER).fieldNames()
    t.supplier.select(*[given.get(c, F.lit(None).cast("string")).alias(c) for c in columns]).write.csv(path, header=True, quote='"', escape='"')
    seen = t.events.select(F.concat(F.lit("ent-"), F.col("user_id").cast("string")).alias("entity_id")).distinct()
    return registers.read_roster(t.spark, path, seen).select("entity_id", "name")


@query("funnel", """SELECT outcome, count(*) AS count FROM (SELECT CASE WHEN platform = 'unknown' THEN 'unknown platform' WHEN platform = 'selfhosted' THEN 'needs a reader'
    WHEN event_id % 5 = 0 THEN platform || ' (weak match)' WHEN platform = 'ionwave' THEN 'no adapter' WHEN event_id % 7 = 0 THEN 'tenant not named' ELSE 'candidate' END AS outcome FROM log) GROUP BY outcome""", "log")
def funnel(t: Tables) -> DataFrame:
    reason = filters.reasons_why([("unknown platform", F.col("platform") == "unknown"), ("needs a reader", F.col("platform") == "selfhosted"),
                                  ("weak", F.col("event_id") % 5 == 0), ("no adapter", F.col("platform") == "ionwave"),
                                  ("tenant not named", F.col("event_id") % 7 == 0)])
    named = F.when(reason == "weak", F.concat(F.col("platform"), F.lit(" (weak match)"))).otherwise(reason)
    return marts.funnel(t.log, named)


@query("recovery_outcomes", """SELECT outcome, count(*) AS count FROM (SELECT CASE platform WHEN 'unknown' THEN 'unread' WHEN 'ionwave' THEN 'stuck' WHEN 'opengov' THEN 'live' ELSE 'lead' END AS outcome
    FROM log) GROUP BY outcome""", "log")
def recovery_outcomes(t: Tables) -> DataFrame:
    return marts.tally(t.log, resolve.recovery_outcome("platform", ["ionwave"], ["opengov"]), "outcome")


@query("source_identity", """SELECT page_id, h || CASE WHEN page_id % 3 = 0 THEN '#t' || page_id ELSE '' END AS identity,
    CASE WHEN page_id % 4 = 0 THEN 'windermere.fl.us' ELSE array_to_string(list_slice(string_split(h, '.'), greatest(1, len(string_split(h, '.')) - 1), len(string_split(h, '.'))), '.') END AS domain
    FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS h FROM pages)""")
def source_identity(t: Tables) -> DataFrame:
    tenant = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("T"), F.col("page_id").cast("string")))
    url = F.when(F.col("page_id") % 4 == 0, F.lit("http://town.windermere.fl.us/bids")).otherwise(F.col("url"))
    return t.pages.select("page_id", resolve.source_identity("url", tenant).alias("identity"), resolve.registrable_domain(url).alias("domain"))


# ---- watchlists ------------------------------------------------------------

RULES_SQL = """r(watchlist_id, counties, offers, categories, keywords, min_value, max_value, no_bond, recurring_only, include_statewide) AS (VALUES
    ('tri-county', ['broward', 'palm-beach'], CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), 0, 0, false, false, false),
    ('anywhere', ['broward'], CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), 0, 250000, false, false, true),
    ('trades', CAST([] AS VARCHAR[]), ['construction', 'services'], CAST([] AS VARCHAR[]), ['gear', 'Bolt'], 100000, 0, true, false, false),
    ('tags', CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), ['small', 'building', 'furniture'], CAST([] AS VARCHAR[]), 0, 0, false, true, false),
    ('words', CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), ['anvil'], 0, 0, false, false, false))"""
_NO: list[str] = []
RULES = [("tri-county", ["broward", "palm-beach"], _NO, _NO, _NO, 0, 0, False, False, False),
         ("anywhere", ["broward"], _NO, _NO, _NO, 0, 250_000, False, False, True),
         ("trades", _NO, ["construction", "services"], _NO, ["gear", "Bolt"], 100_000, 0, True, False, False),
         ("tags", _NO, _NO, ["small", "building", "furniture"], _NO, 0, 0, False, True, False),
         ("words", _NO, _NO, _NO, ["anvil"], 0, 0, False, False, False)]
# Prose in the stand-in table names a county only through these two departments.
NAMED = """nb AS (SELECT *, list_distinct(list_filter(keywords, lambda k: k IN ('broward', 'palm-beach', 'orange')) ||
    CASE department WHEN 'Miami-Dade Public Works' THEN ['miami-dade'] WHEN 'Broward County Office' THEN ['broward'] ELSE CAST([] AS VARCHAR[]) END) AS named FROM bids)"""
MATCHED = f"""{RULES_SQL}, {NAMED}, mt AS (SELECT r.watchlist_id, nb.* FROM nb JOIN r ON {LIVE.replace('status', 'nb.status')}
    AND (len(counties) = 0 OR list_contains(counties, county) OR (county = 'statewide' AND CASE WHEN len(named) > 0 THEN list_has_any(named, counties) ELSE include_statewide END))
    AND (len(offers) = 0 OR list_contains(offers, offer_type)) AND (len(r.categories) = 0 OR list_has_any(nb.categories, r.categories))
    AND (min_value = 0 OR {BUDGET} IS NULL OR {BUDGET} >= min_value) AND (max_value = 0 OR {BUDGET} IS NULL OR {BUDGET} <= max_value)
    AND (NOT no_bond OR NOT list_contains(requirements, 'Bid bond')) AND (NOT recurring_only OR prior_cycles > 0)
    AND (len(r.keywords) = 0 OR len(list_filter(r.keywords, lambda w: contains(lower(concat_ws(' ', title, coalesce(scope, ''), coalesce(description, ''),
      array_to_string(nb.categories, ' '))), lower(w)))) > 0))"""
SEEN = "se AS (SELECT watchlist_id, opportunity_id FROM bids, (SELECT DISTINCT watchlist_id FROM r) WHERE ordinal % 3 = 0)"


def rules(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(RULES, watchlists.RULE_SCHEMA)


def seen(t: Tables) -> DataFrame:
    """Stand-in for the table of pairs that were marked seen: a third of the bids, on every list."""
    lists = F.array(*[F.lit(r[0]) for r in RULES])
    return t.bids.filter("ordinal % 3 = 0").select(F.explode(lists).alias("watchlist_id"), "opportunity_id")


def matched(t: Tables) -> DataFrame:
    return watchlists.matches(watchlists.with_named_counties(t.bids, gazetteer(t), watchlists.needs_prose()), rules(t))


@query("watchlist_matches", f"WITH {MATCHED} SELECT watchlist_id, ordinal, coalesce({DAYS}, 9999) AS days FROM mt", "bids")
def watchlist_matches(t: Tables) -> DataFrame:
    return matched(t).orderBy("watchlist_id", *watchlists.soonest_first(AS_OF)).select(
        "watchlist_id", "ordinal", F.coalesce(text.days_until_due("due_date", AS_OF), F.lit(9_999)).alias("days"))


@query("watchlist_counts", f"""WITH {MATCHED}, {SEEN} SELECT r.watchlist_id, count(mt.ordinal) AS match_count,
    count(mt.ordinal) - (SELECT count(*) FROM se JOIN mt m2 USING (watchlist_id, opportunity_id) WHERE se.watchlist_id = r.watchlist_id) AS new_count FROM r LEFT JOIN mt USING (watchlist_id) GROUP BY r.watchlist_id""", "bids")
def watchlist_counts(t: Tables) -> DataFrame:
    return watchlists.counts(matched(t), seen(t), rules(t))


@query("statewide_county", f"""WITH {NAMED} SELECT county, count(*) AS bids FROM (SELECT unnest(list_distinct(named || CASE WHEN nb.county = 'statewide' THEN
    CAST([] AS VARCHAR[]) ELSE [nb.county] END)) AS county FROM nb) GROUP BY county""", "bids")
def statewide_county(t: Tables) -> DataFrame:
    """Bids per county, counting every county a bid names."""
    named = watchlists.with_named_counties(t.bids, gazetteer(t))
    own = F.when(F.col("county") == "statewide", F.array().cast("array<string>")).otherwise(F.array("county"))
    return (named.select(F.explode(F.array_union("named_counties", own)).alias("county"))
            .groupBy("county").agg(F.count(F.lit(1)).alias("bids")))


@query("new_match_alerts", f"""WITH {MATCHED}, fr AS (SELECT * FROM mt WHERE ordinal % 10 = 1) SELECT watchlist_id, arg_min(opportunity_id, coalesce({DAYS}, 9999) * 10000000000::HUGEINT
      + rnk) AS opportunity_id, count(*) AS found FROM (SELECT *, row_number() OVER (ORDER BY coalesce({DAYS}, 9999), lower(title), ordinal) AS rnk FROM fr) GROUP BY watchlist_id""", "bids")
def new_match_alerts(t: Tables) -> DataFrame:
    fresh = matched(t).filter("ordinal % 10 = 1")
    return watchlists.alerts(fresh, AS_OF).select("watchlist_id", "opportunity_id", "found")


@query("seen_union", f"""WITH {MATCHED}, {SEEN} SELECT watchlist_id, count(*) AS seen FROM (SELECT watchlist_id, opportunity_id FROM se UNION
    SELECT watchlist_id, opportunity_id FROM mt WHERE ordinal % 2 = 0) GROUP BY watchlist_id""", "bids")
def seen_union(t: Tables) -> DataFrame:
    """Pairs seen before and pairs just shown, each once."""
    after = watchlists.mark_seen(seen(t), matched(t).filter("ordinal % 2 = 0"))
    return after.groupBy("watchlist_id").agg(F.count(F.lit(1)).alias("seen"))


@query("digest_sections", f"""WITH {MATCHED}, {SEEN}, {WORKFLOW}, {CALENDAR_SQL}, {_DEADLINE}, {_HOURS}, {RIPE},
    fr AS (SELECT mt.* FROM mt LEFT JOIN se USING (watchlist_id, opportunity_id) WHERE se.opportunity_id IS NULL),
    n AS (SELECT (SELECT count(*) FROM hr JOIN bids b ON b.ordinal = hr.o_orderkey WHERE b.status = 'award' AND hours > 0) AS protests, (SELECT count(*) FROM ripe) AS records,
      (SELECT count(*) FROM fr) - (SELECT count(DISTINCT opportunity_id) FROM fr WHERE status = 'upcoming') AS new_matches,
      (SELECT count(DISTINCT opportunity_id) FROM fr WHERE status = 'upcoming') AS planned,
      (SELECT count(*) FROM wf JOIN bids USING (opportunity_id) WHERE NOT archived AND stage <> 'result' AND {DAYS} BETWEEN 0 AND 7) AS deadlines,
      (SELECT count(*) FROM bids WHERE status = 'award' AND coalesce(award_date, posted_date) >= DATE '{AS_OF}' - 7) AS decided),
    w AS (SELECT *, concat_ws(', ', CASE WHEN protests > 0 THEN protests || CASE WHEN protests = 1 THEN ' protest window open' ELSE ' protest windows open' END END,
      CASE WHEN records > 0 THEN records || CASE WHEN records = 1 THEN ' tabulation requestable' ELSE ' tabulations requestable' END END,
      CASE WHEN new_matches > 0 THEN new_matches || CASE WHEN new_matches = 1 THEN ' new match' ELSE ' new matches' END END, CASE WHEN planned > 0 THEN planned || ' planned' END,
      CASE WHEN deadlines > 0 THEN deadlines || CASE WHEN deadlines = 1 THEN ' deadline this week' ELSE ' deadlines this week' END END) AS bits FROM n)
    SELECT * EXCLUDE (bits), 'Daily digest: ' || CASE WHEN bits <> '' THEN bits ELSE 'source health' END AS subject FROM w""", "bids")
def digest_sections(t: Tables) -> DataFrame:
    """The counts a daily digest is built from, and its subject line."""
    clocked = calendar.business_hours_left(_deadlines(t), "deadline", f"{AS_OF} 10:30:00", "hours").filter("hours > 0")
    protests = (t.bids.filter("status = 'award'").join(clocked.select(F.col("o_orderkey").alias("ordinal")), "ordinal", "left_semi").agg(F.count(F.lit(1)).alias("protests")))
    ripe = _ripe(t).agg(F.count(F.lit(1)).alias("records"))
    decided = filters.decided_since(t.bids, AS_OF).agg(F.count(F.lit(1)).alias("decided"))
    fresh = digest.fresh_counts(watchlists.marked(matched(t), seen(t)))
    return digest.subject(protests, ripe, fresh, digest.due_soon(t.bids, workflow(t.bids), AS_OF), decided)


# ---- prices and vendors ----------------------------------------------------

SAMPLES = """smp AS (SELECT unnest(CASE WHEN len(list_filter(categories, lambda c: c <> 'general')) > 0 THEN list_filter(categories, lambda c: c <> 'general') ELSE ['general'] END) AS slug,
      CASE WHEN county <> 'statewide' THEN county END AS county, award_amount AS dollars FROM bids WHERE status = 'award' AND award_amount > 0
    UNION ALL SELECT category, NULL, CAST(round_even(amount, 0) AS BIGINT) FROM contracts WHERE amount > 0)"""


def _bucket_sql(by: str) -> str:
    return f"""SELECT {by}, n AS count, CAST(floor((a[(n - 1) // 2 + 1] + a[n // 2 + 1]) / 2) AS BIGINT) AS median, a[n // 4 + 1] AS low,
      a[least(n - 1, 3 * n // 4) + 1] AS high FROM (SELECT {by}, list_sort(list(dollars)) AS a, count(*) AS n FROM smp"""


def samples(t: Tables) -> DataFrame:
    return pricing.award_samples(t.bids).unionByName(pricing.contract_samples(t.contracts, F.col("category")))


OVERALL_SQL = f"ov AS ({_bucket_sql('slug')} GROUP BY slug HAVING count(*) >= 3))"
COUNTY_SQL = f"co AS ({_bucket_sql('slug, county')} WHERE county IS NOT NULL GROUP BY slug, county HAVING count(*) >= 3))"


@query("price_buckets", f"WITH {SAMPLES}, {OVERALL_SQL} SELECT * FROM ov", ("bids", "contracts"))
def price_buckets(t: Tables) -> DataFrame:
    return pricing.price_buckets(samples(t), ["slug"])


@query("price_buckets_county", f"WITH {SAMPLES}, {COUNTY_SQL} SELECT * FROM co", ("bids", "contracts"))
def price_buckets_county(t: Tables) -> DataFrame:
    return pricing.price_buckets(samples(t).filter(F.col("county").isNotNull()), ["slug", "county"])


@query("price_hint", f"""WITH {SAMPLES}, {OVERALL_SQL}, {COUNTY_SQL}, q AS (SELECT ordinal, county, unnest(categories) AS slug, generate_subscripts(categories, 1) AS turn FROM bids),
    f AS (SELECT q.ordinal, q.slug, CASE WHEN co.count IS NOT NULL THEN 'county' ELSE 'all' END AS scope, coalesce(co.count, ov.count) AS count, coalesce(co.median, ov.median) AS median,
      row_number() OVER (PARTITION BY q.ordinal ORDER BY turn) AS rn FROM q JOIN ov USING (slug) LEFT JOIN co ON co.slug = q.slug AND co.county = q.county)
    SELECT ordinal, slug, scope, count, median FROM f WHERE rn = 1""", ("bids", "contracts"))
def price_hint(t: Tables) -> DataFrame:
    s = samples(t)
    overall, county = pricing.price_buckets(s, ["slug"]), pricing.price_buckets(s.filter(F.col("county").isNotNull()), ["slug", "county"])
    return pricing.price_hints(t.bids, overall, county).select("ordinal", "slug", "scope", "count", "median")


@query("pricing_pool", """SELECT opportunity_id, award_amount FROM bids WHERE ordinal % 2 = 0 AND status = 'award' UNION ALL
    SELECT opportunity_id, award_amount FROM bids WHERE ordinal % 3 = 0 AND ordinal % 2 <> 0 AND status = 'award'""", "bids")
def pricing_pool(t: Tables) -> DataFrame:
    """Current awards plus archived ones not already current."""
    return boards.pricing_pool(t.bids.filter("ordinal % 2 = 0"), t.bids.filter("ordinal % 3 = 0")).select("opportunity_id", "award_amount")


_VID = "substr(sha1(regexp_replace(regexp_replace(lower({0}), '\\b(llc|l\\.l\\.c|inc|incorporated|corp|corporation|co|company|ltd|llp|pa|pllc)\\b\\.?', '', 'g'), '[^a-z0-9]+', '', 'g')), 1, 16)"


@query("vendor_profiles", f"""WITH rw AS (SELECT {_VID.format('awarded_vendor')} AS vid, trim(awarded_vendor) AS name, agency, ordinal AS seq, 1 AS aw, 0 AS ct, coalesce(award_amount, 0) AS d,
      coalesce(award_date, posted_date) AS decided, list_filter(categories, lambda c: c <> 'general') AS tags FROM bids WHERE status = 'award' AND coalesce(awarded_vendor, '') <> ''
    UNION ALL SELECT {_VID.format('vendor')}, trim(vendor), agency, 1000000000000 + supplier_key * 100000000 + order_key * 10 + line, 0, 1, 0, NULL, CAST([] AS VARCHAR[]) FROM contracts WHERE coalesce(vendor, '') <> ''),
    tot AS (SELECT vid, CAST(sum(aw) AS BIGINT) AS awards, NULLIF(CAST(sum(d) AS BIGINT), 0) AS awarded_total, CAST(sum(ct) AS BIGINT) AS contracts, max(decided) AS last_award FROM rw GROUP BY vid),
    nm AS (SELECT vid, name FROM (SELECT vid, name, row_number() OVER (PARTITION BY vid ORDER BY count(*) DESC, min(seq)) AS rn FROM rw GROUP BY vid, name) WHERE rn = 1),
    ag AS (SELECT vid, string_agg(agency, ', ' ORDER BY rn) AS agencies FROM (SELECT vid, agency, row_number() OVER (PARTITION BY vid ORDER BY count(*) DESC, min(seq)) AS rn FROM rw GROUP BY vid, agency) WHERE rn <= 3 GROUP BY vid),
    tg AS (SELECT vid, string_agg(tag, ', ' ORDER BY rn) AS tags FROM (SELECT vid, tag, row_number() OVER (PARTITION BY vid ORDER BY count(*) DESC, min(seq * 10 + i)) AS rn FROM
      (SELECT vid, seq, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM rw) GROUP BY vid, tag) WHERE rn <= 3 GROUP BY vid)
    SELECT vid AS vendor_id, name, awards, awarded_total, contracts, last_award, agencies, coalesce(tags, '') AS categories FROM tot JOIN nm USING (vid) JOIN ag USING (vid) LEFT JOIN tg USING (vid)
    ORDER BY awards DESC, coalesce(awarded_total, 0) DESC, contracts DESC, vid LIMIT 200""", ("bids", "contracts"))
def vendor_profiles(t: Tables) -> DataFrame:
    held = t.contracts.withColumn("ordinal", F.col("supplier_key") * 100_000_000 + F.col("order_key") * 10 + F.col("line"))
    return pricing.vendor_profiles(t.bids, held).orderBy(*pricing.vendor_order(), "vendor_id").limit(200).select(
        "vendor_id", "name", "awards", "awarded_total", "contracts", "last_award", F.array_join("agencies", ", ").alias("agencies"),
        F.array_join("categories", ", ").alias("categories"))


STANDING = """st AS (SELECT user_id AS firm, coalesce(NULLIF(arg_max(CASE WHEN event_id % 13 = 0 THEN '' ELSE CASE event_type WHEN 'purchase' THEN 'committed'
      WHEN 'click' THEN 'pitched' WHEN 'signup' THEN 'interested' WHEN 'error' THEN 'passed' ELSE 'prospect' END END, event_id), ''), 'prospect') AS status FROM events GROUP BY user_id),
    f AS (SELECT s_suppkey AS firm, s_name AS name, coalesce(st.status, 'prospect') AS status FROM supplier LEFT JOIN st ON st.firm = s_suppkey)"""


def firms(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("firm"), F.col("s_name").alias("name"))


def relationship(t: Tables) -> DataFrame:
    """The newest of each firm's status rows, told by the event log."""
    told = F.expr("""CASE WHEN event_id % 13 = 0 THEN '' ELSE CASE event_type WHEN 'purchase' THEN 'committed' WHEN 'click' THEN 'pitched'
        WHEN 'signup' THEN 'interested' WHEN 'error' THEN 'passed' ELSE 'prospect' END END""")
    return matches.latest_status(t.events.select(F.col("user_id").alias("firm"), "event_id", told.alias("status")), "firm", "event_id")


@query("contractor_network", f"""WITH {STANDING}, m AS (SELECT DISTINCT l_suppkey AS firm, b.opportunity_id, b.ordinal, b.first_seen_at AS matched_at FROM lineitem JOIN bids b ON l_orderkey = b.ordinal),
    r AS (SELECT *, count(*) OVER (PARTITION BY firm) AS matched, row_number() OVER (PARTITION BY firm ORDER BY matched_at DESC, ordinal DESC) AS place FROM m)
    SELECT f.firm, f.name, f.status, coalesce(r.matched, 0) AS matched, CAST(coalesce(r.place, 0) AS INTEGER) AS place, r.opportunity_id
    FROM f LEFT JOIN r ON r.firm = f.firm AND r.place <= 5""", "bids")
def contractor_network(t: Tables) -> DataFrame:
    """Every firm with its status, its number of matched bids and the five newest, a row each."""
    found = (t.lineitem.select(F.col("l_suppkey").alias("firm"), F.col("l_orderkey").alias("ordinal")).distinct()
             .join(t.bids.select("ordinal", "opportunity_id", F.col("first_seen_at").alias("matched_at")), "ordinal"))
    return matches.firm_network(firms(t), found, relationship(t)).select("firm", "name", "status", "matched", "place", "opportunity_id")


@query("contractor_status_counts", f"""WITH {STANDING}, s(status) AS (VALUES ('prospect'), ('pitched'), ('interested'), ('committed'), ('passed'))
    SELECT s.status, count(f.firm) AS count FROM s LEFT JOIN f USING (status) GROUP BY s.status""")
def contractor_status_counts(t: Tables) -> DataFrame:
    return marts.tally(matches.standing(firms(t), relationship(t)), "status", "status", ["prospect", "pitched", "interested", "committed", "passed"])


# What contracts buy, told by their names: a class for each noun of the parts list, new and old ones, and sizes above them.
GOODS = (*(classify.Category(noun, noun.capitalize(), "goods", "goods", (rf"\b{noun}s?\b",), "hardware" if noun in ("bolt", "rod", "ring") else None)
           for noun in ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")),
         classify.Category("replacement", "Replacement", "goods", "mixed", (r"\bnew\s+\w+",)), classify.Category("hardware", "Hardware", "goods", "goods"))


@query("contract_prices_by_class", f"""WITH f AS (SELECT amount, name || ' ' || commodity AS b FROM contracts WHERE amount > 0), {classify_sql(GOODS, 'f', 'amount')},
    smp AS (SELECT unnest(CASE WHEN len(tags) > 0 THEN tags ELSE ['general'] END) AS slug, CAST(round_even(amount, 0) AS BIGINT) AS dollars FROM g), {OVERALL_SQL} SELECT * FROM ov""", "contracts")
def contract_prices_by_class(t: Tables) -> DataFrame:
    """Price ranges of contracts by what their names say they buy."""
    tagged = classify.classify(t.contracts.filter(F.col("amount") > 0), F.concat_ws(" ", "name", "commodity"), GOODS)
    tags = F.filter("categories", lambda c: c != "general")
    rows = tagged.withColumn("slug", F.explode(F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("general")))))
    return pricing.price_buckets(pricing.contract_samples(rows, F.col("slug")), ["slug"])
