"""Ranked picks, latest rows and capped sections (family H)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.functions import text
from tenderloom.functions.base import first_rows, numbered, with_scalars
from tenderloom.operators import boards, filters, health, ranking, runs
from tenderloom.operators.dedupe import keep_last_by
from tenderloom.plans.q_market import WORKFLOW, workflow
from tenderloom.plans.registry import query
from tenderloom.plans.sqltext import BARE_REF, BUDGET, DAYS, RANK
from tenderloom.plans.tables import AS_OF, EVENTS_AS_OF, Tables
from tenderloom.session import cut_lineage


@query("fair_share", """SELECT ordinal, source_id, turn FROM (SELECT ordinal, source_id,
      CAST(row_number() OVER (PARTITION BY source_id ORDER BY due_date ASC NULLS LAST, ordinal) AS INTEGER) AS turn
    FROM bids WHERE status IN ('open', 'upcoming', 'award') AND NOT personalized)
    ORDER BY turn, source_id LIMIT 403""", "bids")
def fair_share(t: Tables) -> DataFrame:
    pool = filters.enrichment_candidates(t.bids, "personalized")
    return ranking.fair_share(pool, 403).select("ordinal", "source_id", "turn")


@query("primary_package", f"""WITH d AS (SELECT ordinal, {BARE_REF} AS ref, unnest(documents) AS doc,
      generate_subscripts(documents, 1) AS pos FROM bids),
    r AS (SELECT ordinal, doc.url AS url, row_number() OVER (PARTITION BY ordinal ORDER BY doc.kind = 'addendum',
      NOT coalesce(length(ref) >= 5 AND contains(regexp_replace(lower(doc.name), '[^a-z0-9]', '', 'g'), ref), false), pos) AS rn
      FROM d WHERE ends_with(split_part(lower(doc.url), '?', 1), '.pdf'))
    SELECT b.ordinal, r.url AS package_url FROM bids b LEFT JOIN r ON b.ordinal = r.ordinal AND r.rn = 1""", "bids")
def primary_package(t: Tables) -> DataFrame:
    return ranking.primary_package(t.bids).select("ordinal", "package_url")


RUN_ROWS = """runs_n AS (SELECT source_id, CAST(date_diff('day', DATE '2024-01-01', run_day) AS INTEGER) AS run_no,
    CAST(run_day AS TIMESTAMP) AS run_at, row_count, events, had_error,
    CASE WHEN row_count > 0 THEN 'ok' WHEN events % 2 = 0 THEN 'empty' ELSE 'ok' END AS status,
    CASE WHEN events % 3 = 0 THEN 'slow portal' END AS note FROM runs)"""


def run_rows(t: Tables) -> DataFrame:
    return t.runs.select(
        "source_id", F.datediff("run_day", F.lit("2024-01-01").cast("date")).alias("run_no"),
        F.col("run_day").cast("timestamp_ntz").alias("run_at"), "row_count", "events", "had_error",
        F.expr("CASE WHEN row_count > 0 THEN 'ok' WHEN events % 2 = 0 THEN 'empty' ELSE 'ok' END").alias("status"),
        F.expr("CASE WHEN events % 3 = 0 THEN 'slow portal' END").alias("note"))


def newest_run(t: Tables) -> DataFrame:
    rows = run_rows(t)
    return with_scalars(rows, rows.agg(F.max("run_no").alias("newest"))).filter("run_no = newest").drop("newest")


RUN_LOG = f"""{RUN_ROWS}, run_log AS (SELECT run_no, CAST(sum(row_count) AS BIGINT) AS opp_count,
    CAST(sum(had_error) AS BIGINT) AS errors, CASE WHEN run_no % 7 = 3 THEN 'running' WHEN run_no % 7 = 5 THEN 'error'
    ELSE 'done' END AS status FROM runs_n GROUP BY run_no)"""


def run_log(t: Tables) -> DataFrame:
    return run_rows(t).groupBy("run_no").agg(F.sum("row_count").alias("opp_count"),
                                             F.sum("had_error").alias("errors")) \
        .withColumn("status", F.expr("CASE WHEN run_no % 7 = 3 THEN 'running' WHEN run_no % 7 = 5 THEN 'error' ELSE 'done' END"))


JUDGED = """dr AS (SELECT run_no, count(*) FILTER (status = 'done') OVER (ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seq,
      status = 'done' AS done FROM run_log),
    n AS (SELECT r.*, list_sort(list(row_count) FILTER (done) OVER (PARTITION BY source_id ORDER BY seq
      RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING)) AS past FROM runs_n r JOIN dr USING (run_no)),
    m AS (SELECT *, past[len(past) // 2 + 1] AS norm FROM n),
    jd AS (SELECT source_id, run_no, row_count, norm,
      CASE WHEN norm >= 3 AND row_count = 0 AND status IN ('ok', 'empty') THEN 'degraded' ELSE status END AS status,
      CASE WHEN norm IS NULL OR norm < 3 THEN note
        WHEN row_count = 0 AND status IN ('ok', 'empty') THEN 'returned 0 rows; this source''s recent norm is ' || norm
        WHEN row_count < norm * 0.3 AND norm >= 10 THEN CASE WHEN coalesce(note, '') = '' THEN '' ELSE note || '; ' END
          || 'sharp drop: ' || row_count || ' rows vs recent norm ' || norm ELSE note END AS note FROM m)"""


def run_table(t: Tables, verdict=None) -> DataFrame:
    """Runs as they are kept: one row each, the health of its sources inside."""
    rows = run_rows(t).select("run_no", "source_id", F.concat(F.lit("Portal "), "source_id").alias("name"), (F.col("status") if verdict is None else verdict).alias("status"),
                              F.col("row_count").alias("count"), F.when(F.col("had_error") == 1, "timeout").alias("error"), "note", (F.col("events") * 10).alias("elapsed_ms"))
    log = run_log(t).select("run_no", F.lit(None).cast("timestamp_ntz").alias("finished_at"), "status", "opp_count", F.lit(0).cast("long").alias("new_count"))
    return cut_lineage(runs.embed(rows, log, ["source_id", "name", "status", "count", "error", "note", "elapsed_ms"]))


def known_sources(t: Tables) -> DataFrame:
    return t.runs.select("source_id").distinct()


@query("source_drops", f"WITH {RUN_LOG}, {JUDGED} SELECT source_id, run_no, norm, status, note FROM jd", "runs")
def source_drops(t: Tables) -> DataFrame:
    return health.source_drops(run_rows(t), run_log(t).filter("status = 'done'").select("run_no")).select("source_id", "run_no", "norm", "status", "note")


@query("never_verified", f"""WITH {RUN_ROWS}, q AS (SELECT *, CASE WHEN hash_mod = 0 THEN 0 ELSE row_count END AS rc FROM
      (SELECT *, CAST(substr(source_id, 4) AS INTEGER) % 5 AS hash_mod FROM runs_n)),
    h AS (SELECT source_id, count(*) AS seen, max(rc) AS best, min(run_at) AS since FROM q
      WHERE run_no < (SELECT max(run_no) FROM q) AND run_no > (SELECT max(run_no) FROM q WHERE run_no < (SELECT max(run_no) FROM q)) - 120 GROUP BY source_id),
    c AS (SELECT source_id, rc, CASE WHEN rc = 0 THEN 'empty' ELSE 'ok' END AS status, note FROM q WHERE run_no = (SELECT max(run_no) FROM q)),
    f AS (SELECT c.*, seen, date_diff('second', since, TIMESTAMP '{EVENTS_AS_OF} 00:00:00') // 86400 AS days, coalesce(best, 0) AS best
      FROM c LEFT JOIN h USING (source_id))
    SELECT source_id, CASE WHEN rc = 0 AND best = 0 AND seen + 1 >= 6 AND days >= 7 THEN 'unverified' ELSE status END AS status,
      CASE WHEN rc = 0 AND best = 0 AND seen + 1 >= 6 AND days >= 7 THEN concat_ws('; ', note, 'no record in ' || (seen + 1)
        || ' fetches over ' || days || ' days — never verified as a live board') ELSE note END AS note FROM f""", "runs")
def never_verified(t: Tables) -> DataFrame:
    rows = run_rows(t).withColumn("row_count", F.when(F.substring("source_id", 4, 20).cast("int") % 5 == 0, F.lit(0))
                                  .otherwise(F.col("row_count")))
    rows = with_scalars(rows, rows.agg(F.max("run_no").alias("newest")))
    current = rows.filter("run_no = newest").select(
        "source_id", "row_count", F.when(F.col("row_count") == 0, "empty").otherwise("ok").alias("status"), "note")
    return health.never_verified(rows.filter("run_no < newest").select("source_id", "run_no", "run_at", "row_count"),
                                 current, f"{EVENTS_AS_OF} 00:00:00").select("source_id", "status", "note")


@query("source_productivity", f"""WITH {RUN_ROWS} SELECT source_id, row_count, status FROM runs_n
    WHERE run_no = (SELECT max(run_no) FROM runs_n) ORDER BY row_count DESC, source_id LIMIT 10""", "runs")
def source_productivity(t: Tables) -> DataFrame:
    return runs.productivity(run_table(t)).select("source_id", F.col("count").alias("row_count"), "status")


@query("run_trend", f"""WITH {RUN_LOG} SELECT run_no, opp_count FROM (SELECT * FROM run_log ORDER BY run_no DESC LIMIT 30)
    WHERE status = 'done'""", "runs")
def run_trend(t: Tables) -> DataFrame:
    return runs.trend(run_table(t)).select("run_no", "opp_count")


@query("latest_health", f"""WITH {RUN_ROWS}, j AS (SELECT *, CASE WHEN had_error = 1 AND row_count = 0 THEN 'error'
      WHEN had_error = 1 THEN 'degraded' ELSE status END AS verdict FROM runs_n)
    SELECT source_id, verdict, row_count FROM j WHERE run_no = (SELECT max(run_no) FROM j)
      AND verdict IN ('degraded', 'error') ORDER BY source_id LIMIT 6""", "runs")
def latest_health(t: Tables) -> DataFrame:
    """Problem sources of the newest run, read from runs that embed their health rows."""
    verdict = F.expr("CASE WHEN had_error = 1 AND row_count = 0 THEN 'error' WHEN had_error = 1 THEN 'degraded' ELSE status END")
    return runs.problems(run_table(t, verdict)).select("source_id", F.col("status").alias("verdict"), F.col("count").alias("row_count"))


@query("health_counts", f"""WITH {RUN_ROWS}, s AS (SELECT DISTINCT source_id FROM runs_n),
    h AS (SELECT source_id, status FROM runs_n WHERE run_no = (SELECT max(run_no) FROM runs_n))
    SELECT coalesce(h.status, 'silent') AS status, count(*) AS count FROM s LEFT JOIN h USING (source_id) GROUP BY 1""", "runs")
def health_counts(t: Tables) -> DataFrame:
    return runs.status_counts(known_sources(t), run_table(t))


@query("source_status", f"""WITH {RUN_ROWS}, s AS (SELECT DISTINCT source_id FROM runs_n),
    h AS (SELECT source_id, status, row_count FROM runs_n WHERE run_no = (SELECT max(run_no) FROM runs_n)), l AS (SELECT max(run_no) AS last_run,
      (SELECT CAST(sum(row_count) AS BIGINT) FROM runs_n WHERE run_no = (SELECT max(run_no) FROM runs_n)) AS last_count FROM runs_n)
    SELECT s.source_id, h.status, h.row_count, l.last_run, l.last_count FROM s LEFT JOIN h USING (source_id) CROSS JOIN l""", "runs")
def source_status(t: Tables) -> DataFrame:
    return runs.source_status(known_sources(t), run_table(t)).withColumnRenamed("count", "row_count")


@query("user_sort", f"""SELECT * FROM (SELECT 'value' AS sort_key, CAST(row_number() OVER (ORDER BY {BUDGET} DESC NULLS LAST, title, ordinal)
      AS INTEGER) AS place, ordinal FROM bids UNION ALL SELECT 'due', CAST(row_number() OVER (ORDER BY due_date ASC NULLS LAST,
      title, ordinal) AS INTEGER), ordinal FROM bids)""", "bids")
def user_sort(t: Tables) -> DataFrame:
    """Two sort orders over every row, each with its places."""
    def page(name: str, key, descending: bool) -> DataFrame:
        order = [*filters.user_sort(key, descending), F.col("ordinal").asc()]
        # a list is written to be numbered: only what orders it and names its rows
        sorted_by = t.bids.select("ordinal", "title", "due_date", "budget")
        return numbered(sorted_by, order, "place").select(F.lit(name).alias("sort_key"), "place", "ordinal")

    return page("value", text.budget_amount("budget"), True).unionByName(page("due", F.col("due_date"), False))


@query("source_order", f"""WITH {RUN_ROWS}, s AS (SELECT DISTINCT source_id FROM runs_n), h AS (SELECT source_id, status, row_count FROM runs_n WHERE run_no = (SELECT max(run_no) FROM runs_n))
    SELECT source_id, CAST(row_number() OVER (ORDER BY CASE status WHEN 'error' THEN 1 WHEN 'degraded' THEN 2 WHEN 'empty' THEN 3 WHEN 'ok' THEN 4 ELSE 6 END, source_id) AS INTEGER) AS place
    FROM s LEFT JOIN h USING (source_id)""", "runs")
def source_order(t: Tables) -> DataFrame:
    """Sources as their page lists them: what needs attention first, silent ones last."""
    rows = runs.source_status(known_sources(t), run_table(t))
    order = [boards.status_order(F.col("status"), ["error", "degraded", "empty", "ok"]).asc(), F.col("source_id").asc()]
    return numbered(rows, order, "place").select("source_id", "place")


@query("awards_recent", """SELECT ordinal, coalesce(award_date, posted_date) AS decided_on FROM bids WHERE status = 'award'
    ORDER BY coalesce(award_date, posted_date) DESC NULLS LAST, ordinal LIMIT 300""", "bids")
def awards_recent(t: Tables) -> DataFrame:
    return boards.recent_awards(t.bids).select("ordinal", "decided_on")


@query("capped_sections", f"""SELECT county, position, ordinal, section_size, greatest(section_size - 10, 0) AS more FROM (
      SELECT county, CAST(row_number() OVER (PARTITION BY county ORDER BY coalesce({DAYS}, 9999), lower(title), ordinal) AS INTEGER) AS position,
        ordinal, count(*) OVER (PARTITION BY county) AS section_size FROM bids WHERE status = 'open') WHERE position <= 10""", "bids")
def capped_sections(t: Tables) -> DataFrame:
    from tenderloom.operators.watchlists import soonest_first
    return ranking.capped(t.bids.filter("status = 'open'"), soonest_first(AS_OF), cap=10, by=["county"]) \
        .select("county", "position", "ordinal", "section_size", "more")


@query("named_few", f"""WITH soon AS (SELECT * FROM contracts WHERE date_diff('day', DATE '{AS_OF}', end_date) BETWEEN 0 AND 90),
    top AS (SELECT *, row_number() OVER (ORDER BY end_date, name, order_key, line, part_key, supplier_key) AS rn FROM soon)
    SELECT (SELECT count(*) FROM soon) AS total, string_agg(substr(name, 1, 60) || ' (' || substr(agency, 1, 28) || ', ends ' || end_date || ')',
      '; ' ORDER BY rn) || '; and ' || ((SELECT count(*) FROM soon) - 5) || ' more' AS body FROM top WHERE rn <= 5""", "contracts")
def named_few(t: Tables) -> DataFrame:
    soon = filters.expiring(t.contracts, AS_OF, days=90)
    label = F.concat(F.substring("name", 1, 60), F.lit(" ("), F.substring("agency", 1, 28), F.lit(", ends "),
                     F.col("end_date").cast("string"), F.lit(")"))
    order = [F.col(c) for c in ("end_date", "name", "order_key", "line", "part_key", "supplier_key")]
    return ranking.named_few(soon, label, order)


@query("latest_per_key", """SELECT entity_id, platform, event_id FROM log WHERE event_type <> 'error'
    QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_id DESC) = 1""", "log")
def latest_per_key(t: Tables) -> DataFrame:
    return keep_last_by(t.log.filter("event_type <> 'error'"), ["entity_id"], "event_id") \
        .select("entity_id", "platform", "event_id")


@query("cutoff_scan", """WITH o AS (SELECT entity_id, event_id, value, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id) AS pos FROM log),
    s AS (SELECT entity_id, min(pos) AS stop FROM o WHERE value > 120 GROUP BY entity_id)
    SELECT o.entity_id, o.event_id FROM o LEFT JOIN s USING (entity_id) WHERE (s.stop IS NULL OR o.pos < s.stop)
    QUALIFY row_number() OVER (PARTITION BY o.entity_id ORDER BY pos) <= 25""", "log")
def cutoff_scan(t: Tables) -> DataFrame:
    newest_first = [-F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id")]
    return ranking.scan_until(t.log, newest_first, F.col("value") > 120, cap=25, bucket="entity_id") \
        .select("entity_id", "event_id")


@query("recent_per_group", """SELECT method, order_key, line, part_key, supplier_key, end_date FROM contracts
    WHERE end_date BETWEEN DATE '1998-03-01' AND DATE '1998-09-02'
    QUALIFY row_number() OVER (PARTITION BY method ORDER BY end_date DESC, order_key, line, part_key, supplier_key) <= 20""", "contracts")
def recent_per_group(t: Tables) -> DataFrame:
    inside = t.contracts.filter(F.col("end_date").between("1998-03-01", "1998-09-02"))
    order = [F.col("end_date").desc(), *[F.col(c) for c in ("order_key", "line", "part_key", "supplier_key")]]
    return first_rows(inside, ["method"], order, n=20).select(
        "method", "order_key", "line", "part_key", "supplier_key", "end_date")


@query("pipeline_board", f"""WITH {WORKFLOW} SELECT wf.stage, wf.opportunity_id,
    CAST(row_number() OVER (PARTITION BY wf.stage ORDER BY {DAYS} ASC NULLS LAST, b.title, b.ordinal) AS INTEGER) AS place,
    CAST(len(list_filter(range(len(b.requirements)), lambda i: NOT list_contains(wf.ticked, CAST(i AS VARCHAR)))) AS INTEGER) AS unmet
    FROM wf JOIN bids b USING (opportunity_id) WHERE wf.stage IN ('watching', 'preparing', 'submitted', 'result') AND NOT wf.archived""", "bids")
def pipeline_board(t: Tables) -> DataFrame:
    """Every card of each stage, soonest due first, with unmet requirements."""
    return boards.pipeline_board(t.bids, workflow(t.bids), AS_OF).select("stage", "opportunity_id", "place", "unmet")


@query("attention", f"""WITH {WORKFLOW}, a AS (SELECT wf.opportunity_id, wf.stage, {DAYS} AS days, b.ordinal,
      CAST(len(list_filter(range(len(b.requirements)), lambda i: NOT list_contains(wf.ticked, CAST(i AS VARCHAR)))) AS INTEGER) AS unmet
      FROM wf JOIN bids b USING (opportunity_id) WHERE NOT wf.archived AND wf.stage <> 'result')
    SELECT opportunity_id, stage, days, unmet FROM a WHERE days >= 0 AND (days <= 7 OR (unmet > 0 AND days <= 14))
    ORDER BY days, ordinal LIMIT 8""", "bids")
def attention(t: Tables) -> DataFrame:
    return boards.attention(t.bids, workflow(t.bids), AS_OF).select("opportunity_id", "stage", "days", "unmet")


@query("snapshot_csv_order", f"""SELECT ordinal, place FROM (SELECT ordinal, CAST(row_number() OVER (ORDER BY {RANK}, due_date ASC NULLS LAST,
    county, agency, ordinal) AS INTEGER) AS place FROM bids)""", "bids")
def snapshot_csv_order(t: Tables) -> DataFrame:
    order = [*filters.listing_order()[:4], F.col("ordinal").asc()]
    return numbered(t.bids, order, "place").select("ordinal", "place")


@query("sweep_todo", """WITH l AS (SELECT entity_id, platform FROM log QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_id DESC) = 1),
    roster AS (SELECT 'ent' || c_custkey AS entity_id, lower(c_mktsegment) AS tier FROM customer),
    mapped AS (SELECT 'ent' || s_suppkey AS entity_id FROM supplier WHERE s_suppkey % 3 = 0)
    SELECT entity_id, tier FROM roster WHERE tier IN ('building', 'machinery')
      AND entity_id NOT IN (SELECT entity_id FROM l WHERE platform <> 'unknown') AND entity_id NOT IN (SELECT entity_id FROM mapped)""", "log")
def sweep_todo(t: Tables) -> DataFrame:
    roster = t.customer.select(F.concat(F.lit("ent"), F.col("c_custkey").cast("string")).alias("entity_id"), F.lower("c_mktsegment").alias("tier"))
    mapped = t.supplier.filter("s_suppkey % 3 = 0").select(F.concat(F.lit("ent"), F.col("s_suppkey").cast("string")).alias("entity_id"))
    return boards.sweep_todo(roster, keep_last_by(t.log, ["entity_id"], "event_id"), mapped, ["building", "machinery"])


@query("directory_filter", """SELECT s_suppkey AS entity, s_name AS name, CASE WHEN s_suppkey % 4 <> 0 THEN 'T' || s_suppkey END AS code
    FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 AND s_acctbal > 0 AND s_suppkey % 4 <> 0""")
def directory_filter(t: Tables) -> DataFrame:
    """Active directory entries of one state that carry a nested tenant code, by name."""
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"), F.col("n_regionkey").alias("state"), (F.col("s_acctbal") > 0).alias("active"),
        F.struct(F.expr("CASE WHEN s_suppkey % 4 <> 0 THEN concat('T', s_suppkey) END").alias("code")).alias("tenant"))
    return boards.directory(rows, F.col("state") == 1, F.col("active"), F.col("tenant.code")).select("entity", "name", "code")


@query("sweep_report", """WITH l AS (SELECT entity_id, platform, event_id % 13 AS why FROM log
      QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_id DESC) = 1)
    SELECT 'platform' AS section, platform AS key, count(*) AS count, round_even(100 * count(*) / (SELECT count(*) FROM l), 1) AS pct FROM l GROUP BY platform
    UNION ALL SELECT * FROM (SELECT 'reason', 'reason ' || why, count(*), NULL FROM l WHERE platform = 'unknown' GROUP BY why ORDER BY 3 DESC, 2 LIMIT 10)""", "log")
def sweep_report(t: Tables) -> DataFrame:
    """Platform histogram with shares, and the ten commonest reasons for an unknown."""
    latest = keep_last_by(t.log, ["entity_id"], "event_id")
    return boards.sweep_report(latest, F.concat(F.lit("reason "), (F.col("event_id") % 13).cast("string")))