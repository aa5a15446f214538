"""Snapshot, queue and cache upkeep (family L) and the set operations behind it (I)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom import schemas
from tenderloom.operators import marts, state
from tenderloom.plans.registry import query
from tenderloom.plans.tables import Tables

NOW = "2002-01-01 00:00:00"

# The stored snapshot holds keys 0-3 mod 5, the new fetch 1-4; both carry key, status and due date.
_OLD = """old AS (SELECT opportunity_id, ordinal, CASE WHEN ordinal % 4 = 0 THEN 'open' ELSE status END AS status, first_seen_at AS fs, first_seen_at AS ls FROM bids WHERE ordinal % 5 < 4)"""
_NEW = "new AS (SELECT opportunity_id, ordinal, status FROM bids WHERE ordinal % 5 > 0)"


def _old(t: Tables) -> DataFrame:
    return t.bids.filter("ordinal % 5 < 4").select(
        "opportunity_id", "ordinal", F.expr("CASE WHEN ordinal % 4 = 0 THEN 'open' ELSE status END").alias("status"),
        "first_seen_at", F.col("first_seen_at").alias("last_seen_at"))


def _new(t: Tables) -> DataFrame:
    return t.bids.filter("ordinal % 5 > 0").select("opportunity_id", "ordinal", "status")


MERGE_SQL = f"""WITH {_OLD}, {_NEW} SELECT opportunity_id, CASE WHEN new.opportunity_id IS NOT NULL THEN new.status
      WHEN old.status IN ('open', 'upcoming') AND old.ordinal % 15 <> 0 THEN 'closed' ELSE old.status END AS status,
    coalesce(old.fs, TIMESTAMP '{NOW}') AS first_seen_at, CASE WHEN new.opportunity_id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE old.ls END AS last_seen_at,
    new.opportunity_id IS NOT NULL AS present, old.opportunity_id IS NULL AS is_new FROM old FULL JOIN new USING (opportunity_id)"""


@query("snapshot_merge", MERGE_SQL, "bids")
def snapshot_merge(t: Tables) -> DataFrame:
    tracked = t.bids.filter("ordinal % 15 = 0").select("opportunity_id")
    return state.merge_snapshot(_old(t), _new(t), tracked, NOW).drop("ordinal")


@query("snapshot_diff", f"""WITH {_OLD}, {_NEW} SELECT opportunity_id, CASE WHEN old.opportunity_id IS NULL THEN 'new' ELSE 'gone' END AS change
    FROM old FULL JOIN new USING (opportunity_id) WHERE old.opportunity_id IS NULL OR new.opportunity_id IS NULL""", "bids")
def snapshot_diff(t: Tables) -> DataFrame:
    return state.snapshot_diff(_old(t), _new(t))


@query("present_only", """SELECT opportunity_id, agency, amount FROM (SELECT opportunity_id, agency, award_amount AS amount, ordinal FROM bids) WHERE ordinal % 3 <> 0 AND ordinal % 7 <> 0""", "bids")
def present_only(t: Tables) -> DataFrame:
    """Present rows of a payload table; payloads that do not parse are skipped."""
    good = F.to_json(F.struct("agency", F.col("award_amount").alias("amount")), {"ignoreNullFields": "false"})
    stored = t.bids.select("opportunity_id", (F.col("ordinal") % 3 != 0).alias("present"),
                           F.when(F.col("ordinal") % 7 == 0, F.lit('{"agency": ')).otherwise(good).alias("payload"))
    parsed = stored.filter("present").select("opportunity_id", F.from_json(
        "payload", "agency string, amount long, broken string", {"columnNameOfCorruptRecord": "broken"}).alias("p"))
    return parsed.filter(F.col("p.broken").isNull()).select("opportunity_id", "p.agency", "p.amount")


@query("contract_upsert", """WITH o AS (SELECT order_key, line, part_key, supplier_key, source_id, 'old' AS v FROM contracts WHERE order_key % 3 <> 0),
    n AS (SELECT order_key, line, part_key, supplier_key, source_id, 'new' AS v FROM contracts WHERE order_key % 4 = 0 AND source_id <> 'register-n')
    SELECT * FROM n UNION ALL SELECT * FROM o WHERE (source_id, order_key, line) NOT IN (SELECT source_id, order_key, line FROM n)""", "contracts")
def contract_upsert(t: Tables) -> DataFrame:
    rows = t.contracts.select("order_key", "line", "part_key", "supplier_key", "source_id")
    old = rows.filter("order_key % 3 <> 0").withColumn("v", F.lit("old"))
    new = rows.filter("order_key % 4 = 0 AND source_id <> 'register-n'").withColumn("v", F.lit("new"))
    return state.upsert(old, new, ["source_id", "order_key", "line"])


@query("fill_blank_upsert", """WITH o AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS name, CASE WHEN s_suppkey % 3 = 0 THEN '555' END AS phone, s_suppkey % 4 = 0 AS oldkey FROM supplier WHERE s_suppkey % 5 <> 0),
    i AS (SELECT s_suppkey AS id, 'in ' || s_name AS name, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE '777' END AS phone FROM supplier WHERE s_suppkey % 3 <> 1)
    SELECT coalesce(o.id, i.id) AS id, coalesce(NULLIF(o.name, ''), NULLIF(i.name, '')) AS name, coalesce(NULLIF(o.phone, ''), NULLIF(i.phone, '')) AS phone,
      CASE WHEN i.id IS NOT NULL THEN 'new' WHEN o.oldkey THEN 'old' END AS exp, CASE WHEN o.id IS NOT NULL THEN 'y' END AS kept FROM o FULL JOIN i ON o.id = i.id""")
def fill_blank_upsert(t: Tables) -> DataFrame:
    s = t.supplier
    old = s.filter("s_suppkey % 5 <> 0").selectExpr(
        "s_suppkey AS id", "CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS name", "CASE WHEN s_suppkey % 3 = 0 THEN '555' END AS phone",
        "CASE WHEN s_suppkey % 4 = 0 THEN map('exp', 'old', 'kept', 'y') ELSE map('kept', 'y') END AS profile")
    new = s.filter("s_suppkey % 3 <> 1").selectExpr(
        "s_suppkey AS id", "concat('in ', s_name) AS name", "CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE ' 777 ' END AS phone", "map('exp', 'new') AS profile")
    return state.fill_blanks(old, new, "id", ["name", "phone"], merged_map="profile").select(
        "id", "name", "phone", F.col("profile")["exp"].alias("exp"), F.col("profile")["kept"].alias("kept"))


WF_EVENTS = """we AS (SELECT event_id AS seq, user_id AS opportunity_id, CAST(ts AS DATE) AS day, CASE WHEN event_id % 11 = 0 THEN 'watching' WHEN event_id % 11 = 1 THEN 'submitted' END AS stage,
    CASE WHEN event_id % 11 = 2 THEN 'go' WHEN event_id % 11 = 3 THEN 'nogo' END AS decision, CASE WHEN event_id % 97 = 4 THEN 'won' END AS outcome,
    CASE WHEN event_id % 11 = 5 THEN 'sent' WHEN event_id % 11 = 6 THEN 'received' END AS mail FROM events)"""


@query("workflow_fold", f"""WITH {WF_EVENTS}, s AS (SELECT opportunity_id, arg_max(CASE WHEN outcome IS NOT NULL THEN 'result' ELSE stage END, seq) FILTER (outcome IS NOT NULL OR stage IS NOT NULL) AS st,
      coalesce(max(seq) FILTER (outcome IS NOT NULL OR stage IS NOT NULL), -1) AS sat, max(seq) FILTER (decision = 'go') AS gat,
      arg_max(decision, seq) FILTER (decision IS NOT NULL) AS decision, arg_max(outcome, seq) FILTER (outcome IS NOT NULL) AS outcome,
      arg_min(day, seq) FILTER (mail = 'sent') AS sent_on, arg_min(day, seq) FILTER (mail = 'received') AS received_on, count(*) AS events FROM we GROUP BY opportunity_id)
    SELECT opportunity_id, CASE WHEN coalesce(st, 'watching') = 'watching' AND coalesce(gat >= sat, false) THEN 'preparing' ELSE coalesce(st, 'watching') END AS stage,
      decision, outcome, sent_on, received_on, events FROM s""")
def workflow_fold(t: Tables) -> DataFrame:
    events = t.events.selectExpr(
        "event_id AS seq", "user_id AS opportunity_id", "CAST(ts AS DATE) AS at",
        "CASE WHEN event_id % 11 = 0 THEN 'watching' WHEN event_id % 11 = 1 THEN 'submitted' END AS stage",
        "CASE WHEN event_id % 11 = 2 THEN 'go' WHEN event_id % 11 = 3 THEN 'nogo' END AS decision", "CASE WHEN event_id % 97 = 4 THEN 'won' END AS outcome",
        "CASE WHEN event_id % 11 = 5 THEN 'sent' WHEN event_id % 11 = 6 THEN 'received' END AS mail")
    return state.fold_workflow(events)


@query("run_lifecycle", """WITH r AS (SELECT CAST(date_diff('day', DATE '2024-01-01', run_day) AS INTEGER) AS run_no, CAST(sum(row_count) AS BIGINT) AS opp_count FROM runs GROUP BY 1),
    s AS (SELECT *, CASE WHEN run_no % 7 = 3 OR run_no = (SELECT max(run_no) FROM r) THEN 'running' ELSE 'done' END AS status FROM r)
    SELECT run_no, opp_count, CASE WHEN status = 'running' AND run_no < (SELECT max(run_no) FROM s) THEN 'died' ELSE status END AS status FROM s""", "runs")
def run_lifecycle(t: Tables) -> DataFrame:
    from tenderloom.functions.base import with_scalars
    runs = t.runs.groupBy(F.datediff("run_day", F.lit("2024-01-01").cast("date")).alias("run_no")).agg(F.sum("row_count").alias("opp_count"))
    last = runs.agg(F.max("run_no").alias("last"))
    logged = with_scalars(runs, last).withColumn(
        "status", F.when((F.col("run_no") % 7 == 3) | (F.col("run_no") == F.col("last")), "running").otherwise("done")).drop("last")
    return state.settle_runs(logged)


@query("purge_sample", """SELECT 'bids' AS tbl, count(*) AS kept, count(*) FILTER (source_id <> '5-LOW') AS actual FROM bids WHERE source_id <> '5-LOW'
    UNION ALL SELECT 'tracked', count(*), count(*) FROM bids WHERE ordinal % 6 = 2 AND source_id <> '5-LOW'""", "bids")
def purge_sample(t: Tables) -> DataFrame:
    """Rows left in each table after one source's demo rows and what hangs off them are purged."""
    sample = t.bids.filter("source_id = '5-LOW'").select("opportunity_id")
    def left(name: str, table: DataFrame) -> DataFrame:
        kept = state.purge(table, sample)
        return kept.agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("kept"),
                        F.count(F.when(F.col("source_id") != "5-LOW", 1)).alias("actual"))
    return left("bids", t.bids).unionByName(left("tracked", t.bids.filter("ordinal % 6 = 2")))


CACHE = """ca AS (SELECT event_id, user_id AS opportunity_id, event_id % 4 AS version, event_type AS model, substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS digest, ts FROM events)"""


def cache(t: Tables) -> DataFrame:
    from tenderloom.functions import keys
    return t.events.select("event_id", F.col("user_id").alias("opportunity_id"), (F.col("event_id") % 4).alias("version"), F.col("event_type").alias("model"),
                           keys.content_hash(F.col("user_id").cast("string")).alias("digest"), "ts")


@query("cache_prune", f"WITH {CACHE} SELECT event_id, version FROM ca WHERE version >= 2")
def cache_prune(t: Tables) -> DataFrame:
    return state.prune_versions(cache(t), 2).select("event_id", "version")


@query("latest_summary", f"WITH {CACHE} SELECT opportunity_id, event_id FROM ca WHERE version >= 2 QUALIFY row_number() OVER (PARTITION BY opportunity_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_summary(t: Tables) -> DataFrame:
    from tenderloom.operators.ranking import latest_by
    return latest_by(state.prune_versions(cache(t), 2), ["opportunity_id"], "ts", "event_id").select("opportunity_id", "event_id")


@query("cache_misses", f"""WITH {CACHE}, w AS (SELECT c_custkey AS opportunity_id, 'view' AS model, substr(sha256(CAST(CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_custkey END AS VARCHAR)), 1, 16) AS digest, 3 AS version FROM customer)
    SELECT opportunity_id, digest FROM w WHERE NOT EXISTS (SELECT 1 FROM ca WHERE ca.opportunity_id = w.opportunity_id AND ca.digest = w.digest AND ca.model = w.model AND ca.version = w.version)""")
def cache_misses(t: Tables) -> DataFrame:
    from tenderloom.functions import keys
    wanted = t.customer.select(F.col("c_custkey").alias("opportunity_id"), F.lit("view").alias("model"), F.lit(3).cast("long").alias("version"),
                               keys.content_hash(F.expr("CAST(CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_custkey END AS STRING)")).alias("digest"))
    return state.cache_misses(wanted, cache(t), ["opportunity_id", "digest", "model", "version"]).select("opportunity_id", "digest")


@query("status_carry", """WITH f AS (SELECT ordinal, ordinal % 40 AS firm FROM bids WHERE ordinal % 3 = 0), p AS (SELECT ordinal, ordinal % 40 AS firm, CASE WHEN ordinal % 2 = 0 THEN 'pitched' ELSE 'passed' END AS status FROM bids WHERE ordinal % 5 = 0)
    SELECT f.ordinal, f.firm, coalesce(p.status, 'suggested') AS status FROM f LEFT JOIN p USING (ordinal, firm)""", "bids")
def status_carry(t: Tables) -> DataFrame:
    firm = (F.col("ordinal") % 40).alias("firm")
    fresh = t.bids.filter("ordinal % 3 = 0").select("ordinal", firm)
    prior = t.bids.filter("ordinal % 5 = 0").select("ordinal", firm, F.expr("CASE WHEN ordinal % 2 = 0 THEN 'pitched' ELSE 'passed' END").alias("status"))
    return state.carry_status(fresh, prior, ["ordinal", "firm"])


@query("schema_align", """SELECT ordinal, title, NULL::VARCHAR AS brief, CAST(NULL AS BOOLEAN) AS detail_fetched FROM bids WHERE ordinal % 2 = 0
    UNION ALL SELECT ordinal, NULL, 'b' || ordinal, true FROM bids WHERE ordinal % 2 = 1""", "bids")
def schema_align(t: Tables) -> DataFrame:
    """Two table versions read as one: missing columns come back null, none is retyped."""
    older = schemas.align(t.bids.filter("ordinal % 2 = 0").select("ordinal", "title"), schemas.OPPORTUNITY)
    newer = t.bids.filter("ordinal % 2 = 1").select("ordinal", F.concat(F.lit("b"), F.col("ordinal").cast("string")).alias("brief"), F.lit(True).alias("detail_fetched"))
    return older.unionByName(newer, allowMissingColumns=True).select("ordinal", "title", "brief", "detail_fetched")


@query("normalize_matches", """WITH m AS (SELECT o_orderkey AS id, unnest(range(1, 7)) AS i FROM orders), n AS (SELECT id, i, CASE WHEN (id + i) % 4 = 0 THEN '  ' ELSE 'Firm ' || (id % 50 + i) END AS name,
      CASE (id + i) % 3 WHEN 0 THEN ' Strong ' WHEN 1 THEN 'guess' ELSE 'some' END AS gov FROM m WHERE i <= 4)
    SELECT id, count(*) AS matches, string_agg(trim(name) || '/' || CASE WHEN lower(trim(gov)) IN ('strong', 'some', 'none') THEN lower(trim(gov)) ELSE 'unknown' END, '; ' ORDER BY i) AS named,
      CAST(2 AS INTEGER) AS urls FROM n WHERE trim(name) <> '' GROUP BY id""")
def normalize_matches(t: Tables) -> DataFrame:
    """Shape-checked candidate lists: four at most, named only, enum clamped, distinct web links."""
    from tenderloom.operators.matches import normalise
    raw = t.orders.select(F.col("o_orderkey").alias("id"), F.expr("""transform(sequence(1, 6), i -> named_struct(
        'name', CASE WHEN (o_orderkey + i) % 4 = 0 THEN '  ' ELSE concat('Firm ', o_orderkey % 50 + i) END,
        'gov_experience', CASE (o_orderkey + i) % 3 WHEN 0 THEN ' Strong ' WHEN 1 THEN 'guess' ELSE 'some' END,
        'sources', array('https://a.example', ' https://a.example ', 'ftp://b', 'http://c.example')))""").alias("raw"))
    kept = raw.select("id", normalise(F.col("raw")).alias("m")).filter(F.size("m") > 0)
    named = F.transform("m", lambda e: F.concat(e["name"], F.lit("/"), e["gov_experience"]))
    return kept.select("id", F.size("m").cast("long").alias("matches"), F.array_join(named, "; ").alias("named"), F.size(F.get("m", F.lit(0))["sources"]).alias("urls"))


@query("snapshot_retention", """WITH c AS (SELECT DISTINCT event_type AS kind, event_type || '_' || strftime(ts, '%Y%m%d') AS name FROM events)
    SELECT kind, name, row_number() OVER (PARTITION BY kind ORDER BY name DESC) <= 10 AS keep FROM c""")
def snapshot_retention(t: Tables) -> DataFrame:
    catalog = t.events.select(F.col("event_type").alias("kind"), F.concat("event_type", F.lit("_"), F.date_format("ts", "yyyyMMdd")).alias("name")).distinct()
    return state.retain_newest(catalog)


@query("apply_facts", """WITH f AS (SELECT ordinal, CASE WHEN ordinal % 3 = 0 THEN '$' || (ordinal * 10) ELSE '' END AS value, 'Lot ' || (ordinal % 9) AS place,
      CASE WHEN ordinal % 2 = 0 THEN repeat('long scope ', 20) END AS scope FROM bids WHERE ordinal % 4 <> 0)
    SELECT b.ordinal, coalesce(NULLIF(f.value, ''), b.budget) AS budget, coalesce(NULLIF(b.project_location, ''), f.place, b.project_location) AS project_location,
      CASE WHEN length(f.scope) > length(coalesce(b.scope, '')) THEN f.scope ELSE b.scope END AS scope,
      array_to_string(b.requirements || CASE WHEN f.ordinal IS NOT NULL AND NOT list_contains(b.requirements, 'Living wage') THEN ['Living wage'] ELSE CAST([] AS VARCHAR[]) END, ';') AS requirements
    FROM bids b LEFT JOIN f USING (ordinal)""", "bids")
def apply_facts(t: Tables) -> DataFrame:
    from tenderloom.operators.facts import apply_package_facts
    facts = t.bids.filter("ordinal % 4 <> 0").select(
        "ordinal", F.expr("CASE WHEN ordinal % 3 = 0 THEN concat('$', ordinal * 10) ELSE '' END").alias("estimated_value"),
        F.expr("concat('Lot ', ordinal % 9)").alias("project_location"), F.expr("CASE WHEN ordinal % 2 = 0 THEN repeat('long scope ', 20) END").alias("scope"),
        F.array(F.lit("Living wage")).alias("requirements"))
    return apply_package_facts(t.bids, facts, "ordinal").select("ordinal", "budget", "project_location", "scope", F.array_join("requirements", ";").alias("requirements"))


@query("document_bundle", """WITH d AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE text <> '')
    SELECT conv_id, substr('LISTING ' || conv_id || coalesce(string_agg(chr(10) || '== ' || n || ': ' || role || chr(10) || substr(text, 1, 60000), '' ORDER BY n), ''), 1, 160000) AS bundle
    FROM d WHERE n <= 8 GROUP BY conv_id""")
def document_bundle(t: Tables) -> DataFrame:
    from tenderloom.operators.facts import bundle
    parts = t.conversations.filter("text <> ''").select(F.col("conv_id"), F.col("turn").alias("place"), F.col("role").alias("name"), "text")
    return bundle(parts, "conv_id", F.concat(F.lit("LISTING "), F.col("conv_id").cast("string")), parts_kept=8, part_chars=60_000, total_chars=160_000)


@query("demo_row_counts", "SELECT source_id = '5-LOW' AS demo, count(*) AS count FROM bids GROUP BY 1", "bids")
def demo_row_counts(t: Tables) -> DataFrame:
    return marts.tally(t.bids, F.col("source_id") == "5-LOW", "demo")
