"""The refresh run on hand-made records: order of steps, shared packages, budgets, and what later steps see."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from tenderloom.operators import facts, refresh
from tests.conftest import NOW, SOON, opportunities, record

AS_OF = "2024-06-12 09:00:00"
PACKAGE = "Project Location: Lot 7\nEstimated Value: $ 75,000\nBid Bond Required:YES\n"


def doc(url, kind="document", name="Package"):
    return {"name": name, "url": url, "kind": kind}


def run(spark, rows, **given):
    out = refresh.refresh(opportunities(spark, rows), refresh.Inputs(AS_OF, **given))
    return out, {r["ordinal"]: r for r in out.opportunities.collect()}


def texts(spark, *rows):
    return spark.createDataFrame(rows, "url string, text string")


def test_steps_run_in_their_order_and_two_are_written(spark):
    out, rows = run(spark, [record(1), record(2, title="Bridge paving", due_date=SOON)])
    assert [s[1] for s in out.steps] == ["age", "collapse", "details", "packages", "derive", "link", "recurrence", "briefs"]
    assert [(s[1], s[3]) for s in out.steps if s[2]] == [("collapse", 2), ("derive", 2)]
    assert rows[2]["brief"].startswith("[BID] Broward County: Bridge paving Closes Jun 17, 2024")


def test_a_duplicate_is_aged_then_merged_before_anything_is_read(spark):
    rows = [record(1, external_id="ITB-2024-01", due_date=NOW - timedelta(days=1), description="x" * 50),
            record(2, external_id="itb 2024 01", contact="Clerk", budget="$5")]
    out, got = run(spark, rows)
    assert list(got) == [1] and got[1]["status"] == "closed" and (got[1]["contact"], got[1]["budget"]) == ("Clerk", "$5")


def test_a_shared_package_reaches_every_bid_and_beats_prose(spark):
    rows = [record(i, title=f"Framework lot {w}", documents=[doc("http://x/p.PDF?v=1"), doc("http://x/a.pdf", "addendum")],
                   description="budget of $9,000,000") for i, w in enumerate(("roof", "pump", "road"), 1)]
    rows.append(record(9, title="Closed elsewhere", status="closed", documents=[doc("http://x/p.PDF?v=1")]))
    _, got = run(spark, rows, package_texts=texts(spark, ("http://x/p.PDF?v=1", PACKAGE), ("http://x/p.PDF?v=1", PACKAGE), ("http://x/other.pdf", PACKAGE)))
    assert {i: (got[i]["budget"], got[i]["project_location"], got[i]["package_parsed"]) for i in (1, 2, 3)} == dict.fromkeys((1, 2, 3), ("$75,000", "Lot 7", True))
    assert got[9]["package_parsed"] is False and got[9]["project_location"] is None
    assert got[1]["requirements"] == ["Bid bond required"]


def test_an_empty_package_changes_nothing(spark):
    _, got = run(spark, [record(1, documents=[doc("http://x/p.pdf")], budget="$1")], package_texts=texts(spark, ("http://x/p.pdf", "no terms here"), (None, "x")))
    assert (got[1]["package_parsed"], got[1]["budget"], got[1]["scope"]) == (False, "$1", None)


def test_limits_are_fetch_budgets(spark):
    rows = [record(i, title=f"Bid {w}", source_id=s, due_date=NOW + timedelta(days=d), documents=[doc(f"http://x/{i}.pdf")])
            for i, (w, s, d) in enumerate([("roof", "a", 3), ("pump", "a", 1), ("road", "a", 2), ("park", "b", 9)], 1)]
    details = spark.createDataFrame([(str(i), "found@x.gov", "Work " * i) for i in range(1, 5)], "opportunity_id string, contact_email string, scope string")
    packages = texts(spark, *[(f"http://x/{i}.pdf", PACKAGE) for i in range(1, 5)])
    _, got = run(spark, rows, details=details, detail_limit=2, package_texts=packages, package_limit=2)
    assert {i for i in got if got[i]["detail_fetched"]} == {2, 4}  # one of each source, soonest due first
    assert {i for i in got if got[i]["package_parsed"]} == {2, 3}  # soonest due of all
    assert (got[4]["contact_email"], got[4]["scope"], got[1]["contact_email"]) == ("found@x.gov", "Work Work Work Work ", None)
    _, got = run(spark, rows, details=details, package_texts=packages)
    assert all(r["detail_fetched"] and r["package_parsed"] for r in got.values())


def test_awards_and_archive(spark):
    rows = [record(1, title="Chiller overhaul", external_id="RFP-77120"), record(2, title="Bridge paving north"),
            record(3, status="award", title="x", linked_ref="rfp 77120", awarded_vendor="Acme", award_amount=10, award_date=date(2024, 6, 1)),
            record(4, status="award", title="Bridge paving north span", awarded_vendor="Best", award_amount=0, posted_date=date(2024, 5, 2))]
    archive = spark.createDataFrame([("old1", "BROWARD COUNTY", "Annual chiller overhaul", NOW - timedelta(days=400)), ("1", "Broward County", "Chiller overhaul", NOW)],
                                    "opportunity_id string, agency string, title string, due_date timestamp_ntz")
    out, got = run(spark, rows, archive=archive)
    assert [got[i]["award_linkage"] for i in (1, 2, 3, 4)] == [None, None, "ref", "fuzzy"]
    assert (got[1]["awarded_vendor"], got[1]["award_amount"], got[2]["award_date"], got[2]["award_amount"]) == ("Acme", 10, date(2024, 5, 2), 0)
    assert (got[1]["prior_cycles"], got[1]["last_cycle_closed"], got[2]["prior_cycles"]) == (1, date(2023, 5, 9), 0)
    covered = out.coverage.first()
    assert (covered["records"], covered["awards"], covered["with_award_vendor"]) == (4, 2, 2)


def test_the_scope_of_work_survives_linking_by_agency(spark):
    _, got = run(spark, [record(1, scope="Replace the roof")], archive=opportunities(spark, [record(2, title="Roof")]))
    assert got[1]["scope"] == "Replace the roof"


def test_derive_fields_keeps_what_is_stated(spark):
    said = "A bid bond is required. Estimated cost is $2.5 million. Mail bids@x.gov or (305) 555-0142. Questions due March 14, 2024 by 3:30 PM. Pre-bid meeting at Hall B."
    rows = [record(1, description=said, requirements=["Bid bond required"]),
            record(2, description=said, budget="$1", contact_email="me@x.gov", contact_phone="555", pre_bid_meeting="none", tier="state"), record(3, title="", requirements=None)]
    cities = spark.createDataFrame([("davie", "broward", 0)], "needle string, slug string, position int")
    got = {r["ordinal"]: r for r in facts.derive_fields(opportunities(spark, rows), cities).collect()}
    assert (got[1]["budget"], got[1]["contact_email"], got[1]["contact_phone"]) == ("$2.5 million", "bids@x.gov", "(305) 555-0142")
    assert (str(got[1]["questions_due"]), got[1]["pre_bid_meeting"], got[1]["tier"]) == ("2024-03-14 15:30:00", "Pre-bid meeting at Hall B", "county")
    assert got[1]["requirements"] == ["Bid bond required"] and got[2]["requirements"] == ["Bid bond"]
    assert [got[2][c] for c in ("budget", "contact_email", "contact_phone", "pre_bid_meeting", "tier")] == ["$1", "me@x.gov", "555", "none", "state"]
    assert got[3]["requirements"] == [] and got[3]["budget"] is None


def test_an_empty_run(spark):
    out, got = run(spark, [], package_texts=texts(spark), archive=opportunities(spark, []))
    assert got == {} and out.coverage.count() == 0


def test_missing_columns_are_added(spark):
    few = spark.createDataFrame([(1, "1", "s", "Roof", "broward", "Town", "open")],
                                "ordinal long, opportunity_id string, source_id string, title string, county string, agency string, status string")
    row = refresh.refresh(few, refresh.Inputs(AS_OF)).opportunities.select("brief", F.size("requirements").alias("n")).first()
    assert row["brief"] == "[BID] Town: Roof Due date not published on listing." and row["n"] == 0


def test_digest_counts_and_subject(spark):
    from tenderloom.operators import digest, watchlists
    matched = spark.createDataFrame([("w1", "a", "open"), ("w1", "b", "upcoming"), ("w2", "b", "upcoming"), ("w2", "c", "open"), ("w2", "d", "upcoming")],
                                    "watchlist_id string, opportunity_id string, status string")
    seen = spark.createDataFrame([("w2", "c"), ("w2", "c"), ("w1", "zz"), ("w2", "d")], "watchlist_id string, opportunity_id string")
    fresh = digest.fresh_counts(watchlists.marked(matched, seen))
    assert tuple(fresh.first()) == (2, 1)  # three fresh rows, of which bid b is planned and counts once
    assert watchlists.mark_seen(seen, matched).count() == 6
    bids = opportunities(spark, [record(1, due_date=SOON), record(2, due_date=SOON), record(3, due_date=NOW + timedelta(days=8)), record(4)])
    tracked = spark.createDataFrame([("1", "watching", False), ("2", "result", False), ("3", "watching", False), ("4", "watching", False)], "opportunity_id string, stage string, archived boolean")
    due = digest.due_soon(bids, tracked, AS_OF)
    none = spark.createDataFrame([(0, 1)], "protests long, records long")
    assert digest.subject(none, fresh, due).first()["subject"] == "Daily digest: 1 tabulation requestable, 2 new matches, 1 planned, 1 deadline this week"
    quiet = spark.createDataFrame([(0,) * 5], "protests long, records long, new_matches long, planned long, deadlines long")
    assert digest.subject(quiet).first()["subject"] == "Daily digest: source health"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_what_comes_before_packages_and_details_runs_once(spark):
    rows = [record(i, documents=[doc(f"https://p/{i}/package.pdf")]) for i in (1, 2)]
    given = opportunities(spark, rows).withColumn("contact", F.concat(F.lit("marker"), F.col("ordinal").cast("string")))
    given = given.withColumns({"detail_fetched": F.lit(False), "package_parsed": F.lit(False)})
    inputs = refresh.Inputs(AS_OF, package_texts=texts(spark, ("https://p/1/package.pdf", PACKAGE)), details=given.select("opportunity_id", F.lit("x@y.gov").alias("contact_email")))
    packed, read = refresh.read_packages(given, inputs), refresh.read_details(given, inputs)
    assert plan_of(packed).count("LogicalRDD") == 1 and plan_of(read).count("LogicalRDD") == 1
    assert "LogicalRDD" not in plan_of(refresh.package_rows(given, inputs.package_texts))
    assert [r.package_parsed for r in packed.orderBy("ordinal").collect()] == [True, False]
    assert [(r.detail_fetched, r.contact_email) for r in read.collect()] == [(True, "x@y.gov")] * 2


def test_prose_is_searched_where_a_sign_of_the_fact_stands(spark):
    said = ["Budget of $ 48,000.", "48,000 a year", "PRE-BID CONFERENCE at Hall B", "pre-bid at Hall B", "QUESTIONS due 4/2/2024 10:15 AM", "due 4/2/2024", "mail bids@x.gov.", "none", "", None]
    bids = opportunities(spark, [record(i, title="", description=x) for i, x in enumerate(said)])
    got = facts.derive_fields(bids.withColumn("questions_due", F.lit(None).cast("timestamp_ntz"))).orderBy("ordinal").collect()
    assert [(r.budget, r.pre_bid_meeting, r.contact_email) for r in got] == [
        ("$48,000", None, None), (None, None, None), (None, "PRE-BID CONFERENCE at Hall B", None), *[(None, None, None)] * 3, (None, None, "bids@x.gov"), *[(None, None, None)] * 3]
    assert [i for i, r in enumerate(got) if r.questions_due] == [4]


def test_words_of_a_label_are_read_once(spark):
    from tenderloom.operators import dedupe
    df = spark.createDataFrame([(["Bid bond required", "bid bond", "the", "Living wage", "Living wage for the site"],)], "l array<string>")
    kept = df.select(dedupe.absorb_labels(F.col("l")).alias("k"))
    assert plan_of(kept.filter("rand() > -1")).count("regexp_extract_all") <= 1 and kept.first().k == ["Bid bond required", "Living wage for the site"]
