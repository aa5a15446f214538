"""Scalar rules, clocks and filters on hand-made cases."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tenderloom.functions import calendar, classify, dates, package, render, text
from tenderloom.operators import filters, ranking, scoring
from tests.conftest import NOW, PAST, SOON, opportunities, record


def values(spark, expression, *inputs):
    df = spark.createDataFrame([(v,) for v in inputs], "v string")
    return [r[0] for r in df.select(expression).collect()]


def test_budget_amount(spark):
    assert values(spark, text.budget_amount("v"), "$100,000 - $250,000", "$1,200.50", "$2.5 million", "TBD", None, "") == \
        [100000, 120050, 25, None, None, None]


@pytest.mark.parametrize("prose, want", [
    ("not to exceed $1,250,000 total $9,000,000", "$1,250,000"), ("Estimated cost is $2.5 million.", "$2.5 million"),
    ("a $50 fee applies", None), ("$75,000 deposit and $310,500 total", "$310,500"), ("budget of $ 48,000", "$48,000"), ("", None)])
def test_estimated_value(spark, prose, want):
    assert values(spark, text.estimated_value("v"), prose) == [want]


def test_requirements_and_types(spark):
    assert values(spark, text.requirement_labels("v"), "A BID BOND; e-verify; three (3) similar references", "nothing") == \
        [["Bid bond", "E-Verify", "References required"], []]
    assert values(spark, text.solicitation_type("v"), "Request for price quotation", "RFQ for an ITN", "none") == ["RPQ", "ITN", "UNKNOWN"]
    assert values(spark, text.external_id("v"), "RFP No. 2024-118 x", "EVN0012345", "21C-001A", "zz") == ["RFP No. 2024-118", "EVN0012345", "21C-001A", None]


@pytest.mark.parametrize("written, want", [
    ("2024-03-14T20:30:00Z", datetime(2024, 3, 14, 15, 30)), ("03/14/2024 3:30 PM", datetime(2024, 3, 14, 15, 30)),
    ("March 14, 2024 2:15PM EDT", datetime(2024, 3, 14, 13, 15)), ("Thursday, March 14, 2024 at 9:00 a.m.", datetime(2024, 3, 14, 9)),
    ("2024-03-14 10:00:00+02:00", datetime(2024, 3, 14, 3)), ("3/4/2024", datetime(2024, 3, 4)), ("TBD", None), ("", None)])
def test_parse_timestamp(spark, written, want):
    assert values(spark, dates.parse_timestamp("v"), written) == [want]


def deadline(spark, posted):
    df = spark.createDataFrame([(posted,)], "p timestamp_ntz")
    return calendar.protest_deadline(df, "p", "d").first()["d"]


@pytest.mark.parametrize("posted, want", [
    (datetime(2024, 6, 10, 16), datetime(2024, 6, 13, 16)),      # Monday to Thursday
    (datetime(2024, 6, 13, 16), datetime(2024, 6, 18, 16)),      # across a weekend
    (datetime(2024, 6, 15, 8), datetime(2024, 6, 20, 8)),        # posted on Saturday
    (datetime(2024, 7, 2, 9), datetime(2024, 7, 8, 9)),          # the Fourth inside
    (datetime(2024, 11, 26, 9), datetime(2024, 12, 3, 9)),       # Thanksgiving costs two days
    (datetime(2021, 12, 30, 9), datetime(2022, 1, 4, 9))])       # 31 Dec 2021 still counts
def test_protest_deadline(spark, posted, want):
    assert deadline(spark, posted) == want


def test_business_hours_left(spark):
    df = spark.createDataFrame([(datetime(2024, 6, 18, 16),), (datetime(2024, 6, 12, 7),), (None,)], "d timestamp_ntz")
    got = [r["h"] for r in calendar.business_hours_left(df, "d", "2024-06-14 16:00:00", "h").collect()]
    assert sorted(got, key=str) == sorted([48.0, -57.0, None], key=str)


def test_status_aging(spark):
    rows = [record(1, due_date=PAST), record(2, due_date=SOON), record(3, posted_date=date(2020, 1, 1)),
            record(4, posted_date=NOW.date()), record(5, status="upcoming", due_date=PAST)]
    got = {r["ordinal"]: r["status"] for r in filters.age_status(opportunities(spark, rows), str(NOW)).collect()}
    assert got == {1: "closed", 2: "open", 3: "closed", 4: "open", 5: "upcoming"}


def test_fair_share_starves_no_source(spark):
    rows = [record(i, source_id="busy", due_date=NOW + timedelta(days=i)) for i in range(10)] + [record(20, source_id="quiet")]
    got = ranking.fair_share(opportunities(spark, rows), 4).orderBy("turn", "source_id").collect()
    assert [r["ordinal"] for r in got] == [0, 20, 1, 2]
    assert ranking.fair_share(opportunities(spark, rows), 0).count() == 0


def test_primary_package(spark):
    docs = [("Addendum", "https://x/a.pdf", "addendum"), ("Pkg", "https://x/p.PDF?v=1", "document"), ("ITB-24-011 full", "https://x/n.pdf", "document")]
    rows = [record(1, external_id="ITB 24-011", documents=docs), record(2, documents=docs[:2]), record(3, documents=[("n", "https://x/y.doc", "document")])]
    got = {r["ordinal"]: r["package_url"] for r in ranking.primary_package(opportunities(spark, rows)).collect()}
    assert got == {1: "https://x/n.pdf", 2: "https://x/p.PDF?v=1", 3: None}


def test_capacity_counts_other_bids_in_window(spark):
    rows = [record(i, due_date=NOW + timedelta(days=7 * i)) for i in range(6)] + [record(9)]
    df = opportunities(spark, rows)
    got = {r["ordinal"]: (r["near"], r["capacity_score"]) for r in scoring.capacity_scores(df, df).collect()}
    assert got == {0: (2, 50), 1: (3, 30), 2: (4, 10), 3: (4, 10), 4: (3, 30), 5: (2, 50), 9: (0, 60)}


def test_classify_keeps_order_and_umbrella(spark):
    df = spark.createDataFrame([("Roof and HVAC repair",), ("Office furniture",), ("Nothing here",), (None,)], "t string")
    got = [(r["categories"], r["offer_type"], r["keywords"]) for r in classify.classify(df, F.col("t")).collect()]
    assert got == [(["roofing", "hvac", "construction"], "construction", ["roof", "hvac"]), (["furniture"], "goods", ["furniture"]),
                   (["general"], "unknown", []), (["general"], "unknown", [])]


def test_package_facts(spark):
    body = ("Estimated Value: $ 1,200 Project Location: Pier 5\nBid Bond Required:YES Davis Bacon: NO\n"
            "Liquidated Damages: YES $$ Per Day:$333.71\nScope of Work: " + "paint the hall " * 6 + "\nGENERAL CONDITIONS OF BID\nmore")
    got = spark.createDataFrame([(body,)], "v string").select(package.package_facts("v").alias("f")).first()["f"]
    assert (got["estimated_value"], got["project_location"], got["liquidated_damages"]) == ("$1,200", "Pier 5", "$333.71 per day")
    assert got["requirements"] == ["Bid bond required"] and got["scope"] == ("paint the hall " * 6).strip()


def test_short_money(spark):
    df = spark.createDataFrame([(1_400_000,), (2_000_000,), (250_400,), (900,), (None,)], "n long")
    assert [r[0] for r in df.select(render.short_money("n")).collect()] == ["$1.4M", "$2M", "$250k", "$900", None]


def test_rich_text_and_references(spark):
    from tenderloom.sources import pages
    rows = [("Work<br>to do &#8217;x&mdash;y",), ("<p>a<svg><text>no</text></svg>b</p>",), ("&amp;lt; &bogus; &#x1F600; &#0; AT&T &nbsp;z",), (None,)]
    got = [r.t for r in spark.createDataFrame(rows, "h string").select(pages.rich_text("h").alias("t")).collect()]
    assert got == ["Work to do ’x—y", "a b", "&lt; &bogus; 😀 � AT&T z", ""]


def test_wrappers_go_however_many(spark):
    from tenderloom.sources import pages
    text = "Public Notice - NOTICE: Addendum - notice - RFP roof repairs 2nd Revised [PDF] Revised [DOC] pdf [Revised] docx"
    got = spark.createDataFrame([(text,), ("notice",), ("plain roof",)], "t string").select(pages.peel("t").alias("p")).collect()
    assert [r.p for r in got] == ["RFP roof repairs", "", "plain roof"]


def test_clocks_reach_any_year(spark):
    from datetime import datetime as at
    df = spark.createDataFrame([(at(1989, 6, 12, 9),), (at(2061, 6, 13, 9),), (None,)], "p timestamp_ntz")
    got = [r.d for r in calendar.protest_deadline(df, "p", "d").orderBy("p").collect()]
    assert got[0] is None and got[1:] == [at(1989, 6, 15, 9), at(2061, 6, 16, 9)]


def test_numbered_lists(spark):
    from pyspark.sql import functions as F

    from tenderloom.functions.base import numbered
    rows = [("a" if i % 5 else "b", i * 7 % 100, i) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = {r.id: r.place for r in numbered(df, [F.col("v").desc(), F.col("id")], "place", by=["g"]).collect()}
    for g in "ab":
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in ordered] == list(range(1, len(ordered) + 1))
    assert sorted(r.place for r in numbered(df, [F.col("id")], "place").collect()) == list(range(1, 101))


def test_failed_runs_do_not_shorten_the_window(spark):
    from tenderloom.operators import health
    runs = spark.createDataFrame([("s", n, 50 if n < 9 else 1, "ok", None) for n in range(12)], "source_id string, run_no int, row_count int, status string, note string")
    done = spark.createDataFrame([(n,) for n in range(8)], "run_no int")
    got = {r.run_no: r.norm for r in health.source_drops(runs, done).collect()}
    assert got[0] is None and got[8] == 50 and got[11] == 50


def test_equal_place_names_keep_list_order(spark):
    from tenderloom.functions import geo
    cities = spark.createDataFrame([("davie", "broward", 0), ("tampa", "hillsborough", 1)], "needle string, slug string, position int")
    df = spark.createDataFrame([("Davie Tampa Board",)], "agency string")
    assert geo.infer_counties(df, geo.Gazetteer(cities)).first().county_slug == "broward"


def state_holidays(year):
    """The statute, plainly."""
    def nth(month, weekday, n):
        days = [d for d in (date(year, month, 1) + timedelta(days=i) for i in range(31)) if d.month == month and d.weekday() == weekday]
        return days[n]

    def observed(d):
        return d - timedelta(days=1) if d.weekday() == 5 else d + timedelta(days=1) if d.weekday() == 6 else d

    thanksgiving = nth(11, 3, 3)
    return {*(observed(date(year, m, d)) for m, d in ((1, 1), (7, 4), (11, 11), (12, 25))), nth(1, 0, 2), nth(5, 0, -1), nth(9, 0, 0), thanksgiving, thanksgiving + timedelta(days=1)}


def test_clocks_equal_the_calendar_day_by_day_over_three_centuries(spark):
    first, last = date(1900, 1, 1), date(2200, 12, 31)
    holidays = {y: state_holidays(y) for y in range(1900, 2201)}
    days = [first + timedelta(days=i) for i in range((last - first).days + 1)]
    business = [d.weekday() < 5 and d not in holidays[d.year] for d in days]
    idle, total = [], 0
    for b in business:
        total += not b
        idle.append(total)
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d date")
    since = F.lit("1950-06-15").cast("date")
    got = df.select("i", calendar.is_business_day(F.col("d")).alias("b"), calendar.business_days_on(F.col("d"), 3).alias("on"),
                    calendar.idle_days(F.lit(first), F.col("d")).alias("idle"), calendar.idle_days(F.col("d"), since).alias("until")).toPandas().sort_values("i")
    assert got["b"].tolist() == business
    assert got["idle"].tolist() == [n - idle[0] for n in idle]
    mark = days.index(date(1950, 6, 15))
    assert got["until"].tolist() == [max(0, idle[mark] - n) if i < mark else 0 for i, n in enumerate(idle)]
    open_days = [d for d, b in zip(days, business, strict=True) if b]
    at, want = 0, []
    for d in days[:-30]:
        while open_days[at] < d:
            at += 1
        want.append(open_days[at + 3])
    assert got["on"].tolist()[:-30] == want


def test_clocks_need_no_exchange_and_stand_any_year(spark):
    rows = [(datetime(9999, 11, 1, 5),), (datetime(1, 3, 1, 7),), (None,)]
    df = spark.createDataFrame(rows, "d timestamp_ntz")
    clocked = calendar.business_hours_left(calendar.protest_deadline(df, "d", "due"), "d", "2024-06-14 16:00:00", "h")
    plan = clocked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = clocked.collect()
    assert [r["due"] is None for r in got] == [False, False, True] and [r["h"] is None for r in got] == [False, False, True]
    assert got[0]["due"] == datetime(9999, 11, 4, 5) and got[0]["h"] > 0 > got[1]["h"]
