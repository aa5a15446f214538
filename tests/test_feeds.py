"""Character references against the standard library, and feeds whose payloads come in odd shapes."""

import html
import json
import random
from html.entities import html5

from tenderloom.sources import feeds, pages


def test_references_equal_the_standard_library(spark):
    rng = random.Random(4)
    names = rng.sample(sorted(html5), 400) + ["nosuch;", "am", "notit;", "copyright", "AMPX", "lt", "ampamp;"]
    numbers = ["#0;", "#8217", "#x2019;", "#150;", "#x96", "#129;", "#13;", "#xD800;", "#1114112;", "#99999999999999;", "#x0000041;", "#0065", "#11;", "#64976;", "#131070;", "#;", "#x;", "#xg", "#12a;"]
    given = [f"a &{x} b" for x in [*names, *numbers]] + ["".join(rng.choice(["&", "&amp;", "&#38;", "&copy", "&notin", ";", " ", "x", "&lt;b&gt;", "&&", "&;"]) for _ in range(12)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    got = {r.i: r.x for r in df.select("i", pages.unescape("t").alias("x")).collect()}
    want = {i: html.unescape(t).replace(" ", " ") for i, t in enumerate(given)}
    assert [(given[i], got[i], want[i]) for i in got if got[i] != want[i]] == []


def raw(spark, *payloads):
    return spark.createDataFrame([("s", i, x if isinstance(x, str) or x is None else json.dumps(x)) for i, x in enumerate(payloads)], "source_id string, ordinal int, payload string")


def test_lists_are_found_wherever_they_stand(spark):
    row = {"title": "x", "n": 1}
    shapes = [[row], {"a": 1, "zeta": [row, row], "alpha": [{"title": "later"}]}, {"a": {}}, "not json", None, "[1, null, \"x\"]", {"d": [row, 3, None]}, []]
    got = [(r.ordinal, r.place, r.t) for r in feeds.listed(raw(spark, *shapes)).select("ordinal", "place", feeds.said("title").alias("t")).collect()]
    assert sorted(got) == [(0, 0, "x"), (1, 0, "x"), (1, 1, "x"), (6, 0, "x")]


def test_fields_of_any_type(spark):
    rows = raw(spark, [{"a": 5, "b": True, "c": None, "d": " x ", "e": ["1", " ", None, 2], "f": 2.50, "g": "Yes"}])
    r = feeds.listed(rows).select(*[feeds.said(c).alias(c) for c in "abcdz"], feeds.texts("e").alias("e"), feeds.texts("z").alias("ez"), feeds.truth("b").alias("tb"), feeds.truth("g").alias("tg"),
                                  feeds.truth("c").alias("tc"), feeds.truth("d").alias("td")).first()
    assert tuple(r) == ("5", "true", "", "x", "", ["1", "2"], [], True, True, None, False)


def test_contracts_keyed_by_id_or_listed(spark):
    vendors = {"7": {"VendorID": 7, "VendorContactOrganizationName": " Acme "}, "8": {"VendorID": "8", "VendorContactOrganizationName": " "}}
    contract = {"ContractID": 12, "Name": "Roof", "VendorID": "7", "StartDate": "2024-01-02", "EndDate": "1/3/2025", "IsExtendable": 1}
    rows = feeds.portal_contracts(raw(spark, {"publicContracts": {"12": contract, "13": {**contract, "Name": " "}}, "vendors": vendors},
                                      {"publicContracts": [{**contract, "ContractID": "14", "VendorID": 8, "IsExtendable": None}], "vendors": list(vendors.values())},
                                      {"publicContracts": None}, {"success": 0}), "County", "https://p").collect()
    got = {r.contract_id: (r.vendor, r.vendor_id, str(r.end_date), r.extendable) for r in rows}
    assert got == {"12": ("Acme", "7", "2025-01-03", True), "14": (None, "8", "2025-01-03", None)}


def test_contracts_meet_their_vendors_without_a_join(spark):
    """The payloads are read once: the plan shuffles once, on the way to the window, and joins nothing."""
    plan = feeds.portal_contracts(raw(spark, {"publicContracts": {}}), "County", "u")._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert "Join" not in initial and initial.count("Exchange ") == 1 and initial.count("parse_json") + initial.count("parseJson") == 1


def test_vendors_of_repeated_and_missing_ordinals(spark):
    """Payloads of one source and ordinal share their vendors, the last place of a vendor wins; without an ordinal there are none."""
    def payload(contract, *vendors):
        return json.dumps({"publicContracts": [{"ContractID": contract, "Name": "Roof", "VendorID": 7}, "7", None, {"Name": "no id"}],
                           "vendors": [{"VendorID": v, "VendorContactOrganizationName": n} for v, n in vendors]})

    rows = [("s", 1, payload("a", (7, "First"), (7, "Second"), (7, " "))), ("s", 2, payload("b")), ("s", 2, payload("c", (8, "x"), (7, "Shared"))),
            ("s", None, payload("d", (7, "Nobody's"))), (None, 1, payload("e", (7, "Nobody's"))), ("t", 1, payload("f"))]
    given = spark.createDataFrame(rows, "source_id string, ordinal int, payload string")
    got = sorted((r.contract_id, r.vendor, r.vendor_id) for r in feeds.portal_contracts(given, "County", "u").collect())
    assert got == [("a", "Second", "7"), ("b", "Shared", "7"), ("c", "Shared", "7"), ("d", None, "7"), ("e", None, "7"), ("f", None, "7")]


def test_board_actions_stop_at_the_first_old_row(spark):
    rows = [("b", i, str(100 + i), None if i % 2 else f"F{i}", d, t) for i, (d, t) in enumerate([
        ("6/1/2024", "AWARD OF $0 TO ACME SERVICES FOR ROADS"), ("", "Award of RFP No. 449 to BCC Engineering, LLC for $5,000"), ("5/1/2024", "Forward look at Broward"),
        ("1/1/2020", "Award long ago"), ("6/2/2024", "Award after the stop")])]
    df = spark.createDataFrame(rows, "source_id string, place int, matter string, file_number string, date string, title string")
    got = {r.external_id: r for r in feeds.board_actions(df, "2024-06-12", "https://m/{}").collect()}
    assert set(got) == {"F0", "101"}
    assert (got["F0"].award_amount, got["F0"].awarded_vendor, got["F0"].url) == (None, "Acme Services", "https://m/100")
    assert (got["101"].award_amount, got["101"].linked_ref, got["101"].award_linkage, got["101"].award_date) == (5000, "449", "ref", None)
    assert set(feeds.board_actions(df, "2024-06-12", "https://m/{}", cap=1).select("external_id").collect()[0]) == {"F0"}


def test_empty_payloads_give_no_rows(spark):
    nothing = raw(spark, "{}", "[]", None)
    for rows in (feeds.sourcing_events(nothing, "u"), feeds.road_advertisements(nothing, "u"), feeds.current_list(nothing, "u", "d"), feeds.future_list(nothing, "u"),
                 feeds.recommendation_list(nothing, "u", "h"), feeds.award_matters(nothing, "u"), feeds.portal_contracts(nothing, "a", "u")):
        assert rows.count() == 0


def test_an_ad_without_title_or_number_is_left_out(spark):
    ads = raw(spark, {"Model": {"AdList": [{"AdNumber": " 7 "}, {"AdShortDescription": " &nbsp; "}, {"AdShortDescription": "Fix &amp;lt;b&amp;gt; it", "AdContractAmount": "2,950,000.0"}]}})
    got = sorted((r.title, r.budget, r.status) for r in feeds.road_advertisements(ads, "u").select("title", "budget", "status").collect())
    assert got == [("FDOT advertisement 7", None, "closed"), ("Fix it", "$3.0M", "closed")]
