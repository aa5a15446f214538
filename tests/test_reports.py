"""Letting reports as tables, award documents, and boards that point at another platform."""

from datetime import date

from pyspark.sql import functions as F

from tenderloom.sources import pages, reports

HEAD = '<div id="contractHeader"><div class="ContractHeader"><span>Contract No:</span> {no}</div><div class="ContractHeader x"><span>COUNTY:</span> <b>ST. LUCIE</b></div></div>'
ROW = '<div class="textLeft"><div class="vendorName">{n}</div><br><div class="bidTotal">{a}</div></div>'


def test_rows_belong_to_the_header_before_them():
    html = (ROW.format(n="Early", a="$1") + HEAD.format(no="E1") + ROW.format(n="CONTRACTOR'S NAME", a="$9") + ROW.format(n="Acme &amp; <b>Sons</b>", a=" $ 1,234.50 (low)") + ROW.format(n="No price", a="n/a")
            + ROW.format(n=" ", a="$5") + ROW.format(n="Best", a="2000") + HEAD.format(no="") + ROW.format(n="Lost", a="$3") + HEAD.format(no="E2") + '<div class="textLeft">no parts</div>')
    got = list(reports.letting_rows(html))
    assert got == [("E1", "ST. LUCIE", None, 1, "Acme & Sons", 1234.5), ("E1", "ST. LUCIE", None, 2, "Best", 2000.0)]
    assert list(reports.letting_rows(None)) == list(reports.letting_rows("<p>nothing</p></div></div>")) == []


def test_the_first_bidder_listed_wins(spark):
    html = HEAD.format(no="E9") + ROW.format(n="Listed first", a="$500.49") + ROW.format(n="Cheaper", a="$400")
    df = spark.createDataFrame([("s", "4", date(2024, 3, 4), "u1", html), ("s", "99", date(2024, 3, 4), "u2", None), ("s", "99", date(2024, 3, 4), "u3", "<html>")],
                               "source_id string, district string, letting_date date, url string, html string")
    rows = reports.letting_awards(df).collect()
    assert [(r.external_id, r.awarded_vendor, r.award_amount, r.bidders, r.title, r.department, r.award_linkage) for r in rows] == [
        ("E9", "Listed first", 500, 2, "FDOT letting 03/04/2024: contract E9 — St. Lucie County", "FDOT District 4", None)]
    assert rows[0].description.endswith("2 bid(s): Listed first — $500.49 · Cheaper — $400.00")


def test_award_documents(spark):
    texts = ["Notice of intent to award the contract to: Crown USA,  Inc.\nfor $1,200 of $ 9,500.40", "Awarded to Best Firm, for $5", "nothing", "$12", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.v.vendor, r.v.amount) for r in df.select("i", reports.text_award_facts("t").alias("v")).collect()}
    assert got == {0: ("Crown USA", 9500), 1: ("Best Firm", 5), 2: (None, None), 3: (None, 12), 4: (None, None)}


def test_pointer_pages(spark):
    board, link = "/Common/Modules/Bids/RWDBids.css", "https://www.myvendorlink.com/x"
    cases = {"points": f"{board} {link}", "own rows": f'{board} {link} <div class="bidTitle">', "alone": board, "other": link, "none": "text", "named": f"{board} vendor registry"}
    df = spark.createDataFrame(list(cases.items()), "k string, html string")
    got = {r.k: (r.v.platform, r.v.also, r.v.confidence) for r in df.select("k", pages.platform_of(F.col("html")).alias("v")).collect()}
    assert got == {"points": ("vendorlink", ["civicplus"], "pointer"), "own rows": ("civicplus", ["vendorlink"], "strong"), "alone": ("civicplus", [], "strong"),
                   "other": ("vendorlink", [], "strong"), "none": (None, [], None), "named": ("civicplus", ["vendor_registry"], "strong")}
