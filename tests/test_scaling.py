"""What each step carries, writes and tries, beyond the rows it gives."""

import random

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from tenderloom.functions import dates, text
from tenderloom.functions.base import matches, numbered
from tenderloom.operators import refresh
from tenderloom.plans.q_streams import as_stream
from tenderloom.plans.registry import REGISTRY
from tenderloom.session import scratch_path
from tenderloom.sources import feeds, reports, snapshot
from tenderloom.streaming import jobs


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bidders_do_not_carry_their_page(spark):
    page = '<div id="contractHeader"><div class="ContractHeader"><span>Contract No:</span> E1</div></div>' + \
        '<div class="textLeft"><div class="vendorName">A &amp; B</div><div class="bidTotal">$ 1,200.50</div></div>'
    df = reports.letting_bids(spark.createDataFrame([("a", page), ("b", None), ("c", page + "<!-- x -->")], "url string, html string"))
    assert "Join" not in plan(df)
    assert sorted((r["url"], r["contract_no"], r["bidder"], r["amount"]) for r in df.collect()) == [("a", "E1", "A & B", 1200.5), ("c", "E1", "A & B", 1200.5)]


def test_plain_reports_read_as_the_standard_parser_does():
    bits = ["<div>", "</div>", '<div class="vendorName">', '<div class="textLeft">', '<div id="contractHeader">', '<div class="bidTotal">', '<div class="ContractHeader">',
            "<span>", "</span>", "<br/>", '<DIV CLASS="textLeft"/>', " $ 1,2 ", "a &amp b", "&lt;x", "x: ", "</p >", "<i a='b'>", "<!-- x -->", "< y", "<script>", "</script>", '<b a="1"c="2">', "\n"]
    draw = random.Random(3)
    for _ in range(4000):
        html = "".join(draw.choices(bits[:draw.choice([16, 23])], k=draw.randint(1, 20)))
        reader = reports.LettingReader()
        reader.feed(html)
        assert reports.read_report(html).contracts == reader.contracts, html


def test_keyed_values_leave_the_other_ids_behind(spark):
    ids = ", ".join(f'"contract-{i}": {{"n": {i}.50, "t": "x{i}"}}' for i in range(500))
    rows = feeds.keyed(spark.createDataFrame([("s", 0, f'{{"all": {{{ids}}}}}'), ("s", 1, '{"all": [null, 3, {"n": 7}]}')], "source_id string, ordinal int, payload string"), "$.all")
    got = rows.select("ordinal", "r", feeds.said("n").alias("n")).collect()
    assert len(got) == 501 and all(len(x["r"].metadata) < 100 for x in got)
    assert {x["n"] for x in got if x["ordinal"] == 1} == {"7"} and "3.5" in {x["n"] for x in got}


def test_a_package_is_not_read_again_for_each_fact(spark):
    df = spark.createDataFrame([(1, "open", "u/a.pdf")], "ordinal int, status string, u string").selectExpr(
        "ordinal", "status", "'ref' AS external_id", "array(named_struct('name', 'Bid package', 'url', u, 'kind', 'document')) AS documents",
        "cast(null AS timestamp_ntz) AS due_date", "false AS package_parsed")
    rows = refresh.package_rows(df, spark.createDataFrame([("u/a.pdf", "Estimated Value: $ 900")], "url string, text string"))
    assert "Scope" not in plan(rows) and "scope\\s" not in plan(rows)
    assert [(r["ordinal"], r["facts"]["estimated_value"]) for r in rows.collect()] == [(1, "$900")]


def test_a_slice_is_one_batch_of_many_files(spark):
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stream = as_stream(spark.range(1000), "many-files", "id < 10", "id BETWEEN 10 AND 800", "id = 801", "id > 801")
    seen = []
    jobs.drain(stream, scratch_path(spark, "many-files-checkpoint"), lambda batch, n: seen.append((batch.count(), batch.select(F.input_file_name()).distinct().count())))
    assert [n for n, _ in seen] == [10, 791, 1, 198] and width > 1 and seen[1][1] > 1


def test_a_null_group_is_numbered_too(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "g string, x int")
    assert sorted((str(r["g"]), r["x"], r["place"]) for r in numbered(rows, [F.col("x").desc()], "place", ["g"]).collect()) == \
        [("None", 3, 2), ("None", 4, 1), ("a", 1, 2), ("a", 2, 1)]


def test_a_numbered_list_is_written_narrow(spark):
    files = REGISTRY["user_sort"].run(spark, "/root/testdata/sf0.001").inputFiles()
    assert all({"documents", "scope"}.isdisjoint(spark.read.parquet(f).columns) for f in files)


def test_snapshot_rows_are_compressed(spark):
    rows = REGISTRY["snapshot_scan"].run(spark, "/root/testdata/sf0.001")
    assert all(f.endswith(".json.gz") for f in rows.inputFiles())
    assert snapshot.read_snapshot(spark, rows.inputFiles()[0].rsplit("/", 2)[0])[0].count() == rows.count()


def test_patterns_are_tried_where_their_literal_is(spark):
    said = ["Davis Bacon and a BID\nBond", "prequalification, MBE", "M/WBE", "level 2 screening", "three (3) similar references", "e verify", None, "", "nothing", "mandatory x pre-bid"]
    rows = spark.createDataFrame([(s,) for s in said], "s string")
    plain = F.array_compact(F.array(*[F.when(matches("s", p), F.lit(label)) for label, p in text.REQUIREMENTS]))
    found = rows.select(text.requirement_labels("s").alias("a"), plain.alias("b"))
    assert all(r["a"] == r["b"] for r in found.collect()) and "contains(" in plan(found).lower()


def test_dates_of_one_shape_read_as_before(spark):
    rows = spark.createDataFrame([("2024-02-30",), ("2024-02-29",), ("2/9/2024",), ("13/9/2024",), ("2024-01-02T25:00:00",), ("2024-01-02T05:06:07",), ("2024-01-02\n",), ("2-3-2024 ",), ("3/4/24",)], "s string")
    got = [str(r[0]) for r in rows.select(dates.parse_timestamp("s")).collect()]
    assert got == ["None", "2024-02-29 00:00:00", "2024-02-09 00:00:00", "None", "None", "2024-01-02 05:06:07", got[6], "2024-02-03 00:00:00", "2024-03-04 00:00:00"]
