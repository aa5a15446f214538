"""Prefix-filtered joins against all-pairs brute force on small fixtures."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tenderloom.functions import keys
from tenderloom.operators import linkage, records, similarity
from tests.conftest import NOW, opportunities, record

WORDS = "roof pump bridge road paving janitorial hvac chiller fleet elevator signage lighting".split()


def titled(spark, seed, n, start=0):
    rng = random.Random(seed)
    rows = [(start + i, f"agency{rng.randrange(3)}", " ".join(rng.sample(WORDS, rng.randrange(1, 7))), f"id{start + i}",
             datetime(2024, 1, 1) + timedelta(days=rng.randrange(90)) if rng.random() < 0.8 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "ordinal long, agency string, title string, opportunity_id string, due_date timestamp_ntz")


def alike(a, b):
    a, b = set(a.split()), set(b.split())
    return 10 * len(a & b) >= 7 * min(len(a), len(b))


def test_similar_sets_equal_all_pairs(spark):
    left_rows, left = titled(spark, 1, 150)
    right_rows, right = titled(spark, 2, 150)
    got = {(r["scope"], r["left_key"], r["right_key"]) for r in similarity.similar_sets(
        similarity.with_tokens(left), similarity.with_tokens(right)).collect()}
    key = lambda t: " ".join(sorted(t.split()))
    want = {(a[1], key(a[2]), key(b[2])) for a in left_rows for b in right_rows if a[1] == b[1] and alike(a[2], b[2])}
    assert got == want


def test_salted_words_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(similarity, "ROWS_PER_SALT", 3)
    test_similar_sets_equal_all_pairs(spark)


def test_word_pairs_as_keys_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(similarity, "RARE", 2)
    test_similar_sets_equal_all_pairs(spark)
    monkeypatch.setattr(similarity, "ROWS_PER_SALT", 4)
    test_similar_sets_equal_all_pairs(spark)
    test_recurrence_equals_brute_force(spark)


def test_one_word_in_all_titles(spark, monkeypatch):
    monkeypatch.setattr(similarity, "RARE", 20)
    monkeypatch.setattr(similarity, "ROWS_PER_SALT", 50)
    rng = random.Random(8)
    rows = [(i, "Town", "paving " + " ".join(rng.sample(WORDS[:4] + WORDS[5:], rng.randrange(0, 4))) + f" lot{chr(97 + i % 20)}{chr(97 + i % 7)}" * (i % 3 > 0),
             f"id{i}", datetime(2024, 1, 1) + timedelta(hours=i)) for i in range(300)]
    df = spark.createDataFrame(rows, "ordinal long, agency string, title string, opportunity_id string, due_date timestamp_ntz")
    got = {r["ordinal"]: (r["prior_cycles"], r["last_cycle_closed"]) for r in similarity.recurrence(df, df.filter("ordinal % 3 = 0")).collect()}
    for o in rows:
        hits = [p[4].date() for p in rows[::3] if p[0] != o[0] and alike(p[2], o[2])]
        assert got[o[0]] == (len(hits), max(hits, default=None))


def test_fifty_thousand_one_word_titles(spark):
    def word(i):
        return "".join(chr(97 + (i // 26 ** k) % 26) for k in range(4)) + "x"

    titles = spark.range(50_000).selectExpr("id as ordinal", "'Town' as agency", "cast(id as string) as opportunity_id",
                                            "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id % 1000 as int)) as due_date",
                                            "concat_ws('', transform(array(1, 26, 676, 17576), k -> char(97 + cast(floor(id / k) as int) % 26)), 'x') as title")
    asked = spark.createDataFrame([(1, "town", "a", f"{word(77)} roof"), (2, "TOWN", "b", f"{word(1)} {word(2)} {word(3)}"), (3, "Town", "c", "roof"),
                                   (4, None, "d", word(5)), (5, "Town", "e", "")], "ordinal long, agency string, opportunity_id string, title string")
    got = {r["ordinal"]: (r["prior_cycles"], str(r["last_cycle_closed"])) for r in similarity.recurrence(asked, titles).collect()}
    assert got == {1: (1, "2024-01-04"), 2: (3, "2024-01-01"), 3: (0, "None"), 4: (0, "None"), 5: (0, "None")}
    assert similarity.recurrence(titles, titles).agg(F.max("prior_cycles")).first()[0] == 0
    same = titles.withColumn("title", F.lit("paving"))
    counts = similarity.recurrence(same, same).agg(F.min("prior_cycles"), F.max("prior_cycles")).first()
    assert tuple(counts) == (49_999, 49_999)
    best = linkage.link_by_title(same.drop("due_date"), titles.unionByName(same.limit(10)))
    assert best.agg(F.count("*"), F.min("solicitation"), F.max("solicitation"), F.min("score")).first()[0] == 50_000


def test_copies_of_a_bid_and_a_changed_archive_title(spark):
    kind = "ordinal long, agency string, title string, opportunity_id string, due_date timestamp_ntz"
    day = datetime(2024, 1, 1)
    past = spark.createDataFrame([(1, "A", "roof pump", "x", day), (2, "A", "roof pump", "y", day - timedelta(days=3)), (3, "A", "roof pump hvac", "z", None)], kind)
    now = spark.createDataFrame([(1, "A", "roof pump", "x", None), (2, "A", "roof pump", "new", None), (3, "A", "roof pump", "new2", None),
                                 (4, "A", "roof pump bridge", "y", None), (5, "A", "hvac", "z", None)], kind)
    got = {r["ordinal"]: (r["prior_cycles"], r["last_cycle_closed"]) for r in similarity.recurrence(now, past).collect()}
    early = (day - timedelta(days=3)).date()
    assert got == {1: (2, early), 2: (3, day.date()), 3: (3, day.date()), 4: (1, day.date()), 5: (0, None)}


def test_recurrence_equals_brute_force(spark):
    rows, df = titled(spark, 3, 120)
    past_rows, past = rows[:80], df.filter("ordinal < 80")
    got = {r["ordinal"]: (r["prior_cycles"], r["last_cycle_closed"]) for r in similarity.recurrence(df, past).collect()}
    for o in rows:
        hits = [p for p in past_rows if p[1] == o[1] and p[3] != o[3] and alike(p[2], o[2])]
        dated = [p[4].date() for p in hits if p[4]]
        assert got[o[0]] == (len(hits), max(dated) if dated else None)


def test_sets_and_keys_are_never_broadcast(spark):
    """The planner takes them for small: it knows the compressed size of the written sets, not the rows of an explode."""
    _, df = titled(spark, 4, 60)
    for found in (similarity.recurrence(df, df), linkage.link_by_title(df, df)):
        assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_tokens_drop_boilerplate_years_and_digits(spark):
    df = spark.createDataFrame([("RFP No. 12 Annual Janitorial Services 2024 Citywide at HQ 7",)], "t string")
    assert df.select(keys.significant_tokens("t")).first()[0] == ["janitorial"]
    assert df.select(keys.containment(F.array(F.lit("a")), F.array().cast("array<string>"))).first()[0] == 0.0


def test_award_links(spark):
    rows = [record(1, external_id="ITB-24-011", title="Roof repairs"),
            record(2, title="Bridge paving north span"),
            record(3, agency="Other", title="Chiller overhaul"),
            record(4, status="award", linked_ref="itb 24 011", title="x", awarded_vendor="Acme", award_amount=5),
            record(5, status="award", title="Bridge paving north span phase", award_amount=0),
            record(6, status="award", title="Chiller overhaul")]
    df = opportunities(spark, rows)
    links = linkage.link_awards(df)
    assert {(r["ordinal"], r["solicitation"], r["linkage"]) for r in links.collect()} == {(4, 1, "ref"), (5, 2, "fuzzy")}
    facts = {r["ordinal"]: r for r in linkage.donate_award_facts(df, links).collect()}
    assert (facts[1]["awarded_vendor"], facts[1]["award_amount"], facts[2]["award_amount"]) == ("Acme", 5, 0)


def test_ripe_records(spark):
    def closed(i, days, **more):
        return record(i, status="closed", due_date=NOW - timedelta(days=days), title=f"{WORDS[i]} and {WORDS[i + 6]}", **more)

    rows = [closed(0, 30), closed(1, 31), closed(2, 31 + 365), closed(3, 31 + 366), closed(4, 40),
            record(9, status="award", title=f"{WORDS[4]} with {WORDS[10]} award"), closed(5, 40, agency="Elsewhere")]
    leads = records.ripe_for_request(opportunities(spark, rows), "2024-06-12").collect()
    assert {(r["ordinal"], r["ripe_for_days"]) for r in leads} == {(1, 0), (2, 365), (5, 9)}
