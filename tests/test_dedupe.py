"""The distributed collapse against the ordered greedy definition, by brute force."""

import random
import re
from datetime import datetime

from tenderloom.operators import dedupe
from tests.conftest import opportunities, record


def greedy(rows):
    """Definition on a list: returns ordinal -> surviving ordinal."""
    def ref(r):
        bare = re.sub("[^a-z0-9]", "", (r.get("external_id") or "").lower())
        return f"{r['county']}|{bare}" if len(bare) >= 5 else None

    def title(r):
        return f"{r['county']}|{r['agency'].lower()}|" + " ".join(re.sub("[^a-z0-9 ]+", " ", r["title"].lower()).split())

    def richness(r):
        return (r["status"] != "catalog", r.get("due_date") is not None, r.get("posted_date") is not None,
                len(r.get("description") or ""), len(r["categories"]), r.get("external_id") is not None, len(r["title"]))

    owner, into, refs = {}, {}, {}
    for r in sorted(rows, key=richness, reverse=True):
        k, t = ref(r), title(r)
        home = owner.get(k) if k else None
        if home is None and t in owner and (k is None or refs[owner[t]] is None or refs[owner[t]] == k):
            home = owner[t]
        if home is None:
            home = r["ordinal"]
            refs[home] = k
        into[r["ordinal"]] = home
        for key in (k, t):
            if key:
                owner.setdefault(key, home)
    return into


def test_survivors_equal_greedy_on_random_inputs(spark):
    rng = random.Random(7)
    for _ in range(4):
        rows = [record(i, title=f"Job {rng.randrange(9)}", county=rng.choice(["broward", "orange"]),
                       external_id=rng.choice([None, f"REF-{rng.randrange(12):03d}", "A-1"]),
                       description="x" * rng.randrange(4), status=rng.choice(["open", "catalog"]),
                       due_date=rng.choice([None, datetime(2024, 1, 1)])) for i in range(120)]
        got = {r["ordinal"]: r["survivor"] for r in dedupe.survivor_map(opportunities(spark, rows)).collect()}
        assert got == greedy(rows)


def test_reference_spelling_and_donated_fields(spark):
    rows = [record(1, external_id="RFQ-2024-NL-07", description="long text", categories=["roofing"]),
            record(2, external_id="rfq 2024 nl 07", title="Other", contact="Ann", budget="$5", categories=["hvac", "roofing"],
                   due_date=None)]
    out = dedupe.collapse(opportunities(spark, rows)).collect()
    assert [r["ordinal"] for r in out] == [1]
    assert (out[0]["contact"], out[0]["budget"], out[0]["categories"], out[0]["merged_records"]) == ("Ann", "$5", ["roofing", "hvac"], 2)


def test_title_rules(spark):
    apart = [record(1, external_id="RFP-10001"), record(2, external_id="RFP-10002")]
    joined = [record(1, external_id="RFP-10001"), record(2)]
    counties = [record(1), record(2, county="orange")]
    short = [record(1, external_id="A-1", title="One"), record(2, external_id="A-1", title="Two")]
    for rows, kept in ((apart, 2), (joined, 1), (counties, 2), (short, 2)):
        assert dedupe.collapse(opportunities(spark, rows)).count() == kept


def test_collapse_is_idempotent(spark):
    rows = [record(i, title=f"Job {i % 5}", external_id=f"REF-{i % 7:03d}" if i % 3 else None) for i in range(60)]
    once = dedupe.collapse(opportunities(spark, rows)).drop("merged_records")
    again = dedupe.collapse(once)
    assert sorted(r[0] for r in once.select("ordinal").collect()) == sorted(r[0] for r in again.select("ordinal").collect())


def test_label_absorption(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(["Bid bond", "Insurance", "Bid bond required", "Performance bond"],), ([],)], "l array<string>")
    got = [r[0] for r in df.select(dedupe.absorb_labels(F.col("l"))).collect()]
    assert got == [["Bid bond", "Insurance", "Performance bond"], []]
