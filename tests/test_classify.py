"""Literals, the automaton and enrichment, against patterns tried one by one."""

import random
import re

import pytest

from tenderloom.functions import classify
from tenderloom.plans import q_scalars


@pytest.mark.parametrize("pattern, found", [
    (r"\broof(?:ing|s)?\b", {"roof"}), (r"\bre[- ]?roof", {"roof"}), (r"\bdesign[- ]build\b", {"design"}), (r"\bHVAC\b", {"hvac"}),
    (r"(?:paving|asphalt)\s+works", {"paving", "asphalt"}), (r"paving|asphalt", {"paving", "asphalt"}), (r"\bIT\b", None), (r"\d+", None), (r"(?:abc)?", None),
    (r"(?:abc)+x", {"abc"}), (r"a|bcd", None), (r"[ab]cde", {"cde"}), (r"wa?ter", {"ter"}), (r"ſtraße", {"tra"}),
])
def test_every_match_contains_one_of_the_literals(pattern, found):
    assert classify.literals(pattern) == (None if found is None else frozenset(found))


def one_by_one(rules, text, most=classify.MAX_DETECTED):
    out = []
    for i, patterns in enumerate(rules):
        hit = next((m for m in (re.search(p, text, re.I) for p in patterns) if m), None)
        if hit and len(out) < most:
            out.append((i, hit.group(0)))
    return out


LETTERS = "aAbBiIkKsSıİſKßx \t-"


@pytest.mark.parametrize("seed", range(30))
def test_detector_equals_patterns_one_by_one(seed):
    rng = random.Random(seed)

    def piece():
        word = "".join(rng.choice("abiksx") for _ in range(rng.randrange(1, 5)))
        return rng.choice([word, f"(?:{word}|{word[::-1]}b)", f"{word}?", rf"\b{word}", f"[ab]{word}", f"(?:{word})+", r"\s+", rf"{word}\b", f"{word}{{0,2}}"])

    rules = [tuple("".join(piece() for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 4))) for _ in range(40)]
    detector = classify.Detector(rules)
    for _ in range(60):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(0, 60)))
        assert detector.hits(text) == one_by_one(rules, text), text


def test_without_the_automaton_package(monkeypatch):
    import builtins
    real = builtins.__import__

    def lacking(name, *rest, **more):
        if name == "ahocorasick":
            raise ImportError(name)
        return real(name, *rest, **more)

    monkeypatch.setattr(builtins, "__import__", lacking)
    rules = tuple(c.patterns for c in classify.STARTER)
    text = "Re-roofing and HVAC at the water plant; SaaS software, İnsurance broker"
    assert classify.Detector(rules).hits(text) == one_by_one(rules, text)


def test_no_rules_and_no_text():
    assert classify.Detector([]).hits("anything") == [] and classify.Detector([("a",)]).hits("") == []


def test_enrich(spark, tmp_path):
    rows = [(1, "Reroof Fire Station 12", "Paving of the lot. RFP No. 2024-118", None), (2, "ITB chillers", None, "X-1"), (3, None, None, ""), (4, "SaaS", "", "RFQ 9")]
    df = spark.createDataFrame(rows, "id int, title string, description string, external_id string")
    got = {r["id"]: r for r in classify.enrich(df).collect()}
    assert (got[1]["categories"], got[1]["offer_type"], got[1]["external_id"]) == (["roadway_bridge", "roofing", "construction"], "construction", "RFP No. 2024-118")
    assert got[1]["keywords"] == ["paving", "reroof"] and got[1]["solicitation_type"] == "RFP"
    assert (got[2]["solicitation_type"], got[2]["external_id"], got[2]["categories"]) == ("ITB", "X-1", ["general"])
    assert (got[3]["solicitation_type"], got[3]["external_id"], got[3]["offer_type"], got[3]["keywords"]) == ("UNKNOWN", None, "unknown", [])
    assert (got[4]["solicitation_type"], got[4]["categories"], got[4]["offer_type"]) == ("RFQ", ["software"], "goods")


def test_taxonomy_round_trip_and_labels(spark):
    from tenderloom.plans.tables import Tables
    assert len(q_scalars.WIDE) > 200
    assert q_scalars.wide_taxonomy(Tables(spark, "")) == q_scalars.WIDE
    df = spark.createDataFrame([("roofing",), ("water_treatment-plant",), ("éCOLE_x",)], "slug string")
    labels = [r[0] for r in df.select(classify.category_label(df.slug)).collect()]
    assert labels == ["Roofing", "Water treatment plant", "École x"]


def test_more_than_eight_categories_and_umbrellas_beyond_the_cap(spark):
    taxonomy = tuple(classify.Category(f"c{i}", f"C {i}", "g", "goods", (f"word{i:02d}",), "top" if i == 7 else None) for i in range(12)) + (
        classify.Category("top", "Top", "g", "services"),)
    df = spark.createDataFrame([(" ".join(f"WORD{i:02d}" for i in range(11, -1, -1)),)], "t string")
    row = classify.classify(df, df.t, taxonomy).first()
    assert row["categories"] == [*(f"c{i}" for i in range(8)), "top"] and row["offer_type"] == "services"
