"""Work categories, offer type and keywords of a solicitation.

The taxonomy is a parameter: ordered rows of slug, label, group, offer, umbrella
and case-insensitive patterns. `STARTER` is a small default; a deployment loads
its own with `read_taxonomy`. Hundreds of pattern lists are not tried one by one:
each pattern's literals, one of which every match must contain, go into one
automaton that a text passes once, and only the patterns whose literal was met
are tried. The automaton is built once per worker from a broadcast table. This
is the one text step that runs faster in Arrow batches than as native columns;
everything decided from its matches is native.
"""

from __future__ import annotations

import json
import re
import sys
import types
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.functions import text as prose
from tenderloom.functions.base import first_filled, or_blank

MAX_DETECTED = 8  # fixed value: detected categories kept, before umbrellas
#: Shorter literals are in nearly every text and not worth looking for.
LEAST_LITERAL = 3


class Category(NamedTuple):
    slug: str
    label: str
    group: str
    offer: str
    patterns: tuple[str, ...] = ()
    umbrella: str | None = None


# A starter taxonomy, most telling entries of each group.
STARTER: tuple[Category, ...] = (
    Category("construction", "General construction", "construction", "construction",
             (r"\bconstruction\b", r"\brenovation\b", r"\bremodel", r"\bdesign[- ]build\b")),
    Category("roadway_bridge", "Roadway & bridge", "construction", "construction",
             (r"\bpaving\b", r"\basphalt\b", r"\bresurfacing\b", r"\bsidewalk\b", r"\bbridge\b"), "construction"),
    Category("roofing", "Roofing", "construction", "construction", (r"\broof(?:ing|s)?\b", r"\bre[- ]?roof"),
             "construction"),
    Category("hvac", "HVAC", "construction", "construction", (r"\bHVAC\b", r"\bchiller\b", r"\bair\s+condition"),
             "construction"),
    Category("architecture", "Architecture", "design", "professional_services", (r"\barchitect",)),
    Category("software", "Software", "it", "goods", (r"\bsoftware\b", r"\bSaaS\b")),
    Category("janitorial", "Janitorial", "facilities", "services", (r"\bjanitorial\b", r"\bcustodial\b")),
    Category("security_guard", "Security guards", "safety", "services", (r"\bsecurity\s+guard",)),
    Category("water_treatment", "Water treatment", "utilities", "services", (r"\bwater\s+plant\b", r"\bwater\s+treatment\b")),
    Category("furniture", "Furniture", "goods", "goods", (r"\bfurniture\b",)),
    Category("insurance", "Insurance", "financial", "services", (r"\bliability\s+insurance\b", r"\binsurance\s+broker")),
    Category("general", "General", "general", "unknown"),
)


def read_taxonomy(spark: SparkSession, path: str) -> tuple[Category, ...]:
    """Load taxonomy rows (with a `position` column for their order) from JSON or Parquet: a rule table, kept by hand."""
    reader = spark.read.parquet if path.endswith(".parquet") else spark.read.json
    return tuple(Category(r["slug"], r["label"], r["group"], r["offer"], tuple(r["patterns"] or ()), r["umbrella"])
                 for r in reader(path).orderBy("position").collect())


# ---- literals and the automaton ---------------------------------------------

def folded(text: str) -> str:
    """Lower case in which every letter that ignoring case holds equal to an ASCII letter is that letter."""
    return text.casefold().replace("\u0307", "").replace("\u0131", "i")


def literals(pattern: str) -> frozenset[str] | None:
    """Folded strings, one of which is in every text that the pattern matches; None where there is no telling."""
    def best(options: list[frozenset[str]]) -> frozenset[str] | None:
        usable = [o for o in options if o and min(map(len, o)) >= LEAST_LITERAL]
        return max(usable, key=lambda o: (min(map(len, o)), -len(o)), default=None)

    def of(items) -> frozenset[str] | None:
        found, run = [], ""
        for op, arg in [*items, (None, None)]:
            kind = str(op)
            if kind == "LITERAL" and arg < 128:
                run += folded(chr(arg))
                continue
            if run:
                found.append(frozenset([run]))
                run = ""
            if kind == "SUBPATTERN" and (inner := of(arg[3])):
                found.append(inner)
            elif kind in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1 and (inner := of(arg[2])):
                found.append(inner)
            elif kind == "BRANCH":
                parts = [of(branch) for branch in arg[1]]
                if all(parts):
                    found.append(frozenset().union(*parts))
        return best(found)

    return of(re._parser.parse(pattern, re.I))


class Detector:
    """The first matching pattern of each category, in the taxonomy's order."""

    def __init__(self, rules: Sequence[tuple[str, ...]]):
        self.rules = [[re.compile(p, re.I) for p in patterns] for patterns in rules]
        self.always, by_literal = [], {}
        for i, patterns in enumerate(rules):
            for k, pattern in enumerate(patterns):
                found = literals(pattern)
                if found is None:
                    self.always.append((i, k))
                for literal in found or ():
                    by_literal.setdefault(literal, []).append((i, k))
        try:
            import ahocorasick
        except ImportError:  # an optional package; each literal is then searched for by itself
            self.search = lambda text: (v for literal, v in by_literal.items() if literal in text)
        else:
            automaton = ahocorasick.Automaton()
            for literal, v in by_literal.items():
                automaton.add_word(literal, v)
            if by_literal:
                automaton.make_automaton()
            self.search = (lambda text: (v for _, v in automaton.iter(text))) if by_literal else (lambda text: ())

    def hits(self, text: str, most: int = MAX_DETECTED) -> list[tuple[int, str]]:
        """(position, matched text) of the first `most` categories that match."""
        seen, tries = set(), set(self.always)
        for v in self.search(folded(text)):
            if id(v) not in seen:
                seen.add(id(v))
                tries.update(v)
        out: list[tuple[int, str]] = []
        done = -1
        for i, k in sorted(tries):
            if i == done:
                continue
            found = self.rules[i][k].search(text)
            if found:
                out.append((i, found.group(0)))
                done = i
                if len(out) == most:
                    break
        return out


def _worker_detector(rules: tuple[tuple[str, ...], ...]) -> Detector:
    """The worker's own detector for these rules, built at the first call."""
    name = "_tenderloom_detectors"
    held = sys.modules.setdefault(name, types.ModuleType(name)).__dict__.setdefault("held", {})
    if rules not in held:
        held.clear()
        held[rules] = Detector(rules)
    return held[rules]


def _detect(spark: SparkSession, taxonomy: Sequence[Category]):
    """A pandas UDF giving slug, offer, umbrella, its offer, and the matched text of each detected category, in order."""
    offers = {c.slug: c.offer for c in taxonomy}
    told = tuple((c.slug, c.offer, c.umbrella, offers.get(c.umbrella), c.patterns) for c in taxonomy if c.patterns)
    table = spark.sparkContext.broadcast(told)

    @F.pandas_udf("array<struct<slug:string,offer:string,umbrella:string,umbrella_offer:string,found:string>>")
    def detect(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rows = table.value
        detector = _worker_detector(tuple(r[4] for r in rows))
        for batch in texts:
            yield batch.fillna("").map(lambda text: [(*rows[i][:4], found) for i, found in detector.hits(text)])

    return detect


def _by_slug(taxonomy: Sequence[Category], attribute: str) -> Column:
    """slug -> attribute, as one parsed literal however long the taxonomy."""
    return F.from_json(F.lit(json.dumps({c.slug: getattr(c, attribute) for c in taxonomy})), "map<string,string>")


def expand_umbrellas(categories: Column, taxonomy: Sequence[Category]) -> Column:
    """Each slug followed by its umbrella, first appearances kept."""
    umbrella = _by_slug(taxonomy, "umbrella")
    paired = F.flatten(F.transform(categories, lambda c: F.array_compact(F.array(c, umbrella[c]))))
    return F.array_distinct(paired)


def offer_of(votes: Column) -> Column:
    """Offer type by priority rather than majority."""
    def has(kind: str) -> Column:
        return F.array_contains(votes, kind)

    return (F.when(F.size(votes) == 0, "unknown")
            .when(has("construction"), "construction")
            .when(has("professional_services") & ~has("goods"), "professional_services")
            .when(has("goods") & ~has("services"), "goods")
            .when(has("services"), "services")
            .when(has("mixed"), "mixed")
            .otherwise(F.get(votes, F.lit(0))))


def classify(df: DataFrame, text: Column, taxonomy: Sequence[Category] = STARTER) -> DataFrame:
    """Add categories, offer_type and keywords read from `text`."""
    found = df.withColumn("__hits", _detect(df.sparkSession, taxonomy)(text))
    # Umbrellas follow the detected slugs and are never cut by the cap.
    above = F.filter("__hits", lambda h: h["umbrella"].isNotNull())
    tags = F.array_distinct(F.concat(F.transform("__hits", lambda h: h["slug"]), F.transform(above, lambda h: h["umbrella"])))
    votes = F.array_compact(F.array_distinct(F.concat(F.transform("__hits", lambda h: h["offer"]), F.transform(above, lambda h: h["umbrella_offer"]))))
    return (found.withColumn("offer_type", offer_of(votes))
            .withColumn("categories", F.when(F.size("__hits") == 0, F.array(F.lit("general"))).otherwise(tags))
            .withColumn("keywords", F.array_distinct(F.transform("__hits", lambda h: F.trim(F.lower(h["found"])))))
            .drop("__hits"))


def enrich(df: DataFrame, taxonomy: Sequence[Category] = STARTER, title: str = "title", description: str = "description",
           external_id: str = "external_id") -> DataFrame:
    """Add solicitation_type, offer_type, categories and keywords, and fill a blank external_id from the prose."""
    words = F.concat_ws(" ", or_blank(title), or_blank(description))
    kind = prose.solicitation_type(F.concat_ws(" ", or_blank(external_id), words))
    given = df.withColumn("solicitation_type", kind).withColumn(external_id, first_filled(external_id, prose.external_id(words)))
    return classify(given, F.concat_ws("\n", or_blank(title), or_blank(description)), taxonomy)


def category_label(slug: Column, taxonomy: Sequence[Category] = STARTER) -> Column:
    spaced = F.lower(F.translate(slug, "_-", "  "))
    humanised = F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 10_000))
    return F.coalesce(_by_slug(taxonomy, "label")[slug], humanised)


def default_categories(categories: Column, preset: Sequence[str]) -> Column:
    """Put a board's preset categories first and drop `general`."""
    if not preset:
        return categories
    rest = F.filter(categories, lambda c: (c != "general"))
    return F.array_distinct(F.concat(F.array(*[F.lit(p) for p in preset]), rest))
