"""Counties, regions and government tiers read from agency names.

Inference runs once per distinct name and is joined back. City names come as a
parameter table (needle, slug, position), since a state's list runs to hundreds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.base import (ColumnLike, any_of, brought, col, ladder, matches, or_blank)

# Region -> county slugs.
REGIONS: dict[str, list[str]] = {
    "southeast": ["miami-dade", "broward", "palm-beach", "martin", "st-lucie", "indian-river", "okeechobee", "monroe"],
    "southwest": ["lee", "collier", "charlotte", "sarasota", "manatee", "hendry", "glades", "desoto", "hardee",
                  "highlands"],
    "tampa-bay": ["hillsborough", "pinellas", "pasco", "polk", "hernando", "citrus", "sumter"],
    "central": ["orange", "seminole", "osceola", "lake", "volusia", "brevard", "marion", "flagler"],
    "northeast": ["duval", "st-johns", "clay", "nassau", "putnam", "alachua", "baker", "bradford", "union", "columbia",
                  "gilchrist", "levy", "dixie", "lafayette", "suwannee", "hamilton"],
    "northwest": ["leon", "escambia", "santa-rosa", "okaloosa", "walton", "bay", "gulf", "franklin", "wakulla",
                  "jefferson", "madison", "taylor", "gadsden", "liberty", "calhoun", "jackson", "holmes", "washington"],
}
# Display names that are not the slug in title case.
SPECIAL_NAMES = {"miami-dade": "Miami-Dade", "st-lucie": "St. Lucie", "st-johns": "St. Johns", "desoto": "DeSoto"}
PSEUDO_COUNTIES = {"statewide": "Statewide", "federal": "Federal", "unknown": "Unknown"}
REGION_LABELS = {
    "southeast": "Southeast Florida", "southwest": "Southwest Florida", "tampa-bay": "Tampa Bay",
    "central": "Central Florida", "northeast": "Northeast Florida", "northwest": "Northwest Florida",
    "statewide": "Statewide & other", "federal": "Statewide & other", "unknown": "Statewide & other",
}
COUNTY_REGION = {slug: region for region, slugs in REGIONS.items() for slug in slugs}
COUNTY_NAMES = {slug: SPECIAL_NAMES.get(slug, slug.replace("-", " ").title()) for slug in COUNTY_REGION}

# Phrases that mark a body serving the whole state.
STATEWIDE_MARKERS = (
    "state of florida", "florida department of", "department of transportation", "water management district",
    "florida division of", "office of the", "legislative branch", "state courts", "auditor general",
    "citizens property", "enterprise florida", "volunteer florida", "florida lottery", "myflorida", "sourcewell",
    "omnia", "naspo", "buyboard", "1gpa", "equalis", "tips-usa", "florida sheriffs association", "florida buy", "paec",
)
# Patterns for state bodies and tiers.
STATE_BODY = (r"^(?:the\s+)?(?:florida\s+)?(?:department|agency|division|office|commission|board|bureau|council|"
              r"authority|executive office|state board)\s+(?:of|for|on)\b")
TIER_SCHOOL = (r"\b(school district|school board|public schools|county schools|schools of|district school)\b")
TIER_HIGHER_ED = r"\b(university|college|polytechnic)\b"
TIER_SPECIAL = (r"\b(authority|special district|water control|drainage|inlet|mosquito|hospital district|"
                r"health care district|fire district|fire control|community development district|cdd|"
                r"improvement district|sanitary|utility district|utilities commission|housing|port|airport|aviation|"
                r"transit|transportation authority|expressway|metropolitan planning|children's services|"
                r"library district|soil and water)\b")
TIER_MUNICIPAL = r"^(?:the\s+)?(city|town|village)\s+of\b"
CITY_TAIL = (r"\s+(purchasing|procurement|finance|utilities|police|fire|water|public works|department|dept|division|"
             r"office|florida|fl)\b.*$")


def normalise(text: ColumnLike) -> Column:
    out = F.replace(F.replace(F.trim(F.lower(col(text))), F.lit("."), F.lit("")), F.lit("’"), F.lit("'"))
    return F.regexp_replace(out, r"\s+", " ")


def _plain(name: str) -> str:
    return name.lower().replace(".", "")


def county_spellings() -> dict[str, str]:
    """Every accepted spelling of a county's name, in normal form."""
    out = {_plain(name): slug for slug, name in COUNTY_NAMES.items()}
    out.update({"miami dade": "miami-dade", "de soto": "desoto"})
    return out


@dataclass(frozen=True)
class Gazetteer:
    """Names that place an agency: an ordered institution list and a city table.

    `cities` has columns needle and slug, in normal form, and position: the list's order.
    """

    cities: DataFrame
    institutions: Mapping[str, str] = field(default_factory=dict)
    markers: Sequence[str] = STATEWIDE_MARKERS


def lookup(mapping: Mapping[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[key]


def county_label(slug: ColumnLike) -> Column:
    slug = col(slug)
    humanised = F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))
    return F.coalesce(lookup({**COUNTY_NAMES, **PSEUDO_COUNTIES}, slug), humanised)


def region_of(slug: ColumnLike) -> Column:
    slug = col(slug)
    known = lookup({**COUNTY_REGION, **{p: p for p in PSEUDO_COUNTIES}}, slug)
    return F.coalesce(known, F.lit("unknown"))


def is_statewide_body(name: Column, markers: Sequence[str] = STATEWIDE_MARKERS) -> Column:
    return any_of([name.contains(m) for m in markers]) | matches(name, STATE_BODY)


_WORD = r"[\p{L}\p{N}_]+"


def longest_names_inside(names: DataFrame, known: DataFrame, key: str = "name") -> DataFrame:
    """For each `name` (told apart by `key`), the longest known needle of every kind standing in it as whole words.

    `known` has kind, needle, slug and position; the earlier of equally long names
    wins. Candidates come from an equi-join on the
    needle's first word; the exact spelling is then checked with word
    boundaries. Returns key and a map kind -> slug.
    """
    words = F.array_distinct(F.regexp_extract_all("name", F.lit(_WORD), F.lit(0)))
    keyed = known.withColumn("word", F.regexp_extract("needle", f"({_WORD})", 1))
    candidates = names.select(*dict.fromkeys([key, "name"]), F.explode(words).alias("word")).join(brought(keyed), "word")
    exact = F.expr(r"rlike(name, concat('\\b\\Q', needle, '\\E\\b'))")
    best = candidates.filter(exact).groupBy(key, "kind").agg(
        F.max_by("slug", F.struct(F.length("needle"), -F.col("position"))).alias("slug"))
    return best.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("kind", "slug"))).alias("found"))


def infer_counties(df: DataFrame, gazetteer: Gazetteer, agency: str = "agency", hint: str | None = None,
                   out: str = "county_slug", key: str | None = None) -> DataFrame:
    """Add the county each agency name points at, `statewide`, or `unknown`.

    Names recur, so each is judged once. Long texts do not: with a unique `key`
    each row is judged by itself and no text becomes a join key.
    """
    spellings = county_spellings()
    on, text = key or "name", normalise(or_blank(agency))
    names = df.select(key, text.alias("name")) if key else df.select(text.alias("name")).distinct()
    counties = df.sparkSession.createDataFrame(
        [(*pair, i) for i, pair in enumerate(spellings.items())], "needle string, slug string, position int")
    known = gazetteer.cities.select(F.lit("city").alias("kind"), "needle", "slug", "position").unionByName(
        counties.withColumn("kind", F.lit("county")))
    city_of = F.regexp_replace(
        normalise(F.regexp_extract("name", r"\b(?:city|town|village) of ([a-z' .-]+)", 1)), CITY_TAIL, "")
    cities = gazetteer.cities.select(F.col("needle").alias("city_of"), F.col("slug").alias("named_city_slug"))
    explicit = lookup(spellings, F.trim(F.regexp_extract("name", r"\b([a-z][a-z' -]+?)\s+county\b", 1)))
    institution = ladder([(F.col("name").contains(needle), F.lit(slug))
                          for needle, slug in gazetteer.institutions.items()], F.lit(None).cast("string"))
    placed = (names.withColumn("city_of", F.trim(city_of))
              .join(brought(cities), "city_of", "left").join(longest_names_inside(names, known, on), on, "left")
              .select(on, F.when(F.col("name") == "", F.lit("unknown")).otherwise(F.coalesce(
                  explicit,
                  F.when(is_statewide_body(F.col("name"), gazetteer.markers), F.lit("statewide")),
                  institution, "named_city_slug", F.col("found")["city"], F.col("found")["county"],
                  F.lit("unknown"))).alias("__slug")))
    if key:
        joined = df.join(placed, key, "left")
    else:
        joined = df.withColumn("name__", text).join(placed.withColumnRenamed("name", "name__"), "name__", "left").drop("name__")
    if hint is None:
        return joined.withColumnRenamed("__slug", out)
    given = F.coalesce(lookup(spellings, normalise(hint)),
                       F.when(F.col(hint).isin(*COUNTY_NAMES, *PSEUDO_COUNTIES), F.col(hint)))
    return joined.withColumn(out, F.coalesce(given, "__slug")).drop("__slug")


def infer_tiers(df: DataFrame, cities: DataFrame, agency: str = "agency", county: str = "county",
                out: str = "tier_guess") -> DataFrame:
    """Add the government tier an agency name points at; `unknown` when unclear."""
    names = df.select(normalise(or_blank(agency)).alias("name")).distinct()
    hits = longest_names_inside(names, cities.withColumn("kind", F.lit("city")))
    name = F.col("name")
    tiers = names.join(hits, "name", "left").select("name", ladder([
        (name == "", F.lit("unknown")),
        (matches(name, TIER_SCHOOL), F.lit("school_district")),
        (matches(name, TIER_HIGHER_ED), F.lit("higher_ed")),
        (is_statewide_body(name), F.lit("state")),
        (matches(name, TIER_SPECIAL), F.lit("special_district")),
        (matches(name, TIER_MUNICIPAL), F.lit("municipal")),
        (matches(name, r"\bcounty\b"), F.lit("county")),
        (F.col("found").isNotNull(), F.lit("municipal")),
    ], F.lit("unknown")).alias("__tier"))
    return (df.withColumn("name__", normalise(or_blank(agency)))
            .join(tiers.withColumnRenamed("name", "name__"), "name__", "left")
            .withColumn(out, F.when(F.col(county) == "federal", F.lit("federal")).otherwise(F.col("__tier")))
            .drop("name__", "__tier"))
