"""Fragments the SQL twins share."""

from tenderloom.functions.keys import NOISE_WORDS
from tenderloom.plans.tables import AS_OF

BUDGET = "CAST(NULLIF(regexp_replace(regexp_extract(coalesce(budget, ''), '^[^-–]*'), '[^0-9]', '', 'g'), '') AS BIGINT)"
VALUE = f"coalesce({BUDGET}, 0)"
DAYS = f"CAST(date_diff('day', DATE '{AS_OF}', CAST(due_date AS DATE)) AS INTEGER)"
HAS_CATEGORY = ("(coalesce(raw_category, '') <> '' OR len(commodity_codes) > 0 "
                "OR len(list_filter(categories, lambda c: c <> 'general')) > 0)")
RANK = ("CASE status WHEN 'open' THEN 0 WHEN 'upcoming' THEN 1 WHEN 'catalog' THEN 2 WHEN 'closed' THEN 3 "
        "WHEN 'cancelled' THEN 4 ELSE 9 END")
LIVE = "status IN ('open', 'upcoming')"
BARE_REF = "NULLIF(regexp_replace(lower(external_id), '[^a-z0-9]+', '', 'g'), '')"
REF_KEY = f"CASE WHEN length({BARE_REF}) >= 5 THEN county || '|' || {BARE_REF} END"
TITLE_KEY = ("county || '|' || lower(agency) || '|' || trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), "
             "'[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))")
RICH = ("CAST(status <> 'catalog' AS INT) DESC, CAST(due_date IS NOT NULL AS INT) DESC, "
        "CAST(posted_date IS NOT NULL AS INT) DESC, length(coalesce(description, '')) DESC, len(categories) DESC, "
        "CAST(external_id IS NOT NULL AS INT) DESC, length(coalesce(title, '')) DESC, ordinal ASC")


def tokens(title: str) -> str:
    noise = ", ".join(f"'{w}'" for w in NOISE_WORDS)
    return (f"list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(coalesce({title}, '')), "
            f"'\\b(?:19|20)[0-9]{{2}}\\b', ' ', 'g'), '[a-z0-9]+'), lambda w: length(w) > 2 "
            f"AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({noise}))))")


def overlap(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def similar(a: str, b: str) -> str:
    return f"(len({a}) > 0 AND len({b}) > 0 AND 10 * {overlap(a, b)} >= 7 * least(len({a}), len({b})))"


def absorbed(labels: str) -> str:
    """Labels in order, each dropped where a kept one covers its words, and put in the place of the first kept one it covers."""
    def words(label: str) -> str:
        return f"list_filter(regexp_extract_all(lower({label}), '[a-z0-9]+'), lambda w: w NOT IN ('required', 'a', 'the', 'of', 'and', 'to'))"

    new = words("one[1]")
    at = f"list_position(list_transform(kept, lambda k: list_has_all({words('k')}, {new}) OR list_has_all({new}, {words('k')})), true)"
    return (f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({labels}, lambda l: [l])), lambda kept, one: "
            f"CASE WHEN len({new}) = 0 THEN kept WHEN coalesce({at}, 0) = 0 THEN list_concat(kept, one) "
            f"WHEN list_has_all({words(f'kept[{at}]')}, {new}) THEN kept ELSE list_transform(kept, lambda k, i: CASE WHEN i = {at} THEN one[1] ELSE k END) END)")
