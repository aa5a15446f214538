"""Set-similarity joins on title words within one agency, answered without listing pairs.

Two titles match when the words they share are at least seven tenths of the
smaller title's words. The join is exact and never pairs a whole agency with
itself:

1. Equal word sets are collapsed first, so copies cost one row. A set is two
   64-bit ids, its agency's and its own; a word is one.
2. Words are ranked by how rare they are in the agency. A match shares at least
   `c = ceil(0.7 m)` of the smaller set's m words, so the first shared word is
   among its `m - c + 1` rarest and the second among its `m - c + 2` rarest. A
   word that at most `RARE` sets hold is a key alone; a more frequent one is
   a key only together with the second shared word.
3. A key carries the places of its words, which bound how much two sets can
   still share: most candidates end there. The others are verified on word ids.
4. Keys that the index holds more than `ROWS_PER_SALT` times, as counted, are salted.
5. A match is found at its first shared key only, and goes straight into an
   aggregate (`folded`): what is shuffled after the join is at most one row for
   each asked set and task, never pairs.
6. Sets, keys and answers meet in shuffles. A broadcast would be chosen by the
   compressed size of the written sets, which says little of their keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tenderloom.functions import keys
from tenderloom.functions.base import brought, first_rows, shuffled
from tenderloom.session import cut_lineage

# The 0.7 rule in integers, so no float comparison decides a match.
NUMERATOR, DENOMINATOR = 7, 10
#: Sets that a word may be in and still be a key alone.
RARE = 64
ROWS_PER_SALT = 20_000
SET = ["scope_id", "set_id"]


def with_tokens(df: DataFrame, agency: str = "agency", title: str = "title") -> DataFrame:
    """Add agency_key (folded agency), tokens, set_key (the set as one string), and the ids scope_id and set_id."""
    return (df.withColumn("agency_key", F.lower(F.col(agency)))
            .withColumn("tokens", keys.significant_tokens(title))
            .withColumn("set_key", F.array_join("tokens", " "))
            .withColumn("scope_id", F.when(F.col("agency_key").isNotNull(), F.xxhash64("agency_key"))).withColumn("set_id", F.xxhash64("set_key")))


def enough_overlap(shared: Column, smaller: Column) -> Column:
    return DENOMINATOR * shared >= NUMERATOR * smaller


def _needed(size: Column) -> Column:
    """Words that a set of `size` must share with a larger one."""
    return F.floor((NUMERATOR * size + (DENOMINATOR - 1)) / DENOMINATOR).cast("int")


def _places(first: Column, last: Column) -> Column:
    """first, first + 1, ... last; empty where last comes before first."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _entry(codes: Column, i: Column, j: Column | None = None) -> Column:
    """A key with the places of its words, counted from 1 (j is 0 in a key of one word)."""
    word = F.element_at(codes, i)
    key = word if j is None else F.xxhash64(word, F.element_at(codes, j))
    return F.struct(key.alias("key"), i.alias("i"), (F.lit(0) if j is None else j).alias("j"))


def _probe_entries() -> Column:
    """Keys that a smaller set's first shared words can be."""
    codes, size = F.col("codes"), F.size("codes")
    last = size - _needed(size) + 1

    def of_word(i: Column) -> Column:
        alone = (size == 1) | (i <= F.col("rare"))
        return F.when(alone, F.array(_entry(codes, i))).otherwise(F.transform(_places(i + 1, last + 1), lambda j: _entry(codes, i, j)))

    return F.flatten(F.transform(_places(F.lit(1), last), of_word))


def _index_entries() -> Column:
    """Keys under which a set can be found: every word, and frequent words with each word after them."""
    codes, size = F.col("codes"), F.size("codes")
    alone = F.transform(_places(F.lit(1), size), lambda i: _entry(codes, i))
    pairs = F.flatten(F.transform(_places(F.col("rare") + 1, size - 1), lambda i: F.transform(_places(i + 1, size), lambda j: _entry(codes, i, j))))
    return F.concat(alone, pairs)


def _ranked_sets(rows: DataFrame) -> DataFrame:
    """Distinct word sets of `rows` (SET, set_key): codes (word ids, rarest first), and how many of the first words are
    rare and how many are in too few sets to need salt."""
    sets = rows.select(*SET, "set_key").distinct().withColumn("words", F.split("set_key", " "))
    words = sets.select(*SET, F.size("words").alias("size"), F.explode("words").alias("word")).select(
        *SET, "size", F.xxhash64("word").alias("code"), F.crc32("word").alias("check"))
    counts = words.groupBy("scope_id", "code").agg(F.count(F.lit(1)).alias("n"), F.min("check").alias("low"), F.max("check").alias("high"))
    seen = F.when(F.col("low") == F.col("high"), F.col("n")).otherwise(F.raise_error(F.lit("two words share an id")).cast("long"))
    ranked = words.join(shuffled(counts.select("scope_id", "code", seen.alias("seen"))), ["scope_id", "code"]).groupBy(*SET).agg(
        F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("seen", "code"))).alias("ranked"))

    def at_most(n: int) -> Column:
        return F.size(F.filter("ranked", lambda w: w["seen"] <= n))

    whole = F.when(F.size("ranked") == F.col("size"), F.transform("ranked", lambda w: w["code"])).otherwise(
        F.raise_error(F.lit("two word sets share an id")).cast("array<long>"))
    return ranked.select(*SET, whole.alias("codes"), at_most(RARE).alias("rare"), at_most(ROWS_PER_SALT).alias("cool"))


def _met(small: DataFrame, large: DataFrame, strict: bool, hot: bool) -> DataFrame:
    """The columns of `small` and `large` (a set each, their own columns in structs s and l) where they match, with
    `shared`; the small side has no more (or, if strict, fewer) words."""
    probe = small.withColumn("entry", F.explode(_probe_entries()))
    index = large.withColumn("entry", F.explode(_index_entries()))
    salt = F.lit(0).alias("salt")
    if hot:  # some word is in more sets than one task should take: count its keys
        counted = index.filter(F.col("entry.i") > F.col("cool")).groupBy("scope_id", F.col("entry.key").alias("key")).agg(F.count(F.lit(1)).alias("n"))
        salted = brought(counted.filter(F.col("n") > ROWS_PER_SALT).select("scope_id", "key", F.ceil(F.col("n") / ROWS_PER_SALT).cast("int").alias("salts")))
        probe = probe.withColumn("key", F.col("entry.key")).join(salted, ["scope_id", "key"], "left").drop("key")
        probe = probe.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        index = index.withColumn("key", F.col("entry.key")).join(salted, ["scope_id", "key"], "left").drop("key")
        index = index.withColumn("salt", F.pmod(F.xxhash64("set_id"), F.coalesce("salts", F.lit(1))).cast("int"))
    else:
        probe, index = probe.withColumn("salt", salt), index.withColumn("salt", salt)
    probe = probe.select("scope_id", "entry.key", "salt", F.col("codes").alias("sc"), F.col("entry.i").alias("si"), F.col("entry.j").alias("sj"), "s")
    index = index.select("scope_id", "entry.key", "salt", F.col("codes").alias("lc"), F.col("entry.i").alias("li"), F.col("entry.j").alias("lj"), "l")
    smaller, larger = F.size("sc"), F.size("lc")
    alone = F.col("sj") == 0
    # what the two can share at most, given where their first shared words stand
    at_most = F.when(alone, 1 + F.least(smaller - F.col("si"), larger - F.col("li"))).otherwise(2 + F.least(smaller - F.col("sj"), larger - F.col("lj")))
    candidates = (probe.join(shuffled(index), ["scope_id", "key", "salt"])
                  .filter((smaller < larger) if strict else (smaller <= larger))
                  .filter((alone == (F.col("lj") == 0)) & (at_most >= _needed(smaller))))

    # most candidates fall at the count; what is left is tested for its first shared words
    common = F.array_intersect("sc", "lc")
    first = F.get(common, F.lit(0)) == F.element_at("sc", F.col("si"))
    second = alone | (F.get(common, F.lit(1)) == F.element_at("sc", F.greatest("sj", F.lit(1))))
    found = candidates.filter(enough_overlap(F.size(common), smaller)).filter(first & second).withColumn("shared", F.size(common))
    return found.select("s", "l", (F.col("shared") / smaller).alias("score"))


def folded(left: DataFrame, right: DataFrame, answers: Sequence[Column], asked: Sequence[str] = ()) -> DataFrame:
    """`answers` aggregated over the right sets that match each left set.

    `left` holds what is asked (SET, set_key, and the columns `asked` that tell
    questions about one set apart), each once; `right` holds one row a set (SET,
    set_key, and what the answers use). In `answers` the left row is the struct
    `ask`, the right row `hit`, and `score` the shared part of the smaller set.
    Returns SET, `asked` and the answers, for the left rows that match anything.
    """
    def rows(df: DataFrame, as_: str) -> DataFrame:
        kept = [c for c in df.columns if c != "set_key"]
        return df.filter(F.col("set_key") != "").select(*SET, "set_key", F.struct(*kept).alias(as_))

    both = rows(left, "ask").unionByName(rows(right, "hit"), allowMissingColumns=True)
    # far smaller than the records and read four times, so written once
    hot = Observation()
    coded = both.drop("set_key").join(shuffled(_ranked_sets(both)), SET)
    coded = cut_lineage(coded.observe(hot, F.max(F.size("codes") - F.col("cool")).alias("words")))
    salted = bool(hot.get["words"])
    lefts, rights = [coded.filter(F.col(x).isNotNull()).select(*SET, F.col(x).alias("row"), "codes", "rare", "cool") for x in ("ask", "hit")]
    forward = _met(lefts.withColumnRenamed("row", "s"), rights.withColumnRenamed("row", "l"), False, salted)
    backward = _met(rights.withColumnRenamed("row", "s"), lefts.withColumnRenamed("row", "l"), True, salted)
    met = (forward.select(F.col("s").alias("ask"), F.col("l").alias("hit"), "score")
           .unionByName(backward.select(F.col("l").alias("ask"), F.col("s").alias("hit"), "score")))
    by = [F.col(f"ask.{c}").alias(c) for c in [*SET, *asked]]
    return met.groupBy(*by).agg(*answers) if answers else met.select(*by).distinct()


def _distinct_sets(df: DataFrame) -> DataFrame:
    return df.select(*SET, "set_key").filter(F.col("set_key") != "").distinct()


def similar_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """All (scope, left_key, right_key, score) of distinct word sets that match: a listing for small inputs.

    Both inputs come from `with_tokens`; empty sets match nothing. Operators
    fold their answers instead.
    """
    def sets(df: DataFrame, name: str) -> DataFrame:
        return df.filter(F.col("set_key") != "").select(F.col("agency_key").alias("scope"), *SET, "set_key", F.col("set_key").alias(name)).distinct()

    pair = F.collect_list(F.struct("hit.right_key", "score")).alias("pairs")
    found = folded(sets(left, "left_key"), sets(right, "right_key"), [pair], ["scope", "left_key"])
    return found.select("scope", "left_key", F.inline("pairs"))


def best_match(left: DataFrame, right: DataFrame, right_id: str, right_order: str = "ordinal") -> DataFrame:
    """For every left word set, the best-scoring right record; earliest on ties.

    Returns scope_id, set_id (left), score and `right_id`.
    """
    earliest = (right.filter(F.col("set_key") != "").groupBy(*SET, "set_key")
                .agg(F.min(F.struct(F.col(right_order).alias("at"), F.col(right_id).alias("id"))).alias("first"))
                .select(*SET, "set_key", "first.at", "first.id"))
    top = F.max(F.struct("score", (-F.col("hit.at")).alias("at"), F.col("hit.id").alias("id"))).alias("top")
    return folded(_distinct_sets(left), earliest, [top]).select(*SET, F.col("top.score").alias("score"), F.col("top.id").alias(right_id))


def recurrence(bids: DataFrame, archive: DataFrame) -> DataFrame:
    """Past solicitations of the same agency for the same thing, per bid.

    Adds prior_cycles and last_cycle_closed. A bid never counts its own archive
    record; the last cycle is the latest dated one. `archive` holds an
    opportunity_id once. A set of past records brings its count and its two
    latest records, at most one of which is the bid's own; so bids that are in
    the archive ask for themselves, all others once for each set.
    """
    current = with_tokens(bids)
    past = cut_lineage(with_tokens(archive).filter(F.col("set_key") != "").select(*SET, "set_key", "opportunity_id", "due_date"))
    newest_two = first_rows(past.filter(F.col("due_date").isNotNull()).select(*SET, "due_date", "opportunity_id"), SET,
                            [F.col("due_date").desc(), F.col("opportunity_id").desc()], n=2)
    dated = F.struct("due_date", F.col("opportunity_id").alias("id"))
    tops = newest_two.groupBy(*SET).agg(F.max(dated).alias("top"), F.min(dated).alias("low"), F.count(F.lit(1)).alias("dated"))
    sets = (past.groupBy(*SET, "set_key").agg(F.count(F.lit(1)).alias("n")).join(shuffled(tops), SET, "left")
            .select(*SET, "set_key", "n", F.col("top.due_date").alias("newest"), F.col("top.id").alias("newest_id"),
                    F.when(F.col("dated") == 2, F.col("low.due_date")).alias("second")))

    own = past.select(F.col("opportunity_id").alias("own_id"), F.col("scope_id").alias("own_scope"), F.col("set_id").alias("own_set"))
    asking = (current.filter(F.col("set_key") != "").select(*SET, "set_key", "opportunity_id")
              .join(shuffled(own), F.col("opportunity_id") == F.col("own_id"), "left").drop("opportunity_id").distinct())
    itself = (F.col("ask.own_scope") == F.col("hit.scope_id")) & (F.col("ask.own_set") == F.col("hit.set_id"))
    cycles = F.sum(F.col("hit.n") - F.when(itself, 1).otherwise(0)).cast("int").alias("prior")
    closed = F.max(F.when(F.col("hit.newest_id") == F.col("ask.own_id"), F.col("hit.second")).otherwise(F.col("hit.newest"))).alias("closed")
    found = folded(asking, sets, [cycles, closed], ["own_id"])

    # an asker outside the archive is found by its set alone
    archived = own.select(F.col("own_id").alias("archived_id")).distinct()
    same = [*[current[c] == found[c] for c in SET], archived["archived_id"].eqNullSafe(found["own_id"])]
    answered = (current.join(shuffled(archived), current["opportunity_id"] == archived["archived_id"], "left")
                .join(shuffled(found), same, "left"))
    return answered.select(*[current[c] for c in bids.columns if c not in ("prior_cycles", "last_cycle_closed")],
                           F.coalesce(found["prior"], F.lit(0)).alias("prior_cycles"), found["closed"].cast("date").alias("last_cycle_closed"))


def without_similar(df: DataFrame, others: DataFrame) -> DataFrame:
    """Rows of `df` for which no record of `others` at the same agency is similar."""
    left, right = with_tokens(df), with_tokens(others)
    hits = folded(_distinct_sets(left), _distinct_sets(right), [])
    return left.join(shuffled(hits), SET, "left_anti").select(*df.columns)
