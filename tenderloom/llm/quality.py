"""Quality rules with risk-controlled thresholds. Column functions only.

Each rule is a score per document and a ladder of cutoffs fixed beforehand; a
document whose score is above the cutoff is rejected. Per stratum (by default
the language) the labelled good documents say how many of them a cutoff would
reject. A cutoff holds if the exact binomial upper bound on its rate of false
rejections is at most the rule's share of `risk`, which the rules split evenly:
P(X <= k | n, share) <= delta / tests, which is the Clopper-Pearson bound put as
a test. A ladder is walked from its most
lenient cutoff and stops at the first that fails (fixed-sequence testing), so
a ladder counts once; Bonferroni is applied over strata times rules. With
probability 1 - delta no chosen cutoff in any stratum errs beyond its share, so
all rules together reject at most `risk` of any stratum's good documents.

Nulls and edges: null text counts as empty; a null language is a stratum of
its own; a null or twice labelled document takes its lowest label; a stratum
without enough labels rejects nothing by rule; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, let, or_empty, written

#: Share of a stratum's good documents that the rules may reject together, and the error over all strata and rules.
RISK, DELTA = 0.08, 0.05
#: Ladders from lenient to strict.
LADDERS = {
    "symbol_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeat_word_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "shout_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
}


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in the text, the first occurrence included."""
    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(ranked, lambda s: F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])))
        return let(F.coalesce(places(h), F.sort_array(F.transform(twice, lambda x: x["i"]))), lambda a: F.aggregate(a, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
                                             lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")))["n"])

    def places(h: Column) -> Column:
        """Places of windows whose hash occurs twice, in order. Sorts longs of 43 hash bits and 20 of the place;
        where those bits fail to tell two windows apart, or places need more, sorts whole pairs."""
        packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, 20).bitwiseOR(i.cast("long"))))
        at = lambda p: p.bitwiseAND(F.lit((1 << 20) - 1)).cast("int")
        mixed = lambda s: F.exists(F.transform(s, lambda x, j: F.coalesce(
            (F.shiftright(x, 20) == F.shiftright(F.get(s, j - 1), 20)) & (F.get(h, at(x)) != F.get(h, at(F.get(s, j - 1)))), F.lit(False))), lambda x: x)
        twin = lambda s: F.transform(F.filter(s, lambda x, j: F.coalesce(F.shiftright(x, 20) == F.shiftright(F.get(s, j - 1), 20), F.lit(False))
                                                | F.coalesce(F.shiftright(x, 20) == F.shiftright(F.get(s, j + 1), 20), F.lit(False))), at)
        return F.when(F.size(h) < (1 << 20), let(packed, lambda s: F.when(mixed(s), None).otherwise(F.sort_array(twin(s)))))

    def of(w: Column) -> Column:
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(
            let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))))

    return of(words)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without its text, with the base counts and the rule scores; every count covers the whole text."""
    t = or_empty(text)
    words = let(F.split(t, SPACE + "+"), lambda w: F.filter(w, lambda x: x != ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \t-\r]"))
    measured = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    counts = {"_m", "_l", "n_symbols", "_shouts"}
    base = docs.select(*[c for c in docs.columns if c not in {*counts, text}], measured.alias("_m"), by_line.alias("_l"),
                       F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                       F.regexp_count(t, F.lit("[!?]")).cast("long").alias("_shouts"))
    kept = [c for c in base.columns if c not in counts and c not in ("n_words", "word_chars", "n_dup_lines", "n_repeat_words", *LADDERS)]
    least = F.greatest(F.col("_m.n_words"), F.lit(1))
    return base.select(
        *kept, "_m.n_words", "_m.word_chars", "n_symbols", "_l.n_dup_lines", "_m.n_repeat_words",
        (F.col("n_symbols") / F.greatest(F.col("_m.word_chars"), F.lit(1))).alias("symbol_share"),
        (F.col("_l.n_dup_lines") / F.greatest(F.col("_l.n_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("_m.n_repeat_words") / least).alias("repeat_word_share"),
        (F.col("_shouts") / least).alias("shout_share"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed from the log of each term."""
    ratio = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.lit(0.0).alias("s"))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, lambda a, i: F.struct(
        (a["t"] + F.log((n - i) / (i + 1.0)) + ratio).alias("t"), (a["s"] + F.exp(a["t"])).alias("s")))["s"]
    return F.when(k >= n, F.lit(1.0)).otherwise(total)


def thresholds(scored: DataFrame, labels: DataFrame, stratum: str = "lang", ladders: dict[str, tuple[float, ...]] = LADDERS,
               risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_rejected): the strictest certified cutoff of each rule; rules without one are absent."""
    good = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("_q"))
            .where("_q = 1").select("doc_id"))
    held = scored.drop("row").where(~base_failed()).join(good, "doc_id", "left_semi")
    ladder = [(rule, i, c) for rule, cuts in ladders.items() for i, c in enumerate(cuts)]
    counted = held.groupBy(F.col(stratum).alias("stratum")).agg(
        F.count("*").alias("n_good"), *[F.count_if(F.col(r) > c).alias(f"{r}:{i}") for r, i, c in ladder])
    steps = counted.select("stratum", "n_good", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"), F.col(f"`{r}:{i}`").alias("n_rejected"))
        for r, i, c in ladder])).alias("x")).select("stratum", "n_good", "x.*")
    tests = scored.agg((F.count_distinct(stratum) + F.max(F.col(stratum).isNull().cast("int"))).alias("_tests"))
    tried = steps.crossJoin(F.broadcast(tests))  # one row by construction
    n, k = F.col("n_good"), F.col("n_rejected")
    share = risk / len(ladders)
    sure = (k < n * F.lit(share)) & (binomial_cdf(k, n, share) <= F.lit(delta) / (F.col("_tests") * F.lit(len(ladders))))
    walk = W.partitionBy("stratum", "rule").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    passed = tried.withColumn("_ok", F.min(sure.cast("int")).over(walk)).where("_ok = 1")
    return passed.groupBy("stratum", "rule").agg(F.max_by(F.struct("cutoff", "n_good", "n_rejected"), "step").alias("x")).select("stratum", "rule", "x.*")


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", ladders: dict[str, tuple[float, ...]] = LADDERS,
           risk: float = RISK, delta: float = DELTA, with_rows: bool = False) -> DataFrame:
    """One row per document: the counts, base_failed, and kept (false if base_failed or above a certified cutoff).

    `with_rows` adds `row`, the whole row of `docs`.
    """
    row = [F.struct("*").alias("row")] if with_rows else []
    scored = written(features(docs.select("doc_id", F.col(stratum), F.col(text).alias("text"), *row)), "quality-features")
    cut = thresholds(scored, labels, stratum, ladders, risk, delta).groupBy("stratum").agg(
        *[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in ladders])
    cut = written(cut, "quality-cutoffs")  # one row per stratum; its measured size decides how it is joined
    both = scored.join(cut, scored[stratum].eqNullSafe(cut["stratum"]), "left")
    over = F.lit(False)
    for r in ladders:
        over = over | F.coalesce(F.col(r) > F.col(f"_{r}"), F.lit(False))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       base_failed().alias("base_failed"), (~base_failed() & ~over).alias("kept"), *(["row"] if with_rows else []))


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep."""
    return judged(docs, labels, with_rows=True).where("kept").select("row.*")
