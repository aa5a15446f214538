"""Mixing sources to target weights by capped water-filling. Column functions only.

Targets: every source gets its weight's share of the total, clamped at `epochs`
times its size; the excess is shared out again by weight until nothing is
above its clamp. Repetitions: a source at rate r repeats each document
floor(r) whole times; the rest of its target is filled in a seeded order with
one more whole repetition each, and the document at the edge with the part of
its words that is still missing. A source's words thus meet its target to the
rounding of one word, and a rerun gives the same rows.

Nulls and edges: null text has no words, a null source is one source and comes
last, sources of no words get a target of zero, equal rows share the order's
ties and are counted one after the other. Extra columns pass through
`mixture`; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, or_empty, running_totals, width, written

WEIGHTS, EPOCHS, SEED = (5.0, 2.0, 1.0), 3.0, "mix-1"


def sources(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, n_docs, source_size, weight): weights repeat over the sources by code point, null last."""
    per = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    # a rank without a single sorting task: range slices, a rank in each, and the rows of the slices before
    cut = written(per.repartitionByRange(width(per.sparkSession), F.col("source").isNull(), F.col("source"))
                  .withColumn("_slice", F.spark_partition_id()), "mix-sources")
    ahead = (cut.groupBy("_slice").agg(F.count("*").alias("_rows"))
             .select(F.col("_slice").alias("_at"), F.coalesce(F.sum("_rows").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead")))
    ranked = (cut.withColumn("_rank", F.row_number().over(W.partitionBy("_slice").orderBy(F.col("source").asc_nulls_last())))
              .join(ahead, F.col("_slice") == F.col("_at")))
    place = F.pmod(F.col("_ahead") + F.col("_rank") - 1, F.lit(len(weights))).cast("int")
    return ranked.select("source", "n_docs", "source_size", F.array(*[F.lit(w) for w in weights])[place].alias("weight"))


def targets(per_source: DataFrame, epochs: float = EPOCHS) -> DataFrame:
    """`per_source` with `target`: weights' shares of all sizes, clamped at `epochs` times each size.

    Each round clamps every source above its limit at the present level and
    shares the rest among the others; only two sums per round reach the driver.
    """
    table = written(per_source.withColumn("_cap", F.col("source_size") * F.lit(epochs)), "mix-weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        over = F.col("_cap") <= F.col("weight") * F.lit(level)
        s = table.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("_cap"))), F.lit(0.0)).alias("held"),
                      F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("open")).first()
        if s["n"] == clamped or not s["open"]:
            break
        clamped, level = s["n"], (total - s["held"]) / s["open"]
    return table.withColumn("target", F.least(F.col("_cap"), F.col("weight") * F.lit(level))).drop("_cap")


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """`docs` (doc_id, text, source) with size, source_size, target and taken; the text itself is left out."""
    t = or_empty("text")
    # the order: a digest of seed, id and text, so that rows with the same id stay apart
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.md5(t)))
    sized = written(docs.select("doc_id", "source", F.regexp_count(t, F.lit(WORD)).cast("long").alias("size"), order.alias("_order")), "mix-sizes")
    goal = targets(sources(sized, weights), epochs)
    goal = written(goal, "mix-targets").withColumnRenamed("source", "_source")
    joined = sized.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight")
    ordered = running_totals(joined, ["source"], ["_order", "doc_id"], "size", "n_docs", "mix-order")
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    extra = F.round(F.col("target") - rate * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), extra - F.col("before")))
    return ordered.select("doc_id", "source", "size", "source_size", "target", (rate * F.col("size") + part).cast("long").alias("taken"), "_order")


def repeated(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """`docs` itself with each row as often as the mix takes it; the document at a source's edge counts if half of it is taken.

    A document without words is taken once where its source is taken at all.
    Other columns go along whatever their names.
    """
    t = or_empty("text")
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.md5(t)))
    times = mixture(docs, weights, epochs, seed).groupBy(F.col("_order").alias("_o")).agg(
        F.max(F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise((F.col("target") > 0).cast("int")).cast("int")).alias("_times"))
    # the caller's row stands in a struct of its own, so that no name of its meets one of ours
    held = docs.select(order.alias("_k"), F.struct(*docs.columns).alias("_row")).join(times, F.col("_k") == F.col("_o")).where("_times > 0")
    copies = held.select("_row", F.explode(F.sequence(F.lit(1), "_times")).alias("_n"))
    return copies.select(*[F.col("_row")[n].alias(n) for n in docs.columns])
