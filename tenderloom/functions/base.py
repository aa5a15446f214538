"""Small column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: ColumnLike) -> Column:
    """True where a text value is missing or empty (the two mean the same upstream)."""
    c = col(c)
    return c.isNull() | (c == "")


def filled(c: ColumnLike) -> Column:
    return ~blank(c)


def filled_array(c: ColumnLike) -> Column:
    return F.coalesce(F.size(col(c)) > 0, F.lit(False))


def filled_number(c: ColumnLike) -> Column:
    return F.coalesce(col(c) != 0, F.lit(False))


def or_blank(c: ColumnLike) -> Column:
    return F.coalesce(col(c), F.lit(""))


def none_if_blank(c: ColumnLike) -> Column:
    return F.nullif(col(c), F.lit(""))


def first_filled(*cs: ColumnLike) -> Column:
    """The first non-blank text among the arguments."""
    return F.coalesce(*[none_if_blank(c) for c in cs])


def ladder(rules: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    """Ordered when/then rules; the first true one wins."""
    if not rules:
        return otherwise
    head, *rest = rules
    chain = F.when(head[0], head[1])
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def matches(c: ColumnLike, pattern: str) -> Column:
    """Case-insensitive search anywhere in the text; null text never matches."""
    return F.coalesce(col(c).rlike("(?i)" + pattern), F.lit(False))


def capture(c: ColumnLike, pattern: str, group: int = 1) -> Column:
    """One group of the first case-insensitive match, or null when there is none."""
    return none_if_blank(F.regexp_extract(col(c), "(?i)" + pattern, group))


def captures(c: ColumnLike, pattern: str, group: int = 0) -> Column:
    """One group of every case-insensitive match, in text order."""
    return F.regexp_extract_all(col(c), F.lit("(?i)" + pattern), F.lit(group))


def let(value: ColumnLike, body) -> Column:
    """`body(value)` with `value` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(col(value)), body), F.lit(0))


def labels_where(pairs: Sequence[tuple[str, Column]]) -> Column:
    """The labels whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(label)) for label, cond in pairs]))


def count_if(condition: Column) -> Column:
    """Rows where `condition` is true, never null."""
    return F.count(F.when(condition, F.lit(1)))


def sum_if(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("long")


def first_rows(df, keys: Sequence[ColumnLike], order: Sequence[Column], n: int = 1, keep_rank: str | None = None):
    """The first `n` rows of every key in the given order.

    Written as `row_number() <= n` so the engine filters to n rows per key
    before the shuffle, which keeps one hot key from landing whole in a task.
    """
    from pyspark.sql import Window

    rank = keep_rank or "__rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
    return out if keep_rank else out.drop(rank)


def numbered(df, order: Sequence[Column], place: str, by: Sequence[str] = ()):
    """`df` with `place`: 1, 2, ... in the given order, within each value of `by`.

    Rows are range-partitioned by the whole order, numbered inside each slice
    and moved on by the rows of the slices before, so neither one list nor one
    large group is sorted by a single task. The slices are a written table: a
    second reading cannot cut them elsewhere.
    """
    from pyspark.sql import Window

    from tenderloom.session import cut_lineage

    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut_lineage(df.repartitionByRange(slices, *by, *order).withColumn("__slice", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*by, "__slice").agg(F.count(F.lit(1)).alias("__rows")).select(
        *by, "__slice", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by, "__slice").orderBy(*order)
    offsets = offsets.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__slice").alias("__of"), "__before")
    same = [F.col("__slice") == F.col("__of"), *[F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]]  # a null is a group too
    return (cut.withColumn("__in", F.row_number().over(inside)).join(offsets, same).drop("__of", *[f"__by_{c}" for c in by])
            .withColumn(place, (F.col("__before") + F.col("__in")).cast("int")).drop("__slice", "__in", "__before"))


def with_scalars(df, one_row):
    """Add the columns of a one-row aggregate to every row."""
    return df.join(F.broadcast(one_row))


#: Rows up to which a small side is sent to every executor; larger ones are joined by a shuffle.
BROUGHT_ROWS = 100_000


def brought(df, most: int = BROUGHT_ROWS):
    """`df` with a broadcast hint if its counted rows are at most `most`; a list's size is unknown to the planner."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def shuffled(df):
    """`df` with a hint that keeps it from being broadcast: its rows grow with the input, and the planner may take it
    for small by the compressed size of a written table, or by the rows before an explode."""
    return df.hint("merge")


def lookup_map(mapping, key: Column) -> Column:
    """The value of `key` in a fixed dictionary, or null."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[key]
