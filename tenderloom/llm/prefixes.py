"""The prefix tree of rebuilt conversations, from fingerprints that compose.

A conversation is rebuilt from the first turns of a base conversation and its
own turns after as many of its own; no rebuilt text is ever put together. A
sequence of turns has the fingerprint (length n, S) with S the sum of
turn_i * B^i modulo a prime, in four lanes of 31 bits. Fingerprints form a
monoid, (n, S) (m, T) = (n + m, S + B^n T), and B has an inverse, so the
fingerprint of a rebuilt prefix follows from three stored products: the base's
at the end of its head, and the conversation's own at the end of what is left
out and at the turn::

    S_base[head] + (S_own[k] - S_own[h]) * B^(head - h)

Products of prefixes are made by a scan over range partitions: a partition's
running products start at one, and a table of one row a partition carries the
product of a conversation that began before it. So no conversation is held in
one task, however long.

Prefixes of equal depth and fingerprint are one node. A node stores for each
member where its last turn lies (conversation, position). Where these differ,
the texts are fetched by the references and compared; one that differs raises
`FingerprintClash`. As a fingerprint less its last turn is its parent's, equal
last turns make equal sequences.

The nodes whose least member is one conversation form a chain down its path, and
each chain hangs from a node of another. Sums over subtrees are sums over chains
by pointer doubling, then running sums within a chain.

Nulls and edges: a null role or text is empty, turns go by number, nulls first,
rows of one turn in the order of a 128-bit hash of role and text, repeated rows
are repeated turns. Rows with a null conv_id belong to no conversation. A base
that is absent, null or shorter gives what it has. Extra columns are ignored
whatever their names, an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as c

PRIME, LANES = (1 << 31) - 1, 4
#: Fixed bases, one a lane.
BASES = (1_103_515_245, 1_664_525_719, 1_812_433_253, 1_950_351_217)
#: Turns that a head may have.
MOST_HEAD = 64
#: Rows of one conversation that meet in one task of a join, and depths of a chain in one task of a running sum.
SLICE = 1 << 14
#: Ids of an end list are joined within blocks of so many values, then block after block.
BLOCK_BITS = 12
NO_ENDS = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "ka", "kb"]


class FingerprintClash(ValueError):
    """Turns of different text with one fingerprint."""


# ---------------------------------------------------------------- products of prefixes

def hashes(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and a 128-bit hash (a, b) of role and text."""
    tidy = rows.select("conv_id", "turn", c.or_empty("role").alias("role"), c.or_empty("text").alias("text")).where("conv_id IS NOT NULL")
    return tidy.select("*", F.xxhash64("role", "text").alias("a"), F.xxhash64("text", F.lit(1), "role").alias("b"))


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, ... base^(n - 1) modulo the prime."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
    return out[:n]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running products of each conversation within the partition: s after the turn, q before it."""
    from pyspark import TaskContext

    part, p = TaskContext.get().partitionId(), np.uint64(PRIME)
    last, last_pos, last_s = None, 0, [0] * LANES
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
        new = np.append(True, conv[1:] != conv[:-1])
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        goes_on = conv[0] == last
        pos0 = last_pos if goes_on else 0
        j = np.arange(n) - starts[group] + 1
        first = group == 0
        pos = j + np.where(first, pos0, 0)
        columns = [pa.array(np.full(n, part, np.int32)), batch.column("conv_id"), batch.column("turn"), batch.column("a"), batch.column("b"), batch.column("chars"), pa.array(pos)]
        before = []
        words = [batch.column(x).to_numpy(zero_copy_only=False).view(np.uint64) for x in ("a", "b")]
        for lane in range(LANES):
            code = (words[lane // 2] >> np.uint64(32 * (lane % 2)) & np.uint64(0xFFFFFFFF)) % p
            power = _powers(BASES[lane], n + 1)[j]
            power = np.where(first, power * np.uint64(pow(BASES[lane], pos0, PRIME)) % p, power)
            term = code * power % p
            run = np.cumsum(term)
            s = (run - (run[starts] - term[starts])[group] + np.where(first, np.uint64(last_s[lane] if goes_on else 0), np.uint64(0))) % p
            columns.append(pa.array(s.astype(np.int32)))
            before.append(pa.array(((s + p - term) % p).astype(np.int32)))
            last_s[lane] = int(s[-1])
        last, last_pos = conv[-1], int(pos[-1])
        yield pa.record_batch([*columns, *before], ["part", "conv_id", "turn", "a", "b", "chars", "pos", *_lanes("s"), *_lanes("q")])


def _lanes(name: str) -> list[str]:
    return [f"{name}{i}" for i in range(LANES)]


def products(rows: DataFrame) -> DataFrame:
    """conv_id, turn, a, b, chars, pos (from 1), and the lanes of its prefix's product: s after the turn, q before it."""
    order = ["conv_id", "turn", "a", "b"]
    narrow = hashes(rows).select(*order, F.length("text").cast("long").alias("chars"))
    dealt = narrow.repartitionByRange(c.width(rows.sparkSession), *order).sortWithinPartitions(*order)
    lanes = ", ".join(f"{x} int" for x in [*_lanes("s"), *_lanes("q")])
    local = c.written(dealt.mapInArrow(c.task(_scan), f"part int, conv_id long, turn long, a long, b long, chars long, pos long, {lanes}"), "prefix-products")
    borders = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "pos", *_lanes("s"))).alias("last")).collect()  # one row a partition
    carry, fixes = (None, 0, [0] * LANES), []
    for row in sorted(borders, key=lambda r: r["part"]):
        conv, pos, s = row["last"][0], row["last"][1], list(row["last"][2:])
        if row["first"] == carry[0]:
            shift = [pow(b, carry[1], PRIME) for b in BASES]
            fixes.append((row["part"], carry[0], carry[1], *carry[2], *shift))
            if conv == carry[0]:
                pos, s = pos + carry[1], [(x + m * y) % PRIME for x, m, y in zip(carry[2], shift, s, strict=True)]
        carry = (conv, pos, s)
    plain = ["conv_id", "turn", "a", "b", "chars"]
    if not fixes:
        return local.select(*plain, "pos", *[F.col(x).cast("long").alias(x) for x in [*_lanes("s"), *_lanes("q")]])
    kinds = ", ".join(f"{x} long" for x in [*_lanes("f"), *_lanes("m")])
    fix = rows.sparkSession.createDataFrame(fixes, f"part int, conv_id long, ahead long, {kinds}")
    # at most one row a partition
    met = local.join(F.broadcast(fix), ["part", "conv_id"], "left")

    def moved(x: str, i: int) -> Column:
        lane = F.col(f"{x}{i}").cast("long")
        return F.coalesce((F.col(f"f{i}") + F.col(f"m{i}") * lane) % PRIME, lane).alias(f"{x}{i}")

    return met.select(*plain, (F.col("pos") + F.coalesce("ahead", F.lit(0))).alias("pos"), *[moved(x, i) for x in "sq" for i in range(LANES)])


# ---------------------------------------------------------------- members of nodes

def _pair(lanes: list[Column]) -> list[Column]:
    return [lanes[0] * (1 << 31) + lanes[1], lanes[2] * (1 << 31) + lanes[3]]


def members(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """A row for each prefix of each rebuilt conversation: its key (depth, ka, kb), the parent's (pa, pb), conv_id,
    total (turns of the rebuilt conversation), and the last turn's chars, src and pos (where it lies)."""
    longest = plan.agg(F.coalesce(F.max("head"), F.lit(0))).first()[0]
    if longest > MOST_HEAD:
        raise ValueError(f"a head of {longest} turns; {MOST_HEAD} at most")
    turn = F.struct("pos", *_lanes("s"), *_lanes("q"), "chars")
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), F.sort_array(F.collect_list(F.when(F.col("pos") <= longest, turn))).alias("firsts"))
    sizes = c.written(sizes, "conversation-heads")
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("firsts").alias("base_firsts"))
    known = plan.where("conv_id IS NOT NULL").select("conv_id", "base", F.col("head").cast("long").alias("h"))
    both = known.join(sizes, "conv_id").join(base, "base", "left")
    both = both.withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    both = both.withColumn("total", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))

    def after(array: str, k: str, i: int) -> Column:
        return F.coalesce(F.get(array, F.col(k).cast("int") - 1)[f"s{i}"], F.lit(0))

    def factor(i: int) -> Column:
        inverse = pow(BASES[i], -1, PRIME)
        return F.get(F.array(*[F.lit(pow(inverse, k, PRIME)).cast("long") for k in range(MOST_HEAD + 1)]), (F.col("h") - F.col("head")).cast("int"))

    both = both.select("conv_id", "base", "h", "head", "total", "n", "base_firsts", *[after("base_firsts", "head", i).alias(f"b{i}") for i in range(LANES)],
                       *[after("firsts", "h", i).alias(f"o{i}") for i in range(LANES)], *[factor(i).alias(f"x{i}") for i in range(LANES)])
    both = c.written(both, "rebuilt-conversations")
    names = [*KEY, "pa", "pb", "conv_id", "total", "chars", "src", "pos"]
    zero = F.lit(0).cast("long")
    root = both.select(*[zero.alias(x) for x in [*KEY, "pa", "pb"]], "conv_id", "total", zero.alias("chars"), F.lit(None).cast("long").alias("src"), zero.alias("pos"))
    heads = both.where("head > 0").select("conv_id", "total", "base", F.explode(F.slice("base_firsts", F.lit(1), F.col("head").cast("int"))).alias("t"))
    heads = heads.select(F.col("t.pos").alias("depth"), *_named(_pair([F.col(f"t.s{i}") for i in range(LANES)]), ["ka", "kb"]),
                         *_named(_pair([F.col(f"t.q{i}") for i in range(LANES)]), ["pa", "pb"]), "conv_id", "total", "t.chars", F.col("base").alias("src"), "t.pos")
    # the rows of a long conversation meet their plan in slices
    slices = both.where("n > h").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / SLICE))).alias("slice")).drop("base_firsts", "n", "base")
    own = turns.withColumn("slice", F.floor(F.col("pos") / SLICE)).join(slices, ["conv_id", "slice"]).where("pos > h")

    def rebuilt(x: str) -> list[Column]:
        return _pair([(F.col(f"b{i}") + (F.col(f"{x}{i}") - F.col(f"o{i}") + PRIME) % PRIME * F.col(f"x{i}")) % PRIME for i in range(LANES)])

    own = own.select((F.col("pos") - F.col("h") + F.col("head")).alias("depth"), *_named(rebuilt("s"), ["ka", "kb"]), *_named(rebuilt("q"), ["pa", "pb"]),
                     "conv_id", "total", "chars", F.col("conv_id").alias("src"), "pos")
    return c.written(root.select(names).unionByName(heads.select(names)).unionByName(own.select(names)), "prefix-members")


def _named(columns: list[Column], names: list[str]) -> list[Column]:
    return [x.alias(n) for x, n in zip(columns, names, strict=True)]


def nodes_of(found: DataFrame) -> DataFrame:
    """One row a node: rep (least member), n_convs, goes_on (rep has a further turn), parent key, and the bounds of its references."""
    ends = F.min(F.when(F.col("depth") == F.col("total"), F.col("conv_id")))
    each = found.groupBy(*KEY).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
                                   F.min("src").alias("src0"), F.max("src").alias("src1"), F.min("pos").alias("pos0"), F.max("pos").alias("pos1"), ends.alias("ends"))
    goes_on = F.coalesce(F.col("ends") != F.col("rep"), F.lit(True))
    return c.written(each.select(*KEY, "rep", "n_convs", "chars", "pa", "pb", goes_on.alias("goes_on"), ((F.col("src0") != F.col("src1")) | (F.col("pos0") != F.col("pos1"))).alias("mixed")), "prefix-nodes")


def verify(rows: DataFrame, turns: DataFrame, found: DataFrame, nodes: DataFrame) -> None:
    """Compare the texts that a node's references name, where they name more than one place."""
    mixed = nodes.where("mixed").select(*KEY, F.col("n_convs").alias("rows"))
    if mixed.isEmpty():
        return
    told = c.looked_up(found.where("depth > 0").select(*KEY, "src", "pos"), mixed, KEY, "rows").where("rows IS NOT NULL")
    told = c.written(told.select(*KEY, "src", "pos").distinct(), "turn-references")
    placed = told.join(turns.select(F.col("conv_id").alias("src"), "pos", "turn", "a", "b"), ["src", "pos"])
    texts = hashes(rows)
    met = placed.join(texts, (texts.conv_id == placed.src) & texts.turn.eqNullSafe(placed.turn) & (texts.a == placed.a) & (texts.b == placed.b))
    differ = met.groupBy(*KEY).agg(*[f(x).alias(f"{f.__name__}_{x}") for f in (F.min, F.max) for x in ("role", "text")])
    bad = differ.where("min_role <> max_role OR min_text <> max_text").limit(1).collect()
    if bad:
        raise FingerprintClash(f"different turns share a fingerprint at depth {bad[0]['depth']}")


# ---------------------------------------------------------------- the tree

def end_digests(found: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node, ascending and joined by commas: blocks in columns, then one digest over a node's blocks."""
    ends = found.where("depth = total").select(*KEY, "conv_id", F.shiftright("conv_id", BLOCK_BITS).alias("block"))
    block = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = ends.groupBy(*KEY, "block").agg(block.alias("ids"))
    dealt = blocks.repartition(c.width(found.sparkSession), *KEY).sortWithinPartitions(*KEY, "block")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, run, out = None, None, []

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[i] for x in out], pa.int64() if i < 3 else pa.string()) for i in range(4)], [*KEY, "ends_sha256"])

        for batch in batches:
            for *here, _, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if here != key:
                    if key is not None:
                        out.append((*key, run.hexdigest()))
                    key, run = here, hashlib.sha256(ids.encode())
                else:
                    run.update(b"," + ids.encode())
            if len(out) >= 10_000:
                yield done()
                out = []
        if key is not None:
            out.append((*key, run.hexdigest()))
        yield done()

    return dealt.mapInArrow(c.task(digest), "depth long, ka long, kb long, ends_sha256 string")


def _chain_sums(chains: DataFrame) -> DataFrame:
    """rep, leaves, saved summed over a chain and all chains that hang from it: after round k over those up to 2^k links below."""
    now = c.written(chains.select("rep", F.col("up").alias("jump"), "leaves", "saved"), "chains")
    while not now.where("jump IS NOT NULL").isEmpty():
        below = now.where("jump IS NOT NULL").groupBy("jump").agg(F.count("*").alias("rows"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        below = c.written(below.withColumnRenamed("jump", "to"), "chain-sums")
        onward = below.select("to", "rows").join(now.select(F.col("rep").alias("to"), F.col("jump").alias("next")), "to").withColumnRenamed("to", "jump")
        summed = now.join(below.select(F.col("to").alias("rep"), "more_leaves", "more_saved"), "rep", "left")
        summed = summed.select("rep", "jump", *[(F.col(x) + F.coalesce(f"more_{x}", F.lit(0))).alias(x) for x in ("leaves", "saved")])
        ended = summed.where("jump IS NULL")
        moved = c.looked_up(summed.where("jump IS NOT NULL"), onward, ["jump"], "rows").select("rep", F.col("next").alias("jump"), "leaves", "saved")
        now = c.written(moved.unionByName(ended), "chains")
    return now.select("rep", "leaves", "saved")


def trie(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The nodes of all conversations of (conv_id, turn, role, text), rebuilt by `plan` (conv_id, base, head): the first
    `head` turns of `base`, then the conversation's own turns after its first `head`.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the subtree, each
    node's members but one times the code points of its last text), ends_sha256.
    """
    turns = products(rows)
    found = members(turns, plan)
    nodes = nodes_of(found)
    verify(rows, turns, found, nodes)

    chains = nodes.groupBy("rep").agg(F.min("depth").alias("top"), F.max("depth").alias("end"), F.min_by("pa", "depth").alias("ka"), F.min_by("pb", "depth").alias("kb"),
                                      F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    chains = c.written(chains.withColumn("depth", F.col("top") - 1), "chain-tops")
    hung = chains.where("depth >= 0").groupBy(*KEY).agg(F.count("*").alias("rows")).join(nodes.select(*KEY, F.col("rep").alias("up")), KEY)
    above = c.looked_up(chains.where("depth >= 0"), hung, KEY, "rows").select("rep", "depth", "end", "saved", "up")
    above = above.unionByName(chains.where("depth < 0").select("rep", "depth", "end", "saved", F.lit(None).cast("long").alias("up")))
    places = hung.select(F.col("up").alias("rep"), F.col("depth").alias("end"), F.lit(1).alias("not_leaf"))
    above = c.written(above.join(places, ["rep", "end"], "left").withColumn("leaves", F.when(F.col("not_leaf").isNull(), 1).otherwise(0).cast("long")), "chains-up")
    sums = _chain_sums(above)

    # what hangs from a node, and the node above a chain's top
    nothing = F.lit(0).cast("long")
    from_below = above.where("up IS NOT NULL").select("rep", "up", "depth").join(sums, "rep").groupBy(F.col("up").alias("rep"), "depth").agg(
        F.count("*").alias("hung"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    tops = above.where("up IS NOT NULL").select("rep", (F.col("depth") + 1).alias("depth"), nothing.alias("hung"), nothing.alias("leaves"), nothing.alias("saved"), "up")
    marks = from_below.withColumn("up", F.lit(None).cast("long")).unionByName(tops).groupBy("rep", "depth").agg(*[F.sum(x).alias(x) for x in ("hung", "leaves", "saved")], F.max("up").alias("up"))

    ended = nodes.join(end_digests(found), KEY, "left").join(marks, ["rep", "depth"], "left")
    hung_here, goes_on = F.coalesce("hung", nothing), F.col("goes_on").cast("long")
    each = ended.select("rep", "depth", "n_convs", "up", (hung_here + goes_on).alias("n_children"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
                        (F.coalesce("leaves", nothing) + F.when((hung_here == 0) & ~F.col("goes_on"), 1).otherwise(0)).alias("leaves"),
                        (F.coalesce("saved", nothing) + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.floor(F.col("depth") / SLICE).alias("slice"))
    each = c.written(each, "node-sums")
    later = W.partitionBy("rep").orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, -1)
    beyond = each.groupBy("rep", "slice").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")).select(
        "rep", "slice", F.coalesce(F.sum("l").over(later), nothing).alias("l"), F.coalesce(F.sum("s").over(later), nothing).alias("s"))
    here = W.partitionBy("rep", "slice").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    summed = each.join(beyond, ["rep", "slice"]).select("*", (F.sum("leaves").over(here) + F.col("l")).alias("n_leaves"), (F.sum("saved").over(here) + F.col("s")).alias("saved_tokens"))
    parent = F.when(F.col("depth") > 0, F.coalesce("up", "rep"))
    return summed.select(F.col("rep").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def head_plan(rows: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """conv_id, base and head: the first conversation of its hundred, and a length that hangs on the id's crc32."""
    ids = rows.where("conv_id IS NOT NULL").select("conv_id").distinct()
    return ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("head"))
