import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tenderloom.llm import common, prefixes

SCHEMA = "conv_id long, turn long, role string, text string"


def order(row):
    return (row[1] is not None, row[1] or 0)


def conversations(rows):
    out = {}
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def brute(rows, plan):
    """Every node by whole sequences; plan maps conv_id to (base, head)."""
    own = conversations(rows)
    built = {}
    for conv, turns in own.items():
        base, h = plan(conv)
        built[conv] = own.get(base, [])[:h] + turns[h:]
    members, ends = {}, {}
    for conv, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(conv)
        ends.setdefault(tuple(seq), []).append(conv)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids.get(p, []))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


def crc_plan(conv):
    return conv - (abs(conv) % 100 * (1 if conv >= 0 else -1)), zlib.crc32(str(conv).encode()) % 6


def got(tree):
    return sorted(map(tuple, tree.collect()))


def random_rows(rng, ids, longest=7, words=3):
    return [(c, t, rng.choice(["user", "assistant"]), f"turn {rng.randrange(words)} ü") for c in ids for t in range(rng.randrange(1, longest))]


def test_whole_job_equals_brute_force(spark):
    rng = random.Random(3)
    rows = random_rows(rng, [*range(0, 120), *range(205, 230), *range(-130, -95), 10**15, 10**15 + 1])
    rows += [(1000, t, "user", f"only {t}") for t in range(3)] + [(1001, 0, None, None), (1002, 0, "", ""), (1003, None, "user", "first"), (1003, 0, "user", "second")]
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None), (1100, 0, "user", "x" * 200_000), (1101, 0, "user", "x" * 200_000)]
    rows += [(1200, 0, "user", "again")] * 3  # repeated rows are repeated turns
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, SCHEMA)
    assert got(prefixes.trie(table, prefixes.head_plan(table))) == brute(rows, crc_plan)


def plain_plan(table):
    return table.select("conv_id").distinct().select("conv_id", F.lit(None).cast("long").alias("base"), F.lit(0).alias("head"))


def test_deep_chains_of_conversations(spark):
    # each shares one turn more with the one before: chains hang from chains, 24 links down
    rows = [(k, t, "user", f"shared {t}" if t < k else f"own {k} {t}") for k in range(24) for t in range(k + 2)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert got(prefixes.trie(table, plain_plan(table))) == brute(rows, lambda c: (None, 0))
    rows = [(k, t, "user", f"a{t}" if t <= 24 - k else f"own {k} {t}") for k in range(24) for t in range(30 - k)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert got(prefixes.trie(table, plain_plan(table))) == brute(rows, lambda c: (None, 0))


def test_a_long_conversation_spans_partitions(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "SLICE", 64)
    monkeypatch.setattr(prefixes, "BLOCK_BITS", 3)
    monkeypatch.setattr(common, "HEAVY", 4)
    rows = [(7, t, "user", f"w{t % 5}") for t in range(3000)] + [(8, t, "user", f"w{t % 5}") for t in range(2500)]
    rows += [(c, t, "user", f"w{t}") for c in range(100, 160) for t in range(2)] + [(100, t, "assistant", "later") for t in range(2, 9)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    plan = {**{c: (100, 3) for c in range(100, 160)}, 7: (8, 2), 8: (100, 64)}
    asked = spark.createDataFrame([(c, *v) for c, v in plan.items()], "conv_id long, base long, head int")
    assert got(prefixes.trie(table, asked)) == brute(rows, plan.get)


def test_empty_table_clashing_names_and_heads(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefixes.trie(empty, prefixes.head_plan(empty)).collect() == []
    extra = ", ".join(f"{x} string" for x in ("a", "b", "pos", "s0", "rep", "depth", "total", "chars", "src", "base", "head"))
    rows = [(c, t, "user", f"x{t}", *"abcdefghijk") for c in (1, 2) for t in range(3)]
    table = spark.createDataFrame(rows, f"{SCHEMA}, {extra}")
    assert got(prefixes.trie(table, prefixes.head_plan(table))) == brute([r[:4] for r in rows], crc_plan)
    with pytest.raises(ValueError, match="head of 65"):
        prefixes.trie(table, spark.createDataFrame([(1, 2, 65)], "conv_id long, base long, head int"))


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [(c, 0, "user", "hi") for c in (3, 5, 1)]
    table = spark.createDataFrame(rows, SCHEMA)
    plan = spark.createDataFrame([(c, 99, 4) for c in (1, 3, 5)], "conv_id long, base long, head int")
    none = hashlib.sha256(b"1,3,5").hexdigest()
    assert got(prefixes.trie(table, plan)) == [(1, 0, None, 3, 0, 1, 0, none)]


def test_different_texts_with_one_fingerprint_raise(spark, monkeypatch):
    rows = [(1, 0, "user", "one"), (2, 0, "user", "two"), (3, 0, "user", "one")]
    table = spark.createDataFrame(rows, SCHEMA)
    honest = prefixes.hashes
    monkeypatch.setattr(prefixes, "hashes", lambda t: honest(t).withColumn("a", F.lit(7).cast("long")).withColumn("b", F.lit(7).cast("long")))
    with pytest.raises(prefixes.FingerprintClash):
        prefixes.trie(table, plain_plan(table))


def test_fingerprints_compose(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in (1, 2) for t in range(4)]
    joined = [(3, t, "user", f"1 {t}") for t in range(2)] + [(3, t, "user", f"2 {t}") for t in range(2, 4)]
    table = spark.createDataFrame(rows + joined, SCHEMA)
    plan = spark.createDataFrame([(1, 1, 0), (2, 1, 2), (3, 3, 0)], "conv_id long, base long, head int")
    found = prefixes.members(prefixes.products(table), plan)
    keys = {(r.conv_id, r.depth): (r.ka, r.kb) for r in found.collect()}
    assert all(keys[2, d] == keys[3, d] for d in range(5)) and keys[1, 3] != keys[2, 3]
