"""The language model against the formulas over plain dictionaries."""

import math
import random
import zlib
from collections import Counter

import pytest

from tenderloom.llm import ngram


def tokens(text):
    return [w.lower() for w in (text or "").encode().split()] + ["</s>"]


def brute(rows):
    held = {d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0 for d, _ in rows}
    train = [tokens(t) for d, t in rows if not held[d]]
    uni, bi = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<s>", *t], t))
    n, v = sum(uni.values()), len(uni)
    ctx, cont, kinds = Counter(), Counter(w for _, w in bi), {}
    for (u, _), k in bi.items():
        ctx[u] += k
        kinds.setdefault(u, Counter())[min(k, 3)] += 1
    d2 = ngram.discounts([sum(k == i for k in bi.values()) for i in (1, 2, 3, 4)])
    d1 = ngram.discounts([sum(k == i for k in cont.values()) for i in (1, 2, 3, 4)])
    spare = sum(d1[min(k, 3) - 1] for k in cont.values()) / len(bi) if bi else 1.0

    def p1(w):
        k = cont.get(w, 0)
        return (max(k - (d1[min(k, 3) - 1] if k else 0), 0) / len(bi) if bi else 0) + spare / (v + 1)

    def p2(u, w):
        if u not in ctx:
            return p1(w)
        k = bi.get((u, w), 0)
        return max(k - (d2[min(k, 3) - 1] if k else 0), 0) / ctx[u] + sum(d2[i - 1] * m for i, m in kinds[u].items()) / ctx[u] * p1(w)

    assert not uni or math.isclose(sum(p2(next(iter(uni)), w) for w in [*uni, "unknown"]), 1)
    out = {}
    for i, (d, t) in enumerate(rows):
        ts = tokens(t)
        out[i] = (d, held[d], len(ts), sum(w in uni for w in ts), n, sum(math.log10((uni.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ts),
                  sum(math.log10(p2(u, w)) for u, w in zip(["<s>", *ts], ts)))
    return sorted(out.values(), key=str)


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=str), want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and g[6] == pytest.approx(w[6])


def fixture():
    rng = random.Random(2)
    words = [f"{rng.choice('aAbBé')}{int(rng.paretovariate(0.6)) % 90}" for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 200])))) for i in range(120)]
    return [*rows, (500, None), (501, ""), (502, " \n"), (503, "the " * 900), (503, "the " * 900), (None, "the end")]


SCHEMA = "doc_id long, text string, h string"


def test_equals_the_formulas(spark, monkeypatch):
    monkeypatch.setattr(ngram, "PART_TOKENS", 500)
    monkeypatch.setattr(ngram, "HOLD", 300)
    rows = fixture()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(3)
    same(ngram.cross_scored(df).collect(), brute(rows))


def test_nothing_to_learn_from(spark):
    rows = [(d, "a b") for d in range(60) if zlib.crc32(str(d).encode()) % 10 == 0]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    same(ngram.cross_scored(df).collect(), brute(rows))
    assert ngram.cross_scored(df.limit(0)).collect() == []


def brute_of(rows, order):
    """Interpolated modified Kneser-Ney of any order over plain dictionaries."""
    held = {d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0 for d, _ in rows}
    train = [tokens(t) for d, t in rows if not held[d]]
    uni = Counter(w for t in train for w in t)
    n, v = sum(uni.values()), len(uni)

    def grams(t):
        full = ["<s>"] * (order - 1) + t
        return [tuple(full[i: i + order]) for i in range(len(t))]

    counts = {order: Counter(g for t in train for g in grams(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: ngram.discounts([sum(x == i for x in m.values()) for i in (1, 2, 3, 4)]) for k, m in counts.items()}
    total, held_back = {}, {}
    for k, m in counts.items():
        for g, x in m.items():
            total[k, g[:-1]] = total.get((k, g[:-1]), 0) + x
            held_back[k, g[:-1]] = held_back.get((k, g[:-1]), 0) + d[k][min(x, 3) - 1]

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / (v + 1)
        if (k, g[:-1]) not in total:
            return lower
        x = counts[k].get(g, 0)
        return (max(x - (d[k][min(x, 3) - 1] if x else 0), 0) + held_back[k, g[:-1]] * lower) / total[k, g[:-1]]

    some = next(iter(counts[order]))
    assert math.isclose(sum(p((*some[:-1], w)) for w in [*uni, "unknown"]), 1)
    return sorted([(i, held[i], len(ts := tokens(t)), sum(w in uni for w in ts), n, sum(math.log10((uni.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ts),
             sum(math.log10(p(g)) for g in grams(ts))) for i, t in rows], key=str)


@pytest.mark.parametrize("order", [3, 4])
@pytest.mark.parametrize("part_tokens", [500, 2_000_000])
def test_longer_contexts_equal_the_formulas(spark, monkeypatch, order, part_tokens):
    monkeypatch.setattr(ngram, "PART_TOKENS", part_tokens)
    monkeypatch.setattr(ngram, "HOLD", 300)
    rows = fixture()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(3)
    same(ngram.cross_scored(df, order=order).collect(), brute_of(rows, order))


def test_the_query_learns_triples(spark, monkeypatch):
    from tenderloom.llm import queries

    rows = fixture()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    monkeypatch.setattr(queries, "table", lambda *_: df)
    same(queries.op4_kneser_ney(spark, "").collect(), brute_of(rows, 3))


def test_blocks_of_few_tokens_and_no_look_ups_of_grams(spark, monkeypatch):
    from tenderloom.llm import crossfit

    monkeypatch.setattr(ngram, "PART_TOKENS", 500)
    monkeypatch.setattr(crossfit, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(ngram, "_Files", None)  # a part is read once, whatever the number of texts
    rows = fixture()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(3)
    same(ngram.cross_scored(df, order=3).collect(), brute_of(rows, 3))


def test_a_part_is_answered_in_little_memory(monkeypatch):
    """Answers of a part equal plain counts; its peak is bounded by bytes a packed gram (147 before, 72 since)."""
    import tracemalloc

    import numpy as np

    from tenderloom.llm import common, crossfit

    rng, none = np.random.default_rng(0), np.zeros(0, np.uint32)
    monkeypatch.setattr(common.Sorted, "of", staticmethod(lambda *_: None))
    monkeypatch.setattr(crossfit, "often_of", lambda *_: none)
    asked = [crossfit.distinct(rng.integers(0, 400, (3, 40_000)).astype(np.uint32), np.arange(40_000) % 3, 1, none)[:2] for _ in range(8)]
    packs = [crossfit._packed(cols, n, np.zeros(len(n), np.int32), 3, i) for i, (cols, n) in enumerate(asked)]
    answers, emit = {}, crossfit._answered("", 400, 1, (), 3)
    tracemalloc.start()
    for batch in emit(iter(packs)):
        answers |= {r["block"]: r["pack"] for r in batch.to_pylist() if r["kind"] == 3}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * sum(len(n) for _, n in asked)
    count, total, once = Counter(), Counter(), Counter()
    for cols, n in asked:
        for g, x in zip(zip(*cols.tolist(), strict=True), n.tolist(), strict=True):
            count[g] += x
    for g, x in count.items():
        total[g[:-1]] += x
        once[g[:-1]] += x == 1
    for i, (cols, n) in enumerate(asked):
        got, grams = crossfit._grown(answers[i], len(n)), list(zip(*cols.tolist(), strict=True))
        assert got[0].tolist() == [count[g] for g in grams]
        assert got[1].tolist() == [total[g[:-1]] for g in grams]
        assert got[2].tolist() == [once[g[:-1]] for g in grams]
