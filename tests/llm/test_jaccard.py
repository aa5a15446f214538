"""The Jaccard join against all pairs on a small fixture."""

import random

import pytest

from tenderloom.llm import common, jaccard


def brute(rows):
    def shingles(text):
        w = (text or "").encode().split()
        w = [x for x in w]
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both and both / len(sets[i] | sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((rows[i][0], least[find(i)], links[i]) for i in range(len(rows)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    out = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 120, 300]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 45))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    out += [None, "", " \n\t", "one two", "one  two", "one two three", "a b c d e", "x " * 3000, "x " * 3000]
    rng.shuffle(out)
    return [(i * 3, t) for i, t in enumerate(out)]


def test_equals_all_pairs(spark, rows):
    df = spark.createDataFrame([(d, t, "en", 5) for d, t in rows], "doc_id long, text string, lang string, node int")
    assert sorted(map(tuple, jaccard.similar(df.repartition(3)).collect())) == brute(rows)


def test_blocks_of_large_buckets(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similar(df).collect())) == brute(rows)


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar(none).collect() == []
    twice = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (8, "a b  c d e f"), (9, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similar(twice).collect())) == [(7, 7, 2), (7, 7, 2), (8, 7, 2), (9, 9, 0)]


def test_posterior_bound_rises():
    fewest = jaccard.fewest_matches()
    assert len(fewest) == jaccard.HASHES // jaccard.STEP and fewest == sorted(fewest) and 0 < fewest[-1] < 0.8 * jaccard.HASHES


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    got = dict(map(tuple, common.components(edges).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
