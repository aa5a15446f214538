"""Repeated passages against a table of all strings of the least length."""

import hashlib
import random
from collections import Counter

import numpy as np

from tenderloom.llm import common, repeats


def brute(rows, least):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if seen[t[i:i + least]] > 1:
                gone[i:i + least] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 8)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(rng.choice([60, 90, 120, 300])) for _ in range(6)]
    rows = [None, "", "short", "a" * 399, "a" * 400, "a" * 401, "ab" * 900, "x" * 2500]
    for _ in range(n):
        text = prose(rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            text += p[a: a + rng.choice([200, 395, 420, 700, 5000])] + prose(rng.randint(0, 30))
        rows.append(text)
    for _ in range(12):  # near copies of one text
        base = list(passages[0] + passages[1])
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = "Z"
        rows.append("".join(base))
    rows += [rows[20]] * 3 + [rows[21]] * 2
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def ours(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, n int, key string").repartition(3)
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removals(df).collect())


def test_equals_all_strings(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert ours(spark, rows) == brute(rows, repeats.LEAST)


def test_blocks_of_large_shards(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 4)
    rows = corpus(3, 40)
    assert ours(spark, rows) == brute(rows, repeats.LEAST)


def test_empty_table_and_repeated_ids(spark):
    assert ours(spark, []) == []
    text = "".join(random.Random(5).choice("abcdefgh ") for _ in range(900))
    rows = [(1, text), (1, text), (2, "q" + text[:450]), (2, "nothing")]
    assert ours(spark, rows) == brute(rows, repeats.LEAST)


def test_steps_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(common, "STEP_BYTES", 1000)
    rows = corpus(4, 30)
    assert ours(spark, rows) == brute(rows, repeats.LEAST)


def test_maximal_repeats_have_all_occurrences():
    rng = random.Random(9)
    for _ in range(30):
        befores = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 14))]
        afters = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 6))) for _ in befores]
        pairs = list(dict.fromkeys(zip(befores, afters, strict=True)))
        want = set()
        for i, (a, b) in enumerate(pairs):
            for x, y in pairs[:i]:
                l = next((k for k in range(min(len(a), len(x))) if a[-1 - k] != x[-1 - k]), min(len(a), len(x)))
                r = next((k for k in range(min(len(b), len(y))) if b[k] != y[k]), min(len(b), len(y)))
                if r and l + r >= 4:
                    want.add((l, r, frozenset(j for j, (p, q) in enumerate(pairs) if p.endswith(a[len(a) - l:]) and q.startswith(b[:r]))))
        got = [(l, r, frozenset(m.tolist())) for l, r, m in repeats.maximal_repeats([p for p, _ in pairs], [q for _, q in pairs], 4)]
        assert len(got) == len(set(got)) and set(got) == want
