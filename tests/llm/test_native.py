"""Quality rules, source mixing and chat formatting against plain Python, with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tenderloom.llm import chat, mixing, quality

# ---------------------------------------------------------------- quality


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + d for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def documents(rng):
    words = ["one", "two", "thrée", "#4", "a|b", "<x>", "ü!"]
    texts = [None, "", " \n\t\x0b\x0c\r ", "a b c", "a b c a b c", "a a a a", "x\n x\nx\n\n\nx", "z z z z " * 40, "q " * 3000]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))).replace("two one", "two\none") for _ in range(60)]
    texts += [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.choice([60, 80, 2000]))) for _ in range(20)]
    return [*enumerate(texts), (3, texts[12]), (3, texts[12])]


SCHEMA = "doc_id long, text string, lang string, n_words int, row string, stratum int"
LABELS = "doc_id long, quality int, toxic int, lang int"


def test_counts_of_whole_texts(spark):
    rows = documents(random.Random(1))
    df = spark.createDataFrame([(d, t, "en" if d % 3 else None, 7, "r", 1) for d, t in rows], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(5, 1, 0, 1), (5, 0, 0, 1), (None, 1, 0, 1)], LABELS)
    got = sorted(tuple(r)[:7] for r in quality.judged(df, labels).collect())
    assert got == sorted((d, *counts(t)) for d, t in rows)
    kept = quality.passing(df, labels)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(d for d, t in rows if not counts(t)[-1])


def test_colliding_short_hashes_fall_back(spark, monkeypatch):
    # places are packed beside 43 bits of the hash: without any of them, every pair of windows collides
    from pyspark.sql import functions as F
    monkeypatch.setattr(quality.F, "shiftright", lambda c, n: F.lit(0) * c)
    rows = documents(random.Random(2))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n) for r in df.select("doc_id", quality.features(df)["doc_id"].alias("x")).limit(0).collect())
    assert got == []
    found = quality.features(df).select("doc_id", "n_repeat_words").collect()
    assert sorted(map(tuple, found)) == sorted((d, counts(t)[4]) for d, t in rows)


def test_cutoffs_hold_their_bound(spark):
    rng = random.Random(3)
    prose = lambda: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(60))
    rows = [(i, prose() + " #" * (40 if i % 10 == 0 else 0), "en" if i < 900 else "xx", 0, "", 0) for i in range(920)]
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0, 0) for i in range(920)], LABELS)
    df = spark.createDataFrame(rows, SCHEMA)
    cut = quality.thresholds(quality.features(df.select("doc_id", "lang", "text")), labels).collect()
    tests = 2 * len(quality.LADDERS)
    for r in cut:
        tail = sum(math.comb(r.n_good, k) * 0.02 ** k * 0.98 ** (r.n_good - k) for k in range(r.n_rejected + 1))
        assert tail <= 0.05 / tests and r.stratum == "en"
    kept = {r.doc_id for r in quality.judged(df, labels).where("kept").collect()}
    assert kept == {i for i in range(920) if i % 10 or i >= 900}


def test_quality_of_nothing(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert quality.judged(docs, labels).collect() == [] and quality.passing(docs, labels).collect() == []


def test_binomial_sums(spark):
    from pyspark.sql import functions as F
    rows = [(k, n) for n in (1, 5, 300, 3000) for k in (0, 1, 4, 90) if k <= n]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", quality.binomial_cdf(F.col("k"), F.col("n"), 0.02).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(sum(math.comb(r.n, k) * 0.02 ** k * 0.98 ** (r.n - k) for k in range(r.k + 1)), rel=1e-9)


# ---------------------------------------------------------------- mixing

DOCS = "doc_id long, text string, source string, size int, taken string"


def goals(sizes):
    """Targets by sharing out again until no source is above three times its size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}
        if len(fixed) == len(sizes):
            return fixed


def test_mix_meets_its_targets(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))), rng.choice(["a", "a", "a", "b", "Z", "é", "", None]), 1, "t") for i in range(400)]
    rows += [(900, None, "only null", 1, "t"), (901, "", None, 1, "t"), (902, "same rows", "b", 1, "t"), (902, "same rows", "b", 1, "t"), (None, "no id", "a", 1, "t")]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mixture(df.repartition(4)).collect()
    sizes = defaultdict(int)
    for _, t, s, _, _ in rows:
        sizes[s] += len((t or "").split())
    want, taken = goals(dict(sizes)), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mixture(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    times = Counter(r.doc_id for r in mixing.repeated(df).collect())
    assert all(times[r.doc_id] == int(r.taken / r.size + 0.5) for r in got if r.size and r.doc_id not in (902, None))
    assert mixing.repeated(df).columns == df.columns


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert mixing.mixture(none).collect() == [] and mixing.repeated(none).collect() == []
    words = spark.createDataFrame([(1, None, "a", 0, ""), (2, "", None, 0, "")], DOCS)
    assert sorted((r.doc_id, r.target, r.taken) for r in mixing.mixture(words).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]


# ---------------------------------------------------------------- chat

TURNS = "conv_id long, turn long, role string, text string, output string, turns int"


def read_back(output):
    """An independent reader of the grammar."""
    out = []
    while output:
        assert output.startswith("<|im_start|>")
        role, _, rest = output[12:].partition("\n")
        body, _, output = rest.partition("<|im_end|>")
        assert output.startswith("\n") and "<|im_start|>" not in body
        output = output[1:]
        out.append((role.replace("%3C", "<").replace("%0A", "\n").replace("%25", "%"), re.sub(r"<\\(\\*)\|", r"<\1|", body)))
    return out


def test_round_trip_of_conflicting_texts(spark):
    rng = random.Random(6)
    pieces = ["<|im_end|>", "<|im_start|>", "assistant", "\n", "<", "|", "\\", "<\\|", "<|", "%0A", "%", "é", "ok", " ", "|>", "<|im_end|", "$1", ""]
    text = lambda k: "".join(rng.choice(pieces) for _ in range(rng.randint(0, k)))
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 4)):
            role = rng.choice(["user", "assistant", "system", text(3), None])
            rows.append((conv, rng.choice([turn, turn, 0]), role, rng.choice([text(9), "plain words", None])))
    rows += [(500, None, "user", "first"), (500, 0, "assistant", "x" * 200_000), (501, 1, "user", "twice"), (501, 1, "user", "twice"), (None, 0, "user", "no id")]
    df = spark.createDataFrame([(*r, "o", 1) for r in rows], TURNS).repartition(3)
    made = chat.formatted(df)
    got, digests = {r.conv_id: r for r in made.collect()}, {r.conv_id: r for r in chat.digests(made).collect()}
    want = defaultdict(list)
    for conv, turn, role, t in rows:
        want[conv].append((turn is not None, turn or 0, role or "", t or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        turns = [(role, t) for _, _, role, t in sorted(turns, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))]
        assert read_back(got[conv].output) == turns == [(x.role, x.text) for x in got[conv].turns]
        d, loss = digests[conv], "".join(t for role, t in turns if role == "assistant")
        assert (d.n_turns, d.loss_chars, d.formatted_chars) == (len(turns), len(loss), len(got[conv].output))
        assert d.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert "<|im_start|>user\nplain words<|im_end|>\n" in "".join(r.output for r in got.values())


def test_chat_of_nothing(spark):
    assert chat.digests(chat.formatted(spark.createDataFrame([], TURNS))).collect() == []
