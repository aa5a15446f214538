import hashlib
import heapq
import random
import re
import zlib

import pytest

from tenderloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Dijkstra over (cost, audit) with the repaired rows carried along; the grammar is checked on whole strings."""
    def legal_prefix(s):
        return re.fullmatch(r"s?(ua)*u?", s) is not None

    seen, facts = set(), []
    for role, text in rows:
        core = text.strip(" \t\n\v\f\r")
        must = not core or (role, text) in seen
        facts.append((must, 0 if must else int(core[-1] not in ".!?")))
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit, list(out)
        if (i, roles[-1:]) in done:
            continue
        done.add((i, roles[-1:]))
        ways = [(2, "I", i, r[0], (r, "")) for r in ("user", "assistant")]
        if i < len(rows):
            role, text = rows[i]
            must, late = facts[i]
            ways.append((3, "D", i + 1, "", None))
            if not must:
                ways += [(2 + late, "R", i + 1, r[0], (r, text)) for r in ("user", "assistant")]
                if role[:1] in ("s", "u", "a"):
                    ways.append((late, "K", i + 1, role[0], (role, text)))
        for more, edit, j, initial, row in ways:
            if legal_prefix(roles + initial):
                heapq.heappush(heap, (cost + more, audit + edit, j, roles + initial, out + ((row,) if row else ())))
    raise AssertionError


def searched(rows):
    *_, cost, audit, out = repair.repaired_one(list(range(len(rows))), rows)
    return cost, audit, out


def random_rows(rng, n):
    texts = ["Yes.", "No!", "cut off", " ", "", "Why?\t", "and then "]
    return [(rng.choice(["user", "assistant", "system", "tool", "", " "] + ["user", "assistant"] * 3),
             rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}" + rng.choice([".", "", "?", " .  "])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(60))
def test_search_equals_brute_force(seed):
    rng = random.Random(seed)
    rows = random_rows(rng, rng.randrange(0, 9))
    assert searched(rows) == brute(rows)


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("stretch", [1, 2, 5])
def test_stretches_give_the_same_path(seed, stretch, monkeypatch):
    rng = random.Random(1000 + seed)
    rows = random_rows(rng, rng.randrange(5, 40))
    want = brute(rows)
    monkeypatch.setattr(repair, "STRETCH", stretch)
    assert searched(rows) == want


def test_known_cases():
    def go(*roles):
        return searched([(r, f"{i}.") for i, r in enumerate(roles)])[:2]

    assert go() == (0, "") and go("user", "assistant") == (0, "KK") and go("system", "user", "assistant") == (0, "KKK")
    assert go("user") == (2, "KI") and go("tool") == (3, "D")
    assert go("user", "user") == (2, "KR")
    assert go("user", "tool", "assistant") == (3, "KDK")
    assert go("assistant", "user") == (4, "IKKI")
    assert go("system") == (3, "D") and go("assistant") == (2, "IK")
    assert searched([("user", "same."), ("user", "same."), ("assistant", "ok.")])[:2] == (3, "KDK")
    assert searched([("tool", ""), ("superuser", "x.")])[:2] == (6, "DD")


def test_long_conversations_grow_with_their_rows():
    rng = random.Random(5)
    rows = random_rows(rng, 20_000)
    cost, audit, out = searched(rows)
    assert len(out) == len(audit) - audit.count("D") and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    assert cost > 0


def damage(rows):
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        if code == 0:
            continue
        row = (conv_id, turn, "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text)
        yield from [row] * (1 + (code == 3))


def expected(rows):
    kept = {}
    for r in damage(rows):
        kept.setdefault(r[0], []).append(r)
    out = []
    for conv_id in {r[0] for r in rows}:
        mine = sorted(kept.get(conv_id, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in mine if r[1] is not None]
        said = [r[2:] for r in mine]
        blank = [not t.strip(" \t\n\v\f\r") for _, t in said]
        dup = [not b and r in said[:i] for i, (r, b) in enumerate(zip(said, blank, strict=True))]
        late = [not b and not d and t.rstrip(" \t\n\v\f\r")[-1] not in ".!?" for (_, t), b, d in zip(said, blank, dup, strict=True)]
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
        cost, audit, fixed = brute(said)
        out.append((conv_id, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, sum(blank), sum(dup), sum(late), illegal, cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_whole_job_with_nulls_ties_and_repeats(spark):
    rng = random.Random(9)
    rows = []
    for conv_id in [*range(120), None, -7]:
        for turn, (role, text) in enumerate(random_rows(rng, rng.randrange(1, 10))):
            rows.append((conv_id, None if rng.random() < 0.1 else turn + (rng.random() < 0.2), None if rng.random() < 0.1 else role, None if rng.random() < 0.1 else text))
    rows += rows[:30]  # repeated rows
    rows += [(500, 0, "user", "x" * 300_000), (500, 1, "assistant", "Ünïcode. "), (501, -(2**40), "user", "a."), (501, 2**40, "assistant", "b.")]
    rows += [(i, 0, "user", "lost.") for i in range(600, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0]  # they lose their only row
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, repair.audits(repair.damaged(table), table).collect()), key=repr)
    assert got == expected(rows)
    assert any(r[7] == "" and r[6] == 0 for r in got)


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.audits(repair.damaged(empty), empty).collect() == []
    extra = ", ".join(f"{x} string" for x in ("code", "copy", "id", "audit", "turns", "cost"))
    rows = [(1, 1, "user", "a.", *"abcdef"), (1, 2, "assistant", "b.", *"abcdef")]
    table = spark.createDataFrame(rows, f"{SCHEMA}, {extra}")
    got = sorted(map(tuple, repair.audits(repair.damaged(table), table).collect()))
    assert got == expected([r[:4] for r in rows])


def test_turns_are_the_operators_output(spark):
    table = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "tool", "ok")], SCHEMA)
    row = repair.repaired(table).first()
    assert (row.audit, row.cost) == ("KR", 3) and [tuple(t) for t in row.turns] == [("user", "Hi."), ("assistant", "ok")]
