r"""Conversations brought to the grammar `(s?(ua)+)?` by the cheapest edits.

Every row of a conversation is kept (0), given the role that the grammar wants
next (Rerole, 2), or deleted (3); rows without text may be inserted anywhere
(Insert, 2). Blank rows and repetitions of an earlier role and text must go; a
truncated row that stays costs 1 more. Of the cheapest edit sequences the one
whose initials D, I, K, R are least in ASCII order is taken.

The search is iterative-deepening A*: depth first in that order, under a bound
that grows by one until a path is accepted; a table holds for each state (rows
read, role before) the largest budget under which it failed. The first path
accepted is the answer: all paths within its bound cost the same, and they were
tried in ASCII order. The estimate ahead of a row counts the deletions and
truncated rows still to come. A long conversation is searched in stretches of
`STRETCH` rows, each against the exact costs of what follows its end, so time
grows with the rows. That gives the same path: a stretch's edits end with an
edit that reads a row, so no stretch's string begins another's.

Order and edges: rows go by turn, nulls first, rows of one turn by role, then
text. A null role or text is one space. A role's initial is its first code
point; a row whose role begins with none of s, u, a (or is empty) cannot be
kept. White space is the space and the characters 9 to 13. A null conv_id is a
conversation of its own, extra columns are ignored whatever their names, an
empty table gives no rows. A conversation is held in one task, as its repaired
turns stand in one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows that one search reads.
STRETCH = 16
SPACE = " \t\n\v\f\r"
#: Role before: none, system, user, assistant; the state after the role that the grammar wants next.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Cost of ending in each state: turns still to insert.
ENDS = (0, 2 * INSERT, INSERT, 0)
LEGAL = {"su", "ua", "au"}
#: A row as the search sees it: (must go, truncated, state after keeping it in each state or None).
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
NOT_KEPT = (None,) * 4
SCHEMA = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "turns array<struct<role:string,text:string>>")


def stretch_path(rows: list[tuple], state: int, ends: tuple) -> tuple[str, int, int]:
    """Edits of `rows` from `state`, the state after them, and the cost with what `ends` adds there."""
    m = len(rows)
    ahead = [min(ends)] * (m + 1)
    for i in range(m - 1, -1, -1):
        must, late, _ = rows[i]
        ahead[i] = ahead[i + 1] + (DELETE if must else late)
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def visit(i: int, q: int, left: int) -> int:
        """The end state of the first path that costs at most `left`; the path is then held. Else -1."""
        if left < ahead[i] or failed.get((i, q), -1) >= left:
            return -1
        if i == m:
            if ends[q] <= left:
                return q
        else:
            must, late, kept = rows[i]
            tries = [("D", i + 1, q, DELETE), ("I", i, NEXT[q], INSERT)]
            if not must:
                if kept[q] is not None:
                    tries.append(("K", i + 1, kept[q], KEEP + late))
                tries.append(("R", i + 1, NEXT[q], REROLE + late))
            for edit, j, p, cost in tries:
                path.append(edit)
                end = visit(j, p, left - cost)
                if end >= 0:
                    return end
                path.pop()
        failed[i, q] = left
        return -1

    bound = ahead[0]
    while (end := visit(0, state, bound)) < 0:
        bound += 1  # costs are whole numbers
    return "".join(path), end, bound


def costs_before(rows: list[tuple], ends: tuple) -> tuple:
    """Least cost from each state ahead of `rows`, given the costs after them."""
    for must, late, kept in reversed(rows):
        read = []
        for q in range(4):
            ways = [DELETE + ends[q]]
            if not must:
                ways.append(REROLE + late + ends[NEXT[q]])
                if kept[q] is not None:
                    ways.append(KEEP + late + ends[kept[q]])
            read.append(min(ways))
        # one or two inserted turns before the row
        ends = tuple(min(read[q], INSERT + read[NEXT[q]], 2 * INSERT + read[NEXT[NEXT[q]]]) for q in range(4))
    return ends


def cheapest(rows: list[tuple]) -> tuple[str, int]:
    """The audit string of a conversation and its cost."""
    cuts = list(range(0, len(rows), STRETCH))
    after = [ENDS]
    for at in reversed(cuts[1:]):
        after.append(costs_before(rows[at: at + STRETCH], after[-1]))
    state, audit, total = START, [], 0
    for at, ends in zip(cuts, reversed(after), strict=False):
        edits, end, cost = stretch_path(rows[at: at + STRETCH], state, ends)
        audit.append(edits)
        total += cost - ends[end]
        state = end
    audit.append("I" * (ENDS[state] // INSERT))
    return "".join(audit), total + ENDS[state]


def applied(audit: str, turns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The turns that the edits of `audit` leave and add."""
    out, rows, state = [], iter(turns), START
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = KEPT[role[:1]][state]
        else:
            state = NEXT[state]
            role = ROLES[state]
        out.append((role, text))
    return out


def repaired_one(turns: list[int | None], rows: list[tuple[str, str]]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and repaired turns of rows in order."""
    numbers = {t for t in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    seen: set[tuple[str, str]] = set()
    faults, seen_by_search = [0, 0, 0], []
    for row in rows:
        core = row[1].rstrip(SPACE)
        late = False
        if not core:
            faults[0] += 1
        elif row in seen:
            faults[1] += 1
        elif late := core[-1] not in ".!?":
            faults[2] += 1
        must = not core or row in seen
        seen.add(row)
        seen_by_search.append((must, TRUNCATED * late, KEPT.get(row[0][:1], NOT_KEPT)))
    illegal = sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    audit, cost = cheapest(seen_by_search)
    return gaps, *faults, illegal, cost, audit, applied(audit, rows)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    kinds = [*[pa.int64()] * 7, pa.string(), pa.list_(turn)]
    out, size = [], 0

    def rows_out() -> pa.RecordBatch:
        columns = [[x[i] for x in out] for i in range(8)] + [[[{"role": r, "text": t} for r, t in x[8]] for x in out]]
        return pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    conv, turns, rows = None, [], []
    for batch in batches:
        for conv_id, number, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if rows and conv_id != conv:
                out.append((conv, *repaired_one(turns, rows)))
                size += sum(len(t) for _, t in rows) + 100
                turns, rows = [], []
                if size > 1 << 23:
                    yield rows_out()
                    out, size = [], 0
            conv = conv_id
            turns.append(number)
            rows.append((role, text))
    if rows:
        out.append((conv, *repaired_one(turns, rows)))
    if out:
        yield rows_out()


def repaired(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and repaired turns of each conversation of (conv_id, turn, role, text)."""
    c.bounded_batches(rows.sparkSession)
    tidy = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    dealt = tidy.repartition(c.width(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(c.task(_repair), SCHEMA)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with seeded faults: by the crc32 of `conv_id:turn` modulo 20 a row is dropped (0), emptied (1), loses its
    sentence marks (2), is repeated (3) or speaks as the user (4). Nulls count as one space."""
    def shown(x: str) -> F.Column:
        return F.coalesce(F.col(x).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return (marked.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))
            .drop("copy"))


def audits(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """`repaired(rows)` as counts and a digest, with a row for every conv_id of `conversations`."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    found = repaired(rows).select(F.col("conv_id").alias("id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                  F.sha2(said, 256).alias("repaired_sha256"))
    ids = conversations.select("conv_id").distinct()
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(
        "conv_id", *[F.coalesce(x, none.get(x, F.lit(0).cast("long"))).alias(x) for x in found.columns[1:]])
